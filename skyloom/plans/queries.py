"""One query for each operator on the driver's tables, with the SQL that gives the same rows.

events is the time series (record event_id, time ts, variable value), embeddings
holds an array variable, lineitem and orders are wide numeric files, nation and
region are variables that do not vary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import arrays as A
from skyloom.functions import time as T
from skyloom.functions import values as V
from skyloom.operators import filters as Fl
from skyloom.operators import merge as M
from skyloom.operators import meta as Mt
from skyloom.operators import records as R
from skyloom.operators import stats as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(table: str, sql: str | None):
    """Registers a function of one table's DataFrame (several names: of several) under its own name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in table.split()))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


MS = "(epoch_us(ts) // 1000 + 62167219200000)"
TT = "((epoch_us(ts) - 946728000000000) * 1000 + 32184000000 + 37000000000)"


@query("events", "SELECT user_id, count(*) FILTER (WHERE value IS NOT NULL)::BIGINT AS n_values, min(value) FILTER (WHERE value BETWEEN 1 AND 200) AS min_value, max(value) FILTER (WHERE value BETWEEN 1 AND 200) AS max_value, count(*) FILTER (WHERE value < 1)::BIGINT AS n_low, count(*) FILTER (WHERE value > 200)::BIGINT AS n_high FROM events GROUP BY user_id")
def stats_by_user(events):
    return S.value_stats(events, "value", ["user_id"], low=1.0, high=200.0).select("user_id", "n_values", "min_value", "max_value", "n_low", "n_high")


MONO = """
WITH p AS (SELECT {by}, {v} AS v, lag({v}) OVER (PARTITION BY {by} ORDER BY {o}) AS p FROM {t} WHERE {v} IS NOT NULL),
c AS (SELECT {by}, count(*)::BIGINT AS n, count(*) FILTER (WHERE v > p)::BIGINT AS up, count(*) FILTER (WHERE v < p)::BIGINT AS down, count(*) FILTER (WHERE v = p)::BIGINT AS same FROM p GROUP BY {by})
SELECT *, CASE WHEN n = 1 THEN 'Steady (one value)' WHEN up = 0 AND down = 0 THEN 'Steady (all values the same)' WHEN down = 0 AND same = 0 THEN 'Increase' WHEN up = 0 AND same = 0 THEN 'Decrease' WHEN down = 0 THEN 'noDecrease' WHEN up = 0 THEN 'noIncrease' ELSE 'False' END AS monoton FROM c"""


@query("events", MONO.format(by="user_id", v="value", o="event_id", t="events"))
def monotonic_per_user(events):
    return S.monotonicity(events, "value", "event_id", ["user_id"])


@query("orders", MONO.format(by="o_custkey", v="o_totalprice", o="o_orderkey", t="orders"))
def monotonic_per_customer(orders):
    return S.monotonicity(orders, "o_totalprice", "o_orderkey", ["o_custkey"])


@query("events", MONO.format(by="one", v="value", o="event_id", t="(SELECT 1 AS one, * FROM events)").replace("SELECT *, CASE", "SELECT n, up, down, same, CASE"))
def monotonic_whole(events):
    return S.monotonicity_whole(events, "value", "event_id")


@query("orders", """
WITH p AS (SELECT o_custkey, o_totalprice AS v, lag(o_totalprice) OVER w AS p, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
c AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE v > p) AS up, count(*) FILTER (WHERE v < p) AS down, coalesce(bool_or(k = 2 AND v = p), false) AS tied FROM p GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n < 2 OR tied OR (up > 0 AND down > 0) THEN 'False' WHEN up > 0 THEN 'Increase' ELSE 'Decrease' END AS monoton FROM c""")
def monotonic_export(orders):
    return S.monotonicity_export(orders, "o_totalprice", "o_orderkey", ["o_custkey"])


@query("lineitem", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity <> 1)::BIGINT AS n_values, min(l_quantity) FILTER (WHERE l_quantity <> 1) AS min_value, max(l_quantity) FILTER (WHERE l_quantity <> 1) AS max_value, count(*) FILTER (WHERE l_quantity = 1)::BIGINT AS n_fill FROM lineitem GROUP BY l_returnflag")
def minmax_without_fill(lineitem):
    return S.value_stats(lineitem, "l_quantity", ["l_returnflag"], fill=1.0).select("l_returnflag", "n_values", "min_value", "max_value", "n_fill")


@query("lineitem", "SELECT count(*) FILTER (WHERE l_discount < 0.02)::BIGINT AS n_low, count(*) FILTER (WHERE l_discount > 0.08)::BIGINT AS n_high, min(l_discount) FILTER (WHERE l_discount BETWEEN 0.02 AND 0.08) AS min_value, max(l_discount) FILTER (WHERE l_discount BETWEEN 0.02 AND 0.08) AS max_value FROM lineitem")
def out_of_range_counts(lineitem):
    return S.value_stats(lineitem, "l_discount", low=0.02, high=0.08).select("n_low", "n_high", "min_value", "max_value")


@query("events", f"SELECT event_id, {MS}::DOUBLE AS epoch FROM events")
def epoch_encode(events):
    return events.select("event_id", T.epoch_of(F.col("ts")).alias("epoch"))


@query("events", "SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS t FROM events")
def epoch_decode(events):
    return events.select("event_id", T.epoch_to_timestamp(T.epoch_of(F.col("ts"))).alias("t"))


@query("events", "SELECT event_id, strftime(ts, '%d-%b-%Y %H:%M:%S.%g') AS s0, strftime(ts, '%Y%m%d%H%M%S') AS s2, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS s3, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS s4 FROM events")
def epoch_strings(events):
    e = T.epoch_of(F.col("ts"))
    return events.select("event_id", *(T.encode_epoch(e, s).alias(f"s{s}") for s in (0, 2, 3, 4)))


@query("events", "SELECT event_id, strftime(ts, '%Y%m%d') || '.' || lpad(least(9999999, (epoch_us(ts) // 1000 % 86400000 * 10000000 * 2 + 86400000) // 172800000)::VARCHAR, 7, '0') AS s1 FROM events")
def epoch_day_fraction(events):
    return events.select("event_id", T.encode_epoch(T.epoch_of(F.col("ts")), 1).alias("s1"))


@query("events", "SELECT event_id, strftime(ts, '%j') || '/' || strftime(ts, '%Y') || ' ' || strftime(ts, '%H:%M:%S') || '.' || strftime(ts, '%g') || ' ' || strftime(ts, '%b') || ' <' AS s FROM events")
def epoch_template(events):
    return events.select("event_id", T.encode_epoch_template(T.epoch_of(F.col("ts")), "<doy>/<year> <hour>:<min>:<sec>.<fos> <month> <<").alias("s"))


@query("events", "SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, (epoch_us(ts) // 1000 % 1000)::INT AS msec FROM events")
def epoch_breakdown(events):
    return events.select("event_id", T.epoch_breakdown(T.epoch_of(F.col("ts"))).alias("p")).select("event_id", *(f"p.{c}" for c in ("year", "month", "day", "hour", "minute", "second", "msec")))


@query("events", f"SELECT event_id, {MS}::DOUBLE AS epoch FROM events")
def epoch_compute(events):
    p = events.select("event_id", T.parts_of(F.col("ts")).alias("p"))
    return p.select("event_id", T.compute_epoch(*(F.col(f"p.{c}") for c in ("year", "month", "day", "hour", "minute", "second", "msec"))).alias("epoch"))


@query("events", f"SELECT event_id, {MS}::DOUBLE AS e0, {MS}::DOUBLE AS e4, -1.0::DOUBLE AS bad FROM events")
def epoch_parse(events):
    e = T.epoch_of(F.col("ts"))
    return events.select("event_id", T.parse_epoch(T.encode_epoch(e, 0), 0).alias("e0"), T.parse_epoch(T.encode_epoch(e, 4), 4).alias("e4"), T.parse_epoch(F.lit("no time"), 0).alias("bad"))


@query("events", "SELECT event_id, (epoch_us(ts) // 1000000 + 62167219200)::DOUBLE AS sec, (epoch_us(ts) % 1000000 * 1000000)::DOUBLE AS psec, ts AS back FROM events")
def epoch16_split(events):
    e = events.select("event_id", T.epoch16_of(F.col("ts")).alias("e"))
    return e.select("event_id", "e.sec", "e.psec", T.epoch16_to_timestamp(F.col("e")).alias("back"))


@query("events", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') || '000000' AS s4 FROM events")
def epoch16_string(events):
    return events.select("event_id", T.encode_epoch16(T.epoch16_of(F.col("ts")), 4).alias("s4"))


@query("events", f"SELECT event_id, {TT} AS tt FROM events")
def tt2000_encode(events):
    return events.select("event_id", T.tt2000_of(F.col("ts")).alias("tt"))


@query("events", "SELECT event_id, ts AS t, false AS leap FROM events")
def tt2000_decode(events):
    tt = events.select("event_id", T.tt2000_of(F.col("ts")).alias("tt"))
    return tt.select("event_id", T.tt2000_to_timestamp(F.col("tt")).alias("t"), T.in_leap_second(F.col("tt")).alias("leap"))


@query("events", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') || '000' AS s3, strftime(ts, '%Y%m%d%H%M%S') AS s2 FROM events")
def tt2000_strings(events):
    tt = T.tt2000_of(F.col("ts"))
    return events.select("event_id", T.encode_tt2000(tt, 3).alias("s3"), T.encode_tt2000(tt, 2).alias("s2"))


@query("events", f"SELECT event_id, {TT} AS tt, {MS}::DOUBLE AS epoch, {TT} - (epoch_us(ts) % 1000) * 1000 AS back FROM events")
def tt2000_convert(events):
    tt = T.tt2000_of(F.col("ts"))
    return events.select("event_id", T.parse_tt2000(T.encode_tt2000(tt, 3)).alias("tt"), T.tt2000_to_epoch(tt).alias("epoch"), T.epoch_to_tt2000(T.epoch_of(F.col("ts"))).alias("back"))


@query("events", "SELECT event_id, julian(ts::DATE)::BIGINT AS jd FROM events")
def julian_days(events):
    return events.select("event_id", T.julian_day(F.col("ts")).alias("jd"))


@query("events", f"SELECT event_id, 63871200000000.0::DOUBLE + value * 60000.0 AS t22, CASE WHEN value - 20 > 0 THEN 63871200000000.0::DOUBLE + (value - 20) * 1000.0 ELSE -1e31::DOUBLE END AS t23 FROM events")
def virtual_epochs(events):
    base = F.lit(63_871_200_000_000.0)
    return events.select("event_id", T.virtual_epoch(base, F.col("value"), "Minutes").alias("t22"), T.virtual_epoch_export(base, F.col("value") - 20).alias("t23"))


@query("events", "SELECT * FROM (VALUES (42::BIGINT, DATE '2017-01-01')) t(n_rows, last_date)")
def leap_table(events):
    return T.leap_table_info(events.sparkSession)


@query("events", "SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def epoch_range(events):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return Fl.epoch_range(events, "ts", t("2024-01-05"), t("2024-01-12")).select("event_id", "ts", "value")


@query("events", "SELECT event_id, value FROM events WHERE event_id >= 100 AND event_id <= 499")
def record_range(events):
    return Fl.record_range(events, "event_id", 100, 499).select("event_id", "value")


@query("events", "SELECT event_id, value FROM events WHERE event_id >= 7 AND event_id < 7 + 50 * 10 AND (event_id - 7) % 10 = 0")
def record_stride(events):
    return Fl.record_stride(events, "event_id", 7, 50, 10).select("event_id", "value")


LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem WHERE ((l_quantity >= 10 AND l_quantity <= 20) OR l_quantity = 1) AND l_discount > 0.02 AND l_discount < 0.07")
def scalar_filters(lineitem):
    ranges = {"l_quantity": Fl.Range(10.0, 20.0, fill=1.0), "l_discount": Fl.Range(0.02, 0.07, inclusive=False)}
    return Fl.where_in_range(lineitem, ranges).select(*LINE)


@query("lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.02 AND l_discount <= 0.07 THEN l_quantity ELSE -1 END AS l_quantity, CASE WHEN l_discount >= 0.02 AND l_discount <= 0.07 THEN l_discount ELSE -1 END AS l_discount, CASE WHEN l_discount >= 0.02 AND l_discount <= 0.07 THEN l_tax ELSE -1 END AS l_tax FROM lineitem")
def group_mask(lineitem):
    return Fl.group_mask(lineitem, {"l_discount": Fl.Range(0.02, 0.07)}, {"l_quantity": -1.0, "l_discount": -1.0, "l_tax": -1.0}).select(*LINE)


@query("embeddings", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x >= -0.1 AND x <= 0.1 THEN x ELSE -999.0 END) AS masked FROM embeddings")
def array_mask(embeddings):
    return embeddings.select("vec_id", A.masked(F.col("embedding").cast("array<double>"), -0.1, 0.1, pad=-999.0).alias("masked"))


@query("embeddings", "SELECT vec_id, embedding[5:8] AS part, [embedding[1], embedding[9], embedding[17]] AS strided FROM embeddings")
def array_slices(embeddings):
    return embeddings.select("vec_id", A.index_between(F.col("embedding"), 4, 7).alias("part"), A.hyper(F.col("embedding"), 0, 3, 8).alias("strided"))


@query("embeddings", "SELECT vec_id, (i - 1)::INT AS index, embedding[i] AS value FROM embeddings, generate_series(1, 64) g(i)")
def array_enumerated(embeddings):
    return Mt.enumerated(embeddings, "vec_id", "embedding")


@query("embeddings", "SELECT vec_id, embedding[1] AS embedding, embedding[2] AS embedding_0, embedding[63] AS embedding_61, embedding[64] AS embedding_end FROM embeddings")
def array_flattened(embeddings):
    flat = embeddings.select("vec_id", *A.flattened("embedding", 64))
    return flat.select("vec_id", "embedding", "embedding_0", "embedding_61", "embedding_end")


@query("events", "SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE value END AS value FROM events")
def quality_flag(events):
    flag = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return events.select("event_id", Fl.flagged(F.col("value"), flag, -1.0).alias("value"))


@query("events", "WITH h AS (SELECT user_id % 4 AS g, event_id - row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS island, event_id FROM events WHERE value > 20) SELECT g, min(event_id) AS first_rec, max(event_id) AS last_rec, count(*)::BIGINT AS n_recs FROM h GROUP BY g, island")
def passing_runs(events):
    return Fl.passing_runs(events.withColumn("g", F.col("user_id") % 4), "event_id", F.col("value") > 20, ["g"])


@query("events", "SELECT event_id, value FROM events WHERE value > 100 ORDER BY event_id LIMIT 1")
def first_match(events):
    return Fl.first_match(events.select("event_id", "value"), "event_id", F.col("value") > 100)


GAPS = """
WITH kept AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rec, value FROM events),
part AS (SELECT * FROM kept WHERE rec % 3 <> 1),
grid AS (SELECT user_id, unnest(generate_series(0, max(rec))) AS rec FROM part GROUP BY user_id),
j AS (SELECT g.user_id, g.rec, s.value, s.rec IS NOT NULL AS real FROM grid g LEFT JOIN part s ON g.user_id = s.user_id AND g.rec = s.rec)
SELECT user_id, rec::BIGINT AS rec, {value} AS value FROM j"""


def gappy(events):
    return R.renumbered(events.select("user_id", F.col("event_id").alias("rec"), "value"), "rec", ["user_id"]).where(F.col("rec") % 3 != 1)


@query("events", GAPS.format(value="CASE WHEN real THEN value ELSE -1e30 END"))
def sparse_pad(events):
    return R.completed(gappy(events), "rec", ["user_id"], {"value": -1e30})


@query("events", GAPS.format(value="coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rec ROWS UNBOUNDED PRECEDING), -1e30)"))
def sparse_prev(events):
    return R.completed(gappy(events), "rec", ["user_id"], {"value": -1e30}, "prev")


@query("lineitem", "SELECT l_orderkey, l_linenumber, ((l_partkey % 256))::SMALLINT AS u1, (l_partkey * 40 % 65536)::INT AS u2 FROM lineitem")
def unsigned_values(lineitem):
    signed = lineitem.select("l_orderkey", "l_linenumber", V.wrapped(F.col("l_partkey"), 8).alias("a"), V.wrapped(F.col("l_partkey") * 40, 16).alias("b"))
    return signed.select("l_orderkey", "l_linenumber", V.unsigned(F.col("a"), 8).alias("u1"), V.unsigned(F.col("b"), 16).alias("u2"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::INT AS i4, (((trunc(l_extendedprice)::BIGINT % 65536) + 32768) % 65536 - 32768)::SMALLINT AS i2, l_extendedprice::FLOAT AS r4 FROM lineitem")
def type_conversion(lineitem):
    p = F.col("l_extendedprice")
    return lineitem.select("l_orderkey", "l_linenumber", V.converted(p, "INT4").alias("i4"), V.converted(p, "INT2").alias("i2"), V.converted(p, "REAL4").alias("r4"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, printf('%8.2f', l_tax) AS f, CASE WHEN length(printf('%2d', l_partkey)) > 2 THEN '**' ELSE printf('%2d', l_partkey) END AS i FROM lineitem")
def formatted_values(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", V.formatted(F.col("l_tax"), "F8.2").alias("f"), V.formatted(F.col("l_partkey"), "I2").alias("i"))


@query("lineitem", """
WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_quantity, l_extendedprice, l_shipdate) AS i FROM lineitem) WHERE i = 1),
d AS (SELECT l_quantity AS a, l_quantity + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS b, l_tax AS c, l_tax * CASE WHEN l_suppkey % 3 = 0 THEN 1.1 ELSE 1 END AS e FROM k)
SELECT 'l_quantity' AS variable, count(*)::BIGINT AS n_compared, count(*) FILTER (WHERE abs(a - b) > 0.5)::BIGINT AS n_values FROM d
UNION ALL SELECT 'l_tax', count(*)::BIGINT, count(*) FILTER (WHERE abs(c - e) > 0.01 * greatest(abs(c), abs(e)))::BIGINT FROM d""")
def tolerance_compare(lineitem):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    one = lineitem.groupBy(*keys).agg(F.min(F.struct("l_quantity", "l_extendedprice", "l_shipdate", "l_tax")).alias("x")).select(*keys, "x.l_quantity", "x.l_tax")
    other = one.withColumns({"l_quantity": F.col("l_quantity") + F.when(F.col("l_partkey") % 10 == 0, 1.0).otherwise(0.0), "l_tax": F.col("l_tax") * F.when(F.col("l_suppkey") % 3 == 0, 1.1).otherwise(1.0)})
    return M.compare_values(one, other, keys, {"l_quantity": 0.5, "l_tax": -0.01}).drop("n_records")


@query("customer orders", "SELECT coalesce(a, b) AS key, CASE WHEN b IS NULL THEN 'first' WHEN a IS NULL THEN 'second' ELSE 'both' END AS found FROM (SELECT DISTINCT c_custkey AS a FROM customer) x FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders) y ON a = b")
def name_match(customer, orders):
    return M.match_names(customer.select(F.col("c_custkey").alias("key")), orders.select(F.col("o_custkey").alias("key")), "key")


@query("orders region", "SELECT o_orderkey, o_totalprice, r_name FROM orders, region WHERE r_regionkey = 2")
def constant_variables(orders, region):
    return R.with_constants(orders.select("o_orderkey", "o_totalprice"), region.where("r_regionkey = 2").select("r_name"))


@query("nation region", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def depend_lookup(nation, region):
    attributes = nation.select("n_nationkey", "n_name", F.lit("DEPEND_0").alias("attribute"), F.col("n_regionkey").alias("value"))
    return Mt.follow_pointer(attributes, "DEPEND_0", region, "r_regionkey").select("n_nationkey", "n_name", "r_name")


@query("orders", "SELECT (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS rec, o_orderdate, o_totalprice FROM orders")
def sort_records(orders):
    return R.sort_records(orders.select(F.col("o_orderkey").alias("rec"), "o_orderdate", "o_totalprice"), "o_orderdate", "rec")


@query("events", "SELECT event_id, value FROM events WHERE event_id < 400 UNION ALL SELECT event_id - 300 + 400, value FROM events WHERE event_id >= 300")
def merge_append(events):
    a = events.where("event_id < 400").select(F.col("event_id"), "value")
    b = events.where("event_id >= 300").select((F.col("event_id") - 300).alias("event_id"), "value")
    return M.append_records([a, b], "event_id")


@query("events", "SELECT coalesce(a.event_id, b.event_id) AS event_id, a.value AS file1_value, b.value AS second_value FROM (SELECT * FROM events WHERE coalesce(event_type, '') <> 'error') a FULL JOIN (SELECT * FROM events WHERE coalesce(event_type, '') <> 'view') b ON a.event_id = b.event_id")
def merge_prefixed(events):
    """Two files that together hold all events, each without one type."""
    part = lambda kind: events.where(F.coalesce("event_type", F.lit("")) != kind).select("event_id", "value")
    return M.prefixed([part("error"), part("view")], "event_id", ["file1", "second"])


@query("events", "SELECT CASE WHEN event_id >= 50 THEN event_id + 10 ELSE event_id END AS event_id, value FROM events UNION ALL SELECT event_id + 50, -value FROM events WHERE event_id < 10")
def record_insert(events):
    base = events.select("event_id", "value")
    return R.insert_records(base, base.where("event_id < 10").withColumn("value", -F.col("value")), "event_id", 50)


@query("events", "SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS event_id, value FROM events WHERE event_id NOT BETWEEN 100 AND 199")
def record_delete(events):
    return R.delete_records(events.select("event_id", "value"), "event_id", 100, 199)


@query("events", "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS event_id, value FROM events WHERE value < 50")
def record_renumber(events):
    return R.renumbered(events.where("value < 50").select("user_id", "event_id", "value"), "event_id", ["user_id"])


@query("events", "SELECT event_type, min(ts) AS first_time, max(ts) AS last_time FROM events GROUP BY event_type")
def range_epoch(events):
    return M.range_of_times(events, "ts", ["event_type"])


@query("documents", "SELECT doc_id AS variable, min(lang) AS lang, min(source) AS source FROM documents GROUP BY doc_id")
def attribute_pivot(documents):
    long = documents.select(F.col("doc_id").alias("variable"), F.explode(F.array(F.struct(F.lit("lang").alias("attribute"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("attribute"), F.col("source").alias("value")))).alias("x")).select("variable", "x.*")
    return Mt.attribute_pivot(long, "variable", "attribute", "value", ["lang", "source"])


@query("documents", "SELECT doc_id, lang FROM documents WHERE coalesce(lang, '') <> 'en' UNION ALL SELECT doc_id, 'second' FROM documents WHERE coalesce(lang, '') = 'en'")
def attribute_merge(documents):
    """Entries of the documents in other languages than English win over those that a second file has for all."""
    first = documents.where("coalesce(lang, '') <> 'en'").select("doc_id", "lang")
    return M.merge_attributes(first, documents.select("doc_id", F.lit("second").alias("lang")), ["doc_id"])


@query("part", "SELECT p_partkey, rtrim(p_name) = rtrim(p_name || '   ') AS same, p_name ILIKE '%WIDGET' AS hit FROM part")
def padded_text(part):
    n = F.col("p_name")
    return part.select("p_partkey", V.padded_equal(n, F.concat(n, F.lit(" \x00 "))).alias("same"), V.name_like(n, "*WIDGET").alias("hit"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'ROW' WHEN 2 THEN 'COLUMN' ELSE '?' END AS majority, CASE l_linenumber WHEN 1 THEN 'RLE' WHEN 2 THEN 'HUFF' WHEN 3 THEN 'AHUFF' WHEN 5 THEN 'GZIP' ELSE '?' END AS compression FROM lineitem")
def token_names(lineitem):
    c = F.col("l_linenumber")
    return lineitem.select("l_orderkey", "l_linenumber", V.token(c, "majority").alias("majority"), V.token(c, "compression").alias("compression"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem) UNPIVOT (value FOR variable IN (l_returnflag, l_linestatus))")
def vertical_layout(lineitem):
    keyed = lineitem.withColumn("rec", F.struct("l_orderkey", "l_linenumber"))
    return Mt.vertical(keyed, "rec", ["l_returnflag", "l_linestatus"]).select("rec.*", "variable", "value")


@query("events", "SELECT event_type, v.attribute, v.value FROM (SELECT event_type, min(value) AS a, max(value) AS b FROM events GROUP BY event_type), LATERAL (VALUES ('VALIDMIN', a), ('VALIDMAX', b), ('SCALEMIN', a), ('SCALEMAX', b)) v(attribute, value)")
def attribute_updates(events):
    kinds = S.value_stats(events, "value", ["event_type"])
    updates = S.attribute_updates(kinds, F.col("event_type"))
    return updates.select(F.col("variable").alias("event_type"), "attribute", F.col("value").cast("double").alias("value"))


@query("events", "SELECT ts AS Epoch, event_id, user_id, value FROM events")
def time_series(events):
    return Mt.time_series(events.select("event_id", F.col("ts").alias("EPOCH"), "user_id", "value"))


from skyloom.plans import codes, files  # noqa: E402, F401  registers their queries
