"""Queries of time codes, value codes and metadata rules, with their SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from skyloom.functions import time as T
from skyloom.functions import values as V
from skyloom.operators import filters as Fl
from skyloom.operators import merge as M
from skyloom.operators import meta as Mt
from skyloom.operators import stats as S
from skyloom.plans.queries import MONO, MS, TT, query

SEC = "(epoch_us(ts) // 1000000 + 62167219200)"
PSEC = "(epoch_us(ts) % 1000000 * 1000000)"
#: Digits that the events' times do not have are taken from their numbers.
FINE = f"({PSEC} + event_id % 1000000)"


def fine(events):
    """The events with an epoch16 down to the picosecond."""
    e = T.epoch16_of(F.col("ts"))
    return events.select("event_id", "ts", F.struct(e["sec"].alias("sec"), (e["psec"] + F.col("event_id") % 1_000_000).alias("psec")).alias("e"))


@query("events", f"SELECT event_id, strftime(ts, '%Y%m%d') || '.' || lpad((((({SEC} % 86400)::HUGEINT * 1000000000000 + {FINE}) * 1000000000000000 * 2 + 86400000000000000) // 172800000000000000)::VARCHAR, 15, '0') AS s1, strftime(ts, '%Y%m%d%H%M%S') AS s2 FROM events")
def epoch16_day_fraction(events):
    return fine(events).select("event_id", T.encode_epoch16(F.col("e"), 1).alias("s1"), T.encode_epoch16(F.col("e"), 2).alias("s2"))


@query("events", f"SELECT event_id, {SEC}::DOUBLE AS sec, {FINE}::DOUBLE AS psec, {SEC}::DOUBLE + 1 AS rolled, -1.0::DOUBLE AS bad FROM events")
def epoch16_compute(events):
    x = fine(events).select("event_id", T.epoch16_breakdown(F.col("e")).alias("p"))
    parts = [F.col(f"p.{c}") for c in ("year", "month", "day", "hour", "minute", "second", "msec", "usec", "nsec", "psec")]
    later = [*parts[:6], parts[6] + 1000, *parts[7:]]
    found = x.select("event_id", T.compute_epoch16(*parts).alias("a"), T.compute_epoch16(*later).alias("b"), T.compute_epoch16(-parts[0], *parts[1:]).alias("c"))
    return found.select("event_id", "a.sec", "a.psec", F.col("b.sec").alias("rolled"), F.col("c.sec").alias("bad"))


@query("events", f"SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, ({FINE} // 1000000000)::INT AS msec, ({FINE} // 1000000 % 1000)::INT AS usec, ({FINE} // 1000 % 1000)::INT AS nsec, ({FINE} % 1000)::INT AS psec FROM events")
def epoch16_breakdown(events):
    return fine(events).select("event_id", T.epoch16_breakdown(F.col("e")).alias("p")).select("event_id", "p.*")


@query("events", f"SELECT event_id, strftime(ts, '%j') || ' ' || strftime(ts, '%H:%M:%S') || ' ' || lpad(({FINE} // 1000000000)::VARCHAR, 3, '0') || '.' || lpad(({FINE} // 1000000 % 1000)::VARCHAR, 3, '0') || '.' || lpad(({FINE} // 1000 % 1000)::VARCHAR, 3, '0') || '.' || lpad(({FINE} % 1000)::VARCHAR, 3, '0') || ' ' || lpad({FINE}::VARCHAR, 12, '0') || ' ?' AS s FROM events")
def epoch16_template(events):
    return fine(events).select("event_id", T.encode_epoch16_template(F.col("e"), "<doy> <hour>:<min>:<sec> <msc>.<usc>.<nsc>.<psc> <fos> <none>").alias("s"))


@query("events", f"SELECT event_id, {SEC}::DOUBLE AS sec, {FINE}::DOUBLE AS p0, 0.0::DOUBLE AS p2, {FINE}::DOUBLE AS p3, {FINE}::DOUBLE AS p4, -1.0::DOUBLE AS bad FROM events")
def epoch16_parse(events):
    x = fine(events).select("event_id", *(T.parse_epoch16(T.encode_epoch16(F.col("e"), k), k).alias(f"e{k}") for k in (0, 2, 3, 4)), T.parse_epoch16(F.lit("no time"), 4).alias("x"))
    return x.select("event_id", "e0.sec", *(F.col(f"e{k}.psec").alias(f"p{k}") for k in (0, 2, 3, 4)), F.col("x.sec").alias("bad"))


@query("events", f"SELECT event_id, {SEC}::DOUBLE AS sec, {PSEC}::DOUBLE AS psec, {TT} AS back FROM events")
def tt2000_epoch16(events):
    x = events.select("event_id", T.tt2000_of(F.col("ts")).alias("tt")).select("event_id", T.tt2000_to_epoch16(F.col("tt")).alias("e"))
    return x.select("event_id", "e.sec", "e.psec", T.epoch16_to_tt2000(F.col("e")).alias("back"))


@query("events", f"SELECT event_id, {TT} + event_id % 1000 AS tt, {TT} // 1000000000 * 1000000000 + 86400000000000 + 1000000000 * CASE WHEN {TT} % 1000000000 >= 184000000 THEN 0 ELSE -1 END + 184000000 AS rolled, -9223372036854775805::BIGINT AS bad FROM events")
def tt2000_compute(events):
    x = events.select("event_id", T.parts_of(F.col("ts")).alias("p"))
    p = [F.col(f"p.{c}") for c in ("year", "month", "day", "hour", "minute", "second", "msec", "usec")]
    return x.select("event_id", T.compute_tt2000(*p, F.col("event_id") % 1000).alias("tt"), T.compute_tt2000(*p[:2], p[2] + 1, *p[3:6]).alias("rolled"), T.compute_tt2000(p[0], p[1], p[2], p[3] - 100).alias("bad"))


@query("events", "SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second, (epoch_us(ts) // 1000 % 1000)::INT AS msec, (epoch_us(ts) % 1000)::INT AS usec, 0::INT AS nsec FROM events")
def tt2000_breakdown(events):
    return events.select("event_id", T.tt2000_of(F.col("ts")).alias("tt")).select("event_id", T.tt2000_breakdown(F.col("tt")).alias("p")).select("event_id", "p.*")


@query("events", f"SELECT event_id, {TT} AS t0, {TT} - epoch_us(ts) % 1000000 * 1000 AS t2, {TT} AS t3, abs({TT} - ({TT} - epoch_us(ts) % 86400000000 * 1000 + floor((epoch_us(ts) % 86400000000 * 1000)::HUGEINT * 10000000000 / 86400000000000)::HUGEINT * 86400000000000 // 10000000000)) < 10000 AS near1, -9223372036854775805::BIGINT AS bad FROM events")
def tt2000_parse(events):
    x = events.select("event_id", T.tt2000_of(F.col("ts")).alias("tt"))
    back = x.select("event_id", "tt", *(T.parse_tt2000(T.encode_tt2000(F.col("tt"), k)).alias(f"t{k}") for k in (0, 1, 2, 3)), T.parse_tt2000(F.lit("no time")).alias("bad"))
    return back.select("event_id", "t0", "t2", "t3", (F.abs(F.col("t1") - F.col("tt")) < 10_000).alias("near1"), "bad")


#: Leap seconds of the orders' years.
LEAPS = "CASE WHEN d >= DATE '2006-01-01' THEN 33 WHEN d >= DATE '1999-01-01' THEN 32 WHEN d >= DATE '1997-07-01' THEN 31 WHEN d >= DATE '1996-01-01' THEN 30 WHEN d >= DATE '1994-07-01' THEN 29 WHEN d >= DATE '1993-07-01' THEN 28 WHEN d >= DATE '1992-07-01' THEN 27 WHEN d >= DATE '1991-01-01' THEN 26 ELSE 25 END"


@query("orders", f"SELECT o_orderkey, {LEAPS}::DOUBLE AS leap, (epoch_us(d::TIMESTAMP) - 946728000000000) * 1000 + 32184000000 + {LEAPS}::BIGINT * 1000000000 AS tt, d::TIMESTAMP AS back FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def leap_seconds_by_date(orders):
    x = orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("t"))
    x = x.select("o_orderkey", T.leap_seconds(F.col("t")).alias("leap"), T.tt2000_of(F.col("t")).alias("tt"))
    return x.withColumn("back", T.tt2000_to_timestamp(F.col("tt")))


def drift(s: float, base: int, rate: float) -> str:
    return f"{s}::DOUBLE + (date_diff('day', DATE '1858-11-17', d) + 0.5::DOUBLE - {base}) * {rate}::DOUBLE"


@query("orders", f"SELECT o_orderkey, CASE WHEN d >= DATE '1968-02-01' THEN {drift(4.21317, 39126, 0.002592)} WHEN d >= DATE '1966-01-01' THEN {drift(4.31317, 39126, 0.002592)} WHEN d >= DATE '1965-09-01' THEN {drift(3.84013, 38761, 0.001296)} WHEN d >= DATE '1965-07-01' THEN {drift(3.74013, 38761, 0.001296)} WHEN d >= DATE '1965-03-01' THEN {drift(3.64013, 38761, 0.001296)} WHEN d >= DATE '1965-01-01' THEN {drift(3.54013, 38761, 0.001296)} ELSE {drift(3.44013, 38761, 0.001296)} END AS leap FROM (SELECT o_orderkey, DATE '1964-09-01' + (o_orderkey % 2500)::INT AS d FROM orders)")
def leap_seconds_with_drift(orders):
    day = F.date_add(F.lit("1964-09-01").cast("date"), (F.col("o_orderkey") % 2500).cast("int"))
    return orders.select("o_orderkey", day.cast("timestamp_ntz").alias("t")).select("o_orderkey", T.leap_seconds(F.col("t")).alias("leap"))


@query("events", f"SELECT event_id, {TT} AS right_, {TT} - 1000000000 AS older, {TT} AS adjusted FROM events")
def tt2000_rebase(events):
    x = events.select("event_id", T.tt2000_of(F.col("ts")).alias("tt"))
    start = T.tt2000_of(F.lit("2017-01-01").cast("timestamp_ntz"))
    x = x.select("event_id", T.tt2000_rebase(F.col("tt") - 1_000_000_000, 27).alias("right_"), T.tt2000_rebase(F.col("tt"), 27, to_older=True).alias("older"), (F.col("tt") - 1_000_000_000).alias("adjusted"), (F.col("event_id") % 8).alias("g"))
    return T.adjusted_series(x, "adjusted", "event_id", start, ["g"]).drop("g")


@query("lineitem", "SELECT l_orderkey, l_linenumber, ((x % 18446744073709551616 + 18446744073709551616 + 9223372036854775808) % 18446744073709551616 - 9223372036854775808)::BIGINT AS i8, l_partkey * 9007199254740 AS big FROM (SELECT *, (l_partkey::HUGEINT * 1000 + l_suppkey) * 9007199254740993 AS x FROM lineitem)")
def int8_conversion(lineitem):
    """Products of keys of any size, wrapped to 64 bits; from a key of 1,024,001 on the SQL's product for big overflows, and SQL has no rows."""
    key, digits = F.col("l_partkey").cast("decimal(19,0)"), lambda n: F.lit(Decimal(n)).cast(f"decimal({len(str(n))},0)")
    x = (key * 1000 + F.col("l_suppkey")).cast("decimal(22,0)") * digits(9007199254740993)
    return lineitem.select("l_orderkey", "l_linenumber", V.converted(x.cast("decimal(38,0)"), "INT8").alias("i8"), V.converted(key * digits(9007199254740), "INT8").alias("big"))


@query("part", "SELECT p_partkey, p_name || '*x*' AS s FROM part")
def attribute_bytes(part):
    return part.select("p_partkey", V.attribute_text(F.concat(F.col("p_name").cast("binary"), F.unhex(F.lit("FF78E9202020")))).alias("s"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, [l_partkey::INT, l_suppkey::INT, -3] AS i4, CASE WHEN l_partkey <= 127 THEN [l_partkey::TINYINT] END AS i1, [l_tax] AS r8, ['a ' || l_partkey] AS t, NULL::INT AS bad FROM lineitem")
def parsed_text(lineitem):
    a, b = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return lineitem.select("l_orderkey", "l_linenumber", V.parsed_values(F.concat_ws(", ", a, b, F.lit("-3")), "INT4").alias("i4"), V.parsed_values(a, "INT1").alias("i1"), V.parsed_values(F.col("l_tax").cast("string"), "REAL8").alias("r8"), V.parsed_values(F.concat(F.lit(" 'a "), a, F.lit("' rest")), "CHAR").alias("t"), V.parsed_values(F.lit("1, x"), "INT4")[0].alias("bad"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, printf('%12.3E', p) AS e, replace(printf('%12.3E', p), 'E', 'D') AS d, printf('%9.3G', p) AS g, printf('%9.4G', l_tax) AS h FROM (SELECT *, l_extendedprice + 0.001 AS p FROM lineitem)")
def general_formats(lineitem):
    p = F.col("l_extendedprice") + 0.001  # so that nothing stands half-way, which C rounds to even and the formatter up
    return lineitem.select("l_orderkey", "l_linenumber", V.formatted(p, "E12.3").alias("e"), V.formatted(p, "D12.3").alias("d"), V.formatted(p, "G9.3").alias("g"), V.formatted(F.col("l_tax"), "G9.4").alias("h"))


@query("customer", "SELECT c_custkey, true AS plain, false AS empty, false AS wild, c_custkey % 20 IN (1, 2, 3, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15, 16) AS known FROM customer")
def valid_codes(customer):
    return customer.select("c_custkey", V.valid_name(F.col("c_name")).alias("plain"), V.valid_name(F.lit("")).alias("empty"), V.valid_name(F.concat("c_name", F.lit("\t"))).alias("wild"), V.valid_code((F.col("c_custkey") % 20).cast("int"), "encoding").alias("known"))


@query("lineitem", "SELECT l_orderkey, l_linenumber, l_tax = l_discount AS eq, l_tax <> l_discount AS ne, l_tax < l_discount AS lt, l_tax <= l_discount AS le, l_tax > l_discount AS gt, l_tax >= l_discount AS ge, false AS zeros, true AS later FROM lineitem")
def comparison_kernel(lineitem):
    a, b = F.col("l_tax"), F.col("l_discount")
    e = lambda sec, psec: F.struct(sec.alias("sec"), psec.alias("psec"))
    return lineitem.select("l_orderkey", "l_linenumber", *(Fl.compared(a, b, op).alias(op.lower()) for op in ("EQ", "NE", "LT", "LE", "GT", "GE")), Fl.compared(F.lit(-0.0), F.lit(0.0), "EQ").alias("zeros"), Fl.compared(e(a, b + 1), e(a, b), "GT", "EPOCH16").alias("later"))


@query("events", "SELECT event_id, CASE WHEN event_type = 'error' THEN -1e31 ELSE value END AS value FROM events")
def quality_pairs(events):
    """value is paired with valueq, whose COMPONENT_1 names the flags."""
    spark = events.sparkSession
    attributes = spark.createDataFrame([("valueq", "COMPONENT_0", "value"), ("valueq", "COMPONENT_1", "flags")], "variable string, attribute string, value string")
    with_flags = events.select("event_id", "value", F.lit(0).alias("valueq"), F.when(F.col("event_type") == "error", 2).otherwise(0).alias("flags"))
    return Fl.quality_checked(with_flags, attributes, {"value": -1e31}).select("event_id", "value")


@query("events", MONO.format(by="user_id", v="x", o="event_id", t="(SELECT *, CASE WHEN event_id % 3 = 1 THEN 'NaN'::DOUBLE ELSE event_id::DOUBLE END AS x FROM events)").replace("v > p", "v > p AND NOT isnan(v) AND NOT isnan(p)").replace("v < p", "v < p AND NOT isnan(v) AND NOT isnan(p)").replace("v = p", "v = p AND NOT isnan(v) AND NOT isnan(p)"))
def monotonic_with_nan(events):
    x = F.when(F.col("event_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("event_id").cast("double"))
    return S.monotonicity(events.withColumn("x", x), "x", "event_id", ["user_id"])


@query("events", "SELECT 0::BIGINT AS rec, min(value) AS value FROM events UNION ALL SELECT row_number() OVER (ORDER BY event_id), value FROM events UNION ALL SELECT count(*) + 1, max(value) FROM events")
def append_single_records(events):
    """Parts of one record before and behind a long one, and an empty one between."""
    one = lambda f: events.agg(f("value").alias("value")).select(F.lit(0).cast("long").alias("rec"), "value")
    long = events.select(F.col("event_id").alias("rec"), "value")
    return M.append_records([one(F.min), long.where("false"), long, one(F.max)], "rec")


@query("events", "SELECT event_id, value AS \"file1_value\", user_id AS \"file3_x\", ts AS \"file2_t\" FROM events")
def merge_renumbered(events):
    """A name that has a file's number already gets the next."""
    return M.prefixed([events.select("event_id", "value"), events.select("event_id", F.col("user_id").alias("file2_x"), F.col("ts").alias("t"))], "event_id")


@query("lineitem", "SELECT 'l_quantity' AS variable, count(*) AS n_compared, count(*) FILTER (WHERE l_partkey % 10 = 0) AS n_values, count(DISTINCT l_orderkey) FILTER (WHERE l_partkey % 10 = 0) AS n_records FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)")
def compare_records(lineitem):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    one = lineitem.groupBy(*keys).agg(F.min("l_quantity").alias("l_quantity"))
    other = one.withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("l_partkey") % 10 == 0, 1.0).otherwise(0.0))
    return M.compare_values(one, other, keys, {"l_quantity": 0.5})


@query("part", "SELECT p_partkey, 'time_series>y=a_' || p_brand || '+x' AS value FROM part")
def pointer_names(part):
    """Names with signs that patterns know are taken as they are."""
    names = [f"Brand#{i}+x" for i in range(100)]
    rows = part.select("p_partkey", F.concat(F.lit("time_series>y="), F.col("p_brand"), F.lit("+x")).alias("value"))
    return M.rename_pointers(rows, "value", names, "a")


@query("events", "SELECT user_id AS user, ts AS \"Epoch\", value, event_id FROM events")
def epoch_grouping(events):
    """Variables by their epoch, and of them only those that are asked for."""
    wide = events.select(F.col("user_id").alias("user"), "value", F.col("ts").alias("Epoch"), "event_id", "props")
    order = Mt.epoch_groups(wide.columns, {"value": "Epoch", "event_id": "Epoch"})
    return wide.select(*Mt.chosen_variables(order, exclude=["props"]))


@query("events", "WITH b AS (SELECT event_id // 100 AS block, min(event_id) AS first_rec, max(event_id) AS last_rec, arg_min(ts, event_id) AS ts_first, arg_max(ts, event_id) AS ts_last FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS event_id, ts FROM events) GROUP BY 1) SELECT block, first_rec, last_rec FROM b WHERE ts_last >= TIMESTAMP '2024-01-05' AND ts_first <= TIMESTAMP '2024-01-12'")
def monotonic_pruning(events):
    """Blocks of a rising variable that can hold a range."""
    from skyloom.operators.records import numbered

    rows = numbered(events.select("ts", "event_id"), ["ts", "event_id"])
    blocks = rows.groupBy(F.floor(F.col("rec") / 100).alias("block")).agg(F.min("rec").alias("first_rec"), F.max("rec").alias("last_rec"), F.min_by("ts", "rec").alias("ts_first"), F.max_by("ts", "rec").alias("ts_last"))
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return Fl.monotonic_prune(blocks, "ts", t("2024-01-05"), t("2024-01-12")).select("block", "first_rec", "last_rec")
