"""Queries that write the events as files, four of them, and read these back, with their SQL.

A file part0 to part3 holds the events of the users whose number leaves 0 to 3,
numbered by event.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import time as T
from skyloom.operators import stats as S
from skyloom.plans.queries import MS, TT, query
from skyloom.session import shared_folder
from skyloom.sources import files

TYPES = {"Epoch": "EPOCH", "tt": "TIME_TT2000", "user": "INT4", "small": "UINT1", "value": "REAL8", "label": "CHAR", "pair": "REAL4"}
ATTRIBUTES = {"Epoch": {"UNITS": "ms"}, "small": {"FILLVAL": 255}, "value": {"UNITS": "nT", "VALIDMIN": 1.0, "VALIDMAX": 200.0}}
#: Folders written in this session, by application and input files.
WRITTEN: dict[tuple, str] = {}

BASE = f"""WITH f AS (SELECT 'part' || (user_id % 4) AS file, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS rec,
    {MS}::DOUBLE AS epoch, {TT} AS tt, user_id::INT AS "user", (user_id * 37 % 256)::SMALLINT AS small, value, event_type AS label, ts FROM events) """


def rows_of(events: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(F.col("user_id") % 4).orderBy("event_id")) - 1
    pair = F.array(F.col("value").cast("float"), (-F.col("value")).cast("float"))
    return events.select(F.concat(F.lit("part"), (F.col("user_id") % 4).cast("string")).alias("file"), number.cast("long").alias("rec"), T.epoch_of(F.col("ts")).alias("Epoch"), T.tt2000_of(F.col("ts")).alias("tt"), F.col("user_id").cast("int").alias("user"), (F.col("user_id") * 37 % 256).alias("small"), "value", F.col("event_type").alias("label"), pair.alias("pair"))


def event_files(events: DataFrame) -> str:
    """A folder of files with the events, written once in a session."""
    key = (events.sparkSession.sparkContext.applicationId, *sorted(events.inputFiles()))
    if key not in WRITTEN:
        folder = f"{shared_folder(events.sparkSession)}/files-{uuid.uuid4().hex}"
        files.save_files(files.written(rows_of(events), TYPES, options={"checksum": True}, attributes=ATTRIBUTES), folder)
        WRITTEN[key] = folder
    return WRITTEN[key]


def named(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.regexp_extract("file", "name=([^/]+)", 1))


def event_records(events: DataFrame, *args, **options) -> DataFrame:
    return named(files.read(events.sparkSession, event_files(events), *args, **options))


@query("events", BASE + 'SELECT file, rec, epoch AS "Epoch", tt, "user", small, value, label, [value::FLOAT, (-value)::FLOAT] AS pair FROM f')
def file_records(events):
    return event_records(events)


@query("events", BASE + "SELECT file, rec, make_timestamp(epoch_us(ts) // 1000 * 1000) AS t, ts AS tt FROM f")
def file_times(events):
    return files.decoded(event_records(events, ["Epoch", "tt"])).select("file", "rec", F.col("Epoch").alias("t"), "tt")


@query("events", BASE + 'SELECT file, rec, "user", value FROM f WHERE rec BETWEEN 10 AND 19')
def file_record_range(events):
    return event_records(events, ["user", "value"], (10, 19))


@query("events", BASE + 'SELECT file, rec, "user", small, label FROM f')
def file_without(events):
    return event_records(events, exclude=["Epoch", "tt", "value", "pair"])


@query("events", BASE + "SELECT file, '3.6.3' AS version, 6 AS encoding, 'ROW' AS majority, max(rec) AS max_rec, 0 AS n_r, 7 AS n_z, 4 AS n_attributes, true AS verified FROM f GROUP BY file")
def file_inquiry(events):
    return named(files.file_info(events.sparkSession, event_files(events))).select("file", "version", "encoding", "majority", "max_rec", "n_r", "n_z", "n_attributes", "verified")


@query("events", BASE + "SELECT file, name, type, number, true AS is_z, CASE WHEN name = 'label' THEN most ELSE 1 END AS elements, true AS record_varies, max_rec FROM (SELECT file, max(rec) AS max_rec, max(length(label))::INT AS most FROM f GROUP BY file), (VALUES ('Epoch', 'EPOCH', 0), ('tt', 'TIME_TT2000', 1), ('user', 'INT4', 2), ('small', 'UINT1', 3), ('value', 'REAL8', 4), ('label', 'CHAR', 5), ('pair', 'REAL4', 6)) v(name, type, number)")
def file_variables(events):
    return named(files.variables(events.sparkSession, event_files(events))).select("file", "name", "type", "number", "is_z", "elements", "record_varies", "max_rec")


@query("events", BASE + "SELECT file, attribute, 'VARIABLE' AS scope, variable, entry, type, value FROM (SELECT DISTINCT file FROM f), (VALUES ('UNITS', 'Epoch', 0, 'CHAR', 'ms'), ('FILLVAL', 'small', 3, 'UINT1', '255'), ('UNITS', 'value', 4, 'CHAR', 'nT'), ('VALIDMIN', 'value', 4, 'REAL8', '1.0'), ('VALIDMAX', 'value', 4, 'REAL8', '200.0')) a(attribute, variable, entry, type, value)")
def file_attributes(events):
    return named(files.attributes(events.sparkSession, event_files(events)))


@query("events", BASE + "SELECT file, 'value' AS name, 1::BIGINT AS n_index, 1::BIGINT AS n_entries, 1::BIGINT AS n_levels, count(*) AS n_records, count(*) AS n_allocated, floor(100.0 * (count(*) * 8 + 12) / (count(*) * 8) + 0.5)::BIGINT AS percent FROM f GROUP BY file")
def file_index_statistics(events):
    return named(files.index_statistics(events.sparkSession, event_files(events))).where("name = 'value'")


@query("events", BASE + "SELECT file, 'value' AS name, 0::BIGINT AS first_rec, max(rec) AS last_rec FROM f GROUP BY file")
def file_blocks(events):
    return named(files.blocks(events.sparkSession, event_files(events))).where("name = 'value'").drop("offset")


@query("events", BASE + "SELECT file, record, n FROM (SELECT DISTINCT file FROM f), (VALUES ('CDR', 1::BIGINT), ('GDR', 1), ('zVDR', 7), ('VXR', 7), ('VVR', 7), ('ADR', 4), ('AzEDR', 5)) r(record, n)")
def file_validation(events):
    found = named(files.validate(events.sparkSession, event_files(events)))
    return found.where("ok").groupBy("file", "record").agg(F.count("*").alias("n")).unionByName(found.where("NOT ok").select("file", F.lit("broken").alias("record"), F.lit(1).cast("long").alias("n")))


@query("events", BASE + 'SELECT file, rec, epoch AS "Epoch", "user", value, label, [value::FLOAT, (-value)::FLOAT] AS pair FROM f')
def file_converted(events):
    """The files again with big numbers first, columns first and all four packings, and read from there."""
    spark = events.sparkSession
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    packings = {"Epoch": 5, "user": 2, "value": 2, "label": 1, "pair": 3, "small": 1}
    files.save_files(files.converted_files(spark, event_files(events), little=False, row_major=False, compression=packings, keep=["Epoch", "user", "value", "label", "pair"]), folder)
    return named(files.read(spark, folder))


@query("events", BASE + 'SELECT file, rec, "user", value FROM f')
def file_old_version(events):
    """The files as version 2, packed as a whole, without the times that it lacks."""
    spark = events.sparkSession
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    files.save_files(files.converted_files(spark, event_files(events), version=2, packing=5, keep=["user", "value"]), folder)
    return named(files.read(spark, folder))


@query("events", BASE + "SELECT printf('%6d', \"user\") || ' ' || printf('%8.2f', value) || ' ' || label AS line FROM f UNION ALL SELECT 'user value label'")
def file_text(events):
    return files.horizontal(event_records(events), ["user", "value", "label"], {"user": "I6", "value": "F8.2"})


@query("events", BASE + "SELECT file, rec + 1 AS rec, 'user: ' || \"user\" || '; small: ' || small AS line FROM f WHERE rec BETWEEN 4 AND 8")
def file_dump(events):
    return named(files.dump(events.sparkSession, event_files(events), ["user", "small"], (5, 9)))


@query("events", BASE + "SELECT variable, n_values, min_value, max_value, n_low, n_high, n_fill FROM (SELECT 'value' AS variable, count(*) AS n_values, min(value) FILTER (WHERE value BETWEEN 1 AND 200) AS min_value, max(value) FILTER (WHERE value BETWEEN 1 AND 200) AS max_value, count(*) FILTER (WHERE value < 1) AS n_low, count(*) FILTER (WHERE value > 200) AS n_high, 0::BIGINT AS n_fill FROM f UNION ALL SELECT 'small', count(*) FILTER (WHERE small <> 255), min(small) FILTER (WHERE small <> 255), max(small) FILTER (WHERE small <> 255), 0, 0, count(*) FILTER (WHERE small = 255) FROM f)")
def file_ranged_stats(events):
    spark, folder = events.sparkSession, event_files(events)
    return S.ranged_stats(files.read(spark, folder, ["value", "small"]), ["value", "small"], files.attributes(spark, folder))


@query("events", BASE + "SELECT variable, last_rec, n_written, n_allocated FROM (SELECT max(rec) AS last_rec, count(*) AS n_written, count(*) AS n_allocated FROM f WHERE file = 'part1'), (VALUES ('user'), ('value')) v(variable)")
def file_record_counts(events):
    spark, folder = events.sparkSession, f"{event_files(events)}/name=part1"
    return S.record_counts(files.read(spark, folder, ["user", "value"]), "rec", ["user", "value"], files.blocks(spark, folder))
