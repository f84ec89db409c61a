"""Files and records as streams.

Files that arrive in a folder are parsed as in skyloom.sources.files, each once;
statistics go by windows of event time behind a watermark, so state is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.stats import value_stats
from skyloom.sources import files

#: The columns of Spark's binaryFile source, which a stream has to be told.
RAW = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, path: str, like: str, variables: list[str] | None = None, most: int = 16) -> DataFrame:
    """A stream of (file, rec, variables ...) of the files that arrive at a path, at most so many in a batch; like: a file with the schema."""
    names, schema, parse = files.parser(files.first_file(spark, like), variables)
    raw = spark.readStream.format("binaryFile").schema(RAW).option("maxFilesPerTrigger", most).load(path)
    return raw.select("path", "content").mapInArrow(parse, schema).select("file", "rec", *names)


def windowed_stats(stream: DataFrame, time: str, value: str, window: str, late: str, **bounds: float) -> DataFrame:
    """value_stats() by windows of event time; rows that come later than the watermark allows are left out. bounds: low, high, fill."""
    rows = stream.withWatermark(time, late).withColumn("window", F.window(time, window))
    return value_stats(rows, value, ["window"], **bounds)


def new_records(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each record once, though files that overlap hold it several times within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
