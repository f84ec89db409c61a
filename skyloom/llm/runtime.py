"""What the operators share: stable row ids, checkpoints, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id wherever ids are ordered or joined: after every other.
NULL_ID = (1 << 63) - 1

#: Rows of numbers up to which a table is broadcast; a larger one is joined by shuffle.
FEW = 200_000

#: White space of the word rule `[^\x20\x09-\x0D]+`; bytes.split() uses the same six.
BLANKS = " \t\n\x0b\f\r"


def id_of(column: str | Column) -> Column:
    """The id as a long that is never null: a null id counts as the largest long."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


def null_id_back(column: str | Column) -> Column:
    """Undoes id_of."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != NULL_ID, c)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Where none is set, a folder of our own in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not found and not re.match(r"local(\[[\d*,]+\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="skyloom-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of our own in whatever store holds it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Computes df now and cuts its lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df computed once and, only if it has at most so many rows, marked for broadcast."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it comes in fewer parts than these, as a small file of one row group does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow by another name, so that operators read alike."""
    return df.mapInArrow(fn, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string array's rows; null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def texts_in(column: pa.Array, step: int = 200) -> Iterator[list[bytes]]:
    """as_bytes in lists of step rows, so that Python never holds a second copy of a whole batch."""
    for at in range(0, len(column), step):
        yield as_bytes(column.slice(at, step))


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Starts of consecutive runs of the given lengths, and the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id's text is empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
