"""Sorting, inserting, deleting and completing records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import cut


def numbered(df: DataFrame, keys: list[str], name: str = "rec") -> DataFrame:
    """df with record numbers from 0 in the order of keys, without a single-task window.

    Rows are range-partitioned and sorted; the partitions' sizes give each its
    first number. The dealt rows are kept in a checkpoint, since ranges are drawn
    from a sample and would differ if they were dealt again.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size"))
    starts = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = dealt.withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)))
    return inside.join(starts, F.col("__part") == F.col("__p")).withColumn(name, F.col("__start") + F.col("__i") - 1).drop("__part", "__p", "__i", "__start")


def sort_records(df: DataFrame, key: str, rec: str) -> DataFrame:
    """All record variables permuted so that key rises; equal keys keep their order, and records are renumbered."""
    return numbered(df.withColumnRenamed(rec, "__old"), [key, "__old"], rec).drop("__old")


def insert_records(df: DataFrame, rows: DataFrame, rec: str, at: int, sparse: bool = False) -> DataFrame:
    """rows (numbered from 0) put in before record at; later records move up. A sparse variable takes none."""
    if sparse:
        raise ValueError("records cannot be inserted into a variable with sparse records")
    n = rows.count()
    moved = df.withColumn(rec, F.when(F.col(rec) >= at, F.col(rec) + n).otherwise(F.col(rec)))
    return moved.unionByName(rows.withColumn(rec, F.col(rec) + at))


def delete_records(df: DataFrame, rec: str, first: int, last: int, renumber: bool = True) -> DataFrame:
    """Without records first to last; standard variables close the gap, sparse ones may keep it."""
    kept = df.where(~F.col(rec).between(first, last))
    return kept.withColumn(rec, F.when(F.col(rec) > last, F.col(rec) - (last - first + 1)).otherwise(F.col(rec))) if renumber else kept


def renumbered(df: DataFrame, rec: str, by: list[str]) -> DataFrame:
    """Record numbers without gaps, from 0 in each group."""
    return df.withColumn(rec, (F.row_number().over(Window.partitionBy(*by).orderBy(rec)) - 1).cast("long"))


def completed(df: DataFrame, rec: str, by: list[str], values: dict[str, object], mode: str = "pad") -> DataFrame:
    """Virtual records in the gaps of each group up to its last record.

    mode "pad" gives the pad values, "prev" the previous record's (the pad where
    there is none). The gaps are generated group by group and joined by key.
    """
    last = df.groupBy(*by).agg(F.max(rec).alias("__last"))
    grid = last.select(*(F.col(b).alias(f"__{b}") for b in by), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last").cast("long"))).alias("__rec"))
    on = F.col("__rec") == F.col(rec)
    for b in by:
        on = on & F.col(f"__{b}").eqNullSafe(F.col(b))
    out = grid.join(df, on, "left")
    w = Window.partitionBy(*(f"__{b}" for b in by)).orderBy("__rec").rowsBetween(Window.unboundedPreceding, 0)
    real = F.col(rec).isNotNull()
    shown = {}
    for name, pad in values.items():
        missing = F.coalesce(F.last(F.when(real, F.col(name)), ignorenulls=True).over(w), F.lit(pad)) if mode == "prev" else F.lit(pad)
        shown[name] = F.when(real, F.col(name)).otherwise(missing)
    return out.select(*(F.col(f"__{b}").alias(b) for b in by), F.col("__rec").alias(rec), *(c.alias(n) for n, c in shown.items()))


def with_constants(df: DataFrame, constants: DataFrame) -> DataFrame:
    """Each record beside a one-row table of variables that do not vary."""
    if constants.limit(2).count() > 1:
        raise ValueError("variables that do not vary have one record")
    return df.crossJoin(F.broadcast(constants))


def aligned(left: DataFrame, right: DataFrame, rec: str) -> DataFrame:
    """Variables of two tables side by side by record number, null beyond a table's last record."""
    return left.join(right, rec, "full")
