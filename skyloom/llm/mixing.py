r"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 63-bit hash of its id. Per source the words are summed
by hash bucket; the running sum shows the bucket in which the budget ends, and
only that bucket is summed again by its next nine bits, until it holds one hash.
Documents below the threshold are in: no sort, and budgets are nested, since a
larger one only raises the threshold. A target over the source's size takes
whole copies of all documents and thresholds the rest.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share
``scale`` of all words; none takes over twice its size, and the excess goes to
the others by weight.

Defined results: null text has no words. Rows with equal ids share a hash and
are taken or left together; a null id counts as the largest. Only the columns
that mix adds are replaced; any other column of docs stays as it is. The table
of sources, one row each, is sorted in one task, which can spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.runtime import cut, id_of

WEIGHTS = (5, 2, 1)
SCALE, MOST = 1.5, 2.0
BITS, LEVELS = 9, 7
#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffle.
FEW = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, scale: float = SCALE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The share for each unit of weight is the level at which the capped targets
    add up to the whole budget; sources are capped in order of cap by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rank = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "w_all": F.sum("w").over(every), "budget": F.sum("source_size").over(every) * F.lit(float(scale))})
    # The level if this source and all after it are uncapped. It rises up to the first source whose ratio it does not
    # pass, and falls from there on: the largest of those that pass no ratio is the right one.
    t = t.withColumn("level", (F.col("budget") - F.col("capped")) / (F.col("w_all") - F.col("w_before")))
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    return t.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def joined(docs: DataFrame, by_source: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    right = by_source.withColumnRenamed("source", "__mix_source")
    return docs.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("__mix_source")), how).drop("__mix_source")


def thresholds(rows: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """(source, threshold): hashes below it are in. rows: (source, size, h); budgets: (source, budget) in words.

    threshold is null where every document is in.
    """
    state = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("low"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("threshold"))
    for level in range(LEVELS):
        shift = 63 - BITS * (level + 1)
        open_ = joined(rows, state.where("NOT done").select("source", "low", "left"), few)
        if level:
            open_ = open_.where(F.shiftright("h", shift + BITS) == F.shiftright("low", shift + BITS))
        sums = open_.groupBy("source", "low", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("first"), F.max("h").alias("last"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(run))
        cross = sums.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "first", "last", "left")).alias("x"))
        rest = F.col("x.left") - (F.col("x.upto") - F.col("x.words"))
        alone = F.col("x.first") == F.col("x.last")
        # One hash left: it is in if that brings the sum nearer to the budget.
        end = F.when(2 * rest >= F.col("x.words"), F.col("x.first") + 1).otherwise(F.col("x.first"))
        found = cross.select(F.col("source").alias("__s"), rest.alias("n_left"), F.shiftleft("x.bucket", shift).alias("n_low"), alone.alias("n_done"), F.when(alone, end).alias("n_threshold"))
        same = F.col("source").eqNullSafe(F.col("__s"))
        # A row a source: one task holds the windows over them anyway.
        state = cut(
            state.join(found, same, "left").coalesce(1).select(
                "source",
                F.coalesce("n_left", "left").alias("left"),
                F.coalesce("n_low", "low").alias("low"),
                # What never passes its budget takes all.
                (F.col("done") | F.coalesce("n_done", F.lit(True))).alias("done"),
                F.coalesce("threshold", "n_threshold").alias("threshold"),
            )
        )
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "threshold")


def mix(docs: DataFrame, text: str = "text", weights: tuple = WEIGHTS, scale: float = SCALE, most: float = MOST) -> DataFrame:
    """docs with size, source_size, target, copies and taken (size times copies); columns of these names are replaced.

    Each source's taken words come as near to its target as whole documents
    allow at one end of the hash order. Same input, same result.
    """
    clash = [c for c in ("size", "source_size", "target", "copies", "taken") if c in docs.columns]
    # Columns of our own are named apart from any that docs may have.
    spot = F.xxhash64(id_of("doc_id")).bitwiseAND(F.lit((1 << 63) - 1))
    sized = docs.drop(*clash).withColumns({"size": word_count(F.col(text)), "__mix_h": spot})
    rows = cut(sized.select("source", "size", F.col("__mix_h").alias("h")))
    goal = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, scale, most).coalesce(1))
    few = goal.limit(FEW + 1).count() <= FEW
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(F.lit(0))
    goal = goal.withColumn("__mix_whole", whole.cast("int"))
    part = goal.withColumn("budget", F.col("target") - F.col("__mix_whole") * F.col("source_size")).where("budget > 0")
    limits = thresholds(rows, part.select("source", "budget"), few).select(F.col("source").alias("__s"), F.col("threshold").alias("__mix_limit"), F.lit(True).alias("__mix_part"))
    goal = cut(goal.join(limits, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").coalesce(1))
    out = joined(sized, goal, few)
    extra = F.when(F.col("__mix_part").isNull(), 0).when(F.col("__mix_limit").isNull() | (F.col("__mix_h") < F.col("__mix_limit")), 1).otherwise(0)
    return out.withColumn("copies", (F.col("__mix_whole") + extra).cast("int")).withColumn("taken", F.col("size") * F.col("copies")).drop("__mix_h", "__mix_whole", "__mix_part", "__mix_limit")
