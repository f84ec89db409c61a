r"""Line dedup over levelled sorted runs of line hashes, with Spark functions only.

A LineStore holds runs: bucketed tables of (h1, h2, owner), sorted by hash
within buckets, no hash in two of them. A new batch of hashes is reduced to one
row a hash, anti-joined with every run by merge (runs keep their buckets and
order, so only the batch moves), and what is left becomes a run of level 0. When
a level has ``fanout`` runs they are compacted into one of the next level.

drop_repeated_lines feeds batches by rising id, so the first owner of a line is
the smallest id that holds it.

Defined results: null or empty text is one empty line. A null id ranks after
every other id, and rows with equal ids are one document: they keep or lose a
line together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.runtime import BLANKS, cut, ensure_checkpoint_dir, id_of, remove_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 10
#: A line is hot from one in HOT of the lines whose hash falls in one of PART parts; this decides how it is joined, not what comes out.
HOT, PART = 500, 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text: Column) -> Column:
    """With the id, tells texts apart; repeated rows are equal in both."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_key(line: Column, shortest: int) -> Column:
    """Two hashes (128 bits) of the trimmed, lower-cased line; null below the shortest length."""
    trimmed = F.btrim(line, F.lit(BLANKS))
    # lower() also changes other alphabets, so it only takes lines that are all ASCII.
    key = F.when(F.octet_length(trimmed) == F.length(trimmed), F.lower(trimmed)).otherwise(F.translate(trimmed, UPPER, LOWER))
    return F.when(F.length(trimmed) >= shortest, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")))


class LineStore:
    """Runs of line hashes; add() takes batches in order of arrival and gives each hash its first owner.

    Runs are files in the shared checkpoint folder. The catalog only lends them a
    name while the store lives, since Spark keeps buckets and order with a name.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def write(self, rows: DataFrame) -> str:
        name = f"skyloom_run_{uuid.uuid4().hex}"
        rows = rows.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def remove(self, names: list[str]) -> None:
        for x in names:
            self.spark.sql(f"DROP TABLE {x}")
            remove_folder(self.spark, f"{self.folder}/{x}")

    def put(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self.put(self.write(self.union(old)), level + 1)
            self.remove(old)

    def union(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for x in names[1:]:
            out = out.unionByName(self.spark.table(x))
        return out

    @property
    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def add(self, hashes: DataFrame) -> None:
        """hashes: (h1, h2, did), repeats allowed."""
        fresh = hashes.groupBy("h1", "h2").agg(F.min("did").alias("owner"))
        for run in self.runs:
            fresh = fresh.join(self.spark.table(run).hint("merge"), ["h1", "h2"], "left_anti")
        self.put(self.write(fresh), 0)

    def owners(self) -> DataFrame | None:
        return self.union(self.runs) if self.runs else None

    def drop(self) -> None:
        self.remove(self.runs)
        remove_folder(self.spark, self.folder)
        self.levels = []


def hot_hashes(hashes: DataFrame) -> DataFrame:
    """(h1, h2) of lines that are over one in HOT of a fixed part of all; so there are fewer than HOT of them."""
    part = cut(hashes.where(F.pmod(F.xxhash64("did", "h1"), F.lit(PART)) == 0).groupBy("h1", "h2").agg(F.count("*").alias("n")))
    total = part.agg(F.sum("n")).first()[0] or 0
    return part.where(F.col("n") * HOT > total).select("h1", "h2")


def losses(hashes: DataFrame, owners: DataFrame) -> DataFrame:
    """(did, th, pos) of the lines that an earlier document owns.

    The occurrences of hot lines, which one task could not take, meet their owners
    by broadcast; all others by merge.
    """
    hot = cut(hot_hashes(hashes))
    known = cut(owners.join(F.broadcast(hot), ["h1", "h2"], "left_semi"))
    often = hashes.join(F.broadcast(known), ["h1", "h2"])
    rest = hashes.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(owners, ["h1", "h2"])
    return often.unionByName(rest).where("did > owner").select("did", "th", "pos")


def repeated_lines(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, batches: int = 4) -> DataFrame:
    """(did, th, drops): for each text (id and hash) that loses lines, the places of these lines from 0."""
    spark = docs.sparkSession
    lines = docs.select(id_of("doc_id").alias("did"), text_hash(F.col(text)).alias("th"), F.posexplode(F.transform(lines_of(F.col(text)), lambda x: line_key(x, shortest))).alias("pos", "k"))
    hashes = cut(lines.where("k IS NOT NULL").select("did", "th", "pos", "k.h1", "k.h2"))
    ends = hashes.agg(F.percentile_approx("did", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    ends = sorted(set(ends))
    store = LineStore(spark)
    try:
        for low, high in zip([None, *ends], [*ends, None], strict=True):
            part = hashes if low is None else hashes.where(F.col("did") > low)
            store.add(part if high is None else part.where(F.col("did") <= high))
        return cut(losses(hashes, store.owners()).groupBy("did", "th").agg(F.collect_list("pos").alias("drops")))
    finally:
        store.drop()


def drop_repeated_lines(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, batches: int = 4) -> DataFrame:
    """docs with its text rid of repeated lines, and n_lines (before) and n_dropped; columns of these names are replaced.

    A line's key has blanks stripped at both ends and A-Z lower-cased. Keys of
    at least ``shortest`` code points that several documents hold stay only in
    the smallest id's.
    """
    drops = repeated_lines(docs, text, shortest, batches).select(F.col("did").alias("__did"), F.col("th").alias("__th"), F.col("drops").alias("__drops"))
    out = docs.withColumns({"__id": id_of("doc_id"), "__hash": text_hash(F.col(text))}).join(drops, (F.col("__id") == F.col("__did")) & (F.col("__hash") == F.col("__th")), "left")
    out = out.withColumn("__lines", lines_of(F.col(text)))
    # The places that stay, by one pass over both lists, and their lines.
    stays = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drops")
    out = out.withColumn("__kept", F.when(F.col("__drops").isNull(), F.col("__lines")).otherwise(F.transform(stays, lambda i: F.get("__lines", i))))
    out = out.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long"), text: F.when(F.col("__drops").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n"))})
    return out.drop("__id", "__hash", "__did", "__th", "__drops", "__lines", "__kept")
