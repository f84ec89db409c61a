"""The corpus pipeline: five stages from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of documents; the last adds how often a document is
taken. Stages keep the defined results of their operators for nulls, ties and
repeated rows; a stage over an empty table returns an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.decontaminate import add_overlaps
from skyloom.llm.lines import drop_repeated_lines
from skyloom.llm.mixing import mix
from skyloom.llm.runtime import ensure_checkpoint_dir, few, id_of, remove_folder
from skyloom.llm.simhash import near_copy_rows
from skyloom.llm.toxicity import toxicity_score, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the toxicity model predicts as toxic."""
    model = train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("__score", toxicity_score(F.col("text"), model)).where("__score < 0.5").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier document holds; n_chars follows the text, and no document goes."""
    kept = drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (SimHash proposals first, five-word shingles, similarity 0.8 or more).

    The smallest id stays, whose row is known by its id and text: rows equal in both
    stay together, and a null id counts as the largest.
    """
    gone = near_copy_rows(docs.select("doc_id", "text")).where("NOT stays").select(F.col("did").alias("__id"), F.col("th").alias("__th")).distinct()
    marked = docs.withColumns({"__id": id_of("doc_id"), "__th": F.xxhash64(F.coalesce("text", F.lit("")))})
    return marked.join(few(gone), ["__id", "__th"], "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that overlap with a benchmark item."""
    return add_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("overlaps") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies (1 or 2) and taken words."""
    return mix(docs).where("copies > 0").select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: The fitted toxicity model has no SQL form, so run()'s rows have none either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again. A stage's folder goes when the next is written."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
        if i:
            remove_folder(spark, f"{folder}/{i - 1}_{STAGES[i - 1][0]}")
    return docs
