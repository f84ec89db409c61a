"""Queries op1 to op10 and the pipeline: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of all documents."""
    from skyloom.llm.runtime import spread

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from skyloom.llm.tokens import count_tokens

    return count_tokens(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.licenses import scan_licenses

    return scan_licenses(texts(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.toxicity import score_toxicity

    return score_toxicity(texts(spark, sf_dir), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: their items and the longest overlap."""
    from pyspark.sql import functions as F

    from skyloom.llm.decontaminate import add_overlaps

    found = add_overlaps(texts(spark, sf_dir), table(spark, sf_dir, "benchmark")).where(F.size("overlaps") > 0)
    longest = F.array_max(F.transform("overlaps", lambda h: F.struct(h["words"].alias("words"), h["equal"].alias("equal"))))
    return found.select("doc_id", F.transform("overlaps", lambda h: h["item_id"]).alias("item_ids"), F.size("overlaps").cast("long").alias("n_items"), longest["words"].alias("overlap_words"), (longest["equal"] / longest["words"]).alias("similarity"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.simhash import simhash_groups

    return simhash_groups(texts(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.lm import score_documents

    return score_documents(texts(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyloom.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from skyloom.llm.repeats import remove_repeats

    found = remove_repeats(texts(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from skyloom.llm.lines import drop_repeated_lines

    kept = drop_repeated_lines(texts(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_source_mixing": op8_source_mixing,
    "op9_repeated_strings": op9_repeated_strings,
    "op10_line_dedup": op10_line_dedup,
}
