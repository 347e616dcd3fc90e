"""A training corpus from ``documents`` in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import common, jaccard_join, line_dedup, mixing, nbest, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that break a rule go.

    Null, empty and blank texts go, as they have no words; null ids and other nulls don't matter; repeated rows stay or
    go together; long texts are judged whole; an empty table stays empty; further columns of any name are kept.
    """
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: repeated lines go; a document that had text and has none left goes; n_chars follows the text.

    Null and empty texts lose no line and stay, with n_chars null and 0; rows alike in id and text stay alike; of equal
    lines the first by id (null first) stays; long texts are rebuilt whole; an empty table stays empty; further
    columns are kept, also one named ``lines_dropped``.
    """
    dropped = "__" + "_".join(docs.columns)  # no column has this name
    clean = line_dedup.dedup(docs, counted=dropped)
    kept = clean.where((F.col(dropped) == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near duplicates stays, that of the smallest id.

    Null, empty and blank texts and rows without an id have no near duplicates and stay; rows of one id stay or go
    together; long texts are compared whole; an empty table stays empty; further columns of any name are kept.
    """
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: sources at their target weights, in shuffled shards.

    A source too small for its share gives all it has and doesn't bound the others (``mixing.fair_total``).  Null
    sources are one source of their own; null ids and texts are ordinary values; rows alike in id and text stay
    together; an empty table stays empty; further columns are kept but for two named ``mix_shard`` and
    ``mix_position``, which are the operator's own.
    """
    return mixing.mix(docs, total=mixing.FAIR).drop("mix_shard", "mix_position")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the n best segmentations of every document.

    Null and empty texts have one row without ids; a null id is kept; repeated rows are encoded each; ties keep the
    order of the search; long texts are encoded whole; an empty table gives no rows; further columns are left out.
    """
    return nbest.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_near),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: Neither the hypergeometric mix nor the segmentation can be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
