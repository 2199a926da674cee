"""A training corpus from raw documents: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayflow.llm import common, exact, mixing, neardup, packing, toxicity
from arrayflow.llm.queries import fit_labels
from arrayflow.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents with at least this probability of being toxic go.
TOXIC = 0.3
#: Similarity of word shingles from which two documents are near-duplicates.
SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the field learns from the labels' learning part."""
    common.tune(spark)
    return toxicity.drop_toxic(docs, toxicity.fit_field(docs, fit_labels(spark, sf_dir, "toxic")), TOXIC)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    common.tune(spark)
    return exact.drop_exact(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates, the document with the smallest doc_id stays."""
    common.tune(spark)
    return neardup.drop_near(docs, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    common.tune(spark)
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048 ids."""
    common.tune(spark)
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

# The scores of a trained model and the fitted packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
