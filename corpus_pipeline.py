"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that the one before it kept; its result is written as Parquet and read again.
All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit.llm import decontaminate, jaccard, packing, quality, secrets
from ledgerkit.llm.common import id_remainder, table
from ledgerkit.session import settle


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the discriminant scores 0.5 or more; it learns from the labelled documents here.

    As in the operator's query, ids with remainder 1 do not train. Without any label all stay.
    """
    stats = settle(docs.where(id_remainder("doc_id", 3) != 1).select("doc_id", quality.features(F.col("text")).alias("x")))
    model = quality.train(stats, table(spark, sf_dir, "labels"), "doc_id", "x", "quality")
    return docs.where(quality.scorer(model)(quality.features(F.col("text"))) >= 0.5)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return jaccard.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay, with their number of characters renewed."""
    forest = secrets.train(secrets.weak_labels(settle(secrets.findings(docs))))
    out = secrets.redact(docs, forest)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack_sequences),
]

# A trained classifier, a forest and a tokenizer are beyond SQL; tests/llm has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settle(docs)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
