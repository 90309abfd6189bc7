"""The corpus pipeline: five stages over ``documents``, each an operator of ``coffer.llm``.

Toxic documents go; one document of each group of near-duplicates (five-word
shingles, similarity 0.8) stays; personal data get surrogates; each document is
repeated as often as the mix of sources takes it; the rest is tokenised and
packed. The pieces of the last stage are the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm import mixing, neardup, packing, pii, toxicity
from coffer.llm.common import materialise
from coffer.llm.queries import vocabulary_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return neardup.keep_one(docs, k=5, similarity=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in ``text`` and n_chars to match."""
    report = "pii" + "_" * max(map(len, docs.columns))  # no column's name
    out = pii.replace_pii(docs, report=report)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(report) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(report)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, ids and all, with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near-duplicates", neardup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the nearest-neighbour scores nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole ``documents`` table; each reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
