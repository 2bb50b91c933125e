"""A training-data pipeline over ``documents``: each stage's decisions take effect on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm import exact, minhash, mixing, packing, quality
from keyfold.llm import queries as q
from keyfold.llm.common import Table

#: SQL cannot express the near-duplicate and sampling stages; tests hold the stages against brute force.
ORACLE_SQL = None


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_exact_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, Jaccard 0.8 or more)."""
    return minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target weights of sources, languages and topics, half of the tokens."""
    return mixing.mix_sources(docs, *q.mixture(docs), budget=0.5, keep=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", filter_quality),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared checkpoint folder as Parquet and read again, then dropped once used."""
    docs = q.documents(spark, sf_dir)
    last = None
    for _, stage in STAGES[:-1]:
        table = Table(stage(spark, docs, sf_dir))
        if last is not None:
            last.drop()
        docs, last = table.read(), table
    out = STAGES[-1][1](spark, docs, sf_dir)  # it checkpoints all it needs of its input
    last.drop()
    return out
