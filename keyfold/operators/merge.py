"""Newest version wins: the one expression behind every read and every compaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE


def is_tombstone(op: str = "op", value: str = "value") -> Column:
    """A delete, or a put of an empty value, which reads as absent as well."""
    return (F.col(op) == DELETE) | (F.coalesce(F.octet_length(value), F.lit(0)) == 0)


def newest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; tombstones stay.

    Ranking to 1 is pruned before the shuffle (WindowGroupLimit), so a hot key costs a task one row; predicates on the
    key pass below the window to the scans.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def newest_by_seq(df: DataFrame, key: str = "key", seq: str = "seq", upto: int | None = None) -> DataFrame:
    """The newest version of each key, as of sequence number ``upto`` if given."""
    if upto is not None:
        df = df.where(F.col(seq) <= upto)
    return newest_wins(df, [key], [F.col(seq).desc()])


def merge_sources(sources: list[DataFrame], key: str = "key") -> DataFrame:
    """Union of sources in order of priority, first one first; of equal keys the first source's row stays, in key order."""
    ranked = [s.withColumn("src_rank", F.lit(i)) for i, s in enumerate(sources)]
    merged = newest_wins(reduce(DataFrame.unionByName, ranked), [key], [F.col("src_rank")])
    return merged.orderBy(key)


def live(df: DataFrame, op: str = "op", value: str = "value") -> DataFrame:
    """Hides tombstones; only right above a merge, never below it."""
    return df.where(~is_tombstone(op, value))


def merge_join_back(df: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The same as ``newest_by_seq`` where (key, seq) is unique: a fixed-width aggregate, then a join back."""
    top = df.groupBy(key).agg(F.max(seq).alias(seq))
    return df.join(top, [key, seq], "left_semi")
