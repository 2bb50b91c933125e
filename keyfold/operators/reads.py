"""Point, batch, range and cursor reads over merged versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settle
from .merge import live, newest_by_seq


def in_range(key: Column, start=None, end=None) -> Column:
    """Half-open [start, end); a missing bound is open; start >= end is empty."""
    out = F.lit(True)
    if start is not None:
        out = out & (key >= F.lit(start))
    if end is not None:
        out = out & (key < F.lit(end))
    return out


def scan(df: DataFrame, start=None, end=None, key: str = "key", seq: str = "seq", upto: int | None = None, value: str = "value") -> DataFrame:
    """Live entries of a range in key order. The range is applied below the merge, where scans can use it."""
    return live(newest_by_seq(df.where(in_range(F.col(key), start, end)), key, seq, upto), value=value).orderBy(key)


def get(df: DataFrame, wanted, key: str = "key", seq: str = "seq", upto: int | None = None, value: str = "value") -> DataFrame:
    """Zero or one live row of a key; a tombstone in any newer source shadows all older ones."""
    return live(newest_by_seq(df.where(F.col(key) == F.lit(wanted)), key, seq, upto), value=value)


def multi_get(df: DataFrame, wanted: DataFrame, key: str = "key", seq: str = "seq", upto: int | None = None, value: str = "value") -> DataFrame:
    """One row per row of ``wanted``; misses have null value. Only versions of wanted keys reach the merge."""
    keys = wanted.select(key).distinct()
    hits = live(newest_by_seq(df.join(keys, key, "left_semi"), key, seq, upto), value=value)
    return wanted.join(hits.select(key, value), key, "left")


def misses(df: DataFrame, wanted: DataFrame, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """Rows of ``wanted`` that no live entry answers."""
    return wanted.join(live(newest_by_seq(df, key, seq), value=value).select(key), key, "left_anti")


def seek(df: DataFrame, target, start=None, end=None, key: str = "key") -> DataFrame:
    """The first row with key >= target, never before ``start`` and always before ``end``: a top-1, not a sort."""
    low = target if start is None else max(target, start)
    return df.where(in_range(F.col(key), low, end)).orderBy(key).limit(1)


def successors(df: DataFrame, n_ranges: int | None = None, key: str = "key") -> DataFrame:
    """Each key with the next one in order, ``next_key`` (null for the last).

    Keys are dealt into ordered ranges, by default as many as the session has shuffle partitions, and settled, as the ranges'
    bounds come from a sample. Within a range ``lead`` finds the next, and the first key of the following non-empty range, a
    table of ``n_ranges`` rows, closes the gap.
    """
    n_ranges = n_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settle(df.select(key).repartitionByRange(n_ranges, key).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part").orderBy(key)
    inner = parts.withColumn("next_key", F.lead(key).over(w))
    heads = parts.groupBy("__part").agg(F.min(key).alias("__head"))
    after = heads.withColumn("__after", F.lead("__head").over(Window.orderBy("__part"))).select("__part", "__after")
    return inner.join(F.broadcast(after), "__part").select(key, F.coalesce("next_key", "__after").alias("next_key"))


def history(df: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """All versions with their age: 1 is the newest (order: key ascending, seq descending)."""
    return df.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(F.col(seq).desc())).cast("bigint"))
