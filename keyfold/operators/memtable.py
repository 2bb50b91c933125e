"""The part of the log not yet flushed, as an active and a frozen table of newest versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .merge import merge_sources, newest_by_seq


def sizes(log: DataFrame, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """Adds ``added``, the bytes by which each record made its table grow: key and value of a new key, the value alone of a known one.

    A table never shrinks, as an overwritten value's room is not given back. Node overhead, which is random, is left out.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy(seq)) == 1
    return log.withColumn("added", (F.octet_length(value) + F.when(first, F.octet_length(key)).otherwise(0)).cast("bigint"))


def size(log: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row: the size of the table that holds the log. Keys count once, values every time, so no order is needed."""
    by = log.groupBy(key).agg(F.sum(F.octet_length(value)).alias("v")).select((F.octet_length(key) + F.col("v")).alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("memtable_size"))


def frozen(log: DataFrame, freezes: list[int], key: str = "key", seq: str = "seq") -> DataFrame:
    """The newest version of each key in the active and the frozen table, tombstones too, in key order.

    ``freezes`` are the sequence numbers, ascending, after which the active table was frozen. Freezing puts the active table in the
    place of any frozen one, so only the last two stretches of the log are there.
    """
    cut = freezes[-1] if freezes else 0
    before = freezes[-2] if len(freezes) > 1 else 0
    active, immutable = log.where(F.col(seq) > cut), log.where((F.col(seq) <= cut) & (F.col(seq) > before))
    if not freezes:
        immutable = log.limit(0)
    return merge_sources([newest_by_seq(active, key, seq), newest_by_seq(immutable, key, seq)], key)
