"""The block layout of a run: greedy packing, index entries and file size, as a model over rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block besides entries: the count; of an entry besides key and value: two lengths and its offset.
BLOCK_OVERHEAD, ENTRY_OVERHEAD, OFFSET_BYTES = 2, 4, 2
FOOTER, META_FIXED, BLOOM_HEADER, INDEX_FIXED = 56, 28, 12, 18


def entry_size(key: str = "key", value: str = "value") -> Column:
    return (F.lit(ENTRY_OVERHEAD) + F.octet_length(key) + F.octet_length(value)).cast("bigint")


def pack_blocks(entries: DataFrame, block_size: int, run: str = "run_id", key: str = "key", size: str = "size") -> DataFrame:
    """Adds block_no (bigint): entries fill a block in key order until the next one does not fit; the first always does.

    The fill level carries over from row to row, so a run is read once, in order, by one task; memory holds one batch. Runs
    are the unit of size: compactions begin a new one after ``Options.run_size`` bytes, so tasks stay even.
    """
    schema = entries.schema
    columns = entries.columns

    def fold(frames: Iterator) -> Iterator:
        current, block, used, n = None, 0, 0, 0
        for f in frames:
            out = []
            for r, s in zip(f[run].tolist(), f[size].tolist(), strict=True):
                if r != current:
                    current, block, used, n = r, 0, 0, 0
                # The fit test counts the offsets so far, not the new entry's own.
                if n and used + OFFSET_BYTES * n + BLOCK_OVERHEAD + s > block_size:
                    block, used, n = block + 1, 0, 0
                used, n = used + s, n + 1
                out.append(block)
            yield f.assign(block_no=out)[[*columns, "block_no"]]

    dealt = entries.repartition(F.col(run)).sortWithinPartitions(run, key)
    return dealt.mapInPandas(fold, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "block_no bigint"]))


def block_index(packed: DataFrame, run: str = "run_id", key: str = "key", size: str = "size") -> DataFrame:
    """Per block its last key, number of entries, bytes, and offset in the run."""
    blocks = packed.groupBy(run, "block_no").agg(
        F.max(key).alias("last_key"),
        F.count("*").alias("n"),
        (F.sum(size) + OFFSET_BYTES * F.count("*") + BLOCK_OVERHEAD).cast("bigint").alias("bytes"),
    )
    before = Window.partitionBy(run).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("bigint"))


def file_sizes(index: DataFrame, metadata: DataFrame, bloom_bytes: Column, run: str = "run_id") -> DataFrame:
    """Rows (run_id, file_size): blocks, metadata, filter, index and footer."""
    per = index.groupBy(run).agg(
        F.sum(F.col("bytes") + INDEX_FIXED + F.octet_length("last_key")).alias("body")
    )
    fixed = META_FIXED + F.octet_length("min_key") + F.octet_length("max_key") + BLOOM_HEADER + bloom_bytes + FOOTER
    return per.join(metadata, run).select(run, (F.col("body") + fixed).cast("bigint").alias("file_size"))
