"""Compaction: planning as queries over run metadata, execution as a merge, and safe removal of tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settle
from .merge import is_tombstone, newest_wins


def run_metadata(entries: DataFrame, run: str = "run_id", key: str = "key", seq: str = "seq") -> DataFrame:
    """Per run: key range, sequence range and number of keys (tombstones count)."""
    return entries.groupBy(run).agg(
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
        F.countDistinct(key).alias("entry_count"),
        F.min(seq).alias("min_seq"),
        F.max(seq).alias("max_seq"),
    )


def overlapping(runs: DataFrame, low, high) -> DataFrame:
    """Runs whose closed key range meets [low, high]."""
    return runs.where((F.col("min_key") <= F.lit(high)) & (F.col("max_key") >= F.lit(low)))


def overlap_pairs(runs: DataFrame, per_bucket: int = 64) -> DataFrame:
    """Pairs run_a < run_b with overlapping ranges, by an equality join on buckets of key ranges.

    Buckets hold ``per_bucket`` of the runs' least keys each; a run is in all buckets its range meets, and a pair is told in the first
    that both are in. Runs that meet nothing but neighbours are compared with these alone. Bounds are a row a bucket.
    """
    order = Window.orderBy("min_key")  # of metadata: a row a run
    heads = runs.select("min_key").distinct().withColumn("n", F.row_number().over(order))
    bounds = heads.where(F.pmod(F.col("n") - 1, F.lit(per_bucket)) == 0).select(((F.col("n") - 1) / per_bucket).cast("int").alias("bucket"), F.col("min_key").alias("low"))
    spans = bounds.withColumn("high", F.lead("low").over(Window.orderBy("low")))
    meets = (F.col("max_key") >= F.col("low")) & (F.col("high").isNull() | (F.col("min_key") < F.col("high")))
    inside = settle(runs.select("run_id", "min_key", "max_key").join(F.broadcast(spans), meets).select("run_id", "min_key", "max_key", "bucket", "low"))
    a, b = inside.alias("a"), inside.alias("b")
    meet = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.run_id") < F.col("b.run_id"))
    meet = meet & (F.col("a.min_key") <= F.col("b.max_key")) & (F.col("b.min_key") <= F.col("a.max_key"))
    first = (F.col("a.min_key") >= F.col("a.low")) | (F.col("b.min_key") >= F.col("b.low"))  # one begins here, so no earlier bucket has both
    return a.join(b, meet & first).select(F.col("a.run_id").alias("run_a"), F.col("b.run_id").alias("run_b"))


def size_tiered_pick(runs: DataFrame, threshold: int) -> DataFrame:
    """Inputs (run_id, level, output_level) of the next size-tiered task; none below ``threshold`` runs in level 0.

    All runs of level 0 and the runs of level 1 that meet their joint range go to level 1.
    """
    top = runs.where("level = 0").agg(F.count("*").alias("n"), F.min("min_key").alias("lo"), F.max("max_key").alias("hi")).where(F.col("n") >= threshold)
    hit = (F.col("level") == 0) | ((F.col("level") == 1) & (F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo")))
    return runs.join(F.broadcast(top), hit).select("run_id", "level", F.lit(1).alias("output_level"))


def level_budgets(base: int, multiplier: int, max_levels: int) -> list[tuple[int, int]]:
    """(level, bytes allowed) for the levels that can be compacted into the next."""
    return [(i, base * multiplier ** (i - 1)) for i in range(1, max_levels - 1)]


def leveled_pick(runs: DataFrame, budgets: list[tuple[int, int]]) -> DataFrame:
    """Inputs of the next leveled task: of the first level strictly over its budget the run in position 0, and what it meets one level down."""
    spark = runs.sparkSession
    allowed = spark.createDataFrame(budgets, "level int, budget bigint")
    over = (
        runs.groupBy("level")
        .agg(F.sum("file_size").alias("bytes"))
        .join(F.broadcast(allowed), "level")
        .where("bytes > budget")
        .agg(F.min("level").alias("from_level"))
        .where("from_level is not null")
    )
    picked = runs.join(F.broadcast(over), (F.col("level") == F.col("from_level")) & (F.col("pos") == 0)).select(
        F.col("run_id").alias("p_id"), "from_level", F.col("min_key").alias("lo"), F.col("max_key").alias("hi")
    )
    below = (F.col("level") == F.col("from_level") + 1) & (F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo"))
    return runs.join(F.broadcast(picked), (F.col("run_id") == F.col("p_id")) | below).select(
        "run_id", "level", (F.col("from_level") + 1).alias("output_level")
    )


def bottommost(runs: DataFrame, task: DataFrame, max_levels: int) -> DataFrame:
    """One row (output_level, bottommost): nothing deeper meets the task's range, or there is nothing deeper."""
    span = (
        runs.join(task.select("run_id", "output_level"), "run_id")
        .groupBy("output_level")
        .agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))
    )
    deeper = runs.select(F.col("level").alias("d_level"), F.col("min_key").alias("d_min"), F.col("max_key").alias("d_max"))
    meets = (F.col("d_level") > F.col("output_level")) & (F.col("d_min") <= F.col("hi")) & (F.col("d_max") >= F.col("lo"))
    return (
        span.join(deeper, meets, "left")
        .groupBy("output_level")
        .agg(F.count("d_level").alias("n"))
        .select("output_level", ((F.col("output_level") >= max_levels - 1) | (F.col("n") == 0)).alias("bottommost"))
    )


def compact_entries(entries: DataFrame, bottom: bool, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """One version per key; tombstones go only at the bottom, after the merge."""
    merged = newest_wins(entries, [key], [F.col(seq).desc()])
    return merged.where(~is_tombstone(value=value)) if bottom else merged


def swap(runs: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The next version's runs: inputs out, outputs in."""
    return runs.join(removed.select("run_id"), "run_id", "left_anti").unionByName(added)


def read_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in which two read results differ, either way; none if compaction kept every read."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def runs_per_level(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level").agg(F.count("*").alias("n_runs"), F.sum("entry_count").alias("entries"))


def positions(runs: DataFrame) -> DataFrame:
    """Numbers the runs of each level by id, the order in which they were added."""
    w = Window.partitionBy("level").orderBy("run_id")
    return runs.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
