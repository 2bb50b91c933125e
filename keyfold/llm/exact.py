"""Exact deduplication by distributed most-significant-digit radix partitioning: groups are split by successive bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, Table, quoted, settle

#: Bytes of the first digit, and how much wider each following digit is.
FIRST_DIGIT, GROWTH = 64, 16


def normalised(text: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")), f"{WS_CLASS}+", " ")


def _split(docs: DataFrame, key: str, text: str, first_digit: int, growth: int, carried: list[str]) -> tuple[DataFrame, DataFrame, Table]:
    """Rows (id, uid, alone, sha, c0, c1, ...) with the ``carried`` columns; verdicts (uid, keep_id, n, kept) on those not alone; the rows' table."""
    norm = F.encode(normalised(text), "UTF-8")
    base = docs.select(F.col(quoted(key)).cast("long").alias("id"), norm.alias("norm"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(carried)])
    base = base.withColumn("len", F.octet_length("norm")).withColumn("head", F.expr(f"substring(norm, 1, {first_digit})"))
    # Only groups of two or more are kept, and settled, so that the join has a shuffle on either side that can be split.
    shared = settle(base.groupBy("len", "head").agg(F.count("*").alias("n")).where("n > 1"))
    alone = F.col("n").isNull()
    table = Table(
        base.join(shared, ["len", "head"], "left").select(
            "id",
            F.monotonically_increasing_id().alias("uid"),
            alone.alias("alone"),
            F.sha2("norm", 256).alias("sha"),
            F.when(~alone, F.col("len")).alias("len"),
            F.when(~alone, F.col("head")).alias("head"),
            F.when(~alone, F.expr(f"substring(norm, {first_digit + 1})")).alias("rest"),
            *[f"c{i}" for i in range(len(carried))],
        )
    )
    state = table.read()
    active = state.where("not alone").select("id", "uid", "len", "head", F.lit(0).cast("long").alias("gid"), "rest")
    done = [active.limit(0).select("uid", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("kept"))]
    read, width = first_digit, first_digit
    while active.limit(1).count():
        width *= growth
        by = ["len", "head", "gid", "digit"]
        rows = active.withColumn("digit", F.expr(f"substring(rest, 1, {width})"))
        groups = settle(
            rows.groupBy(*by).agg(
                F.count("*").alias("n"),
                F.min("uid").alias("g"),
                F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("uid"))).alias("m"),
            )
        )
        read += width
        split = rows.join(groups, by).withColumn("ended", (F.col("n") == 1) | (F.col("len") <= read))
        split = settle(
            split.select(
                "id",
                "uid",
                "len",
                F.lit(b"").alias("head"),
                F.col("g").alias("gid"),
                F.when(~F.col("ended"), F.expr(f"substring(rest, {width + 1})")).alias("rest"),
                "n",
                F.col("m.id").alias("keep_id"),
                (F.col("m.uid") == F.col("uid")).alias("kept"),
                "ended",
            )
        )
        done.append(split.where("ended").select("uid", "keep_id", "n", "kept"))
        active = split.where("not ended").select("id", "uid", "len", "head", "gid", "rest")
    return state, reduce(DataFrame.union, done), table


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", first_digit: int = FIRST_DIGIT, growth: int = GROWTH
) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    The first digit of a text is its length in bytes and its first bytes; each round splits every group by the next
    digit, a longer run of bytes, until a group has one member or its texts have ended. A group's digits are counted by an
    aggregate with a map-side part, so a hot text costs a task one row; members then meet the counts in a join whose
    large partitions adaptive execution splits. Texts that are alone after the first round, nearly all, move once;
    only members of larger groups carry the unread rest of their text on. The digest is output, never compared.

    Null text equals empty text. The smallest key of a group stays; a row without a key stays only if its whole group
    lacks keys, and then its keep_id is null. Of rows with the same key and text exactly one stays. An empty table gives
    an empty table; other columns are not read.
    """
    state, verdicts, table = _split(docs, key, text, first_digit, growth, [])
    single = state.where("alone").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"), "sha")
    grouped = state.where("not alone").select("id", "uid", "sha").join(verdicts, "uid").select("id", "keep_id", "n", "kept", "sha")
    out = settle(single.union(grouped))
    table.drop()
    return out.select(F.col("id").alias(key), "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called; one row of each group of equal texts.

    Rows travel with their columns in the first round; those of groups are found again by their number. The table they wait in stays
    in the checkpoint folder, as the result reads it.
    """
    state, verdicts, _ = _split(docs, key, text, FIRST_DIGIT, GROWTH, docs.columns)
    columns = [f"c{i}" for i in range(len(docs.columns))]
    grouped = state.where("not alone").select("uid", *columns).join(verdicts.where("kept").select("uid"), "uid", "left_semi")
    return state.where("alone").select(*columns).union(grouped.select(*columns)).toDF(*docs.columns)
