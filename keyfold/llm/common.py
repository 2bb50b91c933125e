"""Helpers shared by the operators: checkpoints, sizing, components, and whole-batch text arithmetic in numpy.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text, which is what the regular
expression ``[^\\x20\\x09-\\x0D]+`` finds. 64-bit hashes are computed alike in every process; they propose what is equal, and
the words themselves decide.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
#: Bytes of text handled at a time inside a Python worker.
SLICE_BYTES = 1 << 20
#: Stands for a missing doc_id inside shuffles; it sorts after every other id.
NO_ID = (1 << 63) - 1

_U = np.uint64


# ---------------------------------------------------------------- Spark side


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where the session names none, a temporary one if all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="keyfold-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: lost executors cost a reread, never a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def quoted(name: str) -> str:
    """A column's name as Spark's parser reads it, dots and all."""
    return f"`{name.replace('`', '``')}`"


def unused(name: str, df: DataFrame) -> str:
    """``name`` with as many underscores in front as keep it apart from all columns, which Spark tells apart regardless of case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` but those called like one of ``names``, regardless of case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def numbered(df: DataFrame) -> DataFrame:
    """The columns under plain names, for functions over batches, which go by position and whose schema names the result."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


class Table:
    """A Parquet table in the shared folder for wide intermediate rows; ``drop`` it once nothing lazy reads it."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{ensure_checkpoint_dir(self.spark)}/keyfold-{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(conf).delete(path, True)


def partitions(df: DataFrame, target_bytes: int) -> int:
    """Shuffle partitions so that one holds about ``target_bytes`` of input as stored, by the plan's own statistics."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, math.ceil(size / target_bytes)) if size < 1 << 60 else least


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row (node, comp) per node, comp the smallest node reached.

    Alternating large-star and small-star rounds over edge rows, each checkpointed, until only stars are left; nothing but that
    reaches the driver, and a hub's rows are dealt by a join that adaptive execution can split.
    """
    edges = settle(edges.select("a", "b").where("a <> b").distinct())

    def star(e: DataFrame, small: bool) -> DataFrame:
        if small:
            near = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = settle(least)  # settled, it makes the join below one of two shuffles, which can split a hub's rows
        linked = near.join(least, "u")
        if small:
            out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        else:
            out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    def settled(e: DataFrame) -> bool:
        """Whether every edge leads from a node of no other edge to its root."""
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        ends = e.select(F.col("a").alias("n"), one.alias("out"), zero.alias("in")).union(e.select("b", zero, one))
        each = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        return not each.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).limit(1).count()

    while not settled(edges):
        edges = settle(star(edges, small=False))
        edges = settle(star(edges, small=True))
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots)


# ---------------------------------------------------------------- numpy side


def process_state() -> dict:
    """Tables and caches that outlive a task in its Python worker; code that travels by value has no module of its own there."""
    import sys
    import types

    module = sys.modules.setdefault("_keyfold_process_state", types.ModuleType("_keyfold_process_state"))
    return module.__dict__.setdefault("held", {})


def claim(owner: str) -> dict:
    """The process state for one operator's tasks: what another operator left there in this worker goes first."""
    state = process_state()
    if state.get("owner") != owner:
        state.clear()
        state["owner"] = owner
    return state


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def digests(parts: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each byte string."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=_U, count=len(parts))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of what ``a`` stands for followed by what ``b`` stands for."""
    return mix(a * _U(0x9E3779B97F4A7C15) + mix(b + _U(0xD6E8FEB86659FD93)))


def _doubled(units: np.ndarray, width: int, pair) -> np.ndarray:
    """A value for every run of ``width`` units, put together by ``pair`` from runs whose lengths are powers of two."""
    part, size, out, have = units, 1, None, 0
    while size <= width:
        if width & size:
            n = len(units) - have - size + 1
            if n <= 0:
                return units[:0]
            out, have = (part, size) if out is None else (pair(out[:n], part[have : have + n]), have + size)
        if 2 * size <= width:
            if len(part) <= size:
                return units[:0]
            part = pair(part[:-size], part[size:])
        size *= 2
    return out


def window_hash(units: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` units, equal for equal runs wherever they stand."""
    return _doubled(units, width, joined)


def window_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for every run of ``width`` numbered units: the same number if and only if the runs are the same."""

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (np.int64(b.max()) + 1) + b, return_inverse=True)[1] if len(a) else a

    return _doubled(np.unique(ids, return_inverse=True)[1] if len(ids) else ids, width, pair)


def same_windows(ids: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the runs of ``width`` units from ``a`` and from ``b`` on are the same, unit by unit."""
    same = np.ones(len(a), dtype=bool)
    for t in range(width):
        same &= ids[a + t] == ids[b + t]
    return same


def repeated(whash: np.ndarray, at: np.ndarray, ids: np.ndarray, width: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows that start ``at``: those that stand twice or more in their group, and those that are not the first such.

    Equal hashes only propose; the windows' units and their groups' numbers decide.
    """
    h = joined(whash, group.astype(_U))
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return at[:0], at[:0]
    hit = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)
    by = hit[np.argsort(h[hit], kind="stable")]
    same = h[by[1:]] == h[by[:-1]]
    one, other = by[1:][same], by[:-1][same]
    if not (same_windows(ids, at[one], at[other], width) & (group[one] == group[other])).all():
        # Unlike windows with one hash: the windows' own numbers and the groups' take the hashes' place.
        key = np.unique(window_ids(ids, width)[at] * (np.int64(group.max()) + 1) + group, return_inverse=True)[1]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        return at[np.unique(np.concatenate((by[1:][same], by[:-1][same])))], at[np.sort(by[1:][same])]
    return at[np.sort(hit)], at[np.sort(one)]


class Units:
    """Units (words or lines) of several texts, told apart by their bytes and not by a hash.

    ``ids`` numbers the units, equal ones alike; ``distinct`` has each number's unit; ``bounds`` is the first unit of each text,
    ``doc`` the text of each unit, and ``rows`` the units text by text. ``hashes`` are 64-bit values that mean the same in every process;
    who compares these confirms by ``ids``.
    """

    def __init__(self, rows: list[list[bytes]]):
        number: defaultdict = defaultdict(count().__next__)
        self.rows = rows
        self.bounds = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
        self.ids = np.fromiter(map(number.__getitem__, chain.from_iterable(rows)), np.int64, count=int(self.bounds[-1]))
        self.distinct = list(number)
        self.doc = np.repeat(np.arange(len(rows)), np.diff(self.bounds))

    @property
    def hashes(self) -> np.ndarray:
        return digests(self.distinct)[self.ids]

    def __len__(self) -> int:
        return len(self.ids)


class Words(Units):
    """The words of several texts, A-Z lower-cased if ``lower``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        super().__init__([(t.lower() if lower else t).split() for t in texts])


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null becomes empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that hold about ``limit`` bytes; a longer text makes a slice of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
