"""The durable store: an operation log, immutable sorted runs and a manifest, read by one merge expression."""

from __future__ import annotations

import base64
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.cache import LRU
from ..functions.records import checksum, encoded_size, valid_prefix
from ..operators import reads
from ..operators.compaction import compact_entries, level_budgets, leveled_pick, size_tiered_pick
from ..operators.merge import live, newest_by_seq
from ..schema import DELETE, ENTRIES, LOGGED, PUT, CompactionStyle, CorruptionError, EngineError, NotFoundError, Options
from .manifest import CHECKPOINT, COMPACT, FLUSH, LOG, ManifestLog, apply


def _b(x: bytes | None) -> str | None:
    return None if x is None else base64.b64encode(bytes(x)).decode()


def _u(x: str | None) -> bytes | None:
    return None if x is None else base64.b64decode(x)


class Snapshot:
    """A pinned version: its runs, its log and its last sequence number. Later writes, flushes and compactions do not show."""

    def __init__(self, store: Store, state: dict):
        self.store, self.state, self.seq = store, state, state["next_seq"] - 1
        self.pin = store._pin(state["version"])

    def release(self) -> None:
        self.store.manifest.fs.delete(self.pin, False)

    def get(self, key: bytes) -> bytes | None:
        return self.store._get(self.state, key)

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return self.store._scan(self.state, start, end)

    def multi_get(self, wanted: DataFrame) -> DataFrame:
        return reads.multi_get(self.store._entries(self.state), wanted)


class Store:
    """One writer, many readers. Batches are the unit: ``put``/``delete`` of one key are for tests and small fixes."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        """Open or create. Records of the log are checked against their checksums; a segment counts up to its first bad one."""
        self.spark, self.path, self.options = spark, path, options or Options()
        self.manifest = ManifestLog(spark, path)
        self.cache, self.bytes_read = LRU(self.options.block_cache_size), 0
        self.state = self.manifest.load() or {
            "version": 0, "next_seq": 1, "next_run_id": 1, "next_segment": 1, "log": [], "runs": [], "bytes_written": 0,
            "compaction_count": 0, "compaction_bytes": 0, "batches": {},
        }
        self._recover()
        self.published, self.pending, self.synced = self.state, [], time.monotonic()

    def _recover(self) -> None:
        """Marks segments of the log that hold a bad record with the number before it; what they hold from there on is not replayed."""
        if not self.state["log"]:
            return
        number = F.element_at(F.split("_metadata.file_path", "/"), -2)
        try:
            log = self._read([x["path"] for x in self.state["log"]], LOGGED).withColumn("segment", number)
            sound = F.col("crc").eqNullSafe(checksum())
            bad = log.where(~sound).select("segment").distinct()
            good = valid_prefix(log.join(bad, "segment", "left_semi"), sound).groupBy("segment").agg(F.max("seq").alias("last"))
            upto = {r.segment: r.last or 0 for r in bad.join(good, "segment", "left").collect()}  # bad segments only
        except (Py4JJavaError, PySparkException) as e:
            raise CorruptionError(f"the log cannot be read: {e}") from e
        log = [x | ({"upto": upto[x["path"].split("/")[-1]]} if x["path"].split("/")[-1] in upto else {}) for x in self.state["log"]]
        self.state = self.state | {"log": log}

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *failure) -> None:
        if failure[0] is None:
            self.close()

    # ------------------------------------------------------------ writes

    def _commit(self, tag: int, **changes) -> None:
        """Publish what changed as the next version, after the writes that wait for it."""
        self.sync()
        self.state = self.published = self.manifest.commit(self.state, {"tag": tag, **changes})

    def sync(self) -> None:
        """Commit the writes that the sync policy holds back, in one version; if another writer was first, they are dropped."""
        waiting, self.pending, self.synced = self.pending, [], time.monotonic()
        if waiting:
            record = {
                "tag": LOG, "segments": [x for r in waiting for x in r["segments"]], "batch": {k: v for r in waiting for k, v in r["batch"].items()},
                "set": waiting[-1]["set"],
            }
            self.state = self.published  # what stays if the commit fails
            self.state = self.published = self.manifest.commit(self.published, record)

    def _log(self, record: dict) -> None:
        """Take a write into the state, and commit it if it is time."""
        self.pending.append(record)
        self.state = apply(self.state, record) | {"version": self.state["version"]}
        policy = self.options.sync
        late = policy.every_ms is not None and 1000 * (time.monotonic() - self.synced) >= policy.every_ms
        if late or (policy.every_n is not None and len(self.pending) >= policy.every_n):
            self.sync()

    @property
    def writes_since_sync(self) -> int:
        return len(self.pending)

    @property
    def offset(self) -> int:
        """Bytes of the log as encoded records, committed or not."""
        return sum(x["size"] for x in self.state["log"])

    def _pin(self, version: int):
        """A file that keeps a version's data from ``vacuum``, whichever process runs it."""
        pin = self.manifest._path(f"{self.path}/pins/{version}-{uuid.uuid4().hex}")
        self.manifest.fs.create(pin, False).close()
        return pin

    def write(self, ops: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> None:
        """Append (key, value, op) rows to the log in the order of column ``order``; without it keys must be unique.

        Rows are range-partitioned by ``order`` and numbered partition after partition, so numbers ascend with it (they may
        skip). Each row carries its record's checksum. ``batch`` is a stream's name and the batch's number, which ascends; a number up to the
        last one committed under that name is not written again, so the state holds one number a stream.
        """
        if batch is not None and batch[1] <= self.state["batches"].get(batch[0], -1):
            return
        cols = [F.col("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"), F.col("op").cast("tinyint").alias("op")]
        if order is not None:
            ops = ops.repartitionByRange(order).sortWithinPartitions(order)
        rows = ops.select(*cols).withColumn("seq", F.monotonically_increasing_id() + F.lit(self.state["next_seq"]))
        segment = f"oplog/{self.state['next_segment']:06d}-{uuid.uuid4().hex}"
        told = Observation()
        rows = rows.select("key", "value", "seq", "op", checksum().alias("crc")).observe(
            told, F.count(F.lit(1)).alias("n"), F.max("seq").alias("top"), F.sum(F.octet_length("key") + F.octet_length("value")).alias("bytes"),
            F.sum(encoded_size()).alias("size"), F.count(F.when(F.col("key").isNull(), 1)).alias("nulls"),
        )
        rows.write.parquet(f"{self.path}/{segment}")
        done = told.get
        if done["nulls"]:
            raise EngineError("a key must not be null")
        if not done["n"]:
            return
        self._log({
            "tag": LOG,
            "segments": [{"id": self.state["next_segment"], "path": segment, "rows": done["n"], "bytes": done["bytes"], "size": done["size"]}],
            "batch": dict([batch]) if batch is not None else {},
            "set": {"next_seq": done["top"] + 1, "next_segment": self.state["next_segment"] + 1, "bytes_written": self.state["bytes_written"] + done["bytes"]},
        })
        if self.is_full():
            self.flush()

    def is_full(self) -> bool:
        """Whether the log has grown to the size at which it is flushed."""
        return sum(x["bytes"] for x in self.state["log"]) >= self.options.memtable_size

    def segments(self) -> list[int]:
        """The numbers of the log's segments, oldest first; a new one gets the greatest ever plus one."""
        return sorted(x["id"] for x in self.state["log"])

    def put_all(self, rows: DataFrame, order: str | None = None) -> None:
        self.write(rows.withColumn("op", F.lit(PUT)), order)

    def delete_all(self, keys: DataFrame) -> None:
        self.write(keys.select("key", F.lit(b"").alias("value"), F.lit(DELETE).alias("op")))

    def put(self, key: bytes, value: bytes) -> None:
        self.write(self.spark.createDataFrame([(bytearray(key), bytearray(value), PUT)], "key binary, value binary, op tinyint"))

    def delete(self, key: bytes) -> None:
        self.write(self.spark.createDataFrame([(bytearray(key), bytearray(b""), DELETE)], "key binary, value binary, op tinyint"))

    def _write_runs(self, entries: DataFrame, level: int, split: bool) -> list[dict]:
        """Runs of one version per key, sorted by key and in order of it; none if nothing is left to write.

        ``entries`` are merged and dealt by key ranges. Each range
        is a file; if ``split``, files are put together to runs of ``run_size`` bytes, else all are one run.
        """
        path = f"runs/{uuid.uuid4().hex}"
        (
            entries.select("key", "value", "seq", "op")
            .sortWithinPartitions("key")
            .write.option("parquet.bloom.filter.enabled#key", "true")
            .option("parquet.bloom.filter.fpp#key", str(0.5 ** (self.options.bloom_bits_per_key / 1.44)))
            .option("parquet.page.size", str(self.options.block_size))
            .parquet(f"{self.path}/{path}")
        )
        files = (
            self._read([path])
            .groupBy(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"))
            .agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"), F.min("seq").alias("s0"), F.max("seq").alias("s1"))
            .collect()  # a row a range
        )
        groups: list[list] = []
        for f in sorted(files, key=lambda x: bytes(x.lo)):
            if not groups or (split and sum(x.size for x in groups[-1]) + f.size > self.options.run_size):
                groups.append([])
            groups[-1].append(f)
        return [
            {
                "run_id": self.state["next_run_id"] + i, "level": level, "paths": [f"{path}/{x.name}" for x in g], "min_key": _b(g[0].lo),
                "max_key": _b(g[-1].hi), "file_size": sum(x.size for x in g), "entry_count": sum(x.n for x in g), "min_seq": min(x.s0 for x in g),
                "max_seq": max(x.s1 for x in g),
            }
            for i, g in enumerate(groups)
        ]

    def _dealt(self, df: DataFrame) -> DataFrame:
        """By key ranges: a window over keys above needs no other shuffle, and the sample that sets the bounds reads and does not merge."""
        return df.repartitionByRange(self.options.key_partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions")), "key")

    def flush(self) -> None:
        """The log's newest version of each key, tombstones too, becomes a run at the end of level 0; an empty log does nothing."""
        if not self.state["log"]:
            return
        self.sync()
        self._commit(FLUSH, added=self._write_runs(newest_by_seq(self._dealt(self._tail(self.state))), 0, split=False))

    def close(self) -> None:
        self.flush()
        self.sync()

    # ------------------------------------------------------------ reads

    def _read(self, paths: list[str], schema: str = ENTRIES) -> DataFrame:
        for p in paths:
            if not self.manifest.fs.exists(self.manifest._path(f"{self.path}/{p}")):
                raise NotFoundError(p)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def check(self) -> None:
        """Reads every run's files; a CorruptionError if one cannot be read or does not hold what the manifest says."""
        for run in self.state["runs"]:
            try:
                got = self._read(run["paths"]).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
            except (Py4JJavaError, PySparkException) as e:
                raise CorruptionError(f"run {run['run_id']} cannot be read: {e}") from e
            if (got.n, _b(got.lo), _b(got.hi)) != (run["entry_count"], run["min_key"], run["max_key"]):
                raise CorruptionError(f"run {run['run_id']} does not hold what the manifest says")

    def _tail(self, state: dict) -> DataFrame:
        if not state["log"]:
            return self.spark.createDataFrame([], ENTRIES)
        whole = [x["path"] for x in state["log"] if "upto" not in x]
        parts = [self._read(whole)] if whole else []
        parts += [self._read([x["path"]]).where(F.col("seq") <= x["upto"]) for x in state["log"] if "upto" in x]
        return reduce(DataFrame.unionByName, parts)

    def _entries(self, state: dict, start: bytes | None = None, end: bytes | None = None, closed: bool = False) -> DataFrame:
        """All versions that a range may need: runs are pruned by their key ranges before any file is opened."""

        def needed(r: dict) -> bool:
            past = end is not None and (_u(r["min_key"]) > end or (not closed and _u(r["min_key"]) == end))
            return not past and (start is None or _u(r["max_key"]) >= start)

        runs = [r for r in state["runs"] if needed(r)]
        for r in runs:
            self._touch(r)
        parts = ([self._read([p for r in runs for p in r["paths"]])] if runs else []) + [self._tail(state)]
        return reduce(DataFrame.unionByName, parts)

    def _touch(self, run: dict) -> None:
        """Counts what a read opens: files of a run not opened lately, within ``block_cache_size`` bytes, are read anew."""
        if self.cache.get((run["run_id"], 0)) is None:
            self.cache.insert((run["run_id"], 0), run["file_size"])
            self.bytes_read += run["file_size"]

    def _get(self, state: dict, key: bytes) -> bytes | None:
        got = reads.get(self._entries(state, key, key, closed=True), bytearray(key)).select("value").head(1)
        return bytes(got[0].value) if got else None

    def _scan(self, state: dict, start: bytes | None, end: bytes | None) -> DataFrame:
        a, b = (None if x is None else bytearray(x) for x in (start, end))
        return reads.scan(self._entries(state, start, end), a, b).select("key", "value")

    def get(self, key: bytes) -> bytes | None:
        return self._get(self.state, key)

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """Live (key, value) rows of [start, end) in key order."""
        return self._scan(self.state, start, end)

    def multi_get(self, wanted: DataFrame) -> DataFrame:
        return reads.multi_get(self._entries(self.state), wanted)

    def snapshot(self) -> Snapshot:
        self.sync()
        return Snapshot(self, self.state)

    # ------------------------------------------------------------ compaction

    @staticmethod
    def decode_key(text: str) -> bytes:
        """A bound of a run's key range as bytes."""
        return _u(text)

    def runs(self) -> list[dict]:
        """Run metadata in order of age, oldest first within each level."""
        return self.state["runs"]

    def _pick(self, runs: list[dict]) -> tuple[list[dict], int] | None:
        """The next task by the pickers' rules: full level 0 first, then, if leveled, the first level over its budget."""
        if not runs:
            return None
        o, rows, seen = self.options, [], {}
        for r in runs:
            rows.append((r["run_id"], r["level"], seen.setdefault(r["level"], 0), bytearray(_u(r["min_key"])), bytearray(_u(r["max_key"])), r["file_size"]))
            seen[r["level"]] += 1
        table = self.spark.createDataFrame(rows, "run_id bigint, level int, pos int, min_key binary, max_key binary, file_size bigint")
        task = size_tiered_pick(table, o.l0_threshold).collect()
        if not task and o.style is CompactionStyle.LEVELED:
            task = leveled_pick(table, level_budgets(o.level_base_bytes, o.level_size_multiplier, o.max_levels)).collect()
        chosen = {x.run_id for x in task}
        return ([r for r in runs if r["run_id"] in chosen], task[0].output_level) if task else None

    def compact_range(self, start: bytes | None = None, end: bytes | None = None) -> int:
        """Run tasks over the runs that meet [start, end] until none is due; the number of tasks run."""
        n = 0
        self.sync()
        while True:
            inside = [
                r for r in self.state["runs"] if (end is None or _u(r["min_key"]) <= end) and (start is None or _u(r["max_key"]) >= start)
            ]
            task = self._pick(inside)
            if task is None:
                return n
            self._run_task(*task)
            n += 1

    def _run_task(self, inputs: list[dict], level: int) -> None:
        gone = {r["run_id"] for r in inputs}
        # A level-0 run that stays behind may hold older versions than the inputs, and so may any deeper run in their range.
        lo, hi = min(_u(r["min_key"]) for r in inputs), max(_u(r["max_key"]) for r in inputs)
        bottom = not any(
            r["run_id"] not in gone and (r["level"] > level or r["min_seq"] < max(x["max_seq"] for x in inputs)) and lo <= _u(r["max_key"]) and _u(r["min_key"]) <= hi
            for r in self.state["runs"]
        )
        inputs_read = self._read([p for r in inputs for p in r["paths"]])
        added = self._write_runs(compact_entries(self._dealt(inputs_read), bottom), level, split=True)
        self._commit(
            COMPACT, added=added, removed=sorted(gone),
            set={
                "next_run_id": self.state["next_run_id"] + len(added), "compaction_count": self.state["compaction_count"] + 1,
                "compaction_bytes": self.state["compaction_bytes"] + sum(r["file_size"] for r in inputs),
            },
        )

    def checkpoint(self) -> None:
        """Publish the whole state as one record, from which later versions need no earlier one's changes."""
        self.sync()
        self._commit(CHECKPOINT, state=self.state | {"version": self.state["version"] + 1})

    def vacuum(self, older_ms: int = 3_600_000) -> int:
        """Delete files that neither the current version nor any pinned one needs and that are older than ``older_ms``; the number deleted.

        Pins are files, so snapshots of other processes count. Files of a writer that has not committed yet are young.
        """
        fs, path = self.manifest.fs, self.manifest._path
        mark = path(f"{self.path}/.{uuid.uuid4().hex}")
        fs.create(mark, False).close()
        now = fs.getFileStatus(mark).getModificationTime()
        fs.delete(mark, False)
        pins = path(f"{self.path}/pins")
        pinned = {int(f.getPath().getName().split("-")[0]) for f in fs.listStatus(pins)} if fs.exists(pins) else set()
        newest = self.manifest.load() or self.state
        keep = {self.state["version"], newest["version"], *pinned}
        needed: set[str] = set()
        for v in keep & set(self.manifest.versions()):
            state = self.manifest.load(v)
            needed |= {p for r in state["runs"] for p in r["paths"]} | {x["path"] for x in state["log"]}
        folders = {"/".join(p.split("/")[:2]) for p in needed}
        n = 0
        for kind in ("oplog", "runs"):
            folder = path(f"{self.path}/{kind}")
            for f in fs.listStatus(folder) if fs.exists(folder) else ():
                if now - f.getModificationTime() < older_ms:
                    continue
                name = f"{kind}/{f.getPath().getName()}"
                if name not in folders:
                    n += bool(fs.delete(f.getPath(), True))
                elif kind == "runs":  # some of its files make runs still in use
                    for x in fs.listStatus(f.getPath()):
                        own = x.getPath().getName()
                        if own.startswith("part-") and f"{name}/{own}" not in needed:
                            n += bool(fs.delete(x.getPath(), False))
        self.manifest.prune(keep)
        return n

    def stats(self) -> DataFrame:
        """One row of engine statistics; disk bytes include what compactions wrote.

        From the manifest but for reads, which this process counts: ``bytes_read`` and the hit rate are those of files opened, and Parquet's
        readers do not tell how often a Bloom filter spared them a page, so its rate is 0.
        """
        s, levels = self.state, max([1, *(r["level"] + 1 for r in self.state["runs"])])
        disk = sum(r["file_size"] for r in s["runs"])
        written = disk + s["compaction_bytes"]
        row = (
            sum(x["bytes"] for x in s["log"]), [sum(r["level"] == i for r in s["runs"]) for i in range(levels)], 0.0, self.cache.hit_rate(),
            s["bytes_written"], disk, written / s["bytes_written"] if s["bytes_written"] else 0.0, self.bytes_read, s["compaction_count"], s["compaction_bytes"],
        )
        return self.spark.createDataFrame(
            [row],
            "memtable_size bigint, num_runs_per_level array<int>, bloom_filter_hit_rate double, block_cache_hit_rate double, bytes_written bigint, "
            "total_run_bytes bigint, write_amplification double, bytes_read bigint, compaction_count bigint, compaction_bytes bigint",
        )


def live_view(store: Store) -> DataFrame:
    """All live entries, unordered, for further queries."""
    return live(newest_by_seq(store._entries(store.state)))
