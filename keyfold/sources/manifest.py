"""The manifest: structural records as rows to replay, and versions as files committed atomically."""

from __future__ import annotations

import json
import uuid
import zlib

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ConflictError, CorruptionError, NotFoundError

FLUSH, COMPACT, LOG, CHECKPOINT = 1, 2, 3, 4


def valid_records(records: DataFrame, ok: Column) -> DataFrame:
    """Records before the first bad one."""
    bad = records.where(~ok).agg(F.min("ordinal").alias("bad"))
    return records.crossJoin(F.broadcast(bad)).where(F.col("bad").isNull() | (F.col("ordinal") < F.col("bad"))).drop("bad")


def since_checkpoint(records: DataFrame) -> DataFrame:
    """The last checkpoint and what follows it; all records if there is none."""
    last = records.where(F.col("tag") == CHECKPOINT).agg(F.max("ordinal").alias("at"))
    return records.crossJoin(F.broadcast(last)).where(F.col("at").isNull() | (F.col("ordinal") >= F.col("at"))).drop("at")


def replay(records: DataFrame) -> DataFrame:
    """The runs of the newest version: added and not removed since the last checkpoint (ids are never added twice)."""
    rows = since_checkpoint(records)
    added = rows.select(F.inline("added"))
    removed = rows.select(F.explode("removed").alias("run_id"))
    return added.join(removed, "run_id", "left_anti")


def added_twice(records: DataFrame) -> DataFrame:
    """Run ids that records since the last checkpoint add more than once; a sound manifest has none, which ``replay`` relies on."""
    added = since_checkpoint(records).select(F.explode("added.run_id").alias("run_id"))
    return added.groupBy("run_id").agg(F.count("*").alias("times")).where("times > 1")


def next_run_id(records: DataFrame) -> DataFrame:
    """One row: the largest id ever added, or reserved by a checkpoint, plus one."""
    ids = records.select(F.explode("added.run_id").alias("id")).union(records.select(F.col("next_run_id") - 1))
    return ids.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("bigint").alias("next_run_id"))


def log_number(records: DataFrame) -> DataFrame:
    """One row: the newest log number; older segments are not replayed."""
    return records.where("log_number is not null").agg(F.coalesce(F.max_by("log_number", "ordinal"), F.lit(0)).alias("log_number"))


def encode(record: dict) -> str:
    """A record with the checksum of its text."""
    body = json.dumps(record, sort_keys=True)
    return json.dumps({"crc": zlib.crc32(body.encode()), "body": body})


def decode(text: str) -> dict:
    try:
        outer = json.loads(text)
        body = outer["body"]
        if zlib.crc32(body.encode()) != outer["crc"]:
            raise CorruptionError("a manifest record's checksum does not match")
        return json.loads(body)
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise CorruptionError(f"a manifest record cannot be read: {e}") from e


def apply(state: dict | None, record: dict) -> dict:
    """The state after one more record. A run's id that was given out before is never added again."""
    if record["tag"] == CHECKPOINT:
        return record["state"]
    if state is None:
        raise CorruptionError("a manifest begins with a checkpoint")
    added, removed = record.get("added", []), set(record.get("removed", []))
    if any(r["run_id"] < state["next_run_id"] for r in added):
        raise CorruptionError("a run id is added again")
    if not removed <= {r["run_id"] for r in state["runs"]}:
        raise CorruptionError("a run is removed that is not there")
    return state | {
        "version": state["version"] + 1,
        "runs": [r for r in state["runs"] if r["run_id"] not in removed] + added,
        "next_run_id": max([state["next_run_id"], *(r["run_id"] + 1 for r in added)]),
        "log": ([] if record["tag"] == FLUSH else state["log"]) + record.get("segments", []),
        "batches": state["batches"] | record.get("batch", {}),
    } | record.get("set", {})


class ManifestLog:
    """Versions 1, 2, ... as JSON files in ``<path>/manifest``, each one record; creating a version's file is its commit.

    A record says what a write, a flush or a compaction changed; every EVERY-th is a checkpoint of the whole state, so a commit is as
    large as its change and opening reads EVERY files at most. A lock file is created exclusively through Hadoop's file system, so of two
    writers one fails; a lock that a lost writer left goes after STALE_MS. Commits are renamed in whole, so a record that cannot be
    read is no torn write but damage, and opening reports it. ``prune`` removes old versions.
    """

    STALE_MS, EVERY = 600_000, 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.dir = spark, f"{path}/manifest"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(self.dir))

    def _file(self, version: int):
        return self._path(f"{self.dir}/{version:020d}.json")

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path(self.dir))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def base(self, version: int) -> int:
        """The checkpoint that a version is read from."""
        return version - (version - 1) % self.EVERY

    def load(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if not known:
            return None
        version = version or known[-1]
        if version not in known:
            raise NotFoundError(f"manifest version {version}")
        state = None
        for v in range(self.base(version), version + 1):
            if v not in known:
                raise NotFoundError(f"manifest version {v}")
            try:
                stream = self.fs.open(self._file(v))
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
            except Py4JJavaError as e:
                raise CorruptionError(f"manifest version {v}: {e.java_exception}") from e
            state = apply(state, decode(text))
        return state

    def commit(self, state: dict, record: dict) -> dict:
        """Publish ``record``, what changes ``state``, as the next version, and return the state after it; a ConflictError if that version exists."""
        after = apply(state, record)
        version = after["version"]
        if self.base(version) == version:
            record = {"tag": CHECKPOINT, "state": after}
        name = self._file(version)
        if self.fs.exists(name):
            raise ConflictError(f"version {version} is taken")
        tmp = self._path(f"{self.dir}/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(tmp, False)
        out.write(bytearray(encode(record).encode()))
        out.close()
        lock = self._path(f"{self.dir}/{version:020d}.json.lock")
        # Age by the file system's own clock: the file written just now is as new as can be.
        if self.fs.exists(lock) and self.fs.getFileStatus(tmp).getModificationTime() - self.fs.getFileStatus(lock).getModificationTime() > self.STALE_MS:
            self.fs.delete(lock, False)
        if not self.fs.createNewFile(lock):
            self.fs.delete(tmp, False)
            raise ConflictError(f"version {version} is being written")
        if self.fs.exists(name) or not self.fs.rename(tmp, name):
            self.fs.delete(tmp, False)
            self.fs.delete(lock, False)
            raise ConflictError(f"version {version} is taken")
        self.fs.delete(lock, False)
        return after

    def prune(self, keep: set[int]) -> None:
        """Remove versions that no version to keep, nor the newest, is read from."""
        known = self.versions()
        needed = {v for k in {*keep, *known[-1:]} for v in range(self.base(k), k + 1)}
        for v in known:
            if v not in needed:
                self.fs.delete(self._file(v), False)
