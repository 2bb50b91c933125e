"""The durable store against a dictionary: writes, reads, snapshots, compaction, recovery, conflicts, streams."""

import random

import pytest

from keyfold.schema import CompactionStyle, ConflictError, CorruptionError, EngineError, NotFoundError, Options
from keyfold.sources.store import Store
from keyfold.streaming.ingest import ingest, latest_per_key

SCHEMA = "key binary, value binary, op tinyint, n int"


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def batch(spark, ops):
    return spark.createDataFrame([(bytearray(k), bytearray(v), 2 if v == b"" else 1, i) for i, (k, v) in enumerate(ops)], SCHEMA)


@pytest.mark.parametrize("style", list(CompactionStyle))
def test_store_equals_a_dictionary(spark, tmp_path, style):
    r = random.Random(3)
    options = Options(memtable_size=100, l0_threshold=2, level_base_bytes=1, key_partitions=2, style=style)
    store, model, snap, frozen = Store(spark, str(tmp_path / "s"), options), {}, None, None
    for step in range(5):
        ops = [(b"k%02d" % r.randrange(30), b"" if r.random() < 0.3 else b"v%d.%d" % (step, i)) for i in range(25)]
        store.write(batch(spark, ops), order="n")
        for k, v in ops:
            model.pop(k, None) if v == b"" else model.__setitem__(k, v)
        if step == 2:
            snap, frozen = store.snapshot(), dict(model)
        if step == 3:
            assert store.compact_range() > 0
    assert pairs(store.scan()) == sorted(model.items())
    assert pairs(store.scan(b"k05", b"k20")) == sorted((k, v) for k, v in model.items() if b"k05" <= k < b"k20")
    assert pairs(snap.scan()) == sorted(frozen.items())
    assert store.get(b"none") is None and [store.get(k) for k in list(model)[:2]] == list(model.values())[:2]
    store.vacuum(older_ms=0)
    assert pairs(snap.scan()) == sorted(frozen.items())  # pinned
    snap.release()
    store.close()
    again = Store(spark, str(tmp_path / "s"), options)
    assert pairs(again.scan()) == sorted(model.items())
    assert again.vacuum(older_ms=0) > 0 and pairs(again.scan()) == sorted(model.items())
    s = again.stats().first()
    assert s.memtable_size == 0 and s.compaction_count > 0 and s.write_amplification >= 1


def test_a_crash_loses_nothing_that_was_written(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store(spark, path)
    store.put(b"a", b"1")
    store.put(b"b", b"2")
    store.delete(b"a")
    del store  # without close
    (tmp_path / "s" / "runs" / "orphan").mkdir(parents=True)
    (tmp_path / "s" / "oplog" / "of a writer at work").mkdir()
    again = Store(spark, path)
    assert pairs(again.scan()) == [(b"b", b"2")] and again.state["runs"] == []
    again.flush()
    again.flush()  # an empty log does nothing
    assert len(again.runs()) == 1 and again.runs()[0]["entry_count"] == 2  # the tombstone is written
    assert again.vacuum() == 0  # young files may be another writer's
    assert again.vacuum(older_ms=0) >= 2


def test_writers_conflict_and_files_are_checked(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = Store(spark, path), Store(spark, path)
    one.put(b"a", b"1")
    with pytest.raises(ConflictError):
        two.put(b"a", b"2")
    with pytest.raises(EngineError):
        one.write(spark.createDataFrame([(None, bytearray(b"x"), 1)], "key binary, value binary, op tinyint"))
    manifest = tmp_path / "s" / "manifest"
    lock = manifest / f"{2:020d}.json.lock"
    lock.touch()  # a writer that was lost between lock and rename
    with pytest.raises(ConflictError):
        one.put(b"b", b"1")
    import os

    os.utime(lock, (1, 1))
    one.put(b"b", b"1")
    assert pairs(Store(spark, path).scan()) == [(b"a", b"1"), (b"b", b"1")]
    with pytest.raises(NotFoundError):
        one.manifest.load(99)
    import shutil

    shutil.rmtree(tmp_path / "s" / one.state["log"][0]["path"])
    with pytest.raises(NotFoundError):
        one.get(b"a")
    newest = max(manifest.glob("*.json"))
    newest.write_text("{")
    (manifest / f".{newest.name}.crc").unlink(missing_ok=True)
    with pytest.raises(CorruptionError):
        Store(spark, path)


def test_stream_into_the_store(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "s")
    batch(spark, [(b"a", b"1"), (b"b", b"2"), (b"a", b"3")]).write.parquet(str(src))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(src))
    store = Store(spark, path)
    ingest(stream(), store, str(tmp_path / "c"), "n").awaitTermination()
    assert pairs(store.scan()) == [(b"a", b"3"), (b"b", b"2")]
    batch(spark, [(b"b", b"")]).write.mode("append").parquet(str(src))
    ingest(stream(), store, str(tmp_path / "c"), "n").awaitTermination()
    assert pairs(store.scan()) == [(b"a", b"3")]
    before = store.state["version"]
    store.write(batch(spark, [(b"z", b"9")]), "n", batch=("ops", 1))  # replayed after a failure
    assert store.state["version"] == before and store.get(b"z") is None
    q = latest_per_key(stream(), order="n").writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("latest").count() == 2


def test_snapshots_of_other_processes_are_kept(spark, tmp_path):
    path = str(tmp_path / "s")
    one = Store(spark, path, Options(l0_threshold=2, style=CompactionStyle.SIZE_TIERED))
    for v in (b"1", b"2"):
        one.put(b"a", v)
        one.flush()
    snap = Store(spark, path).snapshot()
    assert one.compact_range() == 1 and one.vacuum(older_ms=0) >= 0
    assert pairs(snap.scan()) == [(b"a", b"2")] and snap.get(b"a") == b"2"
    snap.release()
    assert one.vacuum(older_ms=0) > 0 and pairs(one.scan()) == [(b"a", b"2")]


def test_compactions_split_their_output(spark, tmp_path):
    options = Options(l0_threshold=2, key_partitions=6, run_size=1, style=CompactionStyle.SIZE_TIERED)
    store = Store(spark, str(tmp_path / "s"), options)
    for step in range(2):
        store.write(batch(spark, [(b"k%03d" % i, b"%d" % step) for i in range(60)]), order="n")
        store.flush()
    assert [r["level"] for r in store.runs()] == [0, 0] and store.compact_range() == 1
    runs = store.runs()
    assert len(runs) > 2 and all(Store.decode_key(a["max_key"]) < Store.decode_key(b["min_key"]) for a, b in zip(runs[:-1], runs[1:], strict=True))
    assert len({r["run_id"] for r in runs}) == len(runs) and store.state["next_run_id"] == max(r["run_id"] for r in runs) + 1
    store.check()
    assert pairs(store.scan()) == [(b"k%03d" % i, b"1") for i in range(60)]
    before = store.bytes_read
    assert store.get(b"k000") == b"1" and store.bytes_read <= before + max(r["file_size"] for r in runs)  # one run is opened
    plan = store._dealt(store._read([p for r in runs for p in r["paths"]]))
    from keyfold.operators.merge import newest_by_seq

    assert newest_by_seq(plan)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_damage_is_found(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(batch(spark, [(b"k%d" % i, b"v") for i in range(8)]), order="n")
    segment = tmp_path / "s" / store.state["log"][0]["path"]
    rows = spark.read.parquet(str(segment)).orderBy("seq").collect()
    hurt = [(r.key, bytearray(b"w") if i == 5 else r.value, r.seq, r.op, r.crc) for i, r in enumerate(rows)]
    spark.createDataFrame(hurt, "key binary, value binary, seq long, op tinyint, crc long").coalesce(1).write.mode("overwrite").parquet(str(segment))
    again = Store(spark, str(tmp_path / "s"))  # what follows a bad record of a segment is not replayed
    assert [k for k, _ in pairs(again.scan())] == [b"k%d" % i for i in range(5)]
    again.put(b"z", b"1")  # later segments are
    again = Store(spark, str(tmp_path / "s"))
    assert [k for k, _ in pairs(again.scan())] == [b"k%d" % i for i in range(5)] + [b"z"] and again.segments() == [1, 2]
    again.flush()
    again.check()
    assert again.segments() == [] and again.state["next_segment"] == 3
    for f in (tmp_path / "s" / "runs").glob("*/*.parquet"):
        f.write_bytes(f.read_bytes()[:40])
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.raises(CorruptionError):
        again.check()


def test_manifest_versions_hold_changes(spark, tmp_path):
    from keyfold.sources import manifest

    store = Store(spark, str(tmp_path / "s"))
    for i in range(manifest.ManifestLog.EVERY + 2):
        store.put(b"k%02d" % i, b"v")
    files = sorted((tmp_path / "s" / "manifest").glob("*.json"))
    tags = [manifest.decode(f.read_text())["tag"] for f in files]
    assert tags == [manifest.CHECKPOINT, *[manifest.LOG] * 15, manifest.CHECKPOINT, manifest.LOG]
    assert store.manifest.load() == store.state == Store(spark, str(tmp_path / "s")).state
    assert store.manifest.load(5)["next_segment"] == 6
    store.flush()
    store.checkpoint()
    assert store.manifest.load() == store.state
    store.vacuum(older_ms=0)
    assert store.manifest.versions()[0] == 17
    assert pairs(Store(spark, str(tmp_path / "s")).scan()) == [(b"k%02d" % i, b"v") for i in range(18)]
    run = store.runs()[0]
    with pytest.raises(CorruptionError):
        manifest.apply(store.state, {"tag": manifest.FLUSH, "added": [run]})
    with pytest.raises(CorruptionError):
        manifest.apply(store.state, {"tag": manifest.COMPACT, "removed": [99]})
    with pytest.raises(CorruptionError):
        manifest.decode(manifest.encode({"tag": 1}).replace("tag", "tug"))
    with pytest.raises(CorruptionError):
        manifest.apply(None, {"tag": manifest.LOG})


def test_sync_policies(spark, tmp_path):
    from keyfold.schema import SyncPolicy

    path = str(tmp_path / "s")
    store = Store(spark, path, Options(sync=SyncPolicy(every_n=3)))
    for i in range(4):
        store.put(b"k%d" % i, b"v")
    assert store.writes_since_sync == 1 and store.offset == 4 * (13 + 3) and store.segments() == [1, 2, 3, 4]
    assert len(pairs(store.scan())) == 4 and len(pairs(Store(spark, path).scan())) == 3  # the fourth is its writer's alone
    assert store.manifest.versions() == [1]
    store.sync()
    store.sync()
    assert store.writes_since_sync == 0 and store.manifest.versions() == [1, 2] and store.state == Store(spark, path).state
    store.put(b"k9", b"v")
    store.flush()
    assert len(pairs(Store(spark, path).scan())) == 5 and store.segments() == []
    timed = Store(spark, str(tmp_path / "t"), Options(sync=SyncPolicy(every_n=None, every_ms=3_600_000)))
    timed.put(b"a", b"1")
    assert timed.writes_since_sync == 1 and timed.manifest.versions() == []
    timed.synced -= 3600
    timed.put(b"b", b"1")
    assert timed.writes_since_sync == 0 and timed.manifest.versions() == [1]


def test_scheduler(spark, tmp_path):
    from keyfold.streaming.scheduler import CompactionScheduler

    store = Store(spark, str(tmp_path / "s"), Options(l0_threshold=2, style=CompactionStyle.SIZE_TIERED))
    beside = CompactionScheduler(store)
    beside.start()
    beside.start()
    for i in range(2):
        with beside.lock:
            store.put(b"k%d" % i, b"v")
            store.flush()
        beside.notify_flush()
    beside.shutdown()
    assert beside.rounds == 2 and beside.errors == [] and [r["level"] for r in store.runs()] == [1]
    store.compact_range = lambda: 1 // 0
    beside.start()
    beside.notify_flush()
    beside.shutdown()
    assert len(beside.errors) == 1 and len(pairs(store.scan())) == 2
    s = store.stats().first()
    assert (s.bloom_filter_hit_rate, s.compaction_count) == (0.0, 1) and s.bytes_read > 0
