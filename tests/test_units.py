"""Known values of codecs, layout, filters, cache, pickers and reads."""

import random

import pytest
from pyspark.sql import functions as F

from keyfold.functions import bloom, cache, layout, records
from keyfold.operators import compaction, memtable, merge, reads
from keyfold.schema import Options
from keyfold.sources import manifest


def test_crc_and_record_bytes(spark):
    row = spark.createDataFrame([(1, bytearray(b"key"), bytearray(b"value"))], "op int, key binary, value binary")
    got = row.select(F.crc32(F.lit("123456789").cast("binary")).alias("c"), records.encode_record().alias("r"), records.encoded_size().alias("n")).first()
    assert got.c == 3421780262 and len(got.r) == got.n == 13 + 3 + 5


@pytest.mark.parametrize(("key", "value"), [(b"", b""), (b"k", b""), (b"a" * 300, b"\x00\xff" * 700)])
def test_records_round_trip(spark, key, value):
    row = spark.createDataFrame([(2, bytearray(key), bytearray(value))], "op int, key binary, value binary")
    got = records.decode_record(row.select(records.encode_record().alias("data"))).first()
    assert (got.status, got.op, bytes(got.key), bytes(got.value)) == ("ok", 2, key, value)


def test_decoding_names_what_is_wrong(spark):
    import zlib

    def raw(kind=1, klen=1, key=b"k", value=b"v", size=None):
        body = (size or 5 + len(key) + len(value)).to_bytes(4, "little") + bytes([kind]) + klen.to_bytes(4, "little") + key + value
        return bytearray(zlib.crc32(body).to_bytes(4, "little") + body)

    flipped = raw()
    flipped[-1] ^= 1
    rows = [raw(), raw()[:12], raw()[:-1], flipped, raw(kind=3), raw(klen=9), bytearray()]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, data binary")
    got = [r.status for r in records.decode_record(df).orderBy("i").collect()]
    assert got == ["ok", "short header", "truncated", "bad checksum", "bad type", "bad key length", "short header"]


def test_a_bad_record_ends_its_own_segment_only(spark):
    df = spark.createDataFrame([(s, i) for s in (1, 2) for i in range(5)], "segment int, seq int")
    kept = records.valid_prefix(df, ~((F.col("segment") == 1) & (F.col("seq") == 2))).collect()
    assert sorted((r.segment, r.seq) for r in kept) == [(1, 0), (1, 1)] + [(2, i) for i in range(5)]


def test_block_packing(spark):
    """500 entries of 117 bytes at 4096 make 15 blocks of 34 at most; the first entry of a block always fits."""
    rows = [(1, f"{i:05d}", 117) for i in range(500)] + [(2, "a", 9000), (2, "b", 9000), (2, "c", 10)]
    packed = layout.pack_blocks(spark.createDataFrame(rows, "run_id long, key string, size long"), 4096)
    index = layout.block_index(packed).collect()
    first = [r for r in index if r.run_id == 1]
    assert len(first) == 15 and max(r.n for r in first) == 34
    assert sorted((r.block_no, r.n, r.bytes, r.offset) for r in index if r.run_id == 2) == [(0, 1, 9004, 0), (1, 1, 9004, 9004), (2, 1, 14, 18008)]


def test_bloom(spark):
    assert bloom.sizing(1000, 0.01) == (9568, 7)
    for bad in ((0, 0.1), (10, 0.0), (10, 1.0)):
        with pytest.raises(ValueError):
            bloom.sizing(*bad)
    bits, hashes = bloom.sizing(1000, 0.01)
    keys = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = bloom.build(keys, "key", bits, hashes)
    assert bloom.may_contain(keys, words, "key", bits, hashes).where("not maybe").count() == 0
    others = spark.range(10_000).select(F.concat(F.lit("x"), "id").alias("key"))
    assert bloom.may_contain(others, words, "key", bits, hashes).where("maybe").count() < 200
    data = bytes(bloom.serialize(words.withColumn("run", F.lit(1)), "run", bits, hashes).first().data)
    assert data[:4] == hashes.to_bytes(4, "little") and data[4:12] == bits.to_bytes(8, "little") and len(data) == 12 + 8 * -(-bits // 64)
    broken = [data, data[:11], data[:-8], data[:-3], data + bytes(8), bytes(4) + data[4:], b""]
    got = bloom.deserialize(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(broken)], "i int, data binary"))
    got = {r.i: r for r in got.collect()}
    assert [got[i].status for i in range(7)] == ["ok", "short", "word count", "length", "word count", "word count", "short"]
    assert (got[0].num_hashes, got[0].num_bits) == (hashes, bits) and got[1].words is None
    built = {r.word_no: r.bits for r in words.collect()}
    assert got[0].words == [built.get(i, 0) for i in range(-(-bits // 64))]


def test_lru_cache():
    c = cache.LRU(10)
    c.insert("a", 4)
    c.insert("b", 4)
    assert c.get("a") == 4
    c.insert("c", 4)  # evicts b, the least recently used
    assert c.get("b") is None and len(c) == 2 and c.used == 8
    c.insert("a", 1)
    assert c.used == 5
    c.insert("huge", 99)
    assert list(c.items) == ["huge"]
    c.remove("huge")
    assert (c.used, c.hits, c.misses, c.hit_rate()) == (0, 1, 1, 0.5)
    assert cache.LRU(1).hit_rate() == 0.0


def test_simulated_cache_equals_the_model(spark):
    r = random.Random(0)
    trace = [(i % 3, i, r.randrange(20), r.randrange(1, 5)) for i in range(900)]
    caches, want = {}, {}
    for s, i, k, n in trace:
        c = caches.setdefault(s, cache.LRU(25))
        want[i] = c.get(k) is not None
        if not want[i]:
            c.insert(k, n)
    df = spark.createDataFrame(trace, "shard int, i int, key int, size int")
    assert {x.i: x.hit for x in cache.simulate(df, 25).collect()} == want


RUNS = "run_id long, level int, pos int, min_key string, max_key string, file_size long"


def test_pickers(spark):
    rows = [(1, 0, 0, "a", "f", 9), (2, 0, 1, "d", "k", 9), (3, 1, 0, "k", "m", 60), (4, 1, 1, "p", "q", 60), (5, 2, 0, "l", "z", 9), (6, 2, 1, "n", "o", 9)]
    runs = spark.createDataFrame(rows, RUNS)
    ids = lambda df: sorted(r.run_id for r in df.collect())
    assert ids(compaction.size_tiered_pick(runs, 2)) == [1, 2, 3]  # touching ranges overlap
    assert ids(compaction.size_tiered_pick(runs, 3)) == []
    assert ids(compaction.leveled_pick(runs, [(1, 100), (2, 1000)])) == [3, 5]
    assert ids(compaction.leveled_pick(runs, [(1, 120), (2, 1000)])) == []  # equal to the budget is within it
    assert ids(compaction.size_tiered_pick(runs.limit(0), 1)) == []
    o = Options()
    assert compaction.level_budgets(o.level_base_bytes, o.level_size_multiplier, o.max_levels)[:2] == [(1, 10 << 20), (2, 100 << 20)]
    task = spark.createDataFrame([(3, 1, 2), (4, 1, 2)], "run_id long, level int, output_level int")
    assert compaction.bottommost(runs, task, 7).first().bottommost
    task = spark.createDataFrame([(1, 0, 1)], "run_id long, level int, output_level int")
    assert compaction.bottommost(runs, task, 7).first().bottommost
    task = spark.createDataFrame([(3, 1, 1)], "run_id long, level int, output_level int")
    assert not compaction.bottommost(runs, task, 7).first().bottommost


def test_overlap_pairs_are_all_pairs_once(spark):
    r = random.Random(7)
    rows = []
    for i in range(120):
        low = r.randrange(1000)
        rows.append((i, low, low + r.choice([0, 1, 5, 40, 900])))
    runs = spark.createDataFrame(rows, "run_id long, min_key int, max_key int")
    want = sorted((a, c) for a, b, d in rows for c, e, f in rows if a < c and b <= f and e <= d)
    for size in (1, 7, 1000):
        assert sorted(map(tuple, compaction.overlap_pairs(runs, size).collect())) == want
    assert compaction.overlap_pairs(runs.limit(0)).count() == 0


def test_memtables(spark):
    log = spark.createDataFrame([("a", 1, 1, "xy"), ("b", 2, 1, "z"), ("a", 3, 2, ""), ("b", 4, 1, "zzz"), ("c", 5, 1, "c")], LOG)
    assert [r.added for r in memtable.sizes(log).orderBy("seq").collect()] == [3, 2, 0, 3, 2]
    assert memtable.size(log).first()[0] == 10 and memtable.size(log.limit(0)).first()[0] == 0
    rows = lambda *cuts: [(r.key, r.seq) for r in memtable.frozen(log, list(cuts)).collect()]
    assert rows() == rows(3) == [("a", 3), ("b", 4), ("c", 5)]
    assert rows(2, 4) == [("a", 3), ("b", 4), ("c", 5)] and rows(3, 4) == [("b", 4), ("c", 5)]  # what was frozen before is gone


LOG = "key string, seq long, op int, value string"


def test_reads(spark):
    log = spark.createDataFrame(
        [("a", 1, 1, "1"), ("b", 2, 1, "2"), ("a", 3, 2, ""), ("c", 4, 1, "3"), ("b", 5, 1, "4"), ("d", 6, 1, ""), ("a", 7, 1, "5")], LOG
    )
    pairs = lambda df: [(r.key, r.value) for r in df.collect()]
    assert pairs(reads.scan(log)) == [("a", "5"), ("b", "4"), ("c", "3")]  # an empty value reads as absent
    assert pairs(reads.scan(log, "b", "c")) == [("b", "4")]
    assert pairs(reads.scan(log, "c", "b")) == pairs(reads.scan(log, "b", "b")) == []
    assert pairs(reads.scan(log, upto=4)) == [("b", "2"), ("c", "3")]
    assert pairs(reads.get(log, "a", upto=3)) == [] and pairs(reads.get(log, "zz")) == []
    wanted = spark.createDataFrame([("a",), ("d",), ("a",), ("x",)], "key string")
    assert sorted(pairs(reads.multi_get(log, wanted)), key=str) == [("a", "5"), ("a", "5"), ("d", None), ("x", None)]
    assert sorted(r.key for r in reads.misses(log, wanted).collect()) == ["d", "x"]
    assert [r.key for r in reads.seek(log.select("key").distinct(), "bb").collect()] == ["c"]
    assert [r.key for r in reads.seek(log.select("key").distinct(), "bb", end="c").collect()] == []
    assert {r.key: r.next_key for r in reads.successors(log.select("key").distinct(), 3).collect()} == {"a": "b", "b": "c", "c": "d", "d": None}
    newest, joined = merge.newest_by_seq(log), merge.merge_join_back(log)
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, joined.collect()))
    merged = merge.merge_sources([log.where("seq > 4").drop("seq"), log.where("seq in (1, 2, 4)").drop("seq")])
    assert [(r.key, r.value) for r in merged.collect()] == [("a", "5"), ("b", "4"), ("c", "3"), ("d", "")]


def test_manifest_records(spark):
    rec = [
        (0, manifest.FLUSH, [(1, 0)], [], None, None), (1, manifest.LOG, [], [], 2, None), (2, manifest.FLUSH, [(2, 0)], [], None, None),
        (3, manifest.COMPACT, [(3, 1)], [1, 2], None, None), (4, manifest.CHECKPOINT, [(3, 1)], [], 2, 9), (5, manifest.FLUSH, [(9, 0)], [], None, None),
    ]
    df = spark.createDataFrame(rec, "ordinal long, tag int, added array<struct<run_id:bigint,level:int>>, removed array<bigint>, log_number bigint, next_run_id bigint")
    runs = lambda d: sorted((r.run_id, r.level) for r in manifest.replay(d).collect())
    assert runs(df) == [(3, 1), (9, 0)] and runs(df.where("ordinal < 3")) == [(1, 0), (2, 0)]
    assert manifest.next_run_id(df).first()[0] == 10 and manifest.log_number(df).first()[0] == 2
    assert manifest.valid_records(df, F.col("ordinal") != 3).count() == 3
    assert manifest.added_twice(df).count() == 0
    assert [tuple(r) for r in manifest.added_twice(df.union(df.where("ordinal = 5").withColumn("ordinal", F.lit(6)))).collect()] == [(9, 2)]
