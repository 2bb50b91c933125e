"""Every operator as a registered query over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, cache, layout, records
from ..functions.lineage import checkpoint_dir, settle
from ..operators import compaction, memtable, merge, reads
from ..schema import DELETE, PUT, Options
from ..sources import manifest
from ..sources.store import Store

VALUE = "value"


# ---------------------------------------------------------------- adapters: tables as operation logs


def _log(df: DataFrame, key, seq: str, deleted, value, per_run: int) -> DataFrame:
    return df.select(
        key.alias("key"),
        F.col(seq).cast("bigint").alias("seq"),
        F.when(deleted, DELETE).otherwise(PUT).alias("op"),
        F.when(deleted, F.lit("")).otherwise(value).alias("value"),
        F.floor(F.col(seq) / per_run).cast("bigint").alias("run_id"),
    )


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events by user; an error deletes; a run per thousand events."""
    money = F.col("value").cast("decimal(18,2)").cast("string")
    return _log(
        spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value"),
        F.format_string("user_%06d", "user_id"), "event_id", F.col("event_type") == "error", F.concat("event_type", F.lit("|"), money), 1000,
    )


def order_log(spark: SparkSession, d: str) -> DataFrame:
    """Orders by customer; a pending order deletes; a run per 1500 orders."""
    money = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return _log(
        spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"),
        F.format_string("cust_%08d", "o_custkey"), "o_orderkey", F.col("o_orderstatus") == "P", F.concat("o_orderstatus", F.lit("|"), money), 1500,
    )


def level_of(run: str = "run_id"):
    """The newest third of ten runs in level 0, the middle in level 1, the oldest in level 2; by run number modulo ten."""
    n = F.pmod(run, F.lit(10))
    return F.when(n >= 7, 0).when(n >= 4, 1).otherwise(2)


def event_runs(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of the event log's runs with a level, a size (key and value bytes) and a position."""
    log = event_log(spark, d)
    sizes = log.groupBy("run_id").agg(F.sum(F.octet_length("key") + F.octet_length("value")).cast("bigint").alias("file_size"))
    return compaction.positions(compaction.run_metadata(log).join(sizes, "run_id").withColumn("level", level_of()))


_ELOG = """elog as (
  select printf('user_%06d', user_id) as key, event_id as seq, case when event_type = 'error' then 2 else 1 end as op,
         case when event_type = 'error' then '' else event_type || '|' || cast(cast(value as decimal(18, 2)) as varchar) end as value,
         cast(event_id // 1000 as bigint) as run_id from events)"""
_OLOG = """olog as (
  select printf('cust_%08d', o_custkey) as key, o_orderkey as seq, case when o_orderstatus = 'P' then 2 else 1 end as op,
         case when o_orderstatus = 'P' then '' else o_orderstatus || '|' || cast(cast(o_totalprice as decimal(18, 2)) as varchar) end as value,
         cast(o_orderkey // 1500 as bigint) as run_id from orders)"""
_NEW = "newest as (select * from (select *, row_number() over (partition by key order by seq desc) as rn from {0}) where rn = 1)"
_LIVE = "live as (select * from newest where op = 1 and value <> '')"
_RUNS = f"""{_ELOG}, raw as (
  select run_id, min(key) as min_key, max(key) as max_key, count(distinct key) as entry_count, min(seq) as min_seq, max(seq) as max_seq,
         cast(sum(strlen(key) + strlen(value)) as bigint) as file_size,
         case when run_id % 10 >= 7 then 0 when run_id % 10 >= 4 then 1 else 2 end as level from elog group by run_id),
 runs as (select *, cast(row_number() over (partition by level order by run_id) - 1 as integer) as pos from raw)"""


def _e(tail: str, new: bool = True) -> str:
    return f"with {_ELOG}, {_NEW.format('elog')}, {_LIVE} {tail}" if new else f"with {_ELOG} {tail}"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- merges and reads


@query(_e("select key, seq, op, value from newest"))
def merge_newest_wins(spark, d):
    return merge.newest_by_seq(event_log(spark, d)).select("key", "seq", "op", "value")


@query(_e("select key, seq, op, value from newest"))
def merge_newest_wins_join_back(spark, d):
    return merge.merge_join_back(event_log(spark, d)).select("key", "seq", "op", "value")


@query(_e("select key, value from live"))
def get_all_live(spark, d):
    return merge.live(merge.newest_by_seq(event_log(spark, d))).select("key", "value")


@query(_e("select key, value from live where key >= 'user_000010' and key < 'user_000040'"))
def scan_range(spark, d):
    return reads.scan(event_log(spark, d), "user_000010", "user_000040").select("key", "value")


@query(_e("select key, value from live where false"))
def scan_empty_range(spark, d):
    return reads.scan(event_log(spark, d), "user_000040", "user_000010").select("key", "value")


_AS_OF = f"with {_ELOG}, half as (select * from elog where seq <= (select max(seq) // 2 from elog)), {_NEW.format('half')}, {_LIVE}"


def _half(log: DataFrame) -> int:
    return log.agg(F.floor(F.max("seq") / 2).cast("bigint")).first()[0] or 0


@query(f"{_AS_OF} select key, value from live")
def snapshot_at_seq(spark, d):
    log = event_log(spark, d)
    return reads.scan(log, upto=_half(log)).select("key", "value")


@query(f"{_AS_OF} select key, value from live where key = 'user_000017'")
def snapshot_get(spark, d):
    log = event_log(spark, d)
    return reads.get(log, "user_000017", upto=_half(log)).select("key", "value")


@query(_e("select key, value from live where key = 'user_000042'"))
def point_get(spark, d):
    return reads.get(event_log(spark, d), "user_000042").select("key", "value")


_WANTED = "wanted as (select printf('user_%06d', cast(i as integer)) as key from range(0, 2000, 3) t(i))"


def _wanted(spark):
    return spark.range(0, 2000, 3).select(F.format_string("user_%06d", "id").alias("key"))


@query(_e(f", {_WANTED} select wanted.key, live.value from wanted left join live on wanted.key = live.key"))
def multi_get(spark, d):
    return reads.multi_get(event_log(spark, d), _wanted(spark))


@query(_e(f", {_WANTED} select wanted.key from wanted left join live on wanted.key = live.key where live.key is null"))
def multi_get_misses_anti(spark, d):
    return reads.misses(event_log(spark, d), _wanted(spark))


@query(_e("select min(key) as key from newest where key >= 'user_000017x' having min(key) is not null"))
def seek_lower_bound(spark, d):
    return reads.seek(merge.newest_by_seq(event_log(spark, d)), "user_000017x").select("key")


@query(_e("select key, lead(key) over (order by key) as next_key from newest"))
def next_key(spark, d):
    return reads.successors(merge.newest_by_seq(event_log(spark, d)))


@query(f"with {_OLOG} select key, seq, op, value, row_number() over (partition by key order by seq desc) as age from olog")
def version_history_per_key(spark, d):
    return reads.history(order_log(spark, d)).select("key", "seq", "op", "value", "age")


@query(f"with {_OLOG}, {_NEW.format('olog')}, {_LIVE} select key, value from live")
def orders_live(spark, d):
    return merge.live(merge.newest_by_seq(order_log(spark, d))).select("key", "value")


def _per_run(log: DataFrame) -> DataFrame:
    return merge.newest_wins(log, ["run_id", "key"], [F.col("seq").desc()])


_PER_RUN = "per as (select * from (select *, row_number() over (partition by run_id, key order by seq desc) as r from elog) where r = 1)"
_RANKED = f"{_PER_RUN}, newest as (select * from (select * exclude (r), row_number() over (partition by key order by run_id desc) as rn from per) where rn = 1)"


@query(f"with {_ELOG}, {_RANKED}, {_LIVE} select key, value from live")
def merge_runs_by_rank(spark, d):
    """Recency by the run's place instead of the sequence number."""
    ranked = merge.newest_wins(_per_run(event_log(spark, d)), ["key"], [F.col("run_id").desc()])
    return merge.live(ranked).select("key", "value")


@query(f"with {_ELOG}, {_PER_RUN} select run_id, key, seq, op, value from per")
def flush_run_entries(spark, d):
    return _per_run(event_log(spark, d)).select("run_id", "key", "seq", "op", "value")


@query(_e("select key, value from live"))
def memtable_over_runs(spark, d):
    """A tail in memory, with its tombstones, over everything flushed before it."""
    log = event_log(spark, d)
    cut = _half(log)
    tail, flushed = log.where(F.col("seq") > cut), log.where(F.col("seq") <= cut)
    return merge.live(merge.merge_sources([merge.newest_by_seq(tail), merge.newest_by_seq(flushed)])).select("key", "value")


@query("select url as key, html as value from (select *, row_number() over (partition by url order by page_id desc) as rn from pages) where rn = 1 and html <> ''")
def pages_live(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    log = _log(pages, F.col("url"), "page_id", F.lit(False), F.col("html"), 1 << 40)
    return merge.live(merge.newest_by_seq(log)).select("key", "value")


@query("select printf('doc_%08d', doc_id) as key, text as value from documents where text <> ''")
def documents_scan(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    log = _log(docs, F.format_string("doc_%08d", "doc_id"), "doc_id", F.lit(False), F.col("text"), 1 << 40)
    return reads.scan(log).select("key", "value")


# ---------------------------------------------------------------- run metadata and compaction


@query(f"with {_RUNS} select run_id, min_key, max_key, entry_count, min_seq, max_seq from runs")
def run_metadata(spark, d):
    return compaction.run_metadata(event_log(spark, d))


@query(f"""with {_OLOG}, m as (select run_id, min(key) as lo, max(key) as hi from olog group by run_id)
select a.run_id as run_a, b.run_id as run_b from m a join m b on a.run_id < b.run_id and a.lo <= b.hi and b.lo <= a.hi""")
def overlap_pairs(spark, d):
    return compaction.overlap_pairs(compaction.run_metadata(order_log(spark, d)))


@query(f"with {_RUNS} select run_id from runs where min_key <= 'user_000003' and max_key >= 'user_000001'")
def overlapping_runs(spark, d):
    return compaction.overlapping(event_runs(spark, d), "user_000001", "user_000003").select("run_id")


_TIERED = """, t as (select count(*) as n, min(min_key) as lo, max(max_key) as hi from runs where level = 0)
select run_id, level, 1 as output_level from runs, t where n >= {0} and (level = 0 or (level = 1 and min_key <= hi and max_key >= lo))"""


@query(f"with {_RUNS}" + _TIERED.format(3))
def size_tiered_pick(spark, d):
    return compaction.size_tiered_pick(event_runs(spark, d), 3)


@query(f"with {_RUNS} select cast(0 as bigint) as n")
def size_tiered_below_threshold(spark, d):
    return compaction.size_tiered_pick(event_runs(spark, d), 1 << 30).agg(F.count("*").alias("n"))


_LEVELED = """, b(level, budget) as (values (1, {0}), (2, {1})),
 o as (select min(s.level) as l from (select level, sum(file_size) as bytes from runs group by level) s join b on s.level = b.level and bytes > budget),
 p as (select r.* from runs r, o where r.level = o.l and r.pos = 0)
select r.run_id, r.level, p.level + 1 as output_level from runs r, p
where r.run_id = p.run_id or (r.level = p.level + 1 and r.min_key <= p.max_key and r.max_key >= p.min_key)"""


@query(f"with {_RUNS}" + _LEVELED.format(1000, 10000))
def leveled_pick(spark, d):
    return compaction.leveled_pick(event_runs(spark, d), [(1, 1000), (2, 10000)])


@query("select cast(0 as bigint) as n")
def leveled_at_budget_none(spark, d):
    """A level whose size equals its budget is left alone."""
    runs = event_runs(spark, d)
    exact = [(r.level, r.b) for r in runs.groupBy("level").agg(F.sum("file_size").alias("b")).where("level > 0").collect()]  # one row per level
    return compaction.leveled_pick(runs, exact or [(1, 0)]).agg(F.count("*").alias("n"))


@query("select cast(i as integer) as level, cast(10485760 * power(10, i - 1) as bigint) as budget from range(1, 6) t(i)")
def leveled_budgets(spark, d):
    return spark.createDataFrame(compaction.level_budgets(10 << 20, 10, 7), "level int, budget bigint")


@query(f"""with {_RUNS}, i as (select min(min_key) as lo, max(max_key) as hi from runs where level <= 1 having count(*) > 0)
select 1 as output_level, count(r.run_id) = 0 as bottommost from i left join runs r on r.level > 1 and r.min_key <= hi and r.max_key >= lo group by lo, hi""")
def bottommost_flag(spark, d):
    runs = event_runs(spark, d)
    task = runs.where("level <= 1").select("run_id", F.lit(1).alias("output_level"))
    return compaction.bottommost(runs, task, 7)


@query(f"with {_OLOG}, {_NEW.format('olog')} select key, seq, op, value from newest")
def compaction_keep_tombstones(spark, d):
    return compaction.compact_entries(order_log(spark, d), bottom=False).select("key", "seq", "op", "value")


@query(f"with {_OLOG}, {_NEW.format('olog')}, {_LIVE} select key, seq, op, value from live")
def compaction_bottommost_gc(spark, d):
    return compaction.compact_entries(order_log(spark, d), bottom=True).select("key", "seq", "op", "value")


@query("select cast(0 as bigint) as n")
def compaction_read_invariance(spark, d):
    """Reads before and after compacting the upper levels (not to the bottom) differ in no row."""
    log = event_log(spark, d)
    upper = log.where(level_of() <= 1)
    after = compaction.compact_entries(upper, bottom=False).unionByName(log.where(level_of() > 1))
    read = lambda x: merge.live(merge.newest_by_seq(x)).select("key", "value")
    return compaction.read_difference(read(log), read(after)).agg(F.count("*").alias("n"))


_SWAP = """select run_id, level, pos from runs where level > 1
union all select cast(1000000 as bigint), 1, 0"""


@query(f"with {_RUNS} {_SWAP}")
def version_swap(spark, d):
    runs = event_runs(spark, d).select("run_id", "level", "pos")
    added = spark.createDataFrame([(1000000, 1, 0)], "run_id bigint, level int, pos int")
    return compaction.swap(runs, runs.where("level <= 1"), added)


@query(f"with {_RUNS} select level, count(*) as n_runs, cast(sum(entry_count) as bigint) as entries from runs group by level")
def runs_per_level(spark, d):
    return compaction.runs_per_level(event_runs(spark, d))


# ---------------------------------------------------------------- operation log


_SIZED = "sized as (select run_id as segment, seq, cast(13 + strlen(key) + strlen(value) as bigint) as size from elog)"


def _segments(spark, d):
    return event_log(spark, d).withColumnRenamed("run_id", "segment")


@query(f"with {_ELOG}, {_SIZED} select segment, seq, size, cast(sum(size) over (partition by segment order by seq) - size as bigint) as \"offset\" from sized")
def wal_offsets(spark, d):
    log = _segments(spark, d).withColumn("size", records.encoded_size())
    return records.offsets(log).select("segment", "seq", "size", "offset")


@query(f"with {_ELOG}, s as (select run_id as segment, seq, cast(row_number() over (partition by run_id order by seq) % 7 as integer) as since_sync from elog) select *, since_sync = 0 as synced from s")
def wal_sync_points(spark, d):
    return records.sync_points(_segments(spark, d), 7).select("segment", "seq", "since_sync", "synced")


@query(f"""with {_ELOG}, b as (select *, (seq * 7919 + run_id) % 997 = 3 as bad from elog), f as (select run_id, min(seq) as first_bad from b where bad group by run_id)
select e.run_id as segment, count(*) as n, max(seq) as last_seq from elog e left join f on e.run_id = f.run_id where first_bad is null or seq < first_bad group by e.run_id""")
def wal_valid_prefix(spark, d):
    """One record in about a thousand is taken for corrupt; each segment ends before its first."""
    ok = F.pmod(F.col("seq") * 7919 + F.col("segment"), F.lit(997)) != 3
    return records.valid_prefix(_segments(spark, d), ok).groupBy("segment").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query(f"with {_ELOG}, tail as (select * from elog where run_id >= 6), {_NEW.format('tail')} select key, seq, op, value from newest")
def wal_replay_from_log_number(spark, d):
    return merge.newest_by_seq(_segments(spark, d).where("segment >= 6")).select("key", "seq", "op", "value")


def _le(x: str) -> str:
    """SQL: four bytes of a number in hexadecimal, the least first."""
    h = f"printf('%08X', cast({x} as bigint))"
    return "(" + " || ".join(f"substr({h}, {at}, 2)" for at in (7, 5, 3, 1)) + ")"


_BODY = f"""bodies as (
  select *, {_le("5 + strlen(key) + strlen(value)")} || printf('%02X', op) || {_le("strlen(key)")} || hex(encode(key || value)) as body from elog),
 tab as (select list(list_reduce(list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t
         from range(256) r(b)),
 summed as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(body) // 2), lambda i: cast('0x' || substr(body, 2 * i + 1, 2) as bigint))),
                            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as crc from bodies, tab)"""


@query(f"with {_ELOG}, {_BODY} select run_id as segment, seq, crc from summed")
def crc32_records(spark, d):
    """The checksum of every record; the SQL works it out from the polynomial."""
    return _segments(spark, d).select("segment", "seq", records.checksum().alias("crc"))


@query(f"with {_ELOG}, {_BODY} select seq, {_le('crc')} || body as record, cast(13 + strlen(key) + strlen(value) as bigint) as size from summed")
def wal_encode(spark, d):
    """Every record as bytes, in hexadecimal."""
    return event_log(spark, d).select("seq", F.hex(records.encode_record()).alias("record"), records.encoded_size().alias("size"))


@query(f"with {_ELOG} select seq, cast(op as tinyint) as op, hex(encode(key)) as key, hex(encode(value)) as value from elog")
def record_constructors(spark, d):
    """Puts and deletes made by the constructors; a delete's value is empty."""
    log = event_log(spark, d)
    puts = log.where(F.col("op") == PUT).select("seq", *records.put_record(F.col("key"), F.col("value")))
    gone = log.where(F.col("op") == DELETE).select("seq", *records.delete_record(F.col("key")))
    return puts.union(gone).select("seq", "op", F.hex("key").alias("key"), F.hex("value").alias("value"))


@query(f"""with {_ELOG} select seq, case seq % 8 when 1 then 'short header' when 2 then 'truncated' when 3 then 'bad checksum' when 5 then 'bad type'
 when 6 then 'bad key length' else 'ok' end as status, case when seq % 8 in (0, 4, 7) then key end as key, case when seq % 8 in (0, 4, 7) then value end as value,
 cast(case when seq % 8 in (0, 4, 7) then op end as tinyint) as op from elog""")
def wal_decode_classify(spark, d):
    """Records are encoded, five in eight damaged, two of these with a checksum that fits, and decoded again."""
    n, kind = F.octet_length("raw"), F.pmod("seq", F.lit(8))

    def sealed(body):
        return F.concat(records._le32(F.crc32(body)), body)

    part = lambda name, at, to: F.col(name).substr(F.lit(at), to)
    hurt = (
        F.when(kind == 1, F.substring("raw", 1, 9))
        .when(kind == 2, part("raw", 1, n - 1))
        .when(kind == 3, F.concat(F.substring("raw", 1, 8), F.unhex(F.lit("03")), part("raw", 10, n)))
        .when(kind == 5, sealed(F.concat(F.substring("body", 1, 4), F.unhex(F.lit("03")), part("body", 6, n))))
        .when(kind == 6, sealed(F.concat(F.substring("body", 1, 5), F.unhex(F.lit("FFFFFF0F")), part("body", 10, n))))
        .otherwise(F.col("raw"))
    )
    rows = event_log(spark, d).select("seq", records.encode_record().alias("raw"), records.record_body().alias("body")).select("seq", hurt.alias("data"))
    out = records.decode_record(rows)
    return out.select("seq", "status", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), "op")


@query(f"with {_ELOG} select max(run_id) + 1 as next_segment, count(distinct run_id) as n_segments from elog")
def wal_next_segment(spark, d):
    """The number of the segment that a rotation begins: the greatest there is plus one."""
    return _segments(spark, d).agg((F.max("segment") + 1).alias("next_segment"), F.countDistinct("segment").alias("n_segments"))


# ---------------------------------------------------------------- manifest


def _manifest(spark, d) -> DataFrame:
    """A flush and a log-number record per event run, and a compaction of the first two runs into run 1000000."""
    runs = event_runs(spark, d).select("run_id", "level")
    kind = "array<struct<run_id:bigint,level:int>>"
    none, no_ids, no_log = F.array().cast(kind), F.array().cast("array<bigint>"), F.lit(None).cast("bigint")
    flush = runs.select(
        (F.col("run_id") * 2).alias("ordinal"), F.lit(manifest.FLUSH).alias("tag"), F.array(F.struct("run_id", "level")).cast(kind).alias("added"),
        no_ids.alias("removed"), no_log.alias("log_number"), no_log.alias("next_run_id"),
    )
    logs = runs.select(
        F.col("run_id") * 2 + 1, F.lit(manifest.LOG), none, no_ids, F.col("run_id") + 1, no_log
    )
    one = spark.range(1)
    compact = one.select(
        F.lit(10**9).cast("bigint"), F.lit(manifest.COMPACT), F.array(F.struct(F.lit(10**6).cast("bigint").alias("run_id"), F.lit(1).alias("level"))).cast(kind),
        F.array(F.lit(0), F.lit(1)).cast("array<bigint>"), no_log, no_log,
    )
    return flush.union(logs).union(compact)


@query(f"with {_RUNS} select run_id, level from runs where run_id not in (0, 1) union all select cast(1000000 as bigint), 1")
def manifest_replay(spark, d):
    return manifest.replay(_manifest(spark, d)).select("run_id", "level")


@query(f"with {_RUNS} select run_id, level from runs where run_id not in (0, 1) union all select cast(1000000 as bigint), 1")
def manifest_after_checkpoint(spark, d):
    """A checkpoint of the replayed state, appended to the log, replays to the same state."""
    log = _manifest(spark, d)
    state = manifest.replay(log).agg(F.collect_list(F.struct("run_id", "level")).alias("added"))  # metadata: one struct per run
    mark = state.select(
        F.lit(2 * 10**9).cast("bigint"), F.lit(manifest.CHECKPOINT), "added", F.array().cast("array<bigint>"), F.lit(None).cast("bigint"), F.lit(1000001).cast("bigint")
    )
    return manifest.replay(log.union(mark)).select("run_id", "level")


@query("select cast(1000001 as bigint) as next_run_id")
def next_run_id(spark, d):
    return manifest.next_run_id(_manifest(spark, d))


@query(f"with {_ELOG} select max(run_id) + 1 as log_number from elog")
def log_number(spark, d):
    return manifest.log_number(_manifest(spark, d))


@query(f"with {_RUNS} select run_id * 2 + k as ordinal from runs, (values (0), (1)) t(k) where run_id * 2 + k < (select max(run_id) from runs)")
def manifest_valid_prefix(spark, d):
    """Records before the first that does not match its checksum, here one in the middle of the log."""
    log = _manifest(spark, d)
    middle = log.where("ordinal < 1000000000").agg(F.floor(F.max("ordinal") / 2).alias("at"))
    marked = log.join(F.broadcast(middle)).withColumn("ok", F.col("ordinal") != F.col("at"))
    return manifest.valid_records(marked, F.col("ok")).select("ordinal")


@query(f"with {_RUNS} select run_id, cast(2 as bigint) as times from runs where run_id % 3 = 1")
def manifest_added_twice(spark, d):
    """A log that adds some runs again; replay relies on a sound one having none."""
    log = _manifest(spark, d)
    again = log.where((F.col("tag") == manifest.FLUSH) & (F.pmod(F.col("ordinal") / 2, F.lit(3)) == 1)).withColumn("ordinal", F.col("ordinal") + 10**6)
    return manifest.added_twice(log.union(again))


# ---------------------------------------------------------------- layout, filters, cache, statistics


_BLOCKS = f"""recursive {_ELOG}, {_PER_RUN}, ordered as (
  select run_id, key, cast(4 + strlen(key) + strlen(value) as bigint) as size, row_number() over (partition by run_id order by key) as n from per),
 fold(run_id, key, size, n, block_no, used, k) as (
  select run_id, key, size, n, cast(0 as bigint), size, cast(1 as bigint) from ordered where n = 1
  union all
  select o.run_id, o.key, o.size, o.n,
    case when f.used + 2 * f.k + 2 + o.size > 512 then f.block_no + 1 else f.block_no end,
    case when f.used + 2 * f.k + 2 + o.size > 512 then o.size else f.used + o.size end,
    case when f.used + 2 * f.k + 2 + o.size > 512 then cast(1 as bigint) else f.k + 1 end
  from fold f join ordered o on o.run_id = f.run_id and o.n = f.n + 1)"""


def _packed(spark, d):
    entries = _per_run(event_log(spark, d)).withColumn("size", layout.entry_size())
    return layout.pack_blocks(entries.select("run_id", "key", "size"), 512)


@query(f"with {_BLOCKS} select run_id, key, size, block_no from fold")
def block_packing(spark, d):
    return _packed(spark, d).select("run_id", "key", "size", "block_no")


_INDEX = "ix as (select run_id, block_no, max(key) as last_key, count(*) as n, cast(sum(size) + 2 * count(*) + 2 as bigint) as bytes from fold group by run_id, block_no)"


@query(f"with {_BLOCKS}, {_INDEX} select *, cast(sum(bytes) over (partition by run_id order by block_no) - bytes as bigint) as \"offset\" from ix")
def block_index(spark, d):
    return layout.block_index(_packed(spark, d))


_FILES = f"""{_BLOCKS}, ix as (select run_id, block_no, max(key) as last_key, sum(size) + 2 * count(*) + 2 as bytes from fold group by run_id, block_no),
 body as (select run_id, sum(bytes + 18 + strlen(last_key)) as body from ix group by run_id),
 meta as (select run_id, min(key) as lo, max(key) as hi, count(*) as n from per group by run_id),
 files as (select m.run_id, cast(body + 28 + strlen(lo) + strlen(hi) + 12 + 8 * ceil(greatest(64, n * 10) / 64.0) + 56 as bigint) as file_size from meta m join body b on m.run_id = b.run_id)"""


def _file_sizes(spark, d):
    meta = compaction.run_metadata(event_log(spark, d))
    words = F.ceil(F.greatest(F.lit(64), F.col("entry_count") * 10) / 64) * 8
    return layout.file_sizes(layout.block_index(_packed(spark, d)), meta, words)


@query(f"with {_FILES} select * from files")
def run_file_size(spark, d):
    return _file_sizes(spark, d)


@query(f"with {_FILES}, u as (select sum(strlen(key) + strlen(value)) as b from elog) select case when max(b) > 0 then round(cast(sum(file_size) as double) / max(b), 6) else 0.0 end as write_amplification from files, u")
def write_amplification(spark, d):
    user = event_log(spark, d).agg(F.sum(F.octet_length("key") + F.octet_length("value")).alias("b"))
    disk = _file_sizes(spark, d).agg(F.sum("file_size").alias("f"))
    rate = F.when(F.col("b") > 0, F.round(F.col("f").cast("double") / F.col("b"), 6)).otherwise(0.0)
    return disk.crossJoin(user).select(rate.alias("write_amplification"))  # a row each


@query("""select n, p, cast(greatest(64, ceil(n * -1.44 * log2(p))) as bigint) as num_bits, cast(greatest(1, ceil(-1.44 * log2(p) * ln(2))) as bigint) as num_hashes
from (values (1000, 0.01), (5000, 0.1), (5000, 0.05), (5000, 0.001), (10, 0.5)) t(n0, p0), lateral (select cast(n0 as bigint) as n, cast(p0 as double) as p)""")
def bloom_sizing(spark, d):
    rows = [(n, p, *bloom.sizing(n, p)) for n, p in ((1000, 0.01), (5000, 0.1), (5000, 0.05), (5000, 0.001), (10, 0.5))]
    return spark.createDataFrame(rows, "n bigint, p double, num_bits bigint, num_hashes bigint")


def _filter(spark, d, fpr=0.01):
    keys = order_log(spark, d).select("key").distinct()
    bits, hashes = bloom.sizing(max(1, keys.count()), fpr)
    return keys, bloom.build(keys, "key", bits, hashes), bits, hashes


@query("select cast(0 as bigint) as n")
def bloom_no_false_negatives(spark, d):
    keys, words, bits, hashes = _filter(spark, d)
    return bloom.may_contain(keys, words, "key", bits, hashes).where("not maybe").agg(F.count("*").alias("n"))


@query("select cast(p as double) as fpr, true as within_twice_the_target from (values (0.1), (0.05), (0.01), (0.001)) t(p)")
def bloom_fpr(spark, d):
    """The measured rate of 20,000 keys that were not built in, for four targets."""
    probes = spark.range(20_000).select(F.format_string("none_%08d", "id").alias("key"))
    out = None
    for fpr in (0.1, 0.05, 0.01, 0.001):
        _, words, bits, hashes = _filter(spark, d, fpr)
        rate = bloom.may_contain(probes, words, "key", bits, hashes).agg(F.avg(F.col("maybe").cast("int")).alias("r"))
        row = rate.select(F.lit(fpr).alias("fpr"), (F.col("r") < 2 * fpr).alias("within_twice_the_target"))
        out = row if out is None else out.union(row)
    return out


@query(f"""with {_RUNS} select run_id, case run_id % 5 when 1 then 'short' when 2 then 'length' when 3 then 'word count' else 'ok' end as status,
 cast(case when run_id % 5 in (0, 4) then 5 end as bigint) as num_hashes, cast(case when run_id % 5 in (0, 4) then 1000 end as bigint) as num_bits,
 case when run_id % 5 in (0, 4) then true end as same from runs""")
def bloom_round_trip(spark, d):
    """A filter for each run as bytes, three in five damaged, and back; what comes back is what was built."""
    bits, hashes = 1000, 5
    keys = event_log(spark, d).select("run_id", "key").distinct()
    at = keys.select("run_id", F.explode(bloom.positions(F.col("key"), bits, hashes)).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("p", F.lit(64)).cast("int"))
    words = settle(at.groupBy("run_id", F.floor(F.col("p") / 64).cast("int").alias("word_no")).agg(F.bit_or(one).alias("bits")))
    kind, data = F.pmod("run_id", F.lit(5)), F.col("data")
    hurt = (
        F.when(kind == 1, F.substring("data", 1, 11))
        .when(kind == 2, data.substr(F.lit(1), F.octet_length("data") - 3))
        .when(kind == 3, data.substr(F.lit(1), F.octet_length("data") - 8))
        .otherwise(data)
    )
    back = bloom.deserialize(bloom.serialize(words, "run_id", bits, hashes).withColumn("data", hurt))
    built = words.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("word_no", "bits"))).alias("built"))  # a filter's words
    some = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("word_no"), w.alias("bits"))), lambda x: x.bits != 0)
    return back.join(built, "run_id").select("run_id", "status", "num_hashes", "num_bits", F.when(F.col("status") == "ok", some == F.col("built")).alias("same"))


_TRACE = """trace as (select event_id as i, user_id as u, user_id % 8 as shard, row_number() over (partition by user_id % 8 order by event_id) as pos from events),
 linked as (select *, lag(pos) over (partition by shard, u order by pos) as prev from trace)"""


@query(f"""with {_TRACE}, near as (
  select a.shard, a.pos, count(b.pos) as between_them from linked a left join linked b
    on b.shard = a.shard and b.pos > a.prev and b.pos < a.pos and (b.prev is null or b.prev <= a.prev)
  where a.prev is not null group by a.shard, a.pos)
select shard, count(*) filter (where between_them < 5) as hits, any_value(total) as accesses
from near join (select shard as s, count(*) as total from trace group by shard) t on t.s = near.shard group by shard""")
def lru_hit_count(spark, d):
    """Eight shards of five places over the whole trace; the SQL counts distinct users between two accesses instead."""
    trace = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_id").alias("i"), F.col("user_id").alias("key"), F.pmod("user_id", F.lit(8)).alias("shard"), F.lit(1).alias("size")
    )
    return cache.simulate(trace, 5).groupBy("shard").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count("*").alias("accesses"))


_BLOCK_TRACE = """trace as (
  select event_id, user_id % 10 as shard, (user_id % 10) || ':' || (user_id // 10 % 20) * 512 as block, cast(100 + (user_id // 10 % 20) * 97 % 400 as bigint) as size,
         row_number() over (partition by user_id % 10 order by event_id) as pos from events)"""


@query(f"""with recursive {_BLOCK_TRACE}, sim(shard, pos, items, hits) as (
  select shard, pos, [{{'b': block, 's': size}}], cast(0 as bigint) from trace where pos = 1
  union all
  select t.shard, t.pos,
    case when list_contains(list_transform(items, lambda y: y.b), block) then list_append(list_filter(items, lambda y: y.b <> block), {{'b': block, 's': size}})
         else list_filter(list_append(items, {{'b': block, 's': size}}), lambda y, i: i > len(items)
              or size + list_sum(list_transform(items[i:], lambda z: z.s)) <= 1500) end,
    hits + cast(list_contains(list_transform(items, lambda y: y.b), block) as bigint)
  from sim s join trace t on t.shard = s.shard and t.pos = s.pos + 1)
select shard, max(hits) as hits, max(pos) as accesses, round(max(hits) / max(pos), 6) as hit_rate from sim group by shard""")
def block_cache_hits(spark, d):
    """A cache of 1500 bytes a shard over blocks (run, offset) of 100 to 500 bytes; the SQL keeps the list of blocks step by step."""
    nth = F.floor(F.col("user_id") / 10) % 20
    trace = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_id").alias("i"), F.pmod("user_id", F.lit(10)).alias("shard"), F.concat_ws(":", F.pmod("user_id", F.lit(10)), nth * 512).alias("key"),
        (100 + nth * 97 % 400).alias("size"),
    )
    got = cache.simulate(trace, 1500).groupBy("shard").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count("*").alias("accesses"))
    return got.withColumn("hit_rate", F.round(F.col("hits") / F.col("accesses"), 6))


@query(f"with {_ELOG} select cast(sum(strlen(key) + strlen(value)) as bigint) as bytes_written, count(*) as n_ops, count(distinct key) as n_keys, count(*) filter (where op = 2) as n_deletes from elog")
def stats_row(spark, d):
    return event_log(spark, d).agg(
        F.sum(F.octet_length("key") + F.octet_length("value")).cast("bigint").alias("bytes_written"),
        F.count("*").alias("n_ops"),
        F.countDistinct("key").alias("n_keys"),
        F.count(F.when(F.col("op") == DELETE, 1)).alias("n_deletes"),
    )


@query(f"""with {_ELOG}, t as (select * from elog where run_id >= 8), k as (select key, sum(strlen(value)) as v from t group by key)
select coalesce(cast(sum(strlen(key) + v) as bigint), 0) as memtable_size from k""")
def memtable_size(spark, d):
    """The size of the table that holds the log's tail: overwriting adds, and nothing is given back."""
    return memtable.size(event_log(spark, d).where("run_id >= 8"))


@query(f"""with {_ELOG}, f as (select seq, strlen(value) + case when row_number() over (partition by key order by seq) = 1 then strlen(key) else 0 end as added from elog)
select seq, cast(added as bigint) as added from f""")
def memtable_growth(spark, d):
    """By how much each record makes the table grow."""
    return memtable.sizes(event_log(spark, d)).select("seq", "added")


@query(f"""with {_ELOG}, s as (select max(seq) as m from elog), t as (select elog.* from elog, s where seq > m // 4), {_NEW.format('t')}
select key, seq, op, value from newest""")
def memtable_freeze(spark, d):
    """Frozen after a quarter and after half of the log: the second freeze puts its table in the first one's place."""
    log = event_log(spark, d)
    top = log.agg(F.max("seq")).first()[0] or 0
    return memtable.frozen(log, [top // 4, top // 2]).select("key", "seq", "op", "value")


# ---------------------------------------------------------------- the store itself


def _stored(spark, d, read):
    """What ``read`` makes of a store to which the events were written in three parts, flushed after each but the last, and compacted."""
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    options = Options(memtable_size=1 << 40, l0_threshold=2, key_partitions=4, run_size=20_000)
    store = Store(spark, path, options)
    log = event_log(spark, d)
    top = log.agg(F.max("seq")).first()[0] or 0
    ops = log.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "op", "seq")
    for part in range(3):
        store.write(ops.where((F.col("seq") > top * part // 3 - (part == 0)) & (F.col("seq") <= top * (part + 1) // 3)), order="seq")
        if part < 2:
            store.flush()
    store.compact_range()
    again = Store(spark, path, options)  # as after a crash: nothing was closed
    again.check()
    out = settle(read(again))
    again.manifest.fs.delete(again.manifest._path(path), True)
    return out


@query(_e("select key, value from live"))
def store_scan(spark, d):
    """All live entries of a store that was written, flushed, compacted and opened again."""
    return _stored(spark, d, lambda s: s.scan().select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value")))


@query(_e("select key, value from live where key >= 'user_000010' and key < 'user_000040'"))
def store_snapshot_range(spark, d):
    """A range of a snapshot, which a later delete of all keys does not change."""

    def read(store):
        snap = store.snapshot()
        store.delete_all(store.scan().select("key"))
        rows = settle(snap.scan(b"user_000010", b"user_000040"))
        snap.release()
        return rows.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))

    return _stored(spark, d, read)


@query(f"""with {_ELOG}, m as (select max(seq) as top from elog), b as (select strlen(key) + strlen(value) as n, seq > top * 2 // 3 as tail from elog, m)
select coalesce(cast(sum(n) filter (where tail) as bigint), 0) as memtable_size, cast(0 as integer) as level0_runs, cast(sum(n) as bigint) as bytes_written,
 cast(1 as bigint) as compaction_count, true as written_at_least_once, cast(0 as double) as bloom_filter_hit_rate, cast(0.5 as double) as block_cache_hit_rate,
 true as read_once from b""")
def store_stats(spark, d):
    """The store's statistics after one key was got twice from one run, the second time from files opened before."""

    def read(store):
        first = next(r for r in store.runs() if r["level"] == 1)
        key = Store.decode_key(first["min_key"])
        store.get(key)
        store.get(key)
        return store.stats().select(
            "memtable_size", F.get("num_runs_per_level", F.lit(0)).alias("level0_runs"), "bytes_written", "compaction_count",
            (F.col("total_run_bytes") > 0).alias("written_at_least_once"), "bloom_filter_hit_rate", "block_cache_hit_rate",
            (F.col("bytes_read") == first["file_size"]).alias("read_once"),
        )

    return _stored(spark, d, read)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
