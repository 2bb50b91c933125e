"""Near-duplicate components: circulant MinHash bands propose, exact Jaccard on whole shingle sets decides."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    Table,
    Words,
    as_bytes,
    claim,
    components,
    joined,
    mix,
    partitions,
    process_state,
    quoted,
    repeated,
    settle,
    slices,
    unused,
    window_hash,
    window_ids,
)

#: Documents and shingles that are compared with each other at a time; larger candidate groups are dealt out.
BLOCK_DOCS, BLOCK_SHINGLES, HUBS = 256, 1 << 18, 32
#: Counters, and shingles that are counted in them, by which the rarer shingles of a text are told; both change costs and no results.
COUNTERS, COUNTED = 1 << 18, 1 << 20
#: Ids are below this. A row without one is known by a number from here on that its text gives, so it comes after all rows with ids.
NO_IDS = 1 << 62
UNIVERSE = 1 << 20


@dataclass(frozen=True)
class Bands:
    """``bands`` x ``rows`` coordinates. With 40 x 6 a pair at Jaccard 0.85 shares no band with probability 6e-9, at 0.8 5e-6."""

    bands: int = 40
    rows: int = 6
    seed: int = 20240229


def _permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations: the first scatters the universe, the second, read from k consecutive places, ranks it."""
    state, name = process_state(), f"permutations {k} {seed}"
    if name not in state:
        rng = np.random.default_rng(seed)
        sigma = rng.permutation(UNIVERSE).astype(np.int32)
        pi = rng.permutation(UNIVERSE).astype(np.int32)
        state[name] = sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[:k])), k)
    return state[name]


def signature(shingles: np.ndarray, plan: Bands) -> np.ndarray:
    """Coordinate k is the least of pi[(sigma[x] + k) mod D]: one row of the shifted table per shingle, then column minima."""
    k = plan.bands * plan.rows
    sigma, shifted = _permutations(k, plan.seed)
    at = sigma[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    least = np.full(k, UNIVERSE, dtype=np.int32)
    for i in range(0, len(at), 2048):
        np.minimum(least, shifted[at[i : i + 2048]].min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, plan: Bands) -> np.ndarray:
    """A 64-bit key for each band of each signature row."""
    cells = sig.reshape(len(sig), plan.bands, plan.rows).astype(np.uint64)
    h = np.broadcast_to(mix(np.arange(1, plan.bands + 1, dtype=np.uint64)), cells.shape[:2])
    for r in range(plan.rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, r] + np.uint64(1))
    return h.view(np.int64)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text its set of ``width``-word shingles as sorted numbers, alike in all these texts for equal shingles and for no others.

    Fewer words make one shingle, none an empty set.
    """
    w = Words(texts, lower=True)
    wide = window_ids(w.ids, width)
    short: dict[tuple, int] = {}
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(wide[a : b - width + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(tuple(w.ids[a:b].tolist()), len(short))] if b > a else [], dtype=np.int64))
    return out


def _sketches(texts: list[bytes], width: int, plan: Bands) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """For each text the size of its shingle set, a digest of its words, and its signature."""
    w = Words(texts, lower=True)
    words = w.hashes
    wide = window_hash(words, width)
    at = np.flatnonzero(w.doc[: len(wide)] == w.doc[width - 1 :]) if len(wide) else np.empty(0, np.int64)
    _, again = repeated(wide[at], at, w.ids, width, w.doc[at])
    n = np.bincount(w.doc[at], minlength=len(texts)) - np.bincount(w.doc[again], minlength=len(texts))
    sig = np.zeros((len(texts), plan.bands * plan.rows), dtype=np.int32)
    for i, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
        if b - a >= width:
            sig[i] = signature(wide[a : b - width + 1], plan)
        elif b > a:
            n[i], h = 1, words[a : a + 1]
            for t in range(a + 1, b):
                h = joined(h, words[t : t + 1])
            sig[i] = signature(h, plan)
    return n, [hashlib.blake2b(b" ".join(x), digest_size=32).digest() for x in w.rows], sig


def _identified(docs: DataFrame, key: str, text: str):
    """The number a row is known by: its id, or where it has none one made of its text, alike for equal texts."""
    surrogate = F.lit(NO_IDS) + F.xxhash64(F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))).bitwiseAND(F.lit(NO_IDS - 1))
    return F.coalesce(F.col(quoted(key)).cast("long"), surrogate)


def signatures(docs: DataFrame, key: str, text: str, width: int, plan: Bands) -> DataFrame:
    """Rows (id, n, digest, bands): set size, a digest of the words in order, and the band keys."""
    rows = docs.select(_identified(docs, key, text).alias("id"), F.col(quoted(text)).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        claim("minhash")
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in slices(texts):
                n, digest, sig = _sketches(texts[lo:hi], width, plan)
                keys = band_keys(sig, plan)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * plan.bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), flat],
                    names=["id", "n", "digest", "bands"],
                )

    return rows.mapInArrow(run, "id long, n long, digest binary, bands array<long>")


def link(sets: list[np.ndarray], labels: list[int], num: int, den: int) -> list[int]:
    """The smallest label reached by each set over pairs with den * |A & B| >= num * |A | B|; equal labels are linked already.

    Breadth first with a shrinking remainder: a set is compared, in one sweep, with all sets not yet reached, so a
    component around one text takes one sweep however large, and no pair that could join two components is skipped.
    """
    n = len(sets)
    if n == 2 and labels[0] != labels[1]:
        a, b = sets
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [min(labels)] * 2 if den * both >= num * (len(a) + len(b) - both) else list(labels)
    members: dict[int, list[int]] = {}
    for i, x in enumerate(labels):
        members.setdefault(x, []).append(i)
    if len(members) == 1:
        return list(labels)
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cut = np.concatenate(([0], np.cumsum(sizes)))
    own = [ids[cut[i] : cut[i + 1]] for i in range(n)]
    mark = np.zeros(int(ids.max()) + 1, dtype=bool)
    left = np.ones(n, dtype=bool)
    out = list(labels)

    def rest() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        idx = np.flatnonzero(left)
        flat = np.concatenate([own[i] for i in idx]) if len(idx) else ids[:0]
        return idx, flat, np.concatenate(([0], np.cumsum(sizes[idx])[:-1])) if len(idx) else idx

    while left.any():
        first = members[labels[int(np.flatnonzero(left)[0])]]
        left[first] = False
        idx, flat, offs = rest()
        reached, queue = list(first), list(first)
        while queue and len(idx):
            s = queue.pop()
            mark[own[s]] = True
            both = np.add.reduceat(mark[flat].astype(np.int64), offs)
            mark[own[s]] = False
            hit = idx[den * both >= num * (sizes[s] + sizes[idx] - both)]
            if len(hit):
                new = [j for x in {labels[i] for i in hit.tolist()} for j in members[x]]
                left[new] = False
                reached += new
                queue += new
                idx, flat, offs = rest()
        least = min(labels[i] for i in reached)
        for i in reached:
            out[i] = least
    return out


def _verify(rows: DataFrame, n_parts: int, width: int, num: int, den: int) -> DataFrame:
    """Rows (group, part, label, text) -> edges (a, b) found within each (group, part): labels, and the smallest label each reaches.

    Groups are read one after the other, so a task holds one, of a bounded number of documents, at a time.
    """

    def run(batches):
        import pyarrow as pa

        claim("minhash")

        def edges(group):
            labels, texts = zip(*group, strict=True)
            sets = shingle_sets(list(texts), width)
            full = [i for i, x in enumerate(sets) if len(x)]
            labels = [labels[i] for i in full]
            return {(x, y) for x, y in zip(labels, link([sets[i] for i in full], labels, num, den), strict=True) if x != y}

        def batch(found):
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        now, group, found = None, [], []
        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            rows = zip(b.column(2).to_pylist(), as_bytes(b.column(3)), strict=True)
            for key, row in zip(keys, rows, strict=True):
                if key != now:
                    if len(group) > 1:
                        found += edges(group)
                    now, group = key, []
                    if len(found) > 10_000:
                        yield batch(found)
                        found = []
                group.append(row)
        if len(group) > 1:
            found += edges(group)
        if found:
            yield batch(found)

    by = rows.select("group", "part", "label", "text").repartition(n_parts, "group", "part").sortWithinPartitions("group", "part")
    return by.mapInArrow(run, "a long, b long").distinct()


def _shared(members: DataFrame) -> DataFrame:
    """Rows (group, id, label) -> (group, m): the groups with more than one label, and their size. Settled, so that joins can split a hot one."""
    sizes = members.groupBy("group").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return settle(sizes.where("lo < hi").select("group", "m"))


def _crossed(few, blocks, few_blocks):
    """The parts of a group in which each of the ``few`` meets every document: one for each block of all and each block of the few."""
    own, own_few = F.pmod(F.xxhash64("id"), blocks), F.pmod(F.xxhash64("id", F.lit(2)), few_blocks)
    as_any = F.transform(F.sequence(F.lit(0).cast("long"), few_blocks - 1), lambda r: r * blocks + own)
    as_few = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda a: own_few * blocks + a)
    return F.array_distinct(F.concat(as_any, F.when(few, as_few).otherwise(F.array().cast("array<long>"))))


def _meetings(banded: DataFrame, labels: DataFrame) -> DataFrame:
    """Where documents not yet linked have still to be compared: rows (group, part, id, label).

    ``banded`` has (id, bands), ``labels`` (id, label). A group is a band's bucket with more than one label, so a document is in as many
    as it has bands at most, however many are like it. Buckets beyond BLOCK_DOCS are split by the second of each two such bands
    that a document has. What is left beyond it, documents alike in two bands at least, is compared block against block. Who shares
    such a bucket and no second one does not meet here; ``_rest`` is for them.
    """
    members = settle(banded.join(labels, "id").select(F.explode("bands").alias("group"), "id", "label"))
    sizes = _shared(members)
    zero = F.lit(0).cast("long")
    small = members.join(sizes.where(F.col("m") <= BLOCK_DOCS), "group").select("group", zero.alias("part"), "id", "label")
    crowded = sizes.where(F.col("m") > BLOCK_DOCS)
    if not crowded.limit(1).count():
        return small
    bands = members.join(crowded, "group").groupBy("id", "label").agg(F.sort_array(F.collect_set("group")).alias("g"))
    two = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", F.lit(1), i), lambda y: F.xxhash64(y, x))))
    members = settle(bands.select(F.explode(two).alias("group"), "id", "label"))
    sizes = _shared(members)
    blocks = F.ceil(F.col("m") / BLOCK_DOCS).cast("long")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    pairs = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda x: F.least(own, x) * F.col("blocks") + F.greatest(own, x))
    split = members.join(sizes.withColumn("blocks", blocks), "group").select("group", F.explode(pairs).alias("part"), "id", "label")
    return small.union(split)


def _hashes(texts: list[bytes], width: int):
    """For each text the hashes of its different shingles, one for each; none for a text of fewer words, which is like no other class."""
    w = Words(texts, lower=True)
    ids, hashes = window_ids(w.ids, width), window_hash(w.hashes, width)
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        yield hashes[a + np.unique(ids[a : b - width + 1], return_index=True)[1]] if b - a >= width else hashes[:0]


def _counted(rows: DataFrame, width: int) -> np.ndarray:
    """How often shingles stand in the texts of ``rows(id, text)``, by the last bits of their hashes."""

    def run(batches):
        import pyarrow as pa

        claim("minhash")
        total = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in slices(texts):
                h = np.concatenate(list(_hashes(texts[lo:hi], width)))
                total += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    found = rows.select("id", "text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefixes(rows: DataFrame, counts: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """Rows (id, text) -> (id, keys, first): the hashes of a text's rarest shingles that a like text must share one of.

    Shingles go by count and hash, in the same order everywhere. Let texts of x <= y shingles share s with den * s >= num * (x + y - s),
    and let i of the one text's shingles come before the first that they share: then s <= x - i, and s <= y - i for the other text's i. As y >= x
    and den * x >= num * y, that one is among the first of the smaller text with (x - i) * (num + den) >= 2 * num * x, of which there are
    ``first``, and of the larger with (y - i) * den >= num * y, which are all the ``keys``. Unlike shingles of one hash count as many.
    """

    def run(batches):
        import pyarrow as pa

        claim("minhash")
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in slices(texts):
                keys, first = [], []
                for h in _hashes(texts[lo:hi], width):
                    n = len(h)
                    h = h[np.lexsort((h, counts[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]))][: n - -(-num * n // den) + 1]
                    keys.append(h.view(np.int64))
                    first.append(n - -(-2 * num * n // (num + den)) + 1 if n else 0)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), flat, pa.array(first, pa.int64())], names=["id", "keys", "first"])

    return rows.select("id", "text").mapInArrow(run, "id long, keys array<long>, first long")


def _rest(reps: DataFrame, labels: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame | None:
    """Where documents that share a crowded band and are not linked have still to be compared, whatever else they share: (group, part, id, label).

    ``reps`` has (id, n, bands), ``labels`` (id, cand, label), ``texts`` (id, text). A group is a shingle that ``_prefixes`` gives to documents
    with more than one label, among its first to one of them; every pair that has to be linked shares one, and texts that share only what is
    frequent share none. Groups of the same documents are one. In groups beyond BLOCK_DOCS those that have the shingle among their first, or
    those outside the component's largest part if they are fewer, meet every document, block by block. Where comparing all
    documents of a component so sends fewer texts, that is done. None if no band is crowded.
    """
    zero = F.lit(0).cast("long")
    members = settle(reps.join(labels, "id").select(F.explode("bands").alias("group"), "id", "cand", "label", "n"))
    crowded = _shared(members).where(F.col("m") > BLOCK_DOCS)
    if not crowded.limit(1).count():
        return None
    docs = settle(members.join(crowded, "group").select("id", "cand", "label", "n").distinct())
    by_label = docs.groupBy("cand", "label").agg(F.count("*").alias("m"))
    main = by_label.groupBy("cand").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all"))
    main = settle(main.select("cand", F.col("top.label").alias("main"), "all", (F.col("all") - F.col("top.m")).alias("outside")))
    docs = settle(docs.join(main, "cand").select("id", "cand", "label", "n", (F.col("label") != F.col("main")).alias("out")))
    rows = texts.join(docs.select("id"), "id")
    every = -(-docs.agg(F.sum("n")).first()[0] // COUNTED)
    counts = _counted(rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(every)) == 0), width)
    keyed = settle(_prefixes(rows, counts, width, num, den)).join(docs, "id").select("id", "cand", "label", "out", "first", F.posexplode("keys").alias("i", "key"))
    keyed = keyed.withColumn("short", F.col("i") < F.col("first"))
    told = [F.count("*").alias("m"), F.count_if("short").alias("s"), F.count_if("out").alias("o"), F.min("label").alias("lo"), F.max("label").alias("hi")]
    groups = settle(keyed.groupBy("cand", "key").agg(*told).where("lo < hi and s > 0").select("cand", "key", "m", "s", "o"))
    found = settle(keyed.join(groups, ["cand", "key"]).select("cand", "key", "id", "label", "short", "out", "m", "s", "o"))
    who = found.where(F.col("m") <= BLOCK_DOCS).groupBy("cand", "key").agg(F.sort_array(F.collect_set(F.struct("id", "label"))).alias("who"))
    small = who.groupBy("cand", "who").agg(F.min("key").alias("key")).select("cand", "key", F.explode("who").alias("x"))
    small = small.select("cand", F.xxhash64("cand", "key").alias("group"), F.array(zero).alias("parts"), F.col("x.id").alias("id"), F.col("x.label").alias("label"))
    blocks, few = F.ceil(F.col("m") / BLOCK_DOCS).cast("long"), F.when(F.col("s") <= F.col("o"), F.col("short")).otherwise(F.col("out"))
    parts = _crossed(few, blocks, F.ceil(F.least("s", "o") / BLOCK_DOCS).cast("long")).alias("parts")
    large = found.where(F.col("m") > BLOCK_DOCS).select("cand", F.xxhash64("cand", "key").alias("group"), parts, "id", "label")
    by_key = settle(small.union(large))
    sent = by_key.groupBy("cand").agg(F.sum(F.size("parts")).alias("sent")).join(main.where("outside > 0"), "cand")
    blocks, few_blocks = (F.ceil(F.col(x) / BLOCK_DOCS).cast("long") for x in ("all", "outside"))
    whole = settle(sent.where(F.col("sent") > F.col("all") * few_blocks + F.col("outside") * blocks).select("cand", "all", "outside"))
    as_whole = docs.join(whole, "cand").select(F.col("cand").alias("group"), _crossed(F.col("out"), blocks, few_blocks).alias("parts"), "id", "label")
    by_key = by_key.join(whole, "cand", "left_anti").select("group", "parts", "id", "label")
    return by_key.union(as_whole).select("group", F.explode("parts").alias("part"), "id", "label")


def near_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 4, den: int = 5, width: int = 5, plan: Bands | None = None
) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept; a link needs den * intersection >= num * union.

    1. Texts of the same words in the same order form classes; each class is its smallest id. 2. Classes that share a band are
    joined through the bucket's smallest class, and the candidate components of those edges are found by distributed star rounds.
    3. Texts of candidate components are dealt to tasks, and ``link`` compares whole sets there, shingle by shingle. A component
    beyond BLOCK_DOCS or BLOCK_SHINGLES is dealt in blocks, each with the same few hub texts, which joins almost everything. What that
    leaves outside the largest part is compared with every block, or where two documents share a band (``_meetings``) if that sends
    fewer texts; of those in crowded bands that are not linked then, all that share one of their rarest shingles are (``_rest``), without which
    no two can be linked. No task holds more than one group of bounded size.
    4. What a task found is a whole component, or, of blocks and bands, edges whose components are found as in 2.

    Rows that share an id should share the text; else each is judged by its own, and the document stays if one does. Null, empty and blank texts have an empty set and are linked with nothing. Rows without id
    are documents that come after all others, those of equal texts one document; where no row of a component has an id, its component_id is
    null, and kept tells one document of it. An empty table gives an empty table; other columns are not read.
    """
    found = _components(docs, key, text, num, den, width, plan or Bands())
    real = F.when(F.col("component") < NO_IDS, F.col("component"))
    own = F.when(F.col("id") < NO_IDS, F.col("id"))
    return found.select(
        own.alias(key), F.col("n").alias("n_shingles"), real.alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )


def _components(docs: DataFrame, key: str, text: str, num: int, den: int, width: int, plan: Bands) -> DataFrame:
    """Rows (id, n, component), one per row of ``docs``; ids as ``_identified`` gives them."""
    sigs = settle(signatures(docs, key, text, width, plan))
    same = sigs.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    # Classes of one need no row; those of more are settled, so that joins with them can split a class that is hot.
    classes = settle(same.where("m > 1").select("digest", "rep"))
    named = settle(sigs.join(classes, "digest", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"), "bands"))
    reps = named.where((F.col("n") > 0) & (F.col("id") == F.col("rep")))
    keyed = reps.select("id", F.explode("bands").alias("band"))
    buckets = settle(keyed.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("band", "hub"))
    cand = components(keyed.join(buckets, "band").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    sizes = reps.groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n"))
    sized = settle(cand.join(sizes, "node").select(F.col("node").alias("id"), F.col("comp").alias("cand"), "n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES))).cast("long")
    totals = settle(sized.groupBy("cand").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).withColumn("blocks", blocks))
    n_parts = partitions(docs, 4 << 20)
    texts = docs.select(_identified(docs, key, text).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    table = Table(texts.join(sized.join(totals, "cand").select("id", "cand", "blocks", "docs"), "id"))
    rows = table.read()
    zero = F.lit(0).cast("long")
    one = rows.where("blocks = 1").select(F.col("cand").alias("group"), zero.alias("part"), F.col("id").alias("label"), "text")
    final = settle(_verify(one, n_parts, width, num, den)).select(F.col("a").alias("node"), F.col("b").alias("comp"))
    large = sized.join(totals.where("blocks > 1").select("cand", "blocks", "docs"), "cand")
    if totals.where("blocks > 1").limit(1).count():
        # Whole candidate components are settled; only blocks of large ones need be brought together.
        every = F.sequence(zero, F.col("blocks") - 1)
        hub = F.pmod(F.xxhash64("id", F.lit(1)), F.col("docs")) < HUBS
        part = F.when(hub, every).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks"))))
        texts = rows.where("blocks > 1")
        blocks = texts.select(F.col("cand").alias("group"), F.explode(part).alias("part"), F.col("id").alias("label"), "text")
        edges = settle(_verify(blocks, n_parts, width, num, den))
        so_far = settle(components(edges))
        labelled = settle(large.join(so_far.withColumnRenamed("node", "id"), "id", "left").select("id", "cand", F.coalesce("comp", "id").alias("label")))
        by_label = labelled.groupBy("cand", "label").agg(F.count("*").alias("m"))
        main = by_label.groupBy("cand").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all"))
        open_ = main.where(F.col("top.m") < F.col("all")).select("cand", F.col("top.label").alias("main"), (F.col("all") - F.col("top.m")).alias("outside"), "all")
        open_ = open_.join(totals.select("cand", "blocks"), "cand").withColumn("r_blocks", F.ceil(F.col("outside") / BLOCK_DOCS).cast("long"))
        # What is outside the largest part is compared with every block, unless that sends more texts than the bands they share would.
        open_ = settle(open_.withColumn("banded", F.col("r_blocks") + F.col("outside") * F.col("blocks") / F.col("all") > plan.bands))
        if open_.limit(1).count():
            todo = labelled.join(open_.where("not banded"), "cand")
            parts = F.explode(_crossed(F.col("label") != F.col("main"), F.col("blocks"), F.col("r_blocks"))).alias("part")
            todo = todo.select(F.col("cand").alias("group"), parts, "id", "label")
            many = open_.where("banded").select("cand")
            banded = many.limit(1).count() > 0
            if banded:
                todo = todo.union(_meetings(reps.select("id", "bands"), labelled.join(many, "cand").select("id", "label")))
            more = settle(_verify(todo.join(texts.select("id", "text"), "id"), n_parts, width, num, den))
            so_far = settle(components(edges.union(more).union(so_far.select("node", "comp"))))
            if banded:
                now = so_far.withColumnRenamed("node", "id")
                now = settle(labelled.join(many, "cand").join(now, "id", "left").select("id", "cand", F.coalesce("comp", "id").alias("label")))
                rest = _rest(reps.select("id", "n", "bands"), now, texts.select("id", "text"), width, num, den)
                if rest is not None:
                    more = settle(_verify(rest.join(texts.select("id", "text"), "id"), n_parts, width, num, den))
                    so_far = settle(components(more.union(so_far.select("node", "comp"))))
        final = final.union(so_far)
    table.drop()
    return (
        named.select("id", "n", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n", F.coalesce("comp", "rep").alias("component"))
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` whose document stays, one document of each component, with all their columns.

    What ``near_components`` says of ids, nulls and empty texts holds; of rows with the same id and text, or without id and with
    the same text, one stays.
    """
    own, same, name = unused("__id", docs), unused("__text", docs), unused("__kept", docs)
    kept = _components(docs, key, text, num, den, 5, Bands()).where("id = component").select(F.col("id").alias(name)).distinct()
    marked = docs.withColumn(own, _identified(docs, key, text)).withColumn(same, F.xxhash64(F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))))
    rows = marked.join(kept, F.col(own) == F.col(name), "left_semi").dropDuplicates([own, same])
    return rows.select(*map(quoted, docs.columns))
