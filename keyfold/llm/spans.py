"""Repeated runs of units (words or lines): shared symbols reveal where repeats may be, the units themselves decide, spans come back.

A window is a short run of consecutive units of one text. A scheme gives every window an anchor, a name that depends on nothing but the
window's own units, so equal windows always have equal anchors; neighbouring windows mostly share one. Three passes:

1. Every text names its anchors. Names, with document and place, are grouped by name; a name that stands once is no repeat.
2. Texts with shared names send the units around them to the task that owns the name, which compares windows unit by unit.
3. Runs of windows that stand earlier elsewhere come back to their text, and the text is written without them.

Passes 2 and 3 read the texts from one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, WS, Units, as_bytes, claim, joined, mix, numbered, partitions, quoted, slices, unused, window_hash, without

_BIG = 1 << 40
_U = np.uint64


# ---------------------------------------------------------------- schemes


@dataclass(frozen=True)
class Scheme:
    """What repeats are made of: units of a text, the byte between them, windows of units, and each window's anchor.

    ``windows`` gives starts and ends, in order of both; ``select`` gives (name, place) for each. ``within``: an earlier place in the same
    document counts, too.
    """

    split: Callable[[bytes], list[bytes]]
    joint: bytes
    windows: Callable[[Units], tuple[np.ndarray, np.ndarray]]
    select: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    within: bool


def text_lines(text: bytes) -> list[bytes]:
    """The lines with a word, without white space at their ends."""
    return [x for x in (line.strip(WS.encode()) for line in text.split(b"\n")) if x]


def fixed_windows(u: Units, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ``width`` units of one text."""
    start = np.flatnonzero(u.doc[: max(0, len(u) - width + 1)] == u.doc[width - 1 :])
    return start, start + width


def word_windows(u: Units, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The shortest runs of lines that hold ``least`` words or more, one from each line on and one up to each line.

    Of any longer run of lines these are all its lines, so a run of ``least`` words or more is found whole whatever it is made of.
    """
    if not len(u):
        return u.ids, u.ids
    words = np.fromiter((len(x.split()) for x in u.distinct), np.int64, len(u.distinct))[u.ids]
    before = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(len(u))
    end = np.searchsorted(before, before[at] + least)
    start = np.searchsorted(before, before[at + 1] - least, side="right") - 1
    on, upto = end <= u.bounds[u.doc + 1], start >= u.bounds[u.doc]
    key = np.unique(np.concatenate((at[on], start[upto])) * (len(u) + 1) + np.concatenate((end[on], at[upto] + 1)))
    return key // (len(u) + 1), key % (len(u) + 1)


def winnow(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the rightmost of its least unit hashes, the fingerprint that winnowing selects: (name, place)."""
    if not len(start):
        return np.empty(0, _U), start
    h = mix(hashes)
    best, at = h[start], start.copy()
    for t in range(1, int((end - start).max())):
        open_ = np.flatnonzero(start + t < end)
        here = h[start[open_] + t]
        less = open_[here <= best[open_]]
        best[less], at[less] = h[start[less] + t], start[less] + t
    return best, at


def recompress(units: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols after some rounds of recompression: (name, start, lo, hi).

    The first round names maximal runs of one unit, every round then names pairs (left, right), where a symbol's own name says
    whether it is a left or a right one, so pairs never overlap. Names are 64-bit mixes of what they stand for, hence the same in
    all tasks without a dictionary. ``lo:hi`` are the units that settle the symbol: wherever these stand, it stands, too.
    A symbol that rests on a text's end has an unbounded ``lo`` or ``hi``.
    """
    n = len(units)
    start = np.arange(n)
    if not n:
        return units, start, start, start
    first = np.r_[True, (units[1:] != units[:-1]) | (doc[1:] != doc[:-1])]
    start = start[first]
    length = np.diff(np.r_[start, n])
    d = doc[start]
    name = mix(units[start] + mix(length.astype(_U)))
    left_ok, right_ok = np.r_[False, d[1:] == d[:-1]], np.r_[d[1:] == d[:-1], False]
    lo = np.where(left_ok, start - 1, -_BIG)
    hi = np.where(right_ok, start + length + 1, _BIG)
    for _ in range(rounds):
        is_left = (mix(name + _U(0x5851F42D4C957F2D)) & _U(1)).astype(bool)
        after, before = np.r_[d[1:] == d[:-1], False], np.r_[False, d[1:] == d[:-1]]
        pair = np.r_[is_left[:-1] & ~is_left[1:], False] & after
        second = np.r_[False, pair[:-1]]
        # A lone left symbol rests on what follows it, a lone right one on what precedes it, and a pair on both members.
        right_lo, right_hi = np.r_[lo[1:], 0], np.r_[hi[1:], 0]
        left_lo, left_hi = np.r_[0, lo[:-1]], np.r_[0, hi[:-1]]
        low = np.where(is_left, np.where(after, np.minimum(lo, right_lo), lo), np.where(before, np.minimum(lo, left_lo), -_BIG))
        high = np.where(is_left, np.where(after, np.maximum(hi, right_hi), _BIG), np.where(before, np.maximum(hi, left_hi), hi))
        name = np.where(pair, joined(name, np.r_[name[1:], name[:1]]), name)
        keep = ~second
        name, start, lo, hi, d = name[keep], start[keep], low[keep], high[keep], d[keep]
    return name, start, lo, hi


def recompression(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``width`` units the longest, then least-named symbol it settles by itself, or else its least unit: (name, place).

    The longer a symbol, the fewer texts share it by chance.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    name, first, lo, hi = recompress(hashes, doc, rounds)
    ok = hi - lo <= width
    size = np.diff(np.r_[first, len(hashes)])[ok].astype(_U)
    name, first, lo, hi = mix(name[ok] + _U(rounds)), first[ok], lo[ok], hi[ok]
    rank = ((_U(63) - np.minimum(size, _U(63))) << _U(58)) | (name >> _U(6))
    best, at = np.full(n, ~_U(0)), np.full(n, -1, dtype=np.int64)
    for t in range(width):
        win = first - t
        fit = (win <= lo) & (win >= hi - width) & (win >= 0) & (win < n)
        win, r, s = win[fit], rank[fit], first[fit]
        less = r < best[win]
        best[win[less]], at[win[less]] = r[less], s[less]
    bare = np.flatnonzero(at < 0)
    if len(bare):
        h = mix(hashes + _U(1))
        low, where = h[bare], bare.copy()
        for t in range(1, width):
            less = h[bare + t] < low
            low[less], where[less] = h[bare + t][less], bare[less] + t
        best[bare], at[bare] = low, -2 - where
    return mix(best[start]), at[start]


# ---------------------------------------------------------------- which windows come later


def hashed(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each window's units."""
    if not len(start):
        return np.empty(0, _U)
    width = int((end - start).max())
    if (end - start == width).all():
        return window_hash(hashes, width)[start]
    out = mix((end - start).astype(_U))
    for t in range(width):
        open_ = np.flatnonzero(start + t < end)
        out[open_] = joined(out[open_], hashes[start[open_] + t])
    return out


def _alike(ids: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether windows (start, end) of numbered units are the same, unit by unit."""
    size = a[1] - a[0]
    same = size == b[1] - b[0]
    for t in range(int(size.max()) if len(size) else 0):
        open_ = np.flatnonzero(same & (t < size))
        same[open_] = ids[a[0][open_] + t] == ids[b[0][open_] + t]
    return same


def later_windows(
    whash: np.ndarray, ids: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, pos: np.ndarray, within: bool
) -> np.ndarray:
    """Windows that another document with a smaller id has as well; ``within``: or that stand earlier in the same one.

    Equal hashes only propose; the windows' units, numbered by ``ids``, decide.
    """
    out = np.zeros(len(whash), dtype=bool)
    ordered = np.sort(whash)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    some = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, whash), len(twice) - 1)] == whash)
    h = whash[some]
    by = np.argsort(h, kind="stable")
    same = h[by[1:]] == h[by[:-1]]
    a, b = some[by[1:][same]], some[by[:-1][same]]
    if not _alike(ids, (start[a], end[a]), (start[b], end[b])).all():  # unlike windows with one hash: number the windows themselves
        number: dict[tuple, int] = {}
        h = np.array([number.setdefault(tuple(ids[i:j].tolist()), len(number)) for i, j in zip(start[some], end[some], strict=True)])
    d, p = doc[some], pos[some]
    order = np.lexsort((p, d, h)) if within else np.lexsort((d, h))
    h, d, p = h[order], d[order], p[order]
    lead = np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], np.arange(len(h)), 0))
    late = d > d[lead]
    if within:
        late |= (d == d[lead]) & (p > p[lead])
    out[some[order]] = late
    return out


def _runs(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows as runs of units (doc, tag, start, end), ordered by text; windows that meet extend each other both ways."""
    order = np.lexsort((end, start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
    reach = np.cumsum(new) * _BIG + end  # windows of later texts reach beyond all of earlier ones
    reach = np.maximum.accumulate(reach)
    new[1:] |= np.cumsum(new)[1:] * _BIG + start[1:] > reach[:-1]
    a = np.flatnonzero(new)
    return doc[a], tag[a], start[a], (reach % _BIG)[np.r_[a[1:] - 1, len(doc) - 1]]


def _packed(columns, press) -> bytes:
    """Columns of integers, the first as differences, each in the fewest of 4 and 8 bytes, compressed."""
    n = len(columns[0])
    out = [np.array([n, len(columns)], dtype=np.int32).tobytes()]
    for k, x in enumerate(columns):
        x = np.diff(x, prepend=np.int64(0)) if k == 0 else x
        small = n == 0 or -(1 << 31) <= int(x.min()) <= int(x.max()) < 1 << 31
        out += [bytes([4 if small else 8]), x.astype(np.int32 if small else np.int64).tobytes()]
    return press.compress(b"".join(out))


def _unpacked(blob: bytes, press) -> np.ndarray:
    """The columns that ``_packed`` took, as rows of int64."""
    data = press.decompress(blob)
    n, width = np.frombuffer(data, np.int32, 2).tolist()
    at, out = 8, np.empty((width, n), dtype=np.int64)
    for k in range(width):
        size = data[at]
        out[k] = np.frombuffer(data, np.int32 if size == 4 else np.int64, n, at + 1)
        at += 1 + size * n
    out[0] = np.cumsum(out[0])
    return out


def _addressed(columns: tuple[np.ndarray, ...], n_dest: int):
    """Columns, the document first, packed for the tasks that own the documents: (dest, blob) pairs."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    dest = (mix(columns[0].astype(_U)) % _U(n_dest)).astype(np.int64)
    order = np.lexsort((columns[2], columns[0], dest))
    dest, columns = dest[order], [x[order].astype(np.int64) for x in columns]
    cut = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1], True])
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(dest[i]), _packed([x[i:j] for x in columns], press)


#: Bytes of text whose windows are settled together before they travel, and of stretches that travel together.
FOLD_BYTES, TOLD_BYTES = 4 << 20, 16 << 20
#: Buckets of anchors in a partition.
SUB = 8
#: An anchor of about so many windows is hot: these are dealt by their own hashes. One row in SAMPLE is looked at to tell.
HOT_WINDOWS, SAMPLE = 1 << 20, 64
#: What a row carries: runs of units that go, places where units are asked for, or what a bucket of anchors is to compare.
GONE, ASKED = -2, -1


def _hot(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hot anchors in order, and the parts to deal each to, of a sample's rows (name, n)."""
    many = counts.groupBy("name").agg((F.sum("n") * SAMPLE).alias("n")).where(F.col("n") >= HOT_WINDOWS).collect()
    found = sorted((x.name % (1 << 64), 1 + -(-x.n // HOT_WINDOWS)) for x in many)
    return np.array([x for x, _ in found], dtype=_U), np.array([x for _, x in found], dtype=_U)


def _dealt(name: np.ndarray, whash: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What each window is dealt by: its anchor, or where that is hot one of the anchor's parts, by the window's own hash.

    ``hot`` has the hot anchors in order and the number of parts of each. Equal windows stay together either way.
    """
    names, parts = hot
    if not len(names):
        return name
    at = np.minimum(np.searchsorted(names, name), len(names) - 1)
    return np.where(names[at] == name, mix(name + mix(mix(whash) % parts[at] + _U(1))), name)


def _shared(name: np.ndarray, doc: np.ndarray, within: bool) -> np.ndarray:
    """Places whose name stands in another document as well; ``within``: or twice in one."""
    order = np.argsort(name, kind="stable")
    n, d = name[order], doc[order]
    heads = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
    sizes = np.diff(np.r_[heads, len(n)])
    many = sizes > 1 if within else np.minimum.reduceat(d, heads) < np.maximum.reduceat(d, heads)
    out = np.zeros(len(name), dtype=bool)
    out[order] = np.repeat(many, sizes)
    return out


def _batch(part, bucket, blobs):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(part, np.int32)), pa.array(np.asarray(bucket, np.int64)), pa.array(blobs, pa.binary())], names=["part", "bucket", "data"]
    )


MOVED = "part int, bucket long, data binary"
SPANS = "id long, tag long, spans binary"


class Repeats:
    """The plan for one table: rows (id, tag, text), where id and tag tell rows apart, and a number of partitions."""

    def __init__(self, scheme: Scheme, n_parts: int):
        self.scheme, self.n_parts, self.n_buckets = scheme, n_parts, n_parts * SUB

    def folded(self, batches):
        """The windows of each slice: (id, tag, start and end in the text, whether later, hash, text, anchor's name and place)."""
        s = self.scheme
        claim("spans")
        for b in batches:
            all_ids, all_tags = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            texts = as_bytes(b.column(2))
            for lo, hi in slices(texts, FOLD_BYTES):
                u = Units(list(map(s.split, texts[lo:hi])))
                start, end = s.windows(u)
                if not len(start):
                    continue
                h = u.hashes
                name, at = s.select(h, u.doc, start, end)
                whash, d = hashed(h, start, end), u.doc[start]
                ids, tags, first = all_ids[lo:hi][d], all_tags[lo:hi][d], u.bounds[d]
                late = later_windows(whash, u.ids, start, end, ids, start - first, s.within)
                yield ids, tags, start - first, end - first, late, whash, d, name, at

    def anchors(self, batches):
        """Counts of the anchors that travel: (name, n)."""
        import pyarrow as pa

        for _, _, _, _, late, _, _, name, _ in self.folded(batches):
            names, n = np.unique(name[~late], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], names=["name", "n"])

    def name_anchors(self, hot):
        """Pass 1: places of anchors for their buckets, and what slices find by themselves for the texts' homes."""
        import zstandard

        def run(batches):
            press = zstandard.ZstdCompressor(level=1)
            for ids, tags, start, end, late, whash, d, name, at in self.folded(batches):
                if late.any():
                    home, blobs = zip(*_addressed(_runs(ids[late], tags[late], start[late], end[late]), self.n_parts), strict=True)
                    yield _batch(home, np.full(len(home), GONE), blobs)
                first = np.flatnonzero(~late)
                if not len(first):
                    continue
                ids, tags, start, end, d, at = ids[first], tags[first], start[first], end[first], d[first], at[first]
                name = _dealt(name[first], whash[first], hot)
                heads = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (at[1:] != at[:-1]) | (name[1:] != name[:-1])])
                end = np.maximum.reduceat(end, heads)
                ids, tags, start, name = ids[heads], tags[heads], start[heads], name[heads]
                bucket = (mix(name) % _U(self.n_buckets)).astype(np.int64)
                order = np.lexsort((start, ids, bucket))
                bucket = bucket[order]
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                cols = (ids[order], start[order].astype(np.int32), (end - start)[order].astype(np.int32))
                tags, name = tags[order].astype(np.uint32), (name[order] >> _U(32)).astype(np.uint32)
                blobs = []
                for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    head = b"".join(np.diff(x[i:j], prepend=x.dtype.type(0)).astype(x.dtype).tobytes() for x in cols)
                    head = press.compress(head)
                    blobs.append(np.array([j - i, len(head)], np.int32).tobytes() + head + tags[i:j].tobytes() + name[i:j].tobytes())
                yield _batch(bucket[cut[:-1]] // SUB, bucket[cut[:-1]], blobs)

        return run

    @staticmethod
    def _places(blob: bytes) -> tuple[np.ndarray, ...]:
        import zstandard

        n, size = np.frombuffer(blob, np.int32, 2)
        head = zstandard.ZstdDecompressor().decompress(blob[8 : 8 + size])
        ids = np.cumsum(np.frombuffer(head, np.int64, n))
        start = np.cumsum(np.frombuffer(head, np.int32, n, 8 * n), dtype=np.int32)
        length = np.cumsum(np.frombuffer(head, np.int32, n, 12 * n), dtype=np.int32)
        return ids, np.frombuffer(blob, np.uint32, n, 8 + size), start, start + length, np.frombuffer(blob, np.uint32, n, 8 + size + 4 * n)

    def _by_bucket(self, batches, judge, kind):
        """Rows in order of bucket: what ``judge`` makes of a bucket's blobs goes to the texts' homes, and what has a home already passes."""
        import pyarrow.compute as pc

        claim("spans")
        now, blobs, ready, size = None, [], [], 0

        def flush():
            nonlocal ready, size
            if size:
                cols = tuple(np.concatenate(x) for x in zip(*ready, strict=True))
                cols = _runs(*cols) if kind == GONE else cols
                home, packed = zip(*_addressed(cols, self.n_parts), strict=True)
                yield _batch(home, np.full(len(home), kind), packed)
            ready, size = [], 0

        for b in batches:
            own = b.filter(pc.less(b.column(1), 0))
            if own.num_rows:
                yield own
            b = b.filter(pc.greater_equal(b.column(1), 0))
            for bucket, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket != now and blobs:
                    ready.append(judge(now, blobs))
                    size += len(ready[-1][0])
                    blobs = []
                    if size > 1 << 21:
                        yield from flush()
                now = bucket
                blobs.append(data)
        if blobs:
            ready.append(judge(now, blobs))
            size += len(ready[-1][0])
        yield from flush()

    def reveal(self, batches):
        """Shared names of each bucket: their places are asked for."""

        def judge(bucket, blobs):
            ids, tags, start, end, name = (np.concatenate(x) for x in zip(*map(self._places, blobs), strict=True))
            on = _shared(name, ids, self.scheme.within)
            return ids[on], tags[on].astype(np.int64), start[on].astype(np.int64), end[on].astype(np.int64), np.full(int(on.sum()), bucket)

        return self._by_bucket(batches, judge, ASKED)

    def per_text(self, kind: int):
        """Blobs of one kind at the texts' home -> one row for each text: (id, tag, int64 columns side by side)."""

        def run(batches):
            import pyarrow as pa
            import zstandard

            press = zstandard.ZstdDecompressor()
            found = [
                _unpacked(x, press)
                for b in batches
                for k, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
                if k == kind
            ]
            if not found:
                return
            ids, tags, *rest = np.concatenate(found, axis=1)
            order = np.lexsort((rest[0], tags, ids))
            ids, tags, rest = ids[order], tags[order], np.stack([x[order] for x in rest], axis=1)
            cut = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]), True])
            for k in range(0, len(cut) - 1, 10_000):
                at = cut[k : k + 10_001]
                blobs = [rest[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at[:-1]]), pa.array(tags[at[:-1]]), pa.array(blobs, pa.binary())], names=["id", "tag", "spans"]
                )

        return run

    def tell(self, at: int):
        """Pass 2: the units asked for, sent to the buckets of the anchors they stand around. The last columns are id, tag and places."""
        import zstandard

        s = self.scheme

        def run(batches):
            press = zstandard.ZstdCompressor(level=3)
            held: dict[int, list] = {}
            size = 0

            def flush():
                nonlocal held, size
                order = sorted(held)
                blobs = []
                for k in order:
                    ids, tags, start, count, text = zip(*held[k], strict=True)
                    head = _packed(np.array((ids, tags, start, count, list(map(len, text))), dtype=np.int64), press)
                    blobs.append(np.int64(len(head)).tobytes() + head + press.compress(b"".join(text)))
                if order:
                    yield _batch([k // SUB for k in order], order, blobs)
                held, size = {}, 0

            for b in batches:
                ids, tags, asked = (b.column(b.num_columns - k).to_pylist() for k in (3, 2, 1))
                for i, tag, places, text in zip(ids, tags, asked, as_bytes(b.column(at)), strict=True):
                    units = s.split(text)
                    for start, end, bucket in np.frombuffer(places, np.int64).reshape(-1, 3).tolist():
                        part = s.joint.join(units[start:end])
                        held.setdefault(bucket, []).append((i, tag, start, end - start, part))
                        size += len(part) + 100
                    if size > TOLD_BYTES:
                        yield from flush()
            yield from flush()

        return run

    def compare(self, batches):
        """Windows around shared names, compared unit by unit: those that come later go."""
        import zstandard

        s = self.scheme
        press = zstandard.ZstdDecompressor()

        def judge(bucket, blobs):
            heads, number, which = [], {}, []
            for blob in blobs:
                size = int(np.frombuffer(blob, np.int64, 1)[0])
                heads.append(_unpacked(blob[8 : 8 + size], press))
                data = press.decompress(blob[8 + size :])
                cut = np.concatenate(([0], np.cumsum(heads[-1][4]))).tolist()
                which += [number.setdefault(data[i:j], len(number)) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            ids, tags, first, count, _ = np.concatenate(heads, axis=1)
            # Of equal stretches only the one that comes first is compared with others; in all later ones every window goes.
            which = np.array(which)
            order = np.lexsort((first, ids, which)) if s.within else np.lexsort((ids, which))
            lead = order[np.r_[True, which[order][1:] != which[order][:-1]]]
            after = ids > ids[lead][which]
            if s.within:
                after |= (ids == ids[lead][which]) & (first > first[lead][which])
            u = Units([x.split(s.joint) for x in number])
            start, end = s.windows(u)
            d = lead[u.doc[start]]
            offset = start - u.bounds[u.doc[start]]
            late = later_windows(hashed(u.hashes, start, end), u.ids, start, end, ids[d], first[d] + offset, s.within)
            gone = first[d][late] + offset[late]
            # Without ``within``, stretches of the same document as the first one are judged as that is.
            out = [(ids[d][late], tags[d][late], gone, gone + (end - start)[late]), (ids[after], tags[after], first[after], (first + count)[after])]
            rest = np.setdiff1d(np.flatnonzero(~after), lead)
            if len(rest):
                by = {int(x): [] for x in np.unique(which[rest])}
                for w, o, e in zip(u.doc[start][late].tolist(), offset[late].tolist(), (offset + end - start)[late].tolist(), strict=True):
                    if w in by:
                        by[w].append((o, e))
                more = [(int(ids[r]), int(tags[r]), int(first[r]) + o, int(first[r]) + e) for r in rest.tolist() for o, e in by[int(which[r])]]
                if more:
                    out.append(tuple(np.array(x, dtype=np.int64) for x in zip(*more, strict=True)))
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))

        return self._by_bucket(batches, judge, GONE)


def repeated_spans(rows: DataFrame, own: str, tag: str, text: str, scheme: Scheme, stored: DataFrame) -> DataFrame:
    """Rows (id, tag, spans): one for each text with repeated windows, with the runs of units they cover as int64 pairs.

    Columns ``own`` and ``tag`` of ``rows`` tell its rows apart. Inside each slice of a few MB of texts, later windows are settled at once
    and only first ones travel, so a hot text costs a slice one set of places, not one per copy. ``stored`` is the table whose size
    sets the number of partitions; a task holds one of its SUB buckets of anchors at a time. What comes back to the texts
    travels packed, so rows grow with the texts and not with the partitions they passed through. Which anchors are hot is told from a
    sample before, and only decides where windows meet; at most one anchor for each HOT_WINDOWS windows reaches the driver.
    """
    plan = Repeats(scheme, partitions(stored, 32 << 20))
    texts = rows.select(F.col(own).alias("id"), F.col(tag).alias("tag"), F.col(quoted(text)).cast("string").alias("text"))
    some = texts.where(F.pmod(F.xxhash64("id", "tag"), F.lit(SAMPLE)) == 0).mapInArrow(plan.anchors, "name long, n long")
    named = texts.mapInArrow(plan.name_anchors(_hot(some)), MOVED)

    def at_homes(df: DataFrame) -> DataFrame:
        return df.repartitionById(plan.n_parts, F.col("part"))

    def at_buckets(df: DataFrame) -> DataFrame:
        return df.repartitionById(plan.n_parts, F.col("part")).sortWithinPartitions("bucket")

    known = at_homes(at_buckets(named).mapInArrow(plan.reveal, MOVED))  # shuffled once and read twice
    asked = known.mapInArrow(plan.per_text(ASKED), SPANS).toDF(own, tag, unused("__asked", rows))
    columns = [x for x in rows.columns if x not in (own, tag)]
    # All columns, though few are read: so this join and the last one read the texts from one and the same shuffle.
    told = rows.join(asked.hint("shuffle_hash"), [own, tag]).select(*map(quoted, columns), own, tag, asked.columns[-1])
    told = numbered(told).mapInArrow(plan.tell(columns.index(text)), MOVED)
    found = at_buckets(told).mapInArrow(plan.compare, MOVED)
    return at_homes(known.where(F.col("bucket") == GONE).union(found)).mapInArrow(plan.per_text(GONE), SPANS)


def covered(n: int, blob: bytes | None) -> np.ndarray:
    """Which of ``n`` units the spans cover."""
    edges = np.zeros(n + 1, dtype=np.int64)
    if blob:
        pairs = np.frombuffer(blob, np.int64).reshape(-1, 2)
        np.add.at(edges, pairs[:, 0], 1)
        np.add.at(edges, pairs[:, 1], -1)
    return np.cumsum(edges)[:n] > 0


def _remove(docs: DataFrame, key: str, text: str, scheme: Scheme, finish, schema: str) -> DataFrame:
    """Every row of ``docs`` with the columns ``finish`` makes from (text, spans); ``schema`` names and types these.

    A column of ``docs`` that is called like one of these, in any case, gives way to it.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    docs = docs.select(*map(quoted, without(docs, names)))
    own, tag, found = unused("__id", docs), unused("__tag", docs), unused("__spans", docs)
    # The id is never null, and with a digest of the text it tells rows apart, even if ids repeat.
    rows = docs.withColumn(own, F.coalesce(F.col(quoted(key)).cast("long"), F.lit(NO_ID))).withColumn(
        tag, F.xxhash64(F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))
    )
    spans = repeated_spans(rows, own, tag, text, scheme, docs).toDF(own, tag, found)
    joined_rows = rows.join(spans.hint("shuffle_hash"), [own, tag], "left").select(*map(quoted, docs.columns), found)
    columns, at = docs.columns, docs.columns.index(text)
    whole = ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema), schema])

    def run(batches):
        import pyarrow as pa

        arrow = {"long": pa.int64(), "string": pa.string()}
        for b in batches:
            spans = b.column(b.num_columns - 1).to_pylist()
            out = [finish(t, s) for t, s in zip(as_bytes(b.column(at)), spans, strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            made = [pa.array(c, arrow[x.split()[1]]) for c, x in zip(cols, schema.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*columns, *names])

    return numbered(joined_rows).mapInArrow(run, whole)


def drop_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13, rounds: int = 2) -> DataFrame:
    """Substring dedup by recompression. Every row of ``docs`` plus n_words, n_removed and kept_text.

    A word goes if a window of ``width`` words that covers it also starts in a document with a smaller key; windows are judged on
    the input. kept_text joins what stays by one space. Symbols that several documents share after ``rounds`` rounds reveal
    where windows may be equal; there the windows' words decide.

    Null or blank text: no words, kept_text empty. Rows without key come after all others and never remove anything;
    rows with the same key do not remove from each other. An empty table stays empty.
    """
    if width < 2:
        raise ValueError("a window has two words at least")

    def finish(t: bytes, spans):
        words = t.split()
        if not spans:
            return len(words), 0, b" ".join(words).decode()
        gone = covered(len(words), spans)
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        return len(words), len(words) - len(kept), b" ".join(kept).decode()

    scheme = Scheme(
        bytes.split, b" ", lambda u: fixed_windows(u, width), lambda h, doc, start, end: recompression(h, doc, start, end, width, rounds), False
    )
    return _remove(docs, key, text, scheme, finish, "n_words long, n_removed long, kept_text string")


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 13) -> DataFrame:
    """Line dedup by winnowing. Every row of ``docs`` plus n_lines, n_removed and kept_text.

    Units are the lines with a word, stripped. Any run of lines with ``least`` words or more that stands earlier, in order of (key, line),
    goes, be it one line or many. Each shortest run of so many words selects its least line as a fingerprint; fingerprints that stand
    twice are joined by place, and the lines around them compared and extended both ways to whole runs.
    kept_text joins the lines that stay by one newline, in their order; blank lines are not kept.

    Null or blank text: no lines. Rows without key come after all others. Rows with the same key count as one document,
    line number by line number, so rows with the same key and text keep their lines. An empty table stays empty.
    """
    if least < 1:
        raise ValueError("a run has one word at least")

    def finish(t: bytes, spans):
        lines = text_lines(t)
        gone = covered(len(lines), spans)
        kept = [x for x, g in zip(lines, gone.tolist(), strict=True) if not g]
        return len(lines), len(lines) - len(kept), b"\n".join(kept).decode()

    scheme = Scheme(text_lines, b"\n", lambda u: word_windows(u, least), winnow, True)
    return _remove(docs, key, text, scheme, finish, "n_lines long, n_removed long, kept_text string")
