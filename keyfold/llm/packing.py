"""Packing by non-negative least squares over few-document length patterns; residuals go by best fit."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, claim, numbered, quoted, settle

#: Words in a generation of the cache; a worker keeps two generations.
CACHE_WORDS = 600_000
#: A word of lower-case letters of Latin-1 and what may close it: two pieces for the tokenizer's splitter, which nothing before or after changes.
PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?)\"]*)")


class TokenCache(dict):
    """Word (bytes) -> its ids as little-endian uint32 bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in turn. A plain word is one piece
    for its splitter and its bytes the symbols of its merges, so the model alone is asked, and once for all that may close the word.
    """

    def __init__(self, tokenizer: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task's core is the unit of parallelism
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        self.model = self.whole.model
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level vocabularies
        self.symbols = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(keep))}
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = self.ids(word)
        self[word] = ids
        return ids

    def ids(self, word: bytes) -> bytes:
        text = word.decode()
        plain = PLAIN.fullmatch(text.lower())
        if not plain:
            got = self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids
        elif plain[2]:
            return self[plain[1].encode()] + self[plain[2].encode()]
        else:
            piece = plain[1] if plain[1].isascii() else plain[1].encode().decode("latin-1").translate(self.symbols)
            got = [x.id for x in self.model.tokenize(piece)]
        return struct.pack(f"<{len(got)}I", *got)

    def encode(self, text: bytes) -> bytes:
        """The ids of a text."""
        if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()  # as the tokenizer does; without special tokens and combining marks the order of steps is free
        return b"".join(map(self.__getitem__, text.split()))


def token_cache(tokenizer: str) -> TokenCache:
    """The process's cache for a tokenizer file; tasks that follow each other in a worker share it."""
    state = claim("packing")
    if state.get("tokenizer") != tokenizer:
        state["tokenizer"], state["tokens"] = tokenizer, TokenCache(tokenizer)
    return state["tokens"]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares with non-negative unknowns, by active sets: unknowns enter by gradient, and leave where they would turn negative."""
    m, n = a.shape
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(rounds):
        grad = a.T @ (b - a @ x)
        grad[free] = 0
        j = int(np.argmax(grad))
        if grad[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        free[j] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (z <= 1e-12)
            if not bad.any():
                x = z
                break
            step = float(np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300)))
            x = x + step * (z - x)
            gone = free & (x <= 1e-12)
            x[gone] = 0
            free &= ~gone
            if not free.any():
                break
    return x


def patterns(n_bins: int) -> list[tuple[int, ...]]:
    """All multisets of one to three bins (1..n_bins), larger ones first, that may fill a sequence.

    A piece is up to one bin shorter than its bin says, so two bins may add up to one more than a sequence has, three to two more.
    """
    pairs = [(a, n - a) for n in (n_bins, n_bins + 1) for a in range((n + 1) // 2, n_bins)]
    threes = [(a, b, n - a - b) for n in range(n_bins, n_bins + 3) for a in range(1, n_bins) for b in range(1, a + 1) if 1 <= n - a - b <= b]
    return [(n_bins,), *pairs, *threes]


class _Builder:
    """Open sequences as intervals of sequence numbers by room left; placements as runs of ranks within a length."""

    def __init__(self, hist: np.ndarray, room: int):
        self.room, self.left, self.next_rank = room, hist.copy(), np.zeros(room + 1, dtype=np.int64)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]
        self.has = np.zeros(room + 1, dtype=bool)
        self.n_seq = 0
        self.rows: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset

    def add(self, room: int, seq: int, count: int) -> None:
        if count:
            self.open[room].append((seq, count))
            self.has[room] = True

    def place(self, length: int, seq: int, count: int, room: int) -> None:
        self.rows.append((length, int(self.next_rank[length]), seq, self.room - room))
        self.next_rank[length] += count
        self.left[length] -= count

    def fill(self, length: int, seq: int, count: int, room: int, n: int) -> None:
        """Put ``n`` pieces of one length into an interval, as many to a sequence as fit; what is not filled stays open."""
        each = room // length
        full, over = divmod(n, each)
        full = min(full, count)
        for k in range(each if full else 0):
            self.place(length, seq, full, room - k * length)
        self.add(room - each * length, seq, full)
        if over and full < count:
            for k in range(over):
                self.place(length, seq + full, 1, room - k * length)
            self.add(room - over * length, seq + full, 1)
            full += 1
        self.add(room, seq + full, count - full)

    def commit(self, pattern: tuple[int, ...], width: int, count: int) -> None:
        """Open up to ``count`` sequences with a pattern's members, larger ones first, each the longest piece of its bin that is left.

        The last member may be longer than its bin says, as far as the room that the others' bins left unused goes.
        """
        todo = [(self.n_seq, count, self.room)]
        for step, b in enumerate(pattern):
            placed: list[tuple[int, int, int]] = []
            for seq, c, room in todo:
                top = room if step and step == len(pattern) - 1 else min(b * width, room)
                for x in range(top, min((b - 1) * width, top), -1):
                    take = int(min(c, self.left[x]))
                    if take:
                        self.place(x, seq, take, room)
                        placed.append((seq, take, room - x))
                        seq, c = seq + take, c - take
                    if not c:
                        break
                if c and step:
                    self.add(room, seq, c)  # no piece is left for this member: best fit finds others
            todo = placed
            if step == 0:
                self.n_seq += sum(c for _, c, _ in placed)
        for seq, c, room in todo:
            self.add(room, seq, c)

    def best_fit(self) -> None:
        for length in range(self.room, 0, -1):
            while self.left[length]:
                n = int(self.left[length])
                at = length + int(np.argmax(self.has[length:]))
                if not self.has[at]:
                    count = -(-n // (self.room // length))
                    self.fill(length, self.n_seq, count, self.room, n)
                    self.n_seq += count
                    continue
                seq, count = self.open[at].pop()
                self.has[at] = bool(self.open[at])
                self.fill(length, seq, count, at, min(n, count * (at // length)))


def plan_packing(hist: np.ndarray, room: int, n_bins: int = 64) -> tuple[np.ndarray, int]:
    """Placements for ``hist[length]`` pieces: rows (length, first rank, first sequence, offset) sorted by the first two, and the number of sequences.

    Repeat counts of the patterns are fitted to the histogram over ``n_bins`` equal bins and rounded; patterns are placed whole, the
    most frequent first, and what is left goes by best fit, longest first, into the room that patterns leave and then into new
    sequences. The work depends on ``room`` alone, not on how many pieces there are.
    """
    width = -(-room // n_bins)
    binned = np.zeros(n_bins + 1)
    np.add.at(binned, -(-np.arange(room + 1) // width), hist)
    shapes = patterns(n_bins)
    a = np.zeros((n_bins, len(shapes)))
    for j, p in enumerate(shapes):
        for b in p:
            a[b - 1, j] += 1
    total = binned.sum()
    fitted = np.rint(nnls(a, binned[1:] / max(total, 1)) * total).astype(np.int64)
    build = _Builder(hist.astype(np.int64), room)
    for j in np.argsort(-fitted, kind="stable"):
        if fitted[j]:
            build.commit(shapes[j], width, int(fitted[j]))
    build.best_fit()
    rows = np.array(sorted(build.rows), dtype=np.int64).reshape(-1, 4)
    return rows, build.n_seq


def _pieces(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int, room: int) -> DataFrame:
    rows = docs.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(text)).cast("string").alias("text"))

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        cache, part = token_cache(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(room + 1, dtype=np.int64)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                ids = cache.encode(text) + tail
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, room)):
                    size = min(room, n - start)
                    out.append((i, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), part, int(seen[size])))
                    seen[size] += 1
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            )

    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1, room: int = 4096
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenized once; pieces, without their ids, are checkpointed with their task's number and their count within it
    by length. Only the histogram of lengths, ``room`` numbers, reaches the driver; the plan that comes back has a size
    bounded by ``room`` too. A piece's rank within its length is its count plus the counts of earlier tasks, so no length is gathered
    in one task, and a binary search in the plan gives its place.

    Null, empty and blank texts make one piece of the end id. Every row is a document of its own: keys may repeat or be
    null. An empty table gives an empty table; other columns are not read.
    """
    pieces = settle(_pieces(docs, key, text, tokenizer, end_id, room))
    counts = settle(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    hist = np.zeros(room + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``room`` rows
        hist[r.length] = r.n
    plan, _ = plan_packing(hist, room)
    shift = np.int64(1) << np.int64(48)
    index = plan[:, 0] * shift + plan[:, 1]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "base")
    ranked = pieces.join(base, ["part", "length"]).select(
        F.col("id").alias(key), "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )

    def seat(batches):
        import pyarrow as pa

        for b in batches:
            length, rank = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            row = plan[np.searchsorted(index, length * shift + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])],
                names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered(ranked).mapInArrow(
        seat, f"{quoted(key)} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
