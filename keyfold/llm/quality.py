"""Quality rules by repetition coverage: the share of a text's characters inside repeated n-grams and repeated lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, Words, as_bytes, claim, mix, numbered, quoted, repeated, slices, without

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits of the method's verdict, each a percentage of the characters of the text's words (symbols: of words, lines: of lines).

    The base rule is the first two: too few words; too many words in repeated 3-word windows.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    ngram_limits: dict[int, int] = field(default_factory=lambda: {2: 65, 4: 55, 6: 50, 8: 45, 10: 40})
    max_dup_line_chars_percent: int = 40
    max_dup_lines_percent: int = 40
    max_symbols_percent: int = 30


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "worst_coverage"]
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, worst_coverage double"
)


def _covered(rolled: np.ndarray, w: Words, n: int) -> np.ndarray:
    """Which words stand in a window of ``n`` words that is there twice in its text; ``rolled`` has every window's hash."""
    at = np.flatnonzero(w.doc[: len(rolled)] == w.doc[n - 1 :])
    hit, _ = repeated(mix(rolled[at]), at, w.ids, n, w.doc[at])
    edges = np.zeros(len(w) + 1, dtype=np.int64)
    edges[hit] += 1
    edges[hit + n] -= 1
    return np.cumsum(edges)[:-1] > 0


def _lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word, those of them equal to an earlier one, and the characters of these lines' words."""
    if b"\n" not in text:
        return int(bool(text.strip(WS.encode()))), 0, 0
    n = again = chars = 0
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        if not line.strip(WS.encode()):
            continue
        n += 1
        if line in seen:
            again += 1
            chars += sum(len(x.decode()) for x in line.split())
        seen.add(line)
    return n, again, chars


def measure(texts: list[bytes], rules: Rules) -> dict[str, np.ndarray]:
    """All measures of a few texts at once; n-gram hashes roll from one length to the next, and windows of one hash are compared word by word."""
    n_docs = len(texts)
    w = Words(texts)
    n_words = np.diff(w.bounds)
    chars = np.fromiter((len(x.decode()) for x in w.distinct), np.int64, len(w.distinct))[w.ids]

    def per_doc(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(x)))
        return sums[w.bounds[1:]] - sums[w.bounds[:-1]]

    word_chars = per_doc(chars)
    total = np.maximum(word_chars, 1)
    coverage, repeat, over = np.zeros(n_docs), np.zeros(n_docs, dtype=np.int64), np.zeros(n_docs, dtype=bool)
    own = mix(w.hashes)
    rolled, step = own, np.uint64(0xD6E8FEB86659FD93)
    for n in range(2, max([3, *rules.ngram_limits]) + 1):
        if len(own) < n:
            break
        rolled = rolled[:-1] * step + own[n - 1 :]
        if n != 3 and n not in rules.ngram_limits:
            continue
        cover = _covered(rolled, w, n)
        if n == 3:
            repeat = per_doc(cover)
        if n in rules.ngram_limits:
            inside = per_doc(chars * cover)
            coverage = np.maximum(coverage, inside / total)
            over |= 100 * inside > rules.ngram_limits[n] * total
    marks = [SYMBOLS[j : j + 1].encode() for j in range(len(SYMBOLS))]
    symbols = np.fromiter((sum(map(t.count, marks)) for t in texts), np.int64, n_docs)
    lines, dup_lines, dup_chars = np.array([_lines(t) for t in texts], dtype=np.int64).reshape(-1, 3).T
    over |= (100 * symbols > rules.max_symbols_percent * n_words) | (100 * dup_chars > rules.max_dup_line_chars_percent * total)
    over |= 100 * dup_lines > rules.max_dup_lines_percent * np.maximum(lines, 1)
    base = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
    return dict(zip(NAMES, (n_words, word_chars, symbols, dup_lines, repeat, base, ~(base | over), coverage), strict=True))


def score_quality(docs: DataFrame, text: str = "text", rules: Rules | None = None, prefix: str = "") -> DataFrame:
    """Every row of ``docs`` with all its columns and, prefixed if asked, the measures and the verdict ``kept``.

    Windows of words with equal hashes are compared word by word. Null text counts as empty (no words: the base
    rule fails it); rows may repeat or lack an id, as none is used; an empty table stays empty. A column of ``docs`` that is
    called like a measure, in any case, gives way to it; with another ``prefix`` it stays.
    """
    rules = rules or Rules()
    docs = docs.select(*map(quoted, without(docs, [prefix + x for x in NAMES])))
    names, at = docs.columns, docs.columns.index(text)
    added = re.sub(r"(\w+) (\w+)", lambda m: f"`{prefix}{m[1]}` {m[2]}", SCHEMA)
    schema = ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema), added])

    def run(batches):
        import pyarrow as pa

        claim("quality")
        for b in batches:
            texts = as_bytes(b.column(at))
            for lo, hi in slices(texts):
                got = measure(texts[lo:hi], rules)
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(lo, hi - lo).columns, *(pa.array(got[x]) for x in NAMES)],
                    names=[*names, *(prefix + x for x in NAMES)],
                )

    return numbered(docs).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, with the same columns, whatever these are called."""
    prefix = "__q_"
    while len(without(docs, [prefix + x for x in NAMES])) < len(docs.columns):
        prefix = f"_{prefix}"
    return score_quality(docs, text, rules, prefix).where(F.col(f"{prefix}kept")).select(*map(quoted, docs.columns))
