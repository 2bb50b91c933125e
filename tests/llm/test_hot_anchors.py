"""Windows that share an anchor and are not alike are dealt to more than one task, and equal ones still meet."""

import random

import brute
import numpy as np
import pytest

from keyfold.llm import spans


def texts_with_hot_anchors(sep):
    """One unit stands in most texts among unlike neighbours, some of which come again."""
    r = random.Random(8)
    out = []
    for i in range(150):
        w = [f"{sep}{r.randrange(10**9)}" for _ in range(60)]
        w[20:20] = ["common"] * (1 + i % 3)
        if i > 20 and r.random() < 0.4:
            w[5:5] = r.choice(out)[10:45]
        out.append(w)
    return out


@pytest.fixture
def early(monkeypatch):
    """Anchors are hot early, and all rows are looked at; the parts of the hot ones found in each run."""
    found, real = [], spans._hot

    def told(counts):
        found.append(real(counts))
        return found[-1]

    monkeypatch.setattr(spans, "_hot", told)
    monkeypatch.setattr(spans, "HOT_WINDOWS", 20)
    monkeypatch.setattr(spans, "SAMPLE", 1)
    return found


def test_results_with_hot_anchors_are_the_brute_force_ones(spark, early):
    for f, join, want, size in ((spans.drop_repeated_words, " ", brute.substring, "n_words"), (spans.drop_repeated_lines, "\n", brute.lines, "n_lines")):
        pairs = [(i, join.join(w)) for i, w in enumerate(texts_with_hot_anchors("u"))]
        docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r[size], r.n_removed, r.kept_text) for r in f(docs).collect()}
        assert got == want(pairs)
        assert sum(x[1] for x in got.values()) > 0
    assert len(early) == 2 and all(len(names) and parts.min() > 1 for names, parts in early)


def test_a_hot_anchor_is_dealt_to_many_buckets():
    r = np.random.default_rng(4)
    whash = np.r_[r.integers(0, 1 << 63, 10_000), r.integers(0, 50, 10_000)].astype(np.uint64)
    name = np.where(np.arange(20_000) % 2, np.uint64(7), r.integers(100, 1 << 62, 20_000).astype(np.uint64))
    whash = np.where(name == 7, whash, name)
    hot = np.array([7, 1 << 63], dtype=np.uint64), np.array([16, 3], dtype=np.uint64)
    by = spans._dealt(name, whash, hot)
    assert (by[name != 7] == name[name != 7]).all()
    parts, sizes = np.unique(by[(name == 7) & (np.arange(20_000) < 10_000)], return_counts=True)
    assert len(parts) == 16 and sizes.max() < 2 * 5000 / 16
    seen = {}
    for h, n, b in zip(whash.tolist(), name.tolist(), by.tolist(), strict=True):
        assert seen.setdefault((h, n), b) == b
    none = np.empty(0, np.uint64), np.empty(0, np.uint64)
    assert (spans._dealt(name, whash, none) == name).all()
