"""Documents that share one band, and that a crowded one, are compared; with few bands nearly all pairs are such."""

import random

import brute
import corpus_pipeline as cp
import pytest
from conftest import SMALL

from keyfold.llm import minhash


def gapped(seed, n, gaps, length=200, copies=0.25):
    """A template with gaps, so that all are candidates of each other, and here and there a text that one or two words tell from an earlier one."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < copies:
            w = r.choice(out).split()
            for k in r.sample(range(length), r.choice([1, 2])):
                w[k] = f"c{i}_{k}"
        else:
            w = [f"b{k}" for k in range(length)]
            for k in r.sample(range(length), gaps):
                w[k] = f"m{i}_{k}"
        out.append(" ".join(w))
    return out


@pytest.fixture
def crowded(monkeypatch):
    """Small blocks and one band of one coordinate, hence no second band to split a crowded one by; how often ``_rest`` had to do something."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 4)
    monkeypatch.setattr(minhash, "HUBS", 1)
    real, plan, seen = minhash._rest, minhash.Bands(bands=1, rows=1), []

    def told(*a):
        seen.append(real(*a))
        return seen[-1]

    monkeypatch.setattr(minhash, "_rest", told)
    monkeypatch.setattr(minhash, "Bands", lambda: plan)
    return seen


def band(texts):
    """The one band of each text."""
    return [minhash.band_keys(s[None], minhash.Bands())[0, 0] for s in minhash._sketches([t.encode() for t in texts], 5, minhash.Bands())[2]]


def linked(pairs, num, den):
    """The components over links between texts of one band; what shares no band is not proposed."""
    by = {}
    for p, b in zip(pairs, band([t for _, t in pairs]), strict=True):
        by.setdefault(b, []).append(p)
    assert max(map(len, by.values())) > 40
    return {i: v for x in by.values() for i, v in brute.near(x, num, den).items()}


@pytest.mark.parametrize("gaps", [4, 7, 14])
def test_pairs_that_share_one_crowded_band_are_linked(spark, crowded, gaps):
    pairs = list(enumerate(gapped(gaps, 120, gaps)))
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    want = linked(pairs, 4, 5)
    assert 1 < len({v[1] for v in want.values()}) < len(want)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_components(docs).collect()} == want
    assert {r.doc_id for r in cp.dedup_near(spark, docs, SMALL).collect()} == {i for i, v in want.items() if v[1] == i}
    assert crowded and all(x is not None for x in crowded)
