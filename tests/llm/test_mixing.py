"""Source mixing with more sources than one could name, against raking and drawing in plain Python."""

import random

import brute
import pytest
import xxhash

from keyfold.llm import mixing, queries

ALPHA = 0.5


def margin(share, there, budget):
    """Tokens of each value: the lesser of what there is and its share times a level that uses up the budget."""
    low, high = 0.0, budget / min(share.values()) + sum(there.values()) / min(share.values())
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(there[v], level * share[v]) for v in there) < budget:
            low = level
        else:
            high = level
    return {v: min(there[v], high * share[v]) for v in there}


def kind(text):
    n = len(text or "")
    return "note" if n < 600 else "article" if n < 6000 else "treatise"


def mixed(rows, budget):
    """{doc_id: (cell, probability, kept)}; rows are (doc_id, text, lang, source)."""
    cell = {i: (s or "other", x if x in queries.LANGUAGES else "other", kind(t)) for i, t, x, s in rows}
    mass = {}
    for i, t, _, _ in rows:
        mass[cell[i]] = mass.get(cell[i], 0) + len(brute.words(t))
    budget *= sum(mass.values())
    there = [{}, {}, {}]
    for c, n in mass.items():
        for d in range(3):
            there[d][c[d]] = there[d].get(c[d], 0) + n
    shares = [{s: n**ALPHA for s, n in there[0].items()}, queries.LANGUAGES, queries.TOPICS]
    wants = [margin({v: shares[d][v] for v in there[d]}, there[d], budget) for d in range(3)]
    take = {c: float(n) for c, n in mass.items()}
    for _ in range(200):
        old = dict(take)
        for d in range(3):
            have = {}
            for c, n in take.items():
                have[c[d]] = have.get(c[d], 0) + n
            take = {c: n * wants[d][c[d]] / have[c[d]] if have[c[d]] else 0.0 for c, n in take.items()}
        take = {c: min(n, mass[c]) for c, n in take.items()}
        if sum(abs(take[c] - old[c]) for c in take) <= 1e-10 * budget:
            break
    out = {}
    for i, t, _, _ in rows:
        p = take[cell[i]] / mass[cell[i]]
        h = 42
        for x in (i.to_bytes(8, "little"), t.encode(), (17).to_bytes(4, "little")):
            h = xxhash.xxh64_intdigest(x, h)
        out[i] = (cell[i], p, (h >> 11) / (1 << 53) < p)
    return out


def site_rows(n_sources):
    """A few heavy sources, many light ones of unlike sizes, languages and lengths, and rows without source."""
    r = random.Random(n_sources)
    out = []
    for i in range(2 * n_sources):
        s = None if r.random() < 0.01 else f"s{i % n_sources}" if r.random() < 0.9 else f"s{r.randrange(5)}"
        n = r.choice([20, 60, 150, 300, 900, 1700 if i % 7 == 0 else 40])
        out.append((i, " ".join(r.choice(["one", "two", "three"]) for _ in range(n)), r.choice(["en", "en", "de", "fr", "es", "xx"]), s))
    return out


@pytest.mark.parametrize("bound", [100_000, 100])
def test_mixture_of_many_sources_is_the_brute_force_one(spark, monkeypatch, bound):
    """Fitted on the driver and fitted where the cells are: the same probabilities, the same documents."""
    monkeypatch.setattr(mixing, "DRIVER_CELLS", bound)
    rows = site_rows(1500)
    want = mixed(rows, 0.5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: r for r in mixing.mix_sources(docs, *queries.mixture(docs), 0.5).collect()}
    assert got.keys() == want.keys()
    for i, (cell, p, kept) in want.items():
        assert (got[i].source, got[i].lang, got[i].topic) == cell
        assert got[i].probability == pytest.approx(p, rel=1e-6, abs=1e-9) and got[i].kept == kept
    kept = mixing.mix_sources(docs, *queries.mixture(docs), 0.5, keep=True)
    assert {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if v[2]}


@pytest.mark.parametrize("bound", [100_000, 100])
def test_a_sources_rank_does_not_change_its_share(spark, monkeypatch, bound):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", bound)
    docs = spark.createDataFrame([(i, "w " * 100, "en", f"s{i:04d}") for i in range(2000)], "doc_id long, text string, lang string, source string")
    p = [r.probability for r in mixing.mix_sources(docs, *queries.mixture(docs), 0.5).collect()]
    assert len(p) == 2000 and p == pytest.approx([0.5] * 2000)
