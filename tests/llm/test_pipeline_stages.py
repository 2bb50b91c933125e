"""The pipeline's verdict, mixture and packing against plain Python, by the documents kept."""

import random

import brute
import corpus_pipeline as cp
import pytest
from conftest import SMALL
from test_mixing import mixed

from keyfold.llm import quality
from keyfold.llm import queries as q

LIMITS = {2: 65, 4: 55, 6: 50, 8: 45, 10: 40}  # percent


def good(text):
    """The verdict: the base rule, the share of characters in repeated n-grams, repeated lines and symbols."""
    text = text or ""
    w, symbols, base = brute.words(text), brute.quality(text)[2], brute.quality(text)[5]
    total = max(1, sum(map(len, w)))
    if base or 100 * symbols > 30 * len(w):
        return False
    for n, limit in LIMITS.items():
        where = {}
        for k in range(len(w) - n + 1):
            where.setdefault(tuple(w[k : k + n]), []).append(k)
        hit = {k + j for v in where.values() if len(v) > 1 for k in v for j in range(n)}
        if 100 * sum(len(w[k]) for k in hit) > limit * total:
            return False
    lines = [x for x in text.split("\n") if brute.words(x)]
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    return 100 * sum(len(x) for y in again for x in brute.words(y)) <= 40 * total and 100 * len(again) <= 40 * len(lines)


def repetitive(seed, n=400):
    """Texts about the limits: repeated passages of every length, repeated lines, and symbols."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = [f"{r.choice(['w', 'wörd'])}{r.randrange(10**6)}" for _ in range(r.choice([30, 45, 60, 120]))]
        size, kind = r.choice([2, 3, 4, 6, 8, 10, 14]), r.random()
        if kind < 0.5:
            some = [w[k : k + size] for k in range(0, len(w) - size, size)]
            w += [x for run in r.sample(some, r.randrange(len(some))) for x in [*run, f"z{r.randrange(10**6)}"]]
        elif kind < 0.7:
            w += [r.choice("#*$%&|<>") * r.choice([1, 2]) for _ in range(r.randrange(len(w) // 2))]
        text = " ".join(w)
        if kind >= 0.7:
            lines = [" ".join(w[k : k + 2]) for k in range(0, len(w), 2)]
            text = "\n".join(lines + ["a b"] * r.randrange(40)) if kind < 0.8 else "\n".join(lines + r.sample(lines, r.randrange(len(lines))))
        out.append(text)
    return out


def near_limits(seed):
    """For each limit texts that only this limit decides: shares of characters, in long words, from 0.8 to 1.2 times it."""
    r = random.Random(seed)

    def fresh(n):
        return "".join(r.choice("abcdefghij") for _ in range(n))

    out = []
    for size, limit in LIMITS.items():
        for _ in range(60):
            runs = [[fresh(12) for _ in range(size)] for _ in range(40 // size)] * 2
            inside = 12 * size * len(runs)
            rest = [fresh(6) for _ in range(int(inside / (limit / 100 * r.uniform(0.8, 1.2)) - inside) // 6)]
            r.shuffle(runs)
            cut = sorted(r.sample(range(1, len(rest)), len(runs)))
            out.append(" ".join(x for k, run in enumerate(runs) for x in [*rest[cut[k - 1] if k else 0 : cut[k]], *run]) + " " + " ".join(rest[cut[-1] :]))
    for _ in range(60):
        lines = [fresh(30)] * 21
        rest = [f"{fresh(4)} {fresh(4)}" for _ in range(int(20 * 30 / (0.4 * r.uniform(0.8, 1.2)) - 21 * 30) // 8)]
        out.append("\n".join(x for k, y in enumerate(rest) for x in ([lines[k], y] if k < len(lines) else [y])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_the_verdict_is_the_brute_force_one(spark, seed):
    pairs = list(enumerate(repetitive(seed) + near_limits(seed)))
    want = {i for i, t in pairs if good(t)}
    base = {i for i, t in pairs if not brute.quality(t)[5]}
    assert want < base and len(want) > 50
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == want
    assert {r.doc_id for r in quality.score_quality(docs).where("kept").collect()} == want


def test_each_stage_keeps_what_brute_force_keeps(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = {r.doc_id: (r.text, r.lang, r.source) for r in q.documents(spark, SMALL).collect()}
    rows = {i: r for i, r in rows.items() if good(r[0])}
    df = cp.filter_quality(spark, q.documents(spark, SMALL), SMALL)
    assert {r.doc_id for r in df.collect()} == set(rows)
    kept = {i for i, v in brute.exact([(i, r[0]) for i, r in rows.items()]).items() if v[2]}
    kept = {i for i, v in brute.near([(i, rows[i][0]) for i in sorted(kept)], 4, 5).items() if v[1] == i}
    df = cp.dedup_near(spark, cp.dedup_exact(spark, df, SMALL), SMALL)
    assert {r.doc_id for r in df.collect()} == kept
    kept = {i for i, v in mixed([(i, *rows[i]) for i in kept], 0.5).items() if v[2]}
    assert {r.doc_id for r in cp.mix(spark, df, SMALL).collect()} == kept
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length, ends = {}, {}
    for r in cp.run(spark, SMALL).collect():
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    assert length == {i: 1 + len(model.encode(rows[i][0], add_special_tokens=False).ids) for i in kept}
    for s in map(sorted, ends.values()):
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s[:-1], s[1:], strict=True))
