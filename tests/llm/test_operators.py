import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from keyfold.llm import exact, licences, minhash, mixing, packing, quality, queries, spans, tokens, urls
from keyfold.llm.common import Words, components


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket int, spans string")


def rows_of(texts, ids=None):
    return [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]


def varied(seed, n=120):
    """Texts with copies, edited copies, shared passages, empties, runs, odd white space and other scripts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ÄB", "\u00a0", "x\u2003y", "a.", "😀", "The", "the"]
    passage = [r.choice(vocab) for _ in range(40)]
    out = []
    for _ in range(n):
        k = r.random()
        if k < 0.45 or not out:
            w = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 5, 12, 13, 14, 60, 120, 300]))]
            if r.random() < 0.3:
                a = r.randrange(len(w) + 1)
                w[a:a] = passage[r.randrange(10) :]
            if r.random() < 0.15:
                w += ["run"] * r.randrange(40)
            seps = [r.choice([" ", " ", " ", "\n", "\t ", "\r\n"]) for _ in w]
            out.append("".join(x + s for x, s in zip(w, seps, strict=True)))
        elif k < 0.6:
            out.append(r.choice(out))
        elif k < 0.7:
            out.append(None if r.random() < 0.3 else r.choice(["", " \n", "one", "a b c d", "a b c d e"]))
        else:
            w = (r.choice(out) or "").split(" ")
            for _ in range(r.choice([1, 1, 2, 4])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_against_brute_force(spark, seed):
    texts = varied(seed)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    rows = rows_of(texts, ids)
    docs, pairs = frame(spark, rows).repartition(5), list(zip(ids, texts, strict=True))

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in spans.drop_repeated_words(docs).collect()}
    assert got == brute.substring(pairs)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in spans.drop_repeated_lines(docs).collect()}
    assert got == brute.lines(pairs)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(docs, first_digit=8, growth=2).collect()}
    assert got == brute.exact(pairs)
    for num, den in ((85, 100), (4, 5)):
        want = brute.near(pairs, num, den)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_components(docs, num=num, den=den).collect()}
        assert got == want
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score_quality(docs).collect()}
    assert got == {i: brute.quality(t) for i, t in pairs}
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in brute.exact(pairs).items() if v[2]}
    near = brute.near(pairs, 4, 5)
    assert {r.doc_id for r in minhash.drop_near_copies(docs).collect()} == {i for i, v in near.items() if v[1] == i}


def test_large_candidate_groups_go_through_blocks(spark, monkeypatch):
    """Chains and a rest outside the main part, with blocks so small that hubs and second rounds are needed."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 6)
    monkeypatch.setattr(minhash, "HUBS", 1)
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for chain in range(3):
        w = list(base)
        for k in range(chain * 3):
            w[k * 11 + chain] = f"c{chain}_{k}"
        for step in range(16):
            w[r.randrange(len(w))] = f"m{chain}_{step}"
            texts.append(" ".join(w))
    pairs = list(enumerate(texts))
    want = brute.near(pairs, 85, 100)
    assert len({v[1] for v in want.values()}) > 1
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_components(frame(spark, rows_of(texts)), num=85, den=100).collect()}
    assert got == want


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(3)
    units = r.integers(0, 3, 4000).astype(np.uint64)
    doc = np.repeat(np.arange(8), 500)
    start = np.flatnonzero(doc[:-12] == doc[12:])
    for select in (lambda *a: spans.recompression(*a, width=13), spans.winnow):
        name, at = select(units, doc, start, start + 13)
        seen = {}
        for i, x in zip(start.tolist(), name.tolist(), strict=True):
            assert seen.setdefault(tuple(units[i : i + 13]), x) == x


def test_edge_rows(spark):
    """Nulls, repeated rows and ids, empty tables and clashing column names have the results the docstrings state."""
    texts = ["a b c", "a  b\nc", None, "", "a b c", "a b c", " ".join(map(str, range(30))), " ".join(map(str, range(30)))]
    docs = frame(spark, rows_of(texts, [3, 4, 5, 6, None, 3, None, 9]))
    got = exact.exact_groups(docs).collect()
    assert len(got) == 8 and sum(x.kept for x in got) == 3
    assert {x.keep_id for x in got if x.group_size == 5 or x.group_size == 4} == {3}
    assert exact.drop_exact_copies(docs).count() == 3
    near = minhash.near_components(docs).collect()
    assert len(near) == 8 and {x.component_id for x in near if x.doc_id == 4} == {3}
    assert [x.kept for x in near if x.doc_id is None] == [False, False]
    words = {(x.doc_id, x.n_words): x.n_removed for x in spans.drop_repeated_words(docs).collect()}
    assert words[None, 30] == 30 and words[9, 30] == 0 and words[5, 0] == 0
    packed = packing.pack(docs).collect()
    assert len(packed) == 8 and {x.length for x in packed if x.doc_id in (5, 6)} == {1}
    empty = docs.limit(0)
    for f in (exact.exact_groups, exact.drop_exact_copies, minhash.near_components, minhash.drop_near_copies, packing.pack):
        assert f(empty).count() == 0
    for f in (spans.drop_repeated_words, spans.drop_repeated_lines, quality.score_quality, quality.keep_good, tokens.count_tokens, licences.scan_licences):
        assert f(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None)], "page_id long, url string, host string")
    assert urls.filter_urls(nulls, queries.URL_RULES).collect()[0].verdict == "allow"
    mixed = mixing.mix_sources(docs.withColumn("topic", F.lit(None).cast("string")), *queries.mixture(docs), 0.5).collect()
    assert len(mixed) == 8
    assert mixing.mix_sources(empty, *queries.mixture(empty), 0.5).count() == 0


#: Names that operators use inside or give to results, in either case, and one that needs quoting.
ODD = [
    "id", "norm", "LEN", "head", "n", "Kept", "keep_id", "group_size", "text_sha256", "rest", "uid", "gid", "digit", "component_id", "n_shingles",
    "rep", "bands", "band", "bin", "part", "label", "cand", "blocks", "tag", "spans", "N_words", "n_removed", "kept_text", "n_lines", "__id", "__TAG",
    "__spans", "__sha", "__kept_sha", "__kept", "__q_kept", "__d0", "__c1", "__p", "topic", "probability", "n_tokens", "piece", "start", "length",
    "offset", "sequence_id", "rank", "worst_coverage", "word_chars", "licence", "notices", "digest", "a.b", "c`d",
]


def test_columns_with_clashing_names(spark):
    """Extra columns, null in every row or not, change no result; operators that return whole rows return them."""
    texts = varied(11, 40)
    plain = spark.createDataFrame(list(zip(range(40), texts, ["en"] * 40, ["s"] * 40, strict=True)), "doc_id long, text string, lang string, source string")
    extra = plain.select("*", *[F.lit("x" if i % 2 else None).cast("string").alias(c) for i, c in enumerate(ODD)])

    def rows(df, *cols):
        return sorted(map(str, (df.select(*cols) if cols else df).collect()))

    mixed = lambda d: mixing.mix_sources(d, *queries.mixture(d), 0.5)
    for f in (exact.exact_groups, minhash.near_components, tokens.count_tokens, licences.scan_licences, packing.pack, mixed):
        assert rows(f(extra).drop("sequence_id", "offset")) == rows(f(plain).drop("sequence_id", "offset"))
    for f in (spans.drop_repeated_words, spans.drop_repeated_lines, quality.score_quality):
        got, want = f(extra), f(plain)
        assert rows(got, *want.columns) == rows(want)
        assert len(got.columns) < len(ODD) + len(want.columns)  # clashing ones gave way
    mixed = lambda d: mixing.mix_sources(d, *queries.mixture(d), 0.5, keep=True)
    for f in (exact.drop_exact_copies, minhash.drop_near_copies, quality.keep_good, mixed):
        got = f(extra)
        assert got.columns == extra.columns
        assert rows(got, "doc_id") == rows(f(plain), "doc_id")


def test_rows_of_nulls(spark):
    docs = spark.createDataFrame([(None, None, None, None)] * 3 + [(1, None, None, None), (2, "a b " * 40, None, None)], "doc_id long, text string, lang string, source string")
    assert [len(f(docs).collect()) for f in (exact.exact_groups, minhash.near_components, tokens.count_tokens, licences.scan_licences, packing.pack)] == [5] * 5
    assert [len(f(docs).collect()) for f in (spans.drop_repeated_words, spans.drop_repeated_lines, quality.score_quality)] == [5] * 3
    assert exact.drop_exact_copies(docs).count() == 2
    rows = mixing.mix_sources(docs, *queries.mixture(docs), 0.5).collect()
    assert {(r.source, r.lang) for r in rows} == {("other", "other")} and len(rows) == 5


def test_packing_matches_the_tokenizer_and_is_tight(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = [(10**6 + i, t) for i, t in enumerate(["Don't \x01 stop\x01it", "<|endoftext|> e\u0301 \u0301a", "Ⅷ 數字 ﬁ 12ab", "x" * 9000, None, "\u00a0\u2003"])]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    room = 512
    got = packing.pack(docs, room=room).collect()
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for i, t in [(r.doc_id, r.text) for r in docs.collect()]:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), room))
        for r in pieces:
            part = np.array(ids[r.start : r.start + room], dtype="<u4")
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= room
    assert len(seqs) <= 1.02 * total / room + 1


def test_plan_of_any_histogram():
    r = np.random.default_rng(0)
    for hist in (np.zeros(129), np.r_[0, np.full(128, 7)], np.bincount(r.integers(1, 129, 3000), minlength=129), np.bincount([100] * 50 + [28] * 40, minlength=129)):
        rows, n = packing.plan_packing(hist.astype(np.int64), 128, n_bins=16)
        placed = {}
        for i, (length, rank, seq, offset) in enumerate(rows.tolist()):
            end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == length else int(hist[length])
            for k in range(end - rank):
                placed.setdefault(seq + k, []).append((offset, length))
        assert sum(len(x) for x in placed.values()) == hist.sum() and len(placed) == n
        for s in placed.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 128


def test_nnls_finds_the_non_negative_optimum():
    r = np.random.default_rng(1)
    a = r.random((12, 30))
    x = np.where(r.random(30) < 0.2, r.random(30), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6


def test_greedy_counts(spark):
    vocab = {b"a", b"b", b"c", b"ab", b"abc", b"bca", b"cabc", b"aab"}
    m = tokens.LongestMatch(map(tuple, vocab))
    r = random.Random(2)
    for _ in range(3000):
        w = bytes(r.choice(b"abcd" if r.random() < 0.1 else b"abc") for _ in range(r.randrange(12)))
        assert m.count(w) == brute.greedy(w, vocab, 4)
    first, rest = {b"a", b"ab", b"c"}, {b"b", b"ba", b"a"}
    m = tokens.LongestMatch(map(tuple, first), map(tuple, rest))
    assert [m.count(w) for w in (b"abba", b"cba", b"ba", b"acb", b"")] == [2, 2, -1, -1, 0]
    bodies = tokens.byte_vocabulary("word_bpe_49k.json")
    assert (tokens.END,) in bodies and all((b,) in bodies and (b, tokens.END) in bodies for b in range(33, 127))
    longest = max(map(len, bodies))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in tokens.count_tokens(docs).collect()}
    cache = {}
    for r in docs.collect():
        w = [(*x.lower().encode(), tokens.END) for x in brute.words(r.text)]
        for x in set(w) - cache.keys():
            cache[x] = brute.greedy(x, bodies, longest)
        assert got[r.doc_id] == (len(w), sum(cache[x] for x in w), 0)


def test_urls_against_brute_force(spark):
    rules = [*queries.URL_RULES, ("block", "a.example.org", ""), ("allow", "a.example.org", "/en/12"), ("block", "net", "/x/y")]
    hosts = ["org", "example.org", "A.Example.ORG", "b.a.example.org", "xorg", "example.org.", "com", "m.com", "net:80", "net", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/3", "/en/2", "/fr/x?y", "/de/#z", "?q=/es/", "/x/yz", "/x/"]
    all_urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "example.org/es/", "a://b://c/es/", "://org/"]
    pages = spark.createDataFrame(list(enumerate(all_urls)), "page_id long, url string")
    want = {i: brute.url(u, rules) for i, u in enumerate(all_urls)}
    for f in (urls.filter_urls(pages, rules), urls.filter_urls_joined(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in f.collect()} == want


def test_licences(spark):
    body = licences.KNOWN["MIT"]
    mit = "Copyright (c) 2020 Jane\n\n" + body.upper().replace(",", " ,").replace(" ", "\n ", 3)
    wrapped = "BSD 2-Clause License\n\nCopyright (c) 2020, Jane\nAll rights reserved.\n\n" + licences.KNOWN["BSD-2-Clause"].replace("COPYRIGHT HOLDER OR", "\nCOPYRIGHT HOLDER OR")
    notice = "Released under the MIT License."
    texts = [
        mit, "x " + mit, "Prose.\nLICENSED under CC-BY-NC 4.0\nmore", None, licences.KNOWN["Zlib"], "The MIT License (MIT)\n" + mit, wrapped,
        notice + "\rCopyright 2020 J", notice + "\rCopyright 2020 J" + "x" * 400, notice + "\u0085Copyright 2020 J", notice + "\u2028(c) 2020",
        "\u2028" * 500 + notice + "." * 5000 + "\nfoo", "Copyright 2020 " + notice, notice + "\nCopyright 2020 Jane " + "y" * 5000, "", " \n ",
    ]
    docs = frame(spark, rows_of(texts)).repartition(3)
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan_licences(docs).collect()}
    n = "notice:MIT"
    assert got == {
        0: ("MIT", ""), 1: (None, ""), 2: (None, "notice:CC-BY-NC-4.0"), 3: (None, ""), 4: ("Zlib", ""), 5: ("MIT", ""), 6: ("BSD-2-Clause", ""),
        7: (None, ""), 8: (None, ""), 9: (None, ""), 10: (None, ""), 11: (None, n), 12: (None, ""), 13: (n, n), 14: (None, ""), 15: (None, ""),
    }
    digests = {r.doc_id: r.canonical_sha256 for r in licences.scan_licences(docs).collect()}
    assert digests == {i: sha(brute.canonical(t)) for i, t in enumerate(texts)}
    real = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r.doc_id: sha(brute.canonical(r.text)) for r in real.collect()}
    assert {r.doc_id: r.canonical_sha256 for r in licences.scan_licences(real).collect()} == want
    assert {licences.canonical_text(t or "") for t in texts} == {brute.canonical(t) for t in texts}


def test_raking_meets_the_margins():
    r = np.random.default_rng(4)
    codes = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(3), 2), 4), np.tile(np.arange(2), 12)]
    mass = r.uniform(50, 500, 24)
    shares = [np.array([0.3, 0.2, 0.4, 0.1]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    w = mixing.rake(mass, codes, shares, budget=300.0)
    assert (w <= mass + 1e-9).all()
    for c, t in zip(codes, shares, strict=True):
        assert np.allclose(np.bincount(c, weights=w), 300 * t, rtol=1e-6)


def test_what_a_poor_value_lacks_is_taken_from_others():
    got = mixing.margin(np.array([0.5, 0.3, 0.2, 0.0]), np.array([10.0, 1000.0, 1000.0, 1000.0]), 100.0)
    assert np.allclose(got, [10, 54, 36, 0])
    assert mixing.margin(np.array([0.5, 0.5]), np.array([1.0, 2.0]), 100.0).tolist() == [1, 2]
    w = mixing.rake(np.array([10.0, 500.0]), [np.array([0, 1])], [np.array([0.5, 0.5])], budget=100.0)
    assert np.allclose(w, [10, 90])


def test_sampling_follows_the_probabilities(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_sources(docs, *queries.mixture(docs), 0.5).collect()
    want = sum(r.n_tokens * r.probability for r in rows)
    sd = sum(r.n_tokens**2 * r.probability * (1 - r.probability) for r in rows) ** 0.5
    assert abs(sum(r.n_tokens for r in rows if r.kept) - want) < 5 * sd
    assert abs(want - 0.5 * sum(r.n_tokens for r in rows)) < 0.02 * want
    kept = mixing.mix_sources(docs, *queries.mixture(docs), 0.5, keep=True)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {x.node: x.comp for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in nodes}


def test_words_agree_with_the_expression():
    texts = [t or "" for t in varied(7)]
    w = Words([t.encode() for t in texts])
    assert np.diff(w.bounds).tolist() == [len(brute.words(t)) for t in texts]
    flat = [x for t in texts for x in brute.words(t)]
    assert len(set(w.hashes.tolist())) == len(set(flat)) == len(set(zip(flat, w.hashes.tolist(), strict=True)))
