"""Texts made to mislead hashes, very long texts and words, names that need quoting, and plans that must stay in proportion."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.llm import common, exact, licences, minhash, mixing, packing, quality, queries, spans, tokens, urls


def thue_morse(n):
    """The word of n letters and its complement: alike for every polynomial hash modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def check_all(spark, texts, parts=3):
    pairs = list(enumerate(texts))
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(parts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in spans.drop_repeated_words(docs).collect()}
    assert got == brute.substring(pairs)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in spans.drop_repeated_lines(docs).collect()}
    assert got == brute.lines(pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_components(docs, num=85, den=100).collect()}
    assert got == brute.near(pairs, 85, 100)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score_quality(docs).collect()}
    assert got == {i: brute.quality(t) for i, t in pairs}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(docs).collect()}
    assert got == brute.exact(pairs)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    a, b = thue_morse(n)
    rest = [f"w{i}" for i in range(12)]
    fill = [f"f{i}" for i in range(60)]
    texts = [" ".join([a, *rest]), " ".join([b, *rest]), f"{a} x y", f"{b} x y", " ".join([a, "x", "y", *fill, b, "x", "y"]), f"{a}\n{b}\n{a}"]
    check_all(spark, texts)


def mixed_texts(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)]
    passages = [[r.choice(vocab) for _ in range(30)] for _ in range(4)]
    out = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.choice([0, 3, 13, 40, 90]))]
        if r.random() < 0.5:
            w[len(w) // 2 : len(w) // 2] = r.choice(passages)
        out.append("".join(x + r.choice([" ", " ", "\n"]) for x in w))
        if r.random() < 0.3:
            out.append(out[-1].replace(f"w{i % 50} ", "z "))
    return out


def test_words_decide_where_all_hashes_are_one(spark, monkeypatch):
    """With one hash for everything, results are the same: hashes only propose."""
    monkeypatch.setattr(common, "digests", lambda parts: np.zeros(len(parts), dtype=np.uint64))
    check_all(spark, mixed_texts(1))


def counting(real, path):
    """``real`` tells, and the number of units it tells of goes to a file."""

    def tell(self, at):
        own = real(self, at)

        def run(batches):
            for b in batches:
                with open(path, "a") as f:
                    places = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in b.column(b.num_columns - 1).to_pylist()]
                    f.write(f"{sum(int((x[:, 1] - x[:, 0]).sum()) for x in places)}\n")
                yield from own(iter([b]))

        return run

    return tell


def test_shared_anchors_are_what_is_compared(spark, monkeypatch, tmp_path):
    """What passes on to the comparison is what a real selector shares; a selector that names all windows alike passes everything on."""
    r = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(f"u{r.randrange(10**9)}" for _ in range(300)) for _ in range(40)]
    texts = [t if i % 10 else f"{t} {' '.join(passage)}" for i, t in enumerate(texts)]
    lines = ["\n".join(" ".join(x) for x in np.array(t.split()[:300]).reshape(-1, 6).tolist()) for t in texts]
    lines = [t if i % 10 else t + "\n" + " ".join(passage) for i, t in enumerate(lines)]

    def one(hashes, doc, start, end):
        return np.zeros(len(start), dtype=np.uint64), np.zeros(len(start), dtype=np.int64)

    for f, texts, select in ((spans.drop_repeated_words, texts, "recompression"), (spans.drop_repeated_lines, lines, "winnow")):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(20)
        sent, want = [], None
        for kind in ("own", "one"):
            counts = str(tmp_path / f"{select} {kind}")
            with monkeypatch.context() as m:
                if kind == "one":
                    m.setattr(spans, select, lambda h, doc, start, end, *a, **k: one(h, doc, start, end))
                m.setattr(spans.Repeats, "tell", counting(spans.Repeats.tell, counts))
                got = {r.doc_id: (r.n_removed, r.kept_text) for r in f(docs).collect()}
            with open(counts) as lines_:
                sent.append(sum(map(int, lines_)))
            assert want is None or got == want
            want = got
        assert sum(x[0] for x in want.values()) > 0
        assert sent[0] * 5 < sent[1]


def test_loosely_linked_texts_travel_in_proportion(spark, monkeypatch):
    """A template with gaps: all texts are candidates of each other and none is linked. Texts sent grow with their number, not its square."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 4)
    monkeypatch.setattr(minhash, "HUBS", 2)
    real, sent = minhash._verify, []

    def counted(rows, *a):
        sent[-1] += rows.count()
        return real(rows, *a)

    monkeypatch.setattr(minhash, "_verify", counted)
    base = [f"b{i}" for i in range(200)]
    for n in (60, 120, 240):
        r = random.Random(n)
        texts = []
        for i in range(n):
            w = list(base)
            for k in r.sample(range(200), 8):
                w[k] = f"m{i}_{k}"
            texts.append(" ".join(w))
        sent.append(0)
        pairs = list(enumerate(texts))
        docs = spark.createDataFrame(pairs, "doc_id long, text string")
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_components(docs, num=85, den=100).collect()}
        assert got == brute.near(pairs, 85, 100)
    each = [x / n for x, n in zip(sent, (60, 120, 240), strict=True)]
    print(each)
    assert each[2] < 1.8 * each[1] and each[2] < 100  # block against block it is twice as many with each doubling, and goes on


def test_texts_of_megabytes(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(5000)]
    long = " ".join(r.choice(vocab) for _ in range(400_000))  # some 2.3 MB
    part = " ".join(long.split()[1000:200_000])
    lines = "\n".join(" ".join(r.choice(vocab) for _ in range(10)) for _ in range(20_000))
    texts = [long, part, lines, "x" * 3_000_000, "é" * 1_000_000 + " y", "short text", None, lines + "\nend"]
    check_all(spark, texts, 4)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in tokens.count_tokens(docs).collect()}
    assert [got[i].n_words for i in range(6)] == [len(brute.words(t)) for t in texts[:6]] and got[3].n_tokens > 0
    digests = {r.doc_id: r.canonical_sha256 for r in licences.scan_licences(docs).collect()}
    import hashlib

    assert digests[2] == hashlib.sha256(brute.canonical(lines).encode()).hexdigest()
    sizes = {r.doc_id: r.n_tokens for r in mixing.mix_sources(docs, *queries.mixture(docs), 0.5).collect()}
    assert sizes == {i: len(brute.words(t)) for i, t in enumerate(texts)}
    pieces = packing.pack(docs.where("doc_id in (0, 2, 5, 6)")).collect()
    assert all(x.length <= 4096 for x in pieces) and max(x.start + x.length for x in pieces if x.doc_id == 0) > 400_000
    pages = spark.createDataFrame([(1, "http://example.org/es/" + "a/" * 1_000_000), (2, "x" * 2_000_000)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(pages, queries.URL_RULES).collect()} == {1: "block", 2: "allow"}


def test_names_that_need_quoting(spark):
    rows = [(i, "a b c d e f g " * 8, "en", "s", f"http://example.org/es/{i}") for i in range(3)] + [(3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "`a.b` long, `te.xt` string, lang string, source string, `u.rl` string")
    where = {"key": "a.b", "text": "te.xt"}
    for f in (spans.drop_repeated_words, spans.drop_repeated_lines, exact.exact_groups, minhash.near_components, tokens.count_tokens, licences.scan_licences, packing.pack):
        got = f(docs, **where)
        assert "a.b" in got.columns and {r["a.b"] for r in got.collect()} == {0, 1, 2, 3}
    for f in (exact.drop_exact_copies, minhash.drop_near_copies):
        assert {r["a.b"] for r in f(docs, **where).collect()} == {0, 3}
    assert quality.score_quality(docs, text="te.xt").count() == 4 and quality.keep_good(docs, text="te.xt").columns == docs.columns
    dims, targets = {"lang": F.col("lang")}, {"lang": {"en": 1.0}}
    assert mixing.mix_sources(docs, dims, targets, 0.5, **where).count() == 4
    assert mixing.mix_sources(docs, dims, targets, 0.5, keep=True, **where).columns == docs.columns
    table = spark.createDataFrame(queries.URL_RULES, "verdict string, host string, path string")
    for got in (urls.filter_urls(docs, queries.URL_RULES, url="u.rl", key="a.b"), urls.filter_urls_joined(docs, table, url="u.rl", key="a.b")):
        assert {r["a.b"]: r.verdict for r in got.collect()} == {0: "block", 1: "block", 2: "block", 3: "allow"}


def test_rows_without_ids(spark):
    """Documents without ids come after all others, equal ones count as one, and one of them stays."""
    text, other = " ".join(map(str, range(40))), " ".join(map(str, range(50, 90)))
    rows = [(1, text), (None, text), (None, text), (None, other), (None, other), (None, other + " x"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_components(docs).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(
        map(str, [(1, 36, 1), (None, 36, 1), (None, 36, 1), (None, 36, None), (None, 36, None), (None, 37, None), (None, 0, None), (None, 0, None)])
    )
    kept = [(r.doc_id, r.text or "") for r in minhash.drop_near_copies(docs).collect()]
    assert len(kept) == 3 and (1, text) in kept and (None, "") in kept and len({k for k in kept if k[1].startswith("50")}) == 1


def test_urls_empty_repeated_and_tied(spark):
    rules = [("allow", "a.org", "/x"), ("block", "a.org", "/x"), ("block", "org", "/yy"), ("allow", "b.org", "")]
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (2, "http://b.org/yy"), (None, None)], "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for f in (lambda p: urls.filter_urls(p, rules), lambda p: urls.filter_urls_joined(p, table)):
        assert sorted(str((r.page_id, r.rule, r.verdict)) for r in f(pages).collect()) == sorted(
            map(str, [(1, "a.org/x", "block"), (1, "a.org/x", "block"), (2, "org/yy", "block"), (None, None, "allow")])
        )
        assert f(pages.limit(0)).count() == 0
