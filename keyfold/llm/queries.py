"""The operators' registered queries, with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, licences, minhash, mixing, packing, quality, spans, tokens, urls

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Shares of languages; "other" stands for all languages that are not named, and for none. A share that no text can fill goes to the rest in proportion.
LANGUAGES = {"en": 0.49, "de": 0.196, "fr": 0.147, "es": 0.147, "other": 0.02}
TOPICS = {"note": 0.1, "article": 0.6, "treatise": 0.3}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def topic(text: str = "text"):
    """The table has no topic column; a document's kind by its length in characters stands in for one."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return F.when(n < 600, "note").when(n < 6000, "article").otherwise("treatise")


def mixture(docs: DataFrame) -> tuple[dict, dict[str, dict]]:
    """Dimensions and targets: every source (none counts as "other") by the square root of its tokens, languages and topics as given."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("other"))
    lang = F.when(F.col("lang").isin([x for x in LANGUAGES if x != "other"]), F.col("lang")).otherwise("other")
    return {"source": source, "lang": lang, "topic": topic()}, {"source": 0.5, "lang": LANGUAGES, "topic": TOPICS}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = spans.drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = spans.drop_repeated_words(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(documents(spark, sf_dir))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(documents(spark, sf_dir), num=85, den=100)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.score_quality(docs).drop("text", "worst_coverage")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.mix_sources(docs, *mixture(docs), budget=0.5)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def queries() -> dict:
    own = (
        op1_best_fit_packing,
        op2_token_counts,
        op3_line_dedup,
        op4_substring_dedup,
        op5_exact_dedup,
        op6_license_scans,
        op7_minhash_near_dedup,
        op8_quality_rules,
        op9_source_mixing,
        op10_url_filters,
    )
    import corpus_pipeline

    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_WORDS = r"'[^\x20\x09-\x0D]+'"


def _op2_sql() -> str:
    """The longest piece at every place of every distinct word, then a walk from piece to piece; a blank stands for the end of a word."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return f"""
with recursive each as (
  select doc_id, unnest(regexp_extract_all(coalesce(text, ''), {_WORDS})) as word from documents
), symbols as (
  select list(chr(cast(case when own then b else 255 + n end as integer)) order by b) as list from (
    select b, own, row_number() over (partition by own order by b) as n
    from (select b, b between 33 and 126 or b between 161 and 172 or b between 174 and 255 as own from range(256) t(b)))
), known as (
  select distinct regexp_replace(piece, '</w>$', ' ') as piece from (
    select unnest(json_keys(model, '$.vocab')) as piece from read_json('{path}', columns = {{model: 'JSON'}})) where piece <> '</w>'
  union select ' '
), spelt as (
  select word, array_to_string(list_transform(range(0, len(h) // 2), lambda i: list[cast('0x' || substr(h, 2 * i + 1, 2) as integer) + 1]), '') || ' ' as s
  from (select word, hex(encode(lower(word))) as h from (select distinct word from each)), symbols
), longest as (
  select max(length(piece)) as n from known
), places as (
  select word, s, unnest(range(1, length(s) + 1)) as place from spelt
), tries as (
  select word, place, unnest(range(1, least(n, length(s) - place + 1) + 1)) as size, s from places, longest
), steps as (
  select word, place, max(size) as size from tries join known on piece = substr(s, place, size) group by word, place
), walk(word, place, n) as (
  select word, cast(1 as bigint), cast(0 as bigint) from spelt
  union all select w.word, w.place + t.size, n + 1 from walk w join steps t on t.word = w.word and t.place = w.place
), counts as (
  select word, max(n) as n from walk group by word
), told as (
  select doc_id, count(*) as n_words, cast(sum(n) as bigint) as n_tokens from each join counts using (word) group by doc_id
)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_tokens, 0) as n_tokens, cast(0 as bigint) as n_unknown
from documents d left join told on d.doc_id = told.doc_id
"""


def _op4_sql() -> str:
    return f"""
with texts as (
  select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) as ws from documents
), win as (
  select doc_id, p, array_to_string(ws[p:p + 12], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from texts)
), late as (
  select doc_id, p from (select doc_id, p, min(doc_id) over (partition by g) as first from win) where first < doc_id
), gone as (
  select distinct doc_id, p + k as pos from late, range(13) t(k)
), words as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from texts
), told as (
  select w.doc_id, count(*) as n_words, count(g.pos) as n_removed, string_agg(word, ' ' order by w.pos) filter (where g.pos is null) as kept
  from words w left join gone g on w.doc_id = g.doc_id and w.pos = g.pos group by w.doc_id
)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join told on d.doc_id = told.doc_id
"""


def _op7_sql() -> str:
    return f"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), {_WORDS}) as ws from documents
), shingles as (
  select distinct doc_id, array_to_string(ws[p:p + 4], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) as p from texts where len(ws) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as n_both from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * n_both >= 85 * (x.n + y.n - n_both)
), edges as (
  select a, b from links union all select b, a from links
), reach(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, e.b from reach r join edges e on e.a = r.other
), comps as (
  select doc_id, min(other) as component_id from reach group by doc_id
)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join comps on comps.doc_id = d.doc_id left join sizes on sizes.doc_id = d.doc_id
"""


def _op8_sql() -> str:
    rules = quality.Rules()
    limits = ", ".join(f"({n}, {limit})" for n, limit in sorted(rules.ngram_limits.items()))
    sizes = ", ".join(f"({n})" for n in sorted({3, *rules.ngram_limits}))
    return f"""
with texts as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORDS}) as ws from documents
), words as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from texts
), grams as (
  select doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') as g
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from texts, (values {sizes}) s(n))
), twice as (
  select doc_id, n, p from (select doc_id, n, p, count(*) over (partition by doc_id, n, g) as c from grams) where c > 1
), inside as (
  select distinct doc_id, n, pos from (select doc_id, n, unnest(range(p, p + n)) as pos from twice)
), covered as (
  select i.doc_id, i.n, count(*) as words, sum(length(word)) as chars
  from inside i join words w on i.doc_id = w.doc_id and i.pos = w.pos group by i.doc_id, i.n
), over_grams as (
  select distinct c.doc_id from covered c join (values {limits}) l(n, top) on c.n = l.n
  join (select doc_id, sum(length(word)) as total from words group by doc_id) t on t.doc_id = c.doc_id where 100 * chars > top * total
), lines as (
  select doc_id, line, row_number() over (partition by doc_id, line) as k from (select doc_id, unnest(string_split(text, chr(10))) as line from texts)
  where regexp_matches(line, {_WORDS})
), by_line as (
  select doc_id, count(*) as n_lines, count(*) filter (where k > 1) as n_dup_lines,
         coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) filter (where k > 1), 0) as dup_chars
  from lines group by doc_id
), base as (
  select t.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
         coalesce(c.words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(dup_chars, 0) as dup_chars
  from texts t left join by_line b on b.doc_id = t.doc_id left join covered c on c.doc_id = t.doc_id and c.n = 3
), judged as (
  select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed from base
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 100 * n_symbols > {rules.max_symbols_percent} * n_words or 100 * dup_chars > {rules.max_dup_line_chars_percent} * word_chars
            or 100 * n_dup_lines > {rules.max_dup_lines_percent} * n_lines or doc_id in (select doc_id from over_grams)) as kept
from judged
"""


def _op3_sql() -> str:
    """Pairs of equal lines, the earlier one first, make diagonals; unbroken stretches of these with 13 words or more go."""
    return """
with lines as (
  select doc_id, trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) as line, n
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents)
), kept as (
  select doc_id, line, row_number() over (partition by doc_id order by n) - 1 as pos, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as w
  from lines where line <> ''
), pairs as (
  select b.doc_id, b.pos, b.w, a.doc_id as a_doc, a.pos as a_pos
  from kept a join kept b on a.line = b.line and (a.doc_id < b.doc_id or (a.doc_id = b.doc_id and a.pos < b.pos))
), runs as (
  select *, pos - row_number() over (partition by doc_id, a_doc, pos - a_pos order by pos) as run from pairs
), long as (
  select doc_id, pos, sum(w) over (partition by doc_id, a_doc, pos - a_pos, run) as words from runs
), gone as (
  select distinct doc_id, pos from long where words >= 13
), marked as (
  select kept.*, gone.pos is not null as g from kept left join gone on kept.doc_id = gone.doc_id and kept.pos = gone.pos
), told as (
  select doc_id, count(*) as n_lines, count(*) filter (where g) as n_removed,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not g), '') as kept_text
  from marked group by doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept_text, '')) as kept_sha256
from documents d left join told on d.doc_id = told.doc_id
"""


def _op6_sql() -> str:
    def lit(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def chain(x: str) -> str:
        out = f"translate({x}, '{licences.UPPER}', '{licences.LOWER}')"
        for pattern, new, _ in licences.RULES:
            out = f"regexp_replace({out}, {lit(pattern)}, {lit(new)}, 'g')"
        return f"trim({out}, ' ')"

    known = ", ".join(f"({lit(name)}, {lit(text)})" for text, name in licences.known_texts().items() if text)
    return f"""
with known(licence, body) as (values {known}),
 whole as (select doc_id, {chain("coalesce(text, '')")} as c from documents),
 lines as (select distinct doc_id, {chain("line")} as c from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)),
 notes as (select doc_id, string_agg(licence, ',' order by licence) as notices from lines join known on c = body
           where licence like 'notice:%' group by doc_id)
select w.doc_id, sha256(w.c) as canonical_sha256, k.licence, coalesce(n.notices, '') as notices
from whole w left join known k on w.c = k.body left join notes n on w.doc_id = n.doc_id
"""


def oracle_sql() -> dict[str, str]:
    def case(column: int) -> str:
        out = "case "
        for verdict, host, path in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2])):
            out += f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}') then '{(host + path, verdict)[column]}' "
        return out

    return {
        "op2_token_counts": _op2_sql(),
        "op3_line_dedup": _op3_sql(),
        "op4_substring_dedup": _op4_sql(),
        "op5_exact_dedup": """
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents),
 g as (select doc_id, t, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from n)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from g
""",
        "op6_license_scans": _op6_sql(),
        "op7_minhash_near_dedup": _op7_sql(),
        "op8_quality_rules": _op8_sql(),
        "op10_url_filters": f"""
with u as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages)
select page_id, host, path, {case(0)} end as rule, {case(1)} else 'allow' end as verdict from u
""",
    }
