"""URL filters: a trie over reversed host labels, then path segments, with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, quoted, settle

#: Beyond this many bytes of rules the trie is not sent to the executors; ``filter_urls_joined`` takes over.
MAX_BROADCAST_BYTES = 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url; both empty without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host.translate(_FOLD), path[:end]


class RuleTrie:
    """Rules (verdict, host, path prefix). A host rule covers its subdomains; a path rule is a plain prefix of the path.

    Host labels are walked from the right; each node on the way may hold a second trie over path segments, whose last
    segment is a prefix. Of the rules that fit, the longest (host plus path) wins, a longer host breaks a tie, and
    block wins over allow for the same host and path.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if not host or verdict not in ("allow", "block"):
                raise ValueError(f"a rule needs a host and the verdict allow or block: {(verdict, host, path)}")
            host = host.translate(_FOLD)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            sizes, ends = node.setdefault(None, ([], {}))
            if len(last) not in sizes:
                sizes.append(len(last))
            if ends.get(last, ("", ""))[0] != "block":
                ends[last] = (verdict, host + path)

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, found = (0, 0), (None, None)
        node, depth = self.root, 0
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            depth += len(label) + 1
            here = node.get(None)
            for segment in segments:
                if here is None:
                    break
                sizes, ends = here.get(None, ((), {}))
                for size in sizes:  # a look-up for each length of prefix, however many prefixes have it
                    verdict, rule = ends.get(segment[:size], ("", ""))
                    if verdict and (len(rule), depth) > best:
                        best, found = (len(rule), depth), (verdict, rule)
                here = here.get(segment)
        return found


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", key: str = "page_id", default: str = "allow"
) -> DataFrame:
    """One row per page: key, host, path, rule (null if none fits) and verdict (the default if none fits).

    Null and malformed urls have empty host and path and get the default; repeated rows are judged alike; an empty
    table gives an empty table; other columns of ``pages`` are neither read nor clash. The trie is broadcast
    only while the rules take less than MAX_BROADCAST_BYTES; a longer list is joined instead.
    """
    if sum(len(h) + len(p) + 64 for _, h, p in rules) > MAX_BROADCAST_BYTES:
        table = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
        return filter_urls_joined(pages, table, url, key, default)
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))
    rows = pages.select(F.col(quoted(key)).alias(key), F.col(quoted(url)).cast("string").alias("url"))
    kind = rows.schema[key].dataType.simpleString()

    def judge(batches):
        import pyarrow as pa

        match = trie.value.match
        for b in batches:
            out = []
            for u in b.column(1).to_pylist():
                host, path = split_url(u)
                verdict, rule = match(host, path)
                out.append((host, path, rule, verdict or default))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.string()) for c in cols)], names=[key, "host", "path", "rule", "verdict"]
            )

    return numbered(rows).mapInArrow(judge, f"{quoted(key)} {kind}, host string, path string, rule string, verdict string")


def filter_urls_joined(
    pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow"
) -> DataFrame:
    """The same judgement for rule lists of any length: pages meet the rules (verdict, host, path) by a join on every suffix of the host.

    A host has a few labels, so a page makes a few rows; the rule is chosen by an aggregate of fixed width per page row.
    """
    u = F.col("url")
    tail = F.when(F.instr(u, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    rows = (
        pages.select(F.col(quoted(key)).alias(key), F.col(quoted(url)).cast("string").alias("url"))
        .withColumn("row_no", F.monotonically_increasing_id())
        .withColumn("tail", F.coalesce(tail, F.lit("")))
        .withColumn("host", F.translate(F.regexp_extract("tail", r"\A([^/?#]*)", 1), UPPER, LOWER))
        .withColumn("path", F.regexp_extract("tail", r"\A[^/?#]*([^?#]*)", 1))
        .select(quoted(key), "row_no", "host", "path")
    )
    rows = settle(rows)
    labels = F.split("host", r"\.")
    each = rows.withColumn(
        "suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))))
    )
    r = rules.select(
        F.col("verdict").alias("r_verdict"), F.translate("host", UPPER, LOWER).alias("suffix"), F.col("path").alias("r_path")
    )
    best = (
        each.join(r, "suffix")
        .where(F.expr("startswith(path, r_path)"))
        .groupBy("row_no")
        .agg(
            F.max(
                F.struct(
                    (F.length("suffix") + F.length("r_path")).alias("n"),
                    F.length("suffix").alias("h"),
                    F.col("r_verdict").alias("v"),
                    F.concat("suffix", "r_path").alias("rule"),
                )
            ).alias("m")
        )
    )
    return rows.join(best, "row_no", "left").select(
        quoted(key), "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.v", F.lit(default)).alias("verdict")
    )
