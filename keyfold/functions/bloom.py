"""Bloom filters as DataFrames: rows of 64-bit words, built by an aggregate and probed by a join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizing(n: int, fpr: float) -> tuple[int, int]:
    """Bits and hash functions for ``n`` keys at a false-positive rate."""
    if n <= 0 or not 0 < fpr < 1:
        raise ValueError("n must be positive and the rate between 0 and 1")
    per_key = -1.44 * math.log2(fpr)
    return max(64, math.ceil(n * per_key)), max(1, math.ceil(per_key * math.log(2)))


def positions(key: Column, n_bits: int, n_hashes: int) -> Column:
    """Bit positions by double hashing, kept within range before they are multiplied."""
    m = F.lit(n_bits).cast("bigint")
    h1, h2 = F.pmod(F.xxhash64(key), m), F.pmod(F.xxhash64(key, F.lit(0x9747B28C)), m)
    return F.transform(F.sequence(F.lit(0), F.lit(n_hashes - 1)), lambda i: F.pmod(h1 + i * h2, m))


def build(keys: DataFrame, key: str, n_bits: int, n_hashes: int) -> DataFrame:
    """Rows (word_no, bits) of the words that are not zero."""
    at = keys.select(F.explode(positions(F.col(key), n_bits, n_hashes)).alias("p"))
    return at.groupBy(F.floor(F.col("p") / 64).cast("int").alias("word_no")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("p", F.lit(64)).cast("int"))).alias("bits")
    )


def may_contain(probes: DataFrame, words: DataFrame, key: str, n_bits: int, n_hashes: int) -> DataFrame:
    """Distinct keys of ``probes`` with ``maybe``; never false for a key that was built in."""
    at = probes.select(key).distinct().withColumn("p", F.explode(positions(F.col(key), n_bits, n_hashes)))
    at = at.withColumn("word_no", F.floor(F.col("p") / 64).cast("int"))
    bit = F.call_function(
        "shiftrightunsigned", F.coalesce("bits", F.lit(0).cast("bigint")), F.pmod("p", F.lit(64)).cast("int")
    ).bitwiseAND(F.lit(1))
    return at.join(words, "word_no", "left").groupBy(key).agg((F.min(bit) == 1).alias("maybe"))


#: Bytes before the words: the number of hash functions (4) and of bits (8), little-endian.
HEADER = 12


def _reversed(h: Column, n: int) -> Column:
    """``n`` bytes in hexadecimal, the last one first."""
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))])


def serialize(words: DataFrame, by: str, n_bits: int, n_hashes: int) -> DataFrame:
    """Rows (by, word_no, bits) -> (by, data): each filter as bytes, words in order, zeros included.

    A filter's size is set by ``n_bits``, so a group never holds more than its words.
    """
    n = -(-n_bits // 64)
    have = words.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("word_no", "bits"))).alias("have"))
    zero = F.lit(0).cast("bigint")
    one = lambda i: _reversed(F.lpad(F.hex(F.coalesce(F.try_element_at("have", i), zero)), 16, "0"), 8)
    head = n_hashes.to_bytes(4, "little").hex() + n_bits.to_bytes(8, "little").hex()
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one), "")
    return have.select(by, F.unhex(F.concat(F.lit(head), body)).alias("data"))


def deserialize(filters: DataFrame, data: str = "data") -> DataFrame:
    """Adds status (ok, short, word count or length), num_hashes, num_bits and words; the last three are null unless ok.

    ``short`` lacks a whole header, ``word count`` has a number of words that its bits do not ask for, ``length`` ends inside a word.
    """
    h = F.hex(data)
    number = lambda at, n: F.conv(_reversed(F.substring(h, 2 * at + 1, 2 * n), n), 16, 10)
    size = F.octet_length(data)
    hashes, bits = number(0, 4).cast("bigint"), number(4, 8).cast("bigint")
    n = F.floor((size - HEADER) / 8).cast("bigint")
    status = (
        F.when(size < HEADER, "short")
        .when(F.pmod(size - HEADER, F.lit(8)) != 0, "length")
        .when((n != F.ceil(bits / 64)) | (hashes < 1), "word count")
        .otherwise("ok")
    )
    ok = F.col("status") == "ok"
    word = lambda i: F.conv(_reversed(h.substr((2 * HEADER + 16 * i + 1).cast("int"), F.lit(16)), 8), 16, -10).cast("bigint")
    words = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), word)).otherwise(F.array().cast("array<bigint>"))
    return filters.withColumn("status", status).select(
        "*", F.when(ok, hashes).alias("num_hashes"), F.when(ok, bits).alias("num_bits"), F.when(ok, words).alias("words")
    )
