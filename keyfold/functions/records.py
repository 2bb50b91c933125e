"""Log records as columns: sizes, checksums, encoding and classification of decoding errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE, PUT

#: crc32, length, type, key length: the bytes of a record besides key and value.
HEADER = 13


def _le32(n: Column) -> Column:
    """An unsigned 32-bit little-endian integer as four bytes."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def put_record(key: Column, value: Column) -> list[Column]:
    """The columns (op, key, value) of a put."""
    return [F.lit(PUT).cast("tinyint").alias("op"), key.cast("binary").alias("key"), value.cast("binary").alias("value")]


def delete_record(key: Column) -> list[Column]:
    """The columns (op, key, value) of a delete, whose value is empty."""
    return [F.lit(DELETE).cast("tinyint").alias("op"), key.cast("binary").alias("key"), F.lit(b"").alias("value")]


def encoded_size(key: str = "key", value: str = "value") -> Column:
    return (F.lit(HEADER) + F.octet_length(key) + F.octet_length(value)).cast("bigint")


def record_body(op: str = "op", key: str = "key", value: str = "value") -> Column:
    """Everything after the checksum: length, type, key length, key, value."""
    rest = F.lit(5) + F.octet_length(key) + F.octet_length(value)
    kind = F.unhex(F.lpad(F.hex(F.col(op).cast("long")), 2, "0"))
    return F.concat(_le32(rest), kind, _le32(F.octet_length(key)), F.col(key).cast("binary"), F.col(value).cast("binary"))


def checksum(op: str = "op", key: str = "key", value: str = "value") -> Column:
    return F.crc32(record_body(op, key, value))


def encode_record(op: str = "op", key: str = "key", value: str = "value") -> Column:
    return F.concat(_le32(checksum(op, key, value)), record_body(op, key, value))


def _read_le32(data: Column, at: int) -> Column:
    byte = lambda i: F.coalesce(F.conv(F.hex(F.substring(data, at + i, 1)), 16, 10).cast("long"), F.lit(0))
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216


def decode_record(df: DataFrame, data: str = "data") -> DataFrame:
    """Adds op, key, value and status: ok, short header, truncated, bad checksum, bad type or bad key length."""
    d = F.col(data)
    n = F.octet_length(d)
    size, klen = _read_le32(d, 5), _read_le32(d, 10)
    kind = F.conv(F.hex(F.substring(d, 9, 1)), 16, 10).cast("int")
    status = (
        F.when(n < HEADER, "short header")
        .when(n < size + 8, "truncated")
        .when(F.crc32(F.substring(d, 5, 1 << 30)) != _read_le32(d, 1), "bad checksum")
        .when(~kind.isin(PUT, DELETE), "bad type")
        .when(klen + 5 > size, "bad key length")
        .otherwise("ok")
    )
    ok = F.col("status") == "ok"
    return df.withColumn("status", status).select(
        "*",
        F.when(ok, kind.cast("tinyint")).alias("op"),
        F.when(ok, d.substr(F.lit(HEADER + 1), klen.cast("int"))).alias("key"),
        F.when(ok, d.substr((klen + HEADER + 1).cast("int"), (size - klen - 5).cast("int"))).alias("value"),
    )


def offsets(log: DataFrame, segment: str = "segment", seq: str = "seq", size: str = "size") -> DataFrame:
    """Each record's place in its segment: the sizes before it."""
    w = Window.partitionBy(segment).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))


def sync_points(log: DataFrame, every_n: int, segment: str = "segment", seq: str = "seq") -> DataFrame:
    """Records since the last sync (0 right after one) and whether this record syncs."""
    nth = F.row_number().over(Window.partitionBy(segment).orderBy(seq))
    since = F.pmod(nth, F.lit(every_n)).cast("int")
    return log.withColumn("since_sync", since).withColumn("synced", F.col("since_sync") == 0)


def valid_prefix(log: DataFrame, ok: Column, segment: str = "segment", seq: str = "seq") -> DataFrame:
    """Records before the first bad one of their segment; other segments are not affected."""
    first_bad = log.where(~ok).groupBy(segment).agg(F.min(seq).alias("__bad"))
    return log.join(first_bad, segment, "left").where(F.col("__bad").isNull() | (F.col(seq) < F.col("__bad"))).drop("__bad")
