"""Schemas, options and errors."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

PUT, DELETE = 1, 2

OPLOG = "seq bigint, op tinyint, key binary, value binary, segment bigint"
LOGGED = "key binary, value binary, seq bigint, op tinyint, crc bigint"
ENTRIES = "key binary, value binary, seq bigint, op tinyint"
RUNS = (
    "run_id bigint, level int, pos int, min_key binary, max_key binary, file_size bigint, entry_count bigint, "
    "min_seq bigint, max_seq bigint"
)
MANIFEST = "ordinal bigint, tag tinyint, added array<struct<run_id:bigint,level:int>>, removed array<bigint>, log_number bigint, next_run_id bigint"


class EngineError(Exception):
    """Any failure the engine reports."""


class CorruptionError(EngineError):
    """Stored bytes do not say what they should."""


class NotFoundError(EngineError):
    """A run or manifest that should be there is not."""


class ConflictError(EngineError):
    """Another writer committed first."""


class CompactionStyle(StrEnum):
    SIZE_TIERED = "size_tiered"  # fewer rewrites, more runs to read
    LEVELED = "leveled"  # fewer runs to read, more rewrites


@dataclass(frozen=True)
class SyncPolicy:
    """When writes are committed: every one, every n-th, or once ``every_ms`` have passed since the last commit, whichever comes first.

    What is written and not committed is read by its writer only, and lost with it.
    """

    every_n: int | None = 1
    every_ms: int | None = None


@dataclass(frozen=True)
class Options:
    memtable_size: int = 4 << 20
    block_size: int = 4096
    bloom_bits_per_key: int = 10
    max_levels: int = 7
    level_size_multiplier: int = 10
    level_base_bytes: int = 10 << 20
    l0_threshold: int = 4
    block_cache_size: int = 8 << 20
    sync: SyncPolicy = SyncPolicy()
    style: CompactionStyle = CompactionStyle.LEVELED
    run_size: int = 256 << 20  # bytes after which a compaction begins the next run
    key_partitions: int | None = None  # output partitions of a flush or compaction; None: the session's shuffle partitions
