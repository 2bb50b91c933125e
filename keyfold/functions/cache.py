"""LRU cache simulation over an access trace."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LRU:
    """A cache bounded by bytes: reads refresh, inserts replace, the least recently used goes; an oversize entry still enters."""

    def __init__(self, capacity: int):
        self.capacity, self.used, self.hits, self.misses = capacity, 0, 0, 0
        self.items: OrderedDict = OrderedDict()

    def __len__(self) -> int:
        return len(self.items)

    def get(self, key):
        if key in self.items:
            self.items.move_to_end(key)
            self.hits += 1
            return self.items[key]
        self.misses += 1
        return None

    def insert(self, key, size: int) -> None:
        self.remove(key)
        while self.items and self.used + size > self.capacity:
            self.used -= self.items.popitem(last=False)[1]
        self.items[key] = size
        self.used += size

    def remove(self, key) -> None:
        self.used -= self.items.pop(key, 0)

    def hit_rate(self) -> float:
        n = self.hits + self.misses
        return self.hits / n if n else 0.0


def simulate(trace: DataFrame, capacity: int, shard: str = "shard", at: str = "i", key: str = "key", size: str = "size") -> DataFrame:
    """Rows (shard, i, hit): each shard is a cache of its own, as in a sharded block cache.

    A shard's accesses stream through one task in order; memory holds a batch and the cache. More shards, more tasks.
    """

    def fold(frames: Iterator) -> Iterator:
        caches: dict = {}
        for f in frames:
            out = []
            for s, k, n in zip(f[shard].tolist(), f[key].tolist(), f[size].tolist(), strict=True):
                cache = caches.setdefault(s, LRU(capacity))
                hit = cache.get(k) is not None
                if not hit:
                    cache.insert(k, n)
                out.append(hit)
            yield f[[shard, at]].assign(hit=out)

    rows = trace.select(shard, at, key, size)
    kinds = dict(rows.dtypes)
    dealt = rows.repartition(F.col(shard)).sortWithinPartitions(shard, at)
    return dealt.mapInPandas(fold, f"`{shard}` {kinds[shard]}, `{at}` {kinds[at]}, hit boolean")
