"""Mixing to target weights by iterative proportional fitting: token weights are raked to the marginals, documents sampled to match."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, settle, unused

#: Combinations of named values that the targets may have.
MAX_CELLS = 1_000_000
#: Cells that are fitted on the driver; more are fitted where they are, with the same results.
DRIVER_CELLS = 100_000
#: Rounds of the fit that are done again from the last settled weights.
REPLAYED = 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text, the measure of weight; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def margin(share: np.ndarray, there: np.ndarray, budget: float) -> np.ndarray:
    """Tokens to take of each value: its share of the budget, or all there are where that is less; others then take its part in proportion."""
    out, open_ = np.zeros(len(share)), (share > 0) & (there > 0)
    while open_.any():
        want = np.where(open_, share, 0) / share[open_].sum() * max(0.0, budget - out.sum())
        short = open_ & (want >= there)
        if not short.any():
            return out + want
        out[short], open_ = there[short], open_ & ~short
    return out


def rake(
    mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], budget: float, rounds: int = 200, tol: float = 1e-10
) -> np.ndarray:
    """Tokens to take from each cell: at most its mass, in sum at most ``budget``, with marginals as near the target shares as that allows.

    ``codes[d]`` numbers each cell's value in dimension d, ``targets[d]`` is the share of each value; a cell with a value of share 0
    gets nothing. ``margin`` lowers what is asked of a value to what there is. Each round scales the weights to one marginal after the
    other and then cuts cells to their mass, so what a poor cell cannot give is taken from others of the same values.
    """
    open_ = np.ones(len(mass), dtype=bool)
    for c, t in zip(codes, targets, strict=True):
        open_ &= t[c] > 0
    w = np.where(open_, mass, 0.0)
    wants = [margin(t, np.bincount(c, weights=w, minlength=len(t)), budget) for c, t in zip(codes, targets, strict=True)]
    for _ in range(rounds):
        old = w.copy()
        for c, want in zip(codes, wants, strict=True):
            have = np.bincount(c, weights=w, minlength=len(want))
            w = w * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[c]
        w = np.minimum(w, mass)
        if np.abs(w - old).sum() <= tol * max(budget, 1e-300):
            break
    return w


def tempered(mass: dict, alpha: float) -> dict:
    """Shares in proportion to mass**alpha."""
    raised = {k: v**alpha for k, v in mass.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def _advance(batch, factors: list[np.ndarray], level: float):
    """``rake``'s rounds on a batch of sources: (row and number of each cell, weights, their last change, weights scaled once more by source)."""
    sizes = np.diff(batch.column("k").offsets.to_numpy())
    row, r = np.repeat(np.arange(batch.num_rows), sizes), batch.column("r").to_numpy(zero_copy_only=False)
    k, m, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("k", "m", "w"))
    there = np.bincount(row, weights=m, minlength=len(r))
    want = np.where(there > 0, np.minimum(there, level * r), 0.0)

    def scaled(w):
        have = np.bincount(row, weights=w, minlength=len(r))
        return w * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[row]

    old = w
    for f in factors:
        old, w = w, np.minimum(scaled(w) * f[k], m)
    return row, k, w, float(np.abs(w - old).sum()), scaled(w)


def rake_sources(
    by: DataFrame, codes: list[np.ndarray], targets: list[np.ndarray], budget: float, rounds: int = 200, tol: float = 1e-10
) -> DataFrame:
    """``rake`` with a first dimension of any number of values: ``by`` with the column w, the tokens to take from each cell.

    ``by`` has one row a source: its raised tokens ``r``, and the numbers ``k`` and tokens ``m`` of its cells, which ``codes`` and
    ``targets`` describe in the other dimensions. A source's own marginal is met within its row, so a round costs one sum for each
    combination of the others' values. ``margin`` gives a source the lesser of its tokens and ``r`` times a level that all share.
    """
    size = len(codes[0])
    state = settle(by.withColumn("w", F.col("m")))
    there = F.aggregate("m", F.lit(0.0), lambda x, y: x + y)
    level, known = 0.0, -1
    while True:
        short = (there <= F.col("r") * level) & (there > 0)
        open_ = (there > 0) & ~short
        n, given, left = state.agg(F.count_if(short), F.sum(F.when(short, there)), F.sum(F.when(open_, F.col("r")))).first()
        if n == known:
            break
        known, level = n, max(0.0, budget - (given or 0.0)) / left if left else np.inf

    def sums(cells, weights) -> np.ndarray:
        def run(batches):
            import pyarrow as pa

            total = np.zeros(size + 1)
            for b in batches:
                k, w, change = cells(b)
                total[:size] += np.bincount(k, weights=w, minlength=size)
                total[size] += change
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], names=["k", "s"])

        out = np.zeros(size + 1)
        for x in weights.mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
            out[x.k] = x.s
        return out

    def scaled(factors):
        def cells(b):
            _, k, _, change, w = _advance(b, factors, level)
            return k, w, change

        return cells

    def moved(factors) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for b in batches:
                row, _, w, _, _ = _advance(b, factors, level)
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))].astype(np.int32)
                at = b.schema.get_field_index("w")
                cols = [pa.ListArray.from_arrays(pa.array(ends), pa.array(w)) if i == at else c for i, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

        return state.mapInArrow(run, state.schema)

    def whole(b):
        return b.column("k").flatten().to_numpy(zero_copy_only=False), b.column("w").flatten().to_numpy(zero_copy_only=False), 0.0

    mass = sums(whole, state)[:size]
    wants = [margin(t, np.bincount(c, weights=mass, minlength=len(t)), budget) for c, t in zip(codes, targets, strict=True)]
    factors = []
    for _ in range(rounds):
        got = sums(scaled(factors), state)
        if factors and got[size] <= tol * max(budget, 1e-300):
            break
        if len(factors) == REPLAYED:
            state, factors = settle(moved(factors)), []
        f = np.ones(size)
        for c, want in zip(codes, wants, strict=True):
            have = np.bincount(c, weights=got[:size] * f, minlength=len(want))
            f *= np.divide(want, have, out=np.zeros_like(want), where=have > 0)[c]
        factors.append(f)
    return moved(factors)


def mix_sources(
    docs: DataFrame,
    dims: dict[str, Column],
    targets: dict[str, dict | float],
    budget: float,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 17,
    keep: bool = False,
) -> DataFrame:
    """One row per row of ``docs`` with key, the values of ``dims``, n_tokens, probability and kept; or, if ``keep``, the rows kept, unchanged.

    ``dims`` names the dimensions and gives their values as columns; ``targets`` gives, for each, the share of every value
    that may occur in the mixture; rows with other values (null too, unless named) get probability 0. For one dimension it may be a
    number alpha instead: all its values, however many, then have shares in proportion to their tokens**alpha (null is one of them).
    ``budget`` is the share of the tokens of rows with named values that the mixture is to hold. Cells (combinations of values) are
    summed by an aggregate with a map-side part; up to DRIVER_CELLS of them are fitted on the driver and the probabilities broadcast,
    more are fitted where they are and joined, by the same rounds. A document is kept if a number in [0, 1), made from key and text, is
    below its cell's probability (tokens to take by tokens there), which is independent of order and partitioning.

    Null text has no tokens. Rows with the same key and text are kept or dropped together. Empty tables stay empty. The names of
    ``dims`` may clash with columns of ``docs``; the columns given decide.
    """
    names = list(dims)
    free = [d for d in names if not isinstance(targets[d], dict)]
    if len(free) > 1:
        raise ValueError("only one dimension may have a power for its targets")
    fixed = [d for d in names if d not in free]
    levels = {d: [v for v, share in targets[d].items() if share > 0] for d in fixed}
    shape = [len(levels[d]) for d in fixed] + [1]
    size = int(np.prod(shape))
    if size > MAX_CELLS:
        raise ValueError(f"the targets' values make {size} cells; pool rare values first, up to {MAX_CELLS} cells")
    codes = list(np.unravel_index(np.arange(size), shape))
    shares = [np.array([float(targets[d][v]) for v in levels[d]]) for d in fixed] + [np.ones(1)]
    spark = docs.sparkSession
    cell = F.lit(0).cast("long")
    for d in fixed:  # null where a value is not named
        c, values = dims[d].cast("string"), [v for v in levels[d] if v is not None]
        at = F.array_position(F.array(*map(F.lit, values)), c) if values else F.lit(0).cast("long")
        place = {v: j for j, v in enumerate(levels[d])}
        order = F.array(*[F.lit(place[v]).cast("long") for v in values]) if values else None
        code = F.when(at > 0, F.get(order, (at - 1).cast("int"))) if values else F.lit(None).cast("long")
        if None in place:
            code = F.when(c.isNull(), F.lit(place[None]).cast("long")).otherwise(code)
        cell = cell * len(levels[d]) + code
    source = dims[free[0]].cast("string") if free else F.lit("")
    ids, matched, share = [unused(f"__{x}", docs) for x in "vk"], [unused(f"__c{x}", docs) for x in "vk"], unused("__p", docs)
    drawn = F.shiftrightunsigned(F.xxhash64(F.col(quoted(key)).cast("long"), F.col(quoted(text)).cast("string"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    facts = docs.select(source.alias("v"), cell.alias("k"), n_words(F.col(quoted(text))).alias("n"))
    if not keep:  # all that the result tells, so texts are read once
        told = [dims[d].cast("string").alias(f"d{i}") for i, d in enumerate(names)]
        words = n_words(F.col(quoted(text))).alias("n")
        facts = settle(docs.select(source.alias("v"), cell.alias("k"), words, drawn.alias("drawn"), F.col(quoted(key)).alias("key"), *told))
    cells = facts.groupBy("v", "k").agg(F.sum("n").cast("double").alias("n"))
    pair = F.when(F.col("k").isNotNull(), F.struct("k", "n"))
    by = settle(cells.groupBy("v").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(pair)).alias("cells")).where("n > 0 and size(cells) > 0"))
    alpha = float(targets[free[0]]) if free else 1.0
    by = by.select("v", F.pow("n", F.lit(alpha)).alias("r"), F.col("cells.k").alias("k"), F.col("cells.n").alias("m"))
    n_cells, mass = by.agg(F.sum(F.size("k")), F.sum(F.aggregate("m", F.lit(0.0), lambda x, y: x + y))).first()
    wanted = budget * (mass or 0.0)
    if (n_cells or 0) <= DRIVER_CELLS:
        rows = by.orderBy("v").collect()
        flat = [(i, r.v, k, m) for i, r in enumerate(rows) for k, m in zip(r.k, r.m, strict=True)]
        at, k, m = (np.array([x[j] for x in flat], dtype=t) for j, t in ((0, np.int64), (2, np.int64), (3, float)))
        raised = np.array([r.r for r in rows])
        of = [at, *(c[k] for c in codes)] if free else [c[k] for c in codes]
        take = rake(m, of, [raised / raised.sum(), *shares] if free else shares, wanted) if flat else m
        prob = np.divide(take, m, out=np.full(len(m), budget, dtype=float), where=m > 0)
        made = [(x[1], int(x[2]), float(y)) for x, y in zip(flat, prob, strict=True)]
        table = F.broadcast(spark.createDataFrame(made, f"{matched[0]} string, {matched[1]} long, {share} double"))
    else:
        fitted = rake_sources(by, codes, shares, wanted).select("v", F.explode(F.arrays_zip("k", "m", "w")).alias("x"))
        p = F.when(F.col("x.m") > 0, F.col("x.w") / F.col("x.m")).otherwise(float(budget))
        table = settle(fitted.select(F.col("v").alias(matched[0]), F.col("x.k").alias(matched[1]), p.alias(share)))
    p = F.coalesce(F.col(share), F.lit(0.0))
    if keep:
        marked = docs.select("*", source.alias(ids[0]), cell.alias(ids[1]))
        joined = marked.join(table, F.col(ids[0]).eqNullSafe(F.col(matched[0])) & (F.col(ids[1]) == F.col(matched[1])), "left")
        return joined.where(drawn < p).select(*map(quoted, docs.columns))
    joined = facts.join(table, F.col("v").eqNullSafe(F.col(matched[0])) & (F.col("k") == F.col(matched[1])), "left")
    told = [F.col(f"d{i}").alias(d) for i, d in enumerate(names)]
    return joined.select(F.col("key").alias(key), *told, F.col("n").alias("n_tokens"), p.alias("probability"), (F.col("drawn") < p).alias("kept"))
