"""Filling fixed-capacity containers with items (problem 8).

Only the histogram of item lengths reaches the driver: at most ``UNITS``
lengths.  Combinations of up to three lengths that fill a container, up to a
small window of free space, are enumerated, their repeat counts solved by
non-negative least squares against the histogram and rounded down; what is
left is packed greedily, best fit in decreasing length.  The plan then places
the items by their rank in their length, so no item moves to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.session import cut_table

UNITS = 8192  # lengths a container is measured in; longer capacities round lengths up to capacity / UNITS
WINDOW = 4  # units of free space that a combination may leave


def combinations(units: int, hist: np.ndarray | None = None, window: int = WINDOW) -> np.ndarray:
    """Rows of up to three lengths (0 = none), longest first, that fill a container of ``units`` up to ``window`` units.

    For two lengths the third is the longest that fits and, with ``hist``,
    occurs; so a row is never another one with room for a longer third.
    """
    have = np.ones(units + 1, bool) if hist is None else hist > 0
    have[0] = False
    fits = np.maximum.accumulate(np.where(have, np.arange(units + 1), 0))  # the longest length of at most this
    lengths = np.flatnonzero(have)
    out = [np.array([[n, 0, 0] for n in lengths if n >= units - window], np.int32).reshape(-1, 3)]
    for a in lengths[::-1]:
        rest = units - a
        b = lengths[(lengths <= a) & (lengths <= rest)]
        if not len(b):
            continue
        third = np.minimum(fits[rest - b], b)
        # a third that is longer than the second is met with both in the other order, unless it does not occur
        third = np.where(have[third] | (third == 0), third, fits[third])
        ok = rest - b - third <= window
        out.append(np.column_stack([np.full(ok.sum(), a, np.int32), b[ok].astype(np.int32), third[ok].astype(np.int32)]))
    return np.concatenate(out)


def solve_repeats(hist: np.ndarray, combos: np.ndarray, rounds: int = 30, columns: int = 64, close: float = 1e-3) -> np.ndarray:
    """Non-negative x with little weighted |A x - hist|^2, by an active set of columns.

    Too many of a length weigh more than too few: the rest is packed greedily,
    and short lengths are the easiest to place later.  It ends when no column
    helps, or when what is left is below ``close`` of the whole and twenty
    rounds have not made it a hundredth smaller.
    """
    units = len(hist) - 1
    if not len(combos):
        return np.zeros(0)
    weight = np.sqrt(np.arange(units + 1) / units)
    weight[0] = 0.0
    scale = max(1.0, hist.max())
    target = hist / scale * weight
    active: list[int] = []
    x = np.zeros(len(combos))
    dense = np.zeros((units + 1, 0))
    residual = target.copy()
    w3 = weight[combos]
    norms = np.sqrt((w3**2).sum(1)) + 1e-12
    whole, errors = float(target @ target), []
    for _ in range(rounds):
        gain = (w3 * residual[combos]).sum(1) / norms
        gain[active] = -np.inf
        # several of the best columns at once, as long as they share no length
        taken: set[int] = set()
        fresh: list[int] = []
        few = np.argpartition(-gain, min(len(gain) - 1, 256))[:257]
        for c in few[np.argsort(-gain[few], kind="stable")]:
            lengths = set(combos[c][combos[c] > 0].tolist())
            if gain[c] <= 1e-9 or len(fresh) == columns:
                break
            if not lengths & taken:
                taken |= lengths
                fresh.append(int(c))
        if not fresh:
            break
        added = np.zeros((units + 1, len(fresh)))
        for k, c in enumerate(fresh):
            np.add.at(added[:, k], combos[c][combos[c] > 0], 1.0)
        active += fresh
        dense = np.column_stack([dense, added * weight[:, None]])
        current = np.r_[x[active[: -len(fresh)]], np.zeros(len(fresh))]
        while True:
            z = np.linalg.solve(dense.T @ dense + 1e-9 * np.eye(dense.shape[1]), dense.T @ target)
            if (z > 0).all():
                current = z
                break
            falling = z <= 0
            step = np.min(current[falling] / np.maximum(current[falling] - z[falling], 1e-15)) if (current[falling] > 0).any() else 0.0
            current = current + step * (z - current)
            stay = current > 1e-12
            if stay.all():
                stay[int(np.argmin(current))] = False
            x[[a for a, s in zip(active, stay) if not s]] = 0
            active = [a for a, s in zip(active, stay) if s]
            dense, current = dense[:, stay], current[stay]
            if not active:
                break
        x[:] = 0
        x[active] = current
        residual = target - dense @ current
        errors.append(float(residual @ residual))
        if errors[-1] < close * whole and len(errors) > 20 and errors[-1] > 0.99 * errors[-21]:
            break
    return np.maximum(x, 0) * scale


def plan_containers(hist: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(number of containers, {length: how many}) groups that hold every item of the histogram once."""
    units = len(hist) - 1
    left = hist.astype(np.int64).copy()
    groups: list[tuple[int, dict[int, int]]] = []
    combos = combinations(units, hist)
    for row, n in zip(combos, np.floor(solve_repeats(hist, combos)).astype(np.int64)):
        if n <= 0:
            continue
        need: dict[int, int] = {}
        for length in row[row > 0]:
            need[int(length)] = need.get(int(length), 0) + 1
        n = min([int(n), *(int(left[length]) // k for length, k in need.items())])
        if n > 0:
            groups.append((n, need))
            for length, k in need.items():
                left[length] -= n * k
    # the rest, best fit: containers of equal content are handled together, by their free space
    free: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for length in range(units, 0, -1):
        n = int(left[length])
        while n > 0:
            space = min((s for s in free if s >= length and free[s]), default=None)
            if space is None:
                per = units // length
                whole, rest = divmod(n, per)
                if whole:
                    free.setdefault(units - per * length, []).append((whole, {length: per}))
                if rest:
                    free.setdefault(units - rest * length, []).append((1, {length: rest}))
                break
            count, have = free[space].pop()
            per = space // length
            used = min(count, n // per)
            if used:
                free.setdefault(space - per * length, []).append((used, have | {length: have.get(length, 0) + per}))
                n -= used * per
            else:
                free.setdefault(space - n * length, []).append((1, have | {length: have.get(length, 0) + n}))
                used, n = 1, 0
            if count > used:
                free[space].append((count - used, have))
    groups += [g for space in free.values() for g in space]
    return groups


def pack(items: DataFrame, key: str, size: str, capacity: int, items_per_bucket: int = 1_000_000) -> DataFrame:
    """key, piece_no, piece_start, piece_size, container_id of every item or piece of one.

    Only an item larger than the capacity is divided, into pieces of the
    capacity and a rest; piece_start counts from the item's begin.  Null and
    non-positive sizes need no space: such an item has one piece of size 0 and
    a null container.  Repeated keys are items of their own.  Null keys are kept.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    step = max(1, -(-capacity // UNITS))
    units = capacity // step
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0).cast("long"))
    # in a whole number of steps, a piece of units * step fills a container
    full = units * step
    pieces = F.when(n <= capacity, F.array(F.struct(F.lit(0).alias("no"), F.lit(0).cast("long").alias("start"), n.alias("size")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / full)), lambda i: F.struct(i.cast("int").alias("no"), (i * full).alias("start"), F.least(n - i * full, F.lit(full).cast("long")).alias("size")))
    )
    p = items.select(F.col(key).alias("k"), F.explode(pieces).alias("p")).select("k", "p.no", "p.start", "p.size")
    # a whole item between full and capacity fills a container as well
    length = F.least(F.ceil(F.col("size") / step), F.lit(units)).cast("int")
    p = cut_table(p.withColumn("length", length))
    hist = np.zeros(units + 1, np.int64)
    for row in p.where("length > 0").groupBy("length").count().collect():  # at most UNITS rows
        hist[row["length"]] = row["count"]
    buckets = int(max(1, -(-hist.sum() // items_per_bucket)))
    p = p.withColumn("bucket", F.pmod(F.xxhash64("k", "no"), F.lit(buckets)).cast("int"))
    # items of a length in the buckets before: one row for each length and bucket
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = p.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", before.alias("before"))
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(units + 1, np.int64)
    first = 0
    for many, content in plan_containers(hist):
        for length_, times in content.items():
            slots.setdefault(length_, []).append((int(used[length_]), first, times))
            used[length_] += many * times
        first += many
    starts = {k: np.array([s[0] for s in v], np.int64) for k, v in slots.items()}
    firsts = {k: np.array([s[1] for s in v], np.int64) for k, v in slots.items()}
    times = {k: np.array([s[2] for s in v], np.int64) for k, v in slots.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ln, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            where = np.full(len(pdf), -1, np.int64)
            for one in np.unique(ln[ln > 0]):
                m = ln == one
                at = np.searchsorted(starts[one], rank[m], side="right") - 1
                where[m] = firsts[one][at] + (rank[m] - starts[one][at]) // times[one][at]
            out = pdf[["k", "no", "start", "size"]].copy()
            out["container_id"] = pd.array(where, "Int64")
            out.loc[where < 0, "container_id"] = pd.NA
            yield out

    ranked = p.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("k", "no", "start")))
    ranked = ranked.join(offsets, ["length", "bucket"])
    kind = items.schema[key].dataType.simpleString()
    placed = ranked.select("k", "no", "start", "size", "length", (F.col("rank") - 1 + F.col("before")).cast("long").alias("rank")).mapInPandas(place, f"k {kind}, no int, start long, size long, container_id long")
    return placed.select(F.col("k").alias(key), F.col("no").alias("piece_no"), F.col("start").alias("piece_start"), F.col("size").alias("piece_size"), "container_id")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """n_containers, n_pieces, n_tokens, fill: the share of the capacity that is used."""
    return packed.where("container_id is not null").agg(
        F.countDistinct("container_id").alias("n_containers"), F.count("*").alias("n_pieces"), F.coalesce(F.sum("piece_size"), F.lit(0)).alias("n_tokens")
    ).withColumn("fill", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_containers") * F.lit(float(capacity))))
