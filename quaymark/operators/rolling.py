"""Rolling totals over trailing periods (problem 2).

Spans are counted once, summed per entity and day, and laid out in dense
entity x day blocks, one time tile at a time.  A tile carries a halo of the
days before it, so a trailing window never needs a second tile: the block is
multiplied by a banded 0/1 matrix per window length.  Days without activity
are columns of zeros, so they come out like any other day.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.session import cut_table

BLOCK_ENTITIES = 512


def count_once(df: DataFrame, keys: Sequence[str], order: str, keep: Sequence[str]) -> DataFrame:
    """One row for each key: the delivery with the smallest ``order`` value.

    Rows with a null in a key are kept as they are, each for itself, because
    nothing says which other row they repeat.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    own = F.when(~whole, F.col(order))
    picked = df.groupBy(*keys, own.alias("__own")).agg(F.min(F.struct(order, *keep)).alias("__p"))
    return picked.select(*keys, *[F.col(f"__p.{c}").alias(c) for c in keep])


def band(width: int, halo: int, tile: int) -> np.ndarray:
    """(halo + tile) x tile matrix that sums the ``width`` columns ending at each tile day."""
    i, j = np.arange(halo + tile)[:, None], np.arange(tile)[None, :] + halo
    return ((i <= j) & (i > j - width)).astype(np.int64)


def rolling_totals(
    daily: DataFrame,
    entity: str,
    day: str,
    measures: Sequence[str],
    windows: Sequence[int] = (7, 30),
    tile_days: int = 64,
) -> DataFrame:
    """Trailing totals and averages for every entity and day from its first to its last day.

    ``daily`` has at most one row per (entity, day) with integer measures; null
    measures count as 0 and rows with a null day are left out, because they
    belong to no day.  A null entity is an entity of its own.  The average
    divides by the whole window length, days without activity included.
    Other columns of ``daily`` are ignored.  An empty table gives no rows.
    """
    halo = max(windows) - 1
    if tile_days < halo:
        raise ValueError("a tile must be at least as long as the longest window less one day")
    num = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("long")
    base = daily.where(F.col(day).isNotNull()).select(
        F.col(entity).alias("__e"), num.alias("__d"), *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(f"__m{i}") for i, m in enumerate(measures)]
    )
    # first and last day per entity: one row per entity and day reaches this window, however hot the entity
    base = cut_table(base)  # days, not rows: read once for the spans and once for the blocks
    spans = base.groupBy("__e").agg(F.min("__d").alias("__first"), F.max("__d").alias("__last")).withColumnRenamed("__e", "__s")
    base = base.join(spans, F.col("__e").eqNullSafe(F.col("__s"))).drop("__s")
    tile = F.floor(F.col("__d") / tile_days)
    own = F.array(tile)
    halo_next = F.when((F.col("__d") >= (tile + 1) * tile_days - halo) & (F.col("__last") >= (tile + 1) * tile_days), F.array(tile + 1)).otherwise(F.array().cast("array<bigint>"))
    # the first day's row also opens every tile of its entity, so tiles without any activity exist as well
    opened = F.when(
        F.col("__d") == F.col("__first"), F.sequence(tile, F.floor(F.col("__last") / tile_days))
    ).otherwise(F.array().cast("array<bigint>"))
    placed = base.withColumn("__t", F.explode(F.array_union(F.array_union(own, halo_next), opened)))
    n = len(measures)
    schema = T.StructType(
        [T.StructField(entity, daily.schema[entity].dataType), T.StructField("__day", T.LongType())]
        + [T.StructField(f"{m}_sum_{w}d", T.LongType()) for m in measures for w in windows]
        + [T.StructField(f"{m}_avg_{w}d", T.DoubleType()) for m in measures for w in windows]
    )
    bands = {w: band(w, halo, tile_days) for w in windows}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if pdf.empty:
                continue
            # sorted by tile and entity: all but the last group are complete
            entity_no, tile_no = pd.factorize(pdf["__e"], use_na_sentinel=False)[0], pdf["__t"].to_numpy()
            last = (tile_no == tile_no[-1]) & (entity_no == entity_no[-1])
            rest = pdf[last]
            done = pdf[~last]
            if len(done):
                yield from blocks(done)
        if rest is not None and len(rest):
            yield from blocks(rest)

    def blocks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        groups = pdf.groupby(["__t", "__e"], sort=False, dropna=False).ngroup().to_numpy()
        edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        for start in range(0, len(edge), BLOCK_ENTITIES):
            part = edge[start : start + BLOCK_ENTITIES]
            stop = edge[start + BLOCK_ENTITIES] if start + BLOCK_ENTITIES < len(edge) else len(pdf)
            rows = pdf.iloc[part[0] : stop]
            which = np.searchsorted(part, np.arange(part[0], stop), side="right") - 1
            heads = pdf.iloc[part]
            t0 = heads["__t"].to_numpy() * tile_days
            col = rows["__d"].to_numpy() - t0[which] + halo
            inside = (col >= 0) & (col < halo + tile_days)
            days = t0[:, None] + np.arange(tile_days)[None, :]
            live = (days >= heads["__first"].to_numpy()[:, None]) & (days <= heads["__last"].to_numpy()[:, None])
            r, c = np.nonzero(live)
            out: dict[str, object] = {entity: heads["__e"].to_numpy()[r], "__day": days[r, c]}
            sums: dict[str, np.ndarray] = {}
            for i, m in enumerate(measures):
                dense = np.zeros((len(part), halo + tile_days), np.int64)
                np.add.at(dense, (which[inside], col[inside]), rows[f"__m{i}"].to_numpy()[inside])
                for w in windows:
                    sums[f"{m}_sum_{w}d"] = (dense @ bands[w])[r, c]
            out |= sums
            out |= {f"{m}_avg_{w}d": sums[f"{m}_sum_{w}d"] / w for m in measures for w in windows}
            yield pd.DataFrame(out)[[f.name for f in schema.fields]]

    cols = ["__t", "__e", "__d", "__first", "__last", *[f"__m{i}" for i in range(n)]]
    rolled = placed.select(*cols).repartition("__e", "__t").sortWithinPartitions("__t", "__e").mapInPandas(run, schema)
    return rolled.withColumn(day, F.date_add(F.lit("1970-01-01").cast("date"), F.col("__day").cast("int"))).drop("__day").select(entity, day, *[f.name for f in schema.fields[2:]])
