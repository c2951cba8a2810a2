"""References to records that do not exist (problem 4).

Keys are hashed to 128 bits and the hash space is cut into ranges of about
equal load.  Each range holds its parents as arrays sorted by key; batches of
references of the same range are probed by binary search.  A range in which
one key draws very many references is salted: its parents are copied to each
salt and its references are spread over them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO_BITS = 10  # 1,024 slices of the hash space: the bound of what the driver and the broadcast hold
KINDS = ("missing", "deleted", "late")


@dataclass(frozen=True)
class Reference:
    """A reference column: ``key`` null or blank is no reference; ``at`` is the row's time."""

    table: str
    field: str
    rows: DataFrame
    src_id: Column
    key: list[Column]
    at: Column
    parents: DataFrame
    parent_key: list[Column]
    created: Column
    deleted: Column | None = None


def _hashed(code: int, key: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(code), *key).alias("h1"), F.xxhash64(F.lit(code + 7919), *reversed(key)).alias("h2")]


def find_orphans(references: list[Reference], rows_per_group: int = 100_000) -> DataFrame:
    """src_table, src_field, src_id, orphan_kind, at of every row whose reference does not hold.

    ``missing``: no parent has the key.  ``deleted``: all parents of the key
    are deleted at or before the row's time.  ``late``: the earliest parent is
    created after the row's time.  The first kind that fits is given.  A null
    or blank key (any part of it) is no reference; a null row time compares as
    neither deleted nor late; a parent without a creation time is never late.
    Repeated rows each count.  Empty tables give no rows or all ``missing``.
    """
    micro = F.shiftrightunsigned(F.col("h1"), 64 - MICRO_BITS).cast("int")
    refs = parents = None
    for code, r in enumerate(references):
        whole = F.lit(True)
        for k in r.key:
            whole = whole & k.isNotNull()
        one = r.rows.where(whole).select(F.lit(code).alias("code"), r.src_id.cast("long").alias("src_id"), r.at.alias("at"), *_hashed(code, r.key))
        whole = F.lit(True)
        for k in r.parent_key:
            whole = whole & k.isNotNull()
        gone = r.deleted if r.deleted is not None else F.lit(None).cast("timestamp_ntz")
        own = (
            r.parents.where(whole)
            .select(*_hashed(code, r.parent_key), r.created.alias("c"), gone.alias("d"))
            .groupBy("h1", "h2")
            .agg(F.min("c").alias("created"), F.max("d").alias("d"), F.max(F.col("d").isNull().cast("int")).alias("alive"))
            .select("h1", "h2", "created", F.when(F.col("alive") == 0, F.col("d")).alias("deleted"))
        )
        refs = one if refs is None else refs.unionByName(one)
        parents = own if parents is None else parents.unionByName(own)
    refs, parents = refs.withColumn("micro", micro), parents.withColumn("micro", micro)
    spark = refs.sparkSession
    plan = _ranges(refs, parents, rows_per_group)
    lookup = lambda: F.broadcast(spark.createDataFrame(plan, "micro int, grp int, parts int, salts int"))  # noqa: E731  2**MICRO_BITS rows
    part = F.pmod(F.col("h2"), F.col("parts").cast("long")).cast("int").alias("part")
    left = refs.join(lookup(), "micro").select("grp", part, F.pmod(F.xxhash64("src_id", "code"), F.col("salts")).cast("int").alias("salt"), "code", "src_id", "at", "h1", "h2")
    right = parents.join(lookup(), "micro").select("grp", part, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "h1", "h2", "created", "deleted")

    def probe(ref: pd.DataFrame, par: pd.DataFrame) -> pd.DataFrame:
        if ref.empty:
            return pd.DataFrame({"code": np.array([], np.int32), "src_id": np.array([], np.int64), "kind": np.array([], np.int32), "at": pd.Series([], dtype="datetime64[us]")})
        par = par.sort_values(["h1", "h2"], ignore_index=True)
        h1, h2 = ref["h1"].to_numpy(), ref["h2"].to_numpy()
        p1, p2 = par["h1"].to_numpy(np.int64), par["h2"].to_numpy(np.int64)
        # the run of parents with the reference's first half, then its second half within that run
        lo, hi = np.searchsorted(p1, h1, "left"), np.searchsorted(p1, h1, "right")
        pos, end = lo.copy(), hi
        while (open_ := pos < end).any():
            mid = (pos + end) // 2
            less = open_ & (p2[np.minimum(mid, len(p2) - 1)] < h2)
            pos, end = np.where(less, mid + 1, pos), np.where(open_ & ~less, mid, end)
        hit = pos < hi
        if len(par):
            hit &= p2[np.minimum(pos, len(p2) - 1)] == h2
        when = ref["at"].to_numpy("datetime64[us]").astype("int64")
        none = np.iinfo(np.int64).min
        kind = np.full(len(ref), -1, np.int32)
        kind[~hit] = 0
        if len(par):
            at = np.where(hit, pos, 0)
            gone = par["deleted"].to_numpy("datetime64[us]").astype("int64")[at]
            born = par["created"].to_numpy("datetime64[us]").astype("int64")[at]
            dead = hit & (gone != none) & (when != none) & (gone <= when)
            late = hit & ~dead & (born != none) & (when != none) & (born > when)
            kind[dead], kind[late] = 1, 2
        bad = kind >= 0
        return pd.DataFrame({"code": ref["code"].to_numpy(np.int32)[bad], "src_id": ref["src_id"].to_numpy()[bad], "kind": kind[bad], "at": ref["at"].to_numpy()[bad]})

    found = left.groupBy("grp", "part", "salt").cogroup(right.groupBy("grp", "part", "salt")).applyInPandas(probe, "code int, src_id long, kind int, at timestamp_ntz")
    names = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("code") + 1)
    return found.select(
        names([r.table for r in references]).alias("src_table"),
        names([r.field for r in references]).alias("src_field"),
        "src_id",
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1).alias("orphan_kind"),
        "at",
    )


def _ranges(refs: DataFrame, parents: DataFrame, rows_per_group: int) -> list[tuple[int, int, int, int]]:
    """(slice, range, parts, salts): light slices are joined up to the target load; a slice with too
    many parents is cut into parts by key, one with too many references for its parts is salted."""
    load = {m: [0, 0] for m in range(1 << MICRO_BITS)}
    counts = refs.select("micro", F.lit(0).alias("side")).unionAll(parents.select("micro", F.lit(1).alias("side"))).groupBy("micro", "side").count()
    for row in counts.collect():  # at most 2 * 2**MICRO_BITS rows
        load[row["micro"]][row["side"]] = row["count"]
    plan, grp, total = [], 0, 0
    for m in range(1 << MICRO_BITS):
        n_ref, n_par = load[m]
        if n_ref + n_par > rows_per_group:
            parts = max(1, -(-n_par // rows_per_group))
            plan.append((m, (grp := grp + 1), parts, max(1, -(-n_ref // (rows_per_group * parts)))))
            grp, total = grp + 1, 0
            continue
        if total + n_ref + n_par > rows_per_group:
            grp, total = grp + 1, 0
        plan.append((m, grp, 1, 1))
        total += n_ref + n_par
    return plan


def orphan_report(orphans: DataFrame, period: str = "day") -> DataFrame:
    """Orphans per table, field, kind and period of the row's time (null times have a null period)."""
    return orphans.groupBy("src_table", "src_field", "orphan_kind", F.date_format(F.date_trunc(period, F.col("at")), "yyyy-MM-dd").alias("period_utc")).agg(F.count("*").alias("n_rows"))
