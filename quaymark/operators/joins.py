"""Joins of a table with itself within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df to be broadcast if it has at most ``rows`` rows; a larger one is joined as the planner decides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, group: str, spread_by: Sequence[str], block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(left, right): df twice, to be joined on ``group`` and ``__s`` instead of on ``group`` alone.

    A group of more than ``block`` rows is dealt out on the left and copied to
    each of its ceil(n / block) salts on the right, so every pair of its rows
    meets exactly once and no task has more than about ``block`` rows of the
    left side.  Where no group is that large, both sides are df itself.  ``df``
    should be a table: it is read three times.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    if (sizes.agg(F.max("__n").alias("n")).first()["n"] or 0) <= block:
        plain = df.withColumn("__s", F.lit(0))
        return plain, plain
    salts = sizes.where("__n > 1").select(group, F.ceil(F.col("__n") / block).cast("int").alias("__salts"))
    sized = df.join(salts, group)
    left = sized.withColumn("__s", F.pmod(F.xxhash64(*spread_by), F.col("__salts")).cast("int")).drop("__salts")
    right = sized.withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    return left, right


def pairs_within(df: DataFrame, group: str, item: str, a: str, b: str, block: int = 2048) -> DataFrame:
    """group, a, b: all pairs of different items of a group, the smaller one as ``a``; an item twice in a group gives its pairs twice."""
    left, right = spread(df.select(group, item), group, [item], block)
    return left.withColumnRenamed(item, a).join(right.withColumnRenamed(item, b), [group, "__s"]).where(F.col(a) < F.col(b)).drop("__s")
