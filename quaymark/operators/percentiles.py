"""Exact percentiles of groups of any size, without a list of their values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stretch(v: Column) -> Column:
    """A number for the stretch of the number line that a value lies in, in order: signed powers of an eighth of two, 0 for 0."""
    size = F.floor(F.log2(F.abs(v)) * 8)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * (size + 10_000)).cast("int")


def percentiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """by, n and one column per percentile, interpolated between the two nearest ranks; nulls and NaN don't count.

    Equal values are counted first.  They are put in order within stretches of
    the number line (signed powers of an eighth of two), and what lies before a
    stretch comes from one row per group and stretch, so neither a task nor an
    aggregate holds a group.  A group without values has n = 0 and nulls.
    """
    keys = list(by)
    v = F.col(value).cast("double")
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("__v")).agg(F.count("*").alias("__n")).withColumn("__s", stretch(F.col("__v")))
    parts = counts.groupBy(*keys, "__s").agg(F.sum("__n").alias("__k"))
    order = W.partitionBy(*keys).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__k").over(order), F.lit(0))).withColumn("__total", F.sum("__k").over(W.partitionBy(*keys)))
    parts = parts.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], F.col("__s").alias("__t"), "__before", "__total")
    same = F.col("__s") == F.col("__t")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    inner = W.partitionBy(*keys, "__s").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("__upto", F.sum("__n").over(inner)).join(parts, same).withColumn("__upto", F.col("__before") + F.col("__upto"))
    aggs = [F.max("__total").alias("n")]
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("__total") - 1)
        here = lambda rank: (F.col("__upto") > rank) & (F.col("__upto") - F.col("__n") <= rank)
        aggs += [F.max(F.when(here(F.floor(at)), F.col("__v"))).alias(f"__lo_{name}"), F.max(F.when(here(F.ceil(at)), F.col("__v"))).alias(f"__hi_{name}")]
    found = ranked.groupBy(*keys).agg(*aggs)
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        found = found.withColumn(name, F.col(f"__lo_{name}") + (at - F.floor(at)) * (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")))
    return found.select(*keys, "n", *probs)
