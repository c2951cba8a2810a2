"""Percentiles of very large numeric columns (problem 5).

Values are counted in signed logarithmic buckets of a fixed relative width.
Counts of the same bucket add up, so sketches of separate partitions, days or
files are combined by a sum, and a percentile read from any such sum is within
the relative error ``alpha`` of a value of that rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gamma(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket(value: Column, alpha: float, tiny: float = 1e-9) -> tuple[Column, Column]:
    """(sign, key): key k holds gamma**(k-1) < |value| <= gamma**k; |value| <= tiny is zero, with sign and key 0."""
    v = value.cast("double")
    zero = F.abs(v) <= tiny
    sign = F.when(zero, 0).when(v > 0, 1).otherwise(-1)
    key = F.when(zero, 0).otherwise(F.ceil(F.ln(F.when(zero, 1.0).otherwise(F.abs(v))) / F.lit(math.log(gamma(alpha)))).cast("int"))
    return sign.cast("int"), key.cast("int")


def sketch(df: DataFrame, groups: Sequence[str], values: Sequence[str], alpha: float = 0.01, valid: str | None = None) -> DataFrame:
    """groups, metric, sign, key, n: one sketch per group and value column, as rows.

    Nulls and NaN are not counted.  ``valid``: SQL condition on ``value``;
    values that don't fulfil it are counted under the null key.  Infinite
    values count as not valid.  A group has as many rows as it has occupied
    buckets, at most a few thousand whatever the rows; the partial aggregation
    works before the shuffle, so a hot group costs no more than another.
    """
    pairs = ", ".join(f"'{v}', cast(`{v}` as double)" for v in values)
    long = df.selectExpr(*[f"`{g}`" for g in groups], f"stack({len(values)}, {pairs}) as (metric, value)").where("value is not null and not isnan(value)")
    ok = F.abs(F.col("value")) < F.lit(math.inf)
    if valid:
        ok = ok & F.expr(valid)
    sign, key = bucket(F.when(ok, F.col("value")), alpha)
    return long.groupBy(*groups, "metric", F.when(ok, sign).alias("sign"), F.when(ok, key).alias("key")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of equal alpha added up to coarser groups."""
    return sketches.groupBy(*groups, "metric", "sign", "key").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, groups: Sequence[str], probs: Sequence[float], alpha: float = 0.01) -> DataFrame:
    """groups, metric, n, n_invalid and p50-like columns from one sketch per group.

    The percentile p of n values is the value of rank floor(p * (n - 1)), given
    by its bucket's middle, 2 * gamma**k / (gamma + 1).  A group without any
    valid value has null percentiles.
    """
    g = gamma(alpha)
    keys = [*groups, "metric"]
    order = F.col("sign") * (F.col("key") + F.lit(1_000_000))
    by = W.partitionBy(*keys)
    valid = F.when(F.col("key").isNotNull(), F.col("n")).otherwise(0)
    s = sketches.withColumn("total", F.sum(valid).over(by)).withColumn("upto", F.sum(valid).over(by.orderBy(order.asc_nulls_first(), F.col("key")).rowsBetween(W.unboundedPreceding, 0)))
    estimate = F.when(F.col("key").isNotNull(), F.col("sign") * (F.pow(F.lit(g), F.col("key").cast("double")) * F.lit(2 / (g + 1))))
    aggs = [F.max("total").alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("n_invalid")]
    for p in probs:
        rank = F.floor(F.lit(p) * (F.col("total") - 1))
        at = (F.col("key").isNotNull()) & (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
        aggs.append(F.max(F.when(at, estimate)).alias(f"p{p * 100:g}".replace(".", "_")))
    return s.groupBy(*keys).agg(*aggs)
