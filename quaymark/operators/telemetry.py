"""Request telemetry: totals, time buckets, breakdowns, drill-down and keyed writes.

Costs are whole micros.  Time windows are half open.  Tables are append logs:
an upsert is the latest row of its key, an insert-or-ignore the first one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRANULARITIES = ("hour", "day", "week", "month")


def in_window(df: DataFrame, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of [start, end); a plain comparison of the column, so that it reaches the scan."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        df = df.where(F.col(ts) < F.lit(end).cast(df.schema[ts].dataType))
    return df


def _sum(col: Column | str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("long")


def totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests, tokens, requested and actual cost and the difference; zeros for nothing."""
    requested, actual = F.coalesce("requested_input_cost_usd", F.lit(0)) + F.coalesce("requested_output_cost_usd", F.lit(0)), F.coalesce("actual_input_cost_usd", F.lit(0)) + F.coalesce("actual_output_cost_usd", F.lit(0))
    return df.groupBy(*by).agg(F.count("*").alias("requests"), _sum("input_tokens").alias("input_tokens"), _sum("output_tokens").alias("output_tokens"), _sum(requested).alias("requested_cost"), _sum(actual).alias("actual_cost"), _sum(requested - actual).alias("savings"))


def time_buckets(df: DataFrame, ts: str, granularity: str, by: Sequence[str] = ()) -> DataFrame:
    """totals per bucket; an unknown granularity counts as hour.  Weeks begin on Monday."""
    g = granularity if granularity in GRANULARITIES else "hour"
    bucket = F.date_format(F.date_trunc(g, F.col(ts)), "yyyy-MM-dd HH:mm:ss")
    return totals(df.withColumn("bucket", bucket), ["bucket", *by])


def newest(df: DataFrame, ts: str, tie: str, limit: int = 100) -> DataFrame:
    """The newest rows, 100 unless said otherwise and 1,000 at most: a top-k, sorted per partition and merged."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(max(1, min(limit, 1000)))


def nth_turn(df: DataFrame, by: Sequence[str], ts: str, tie: str, n: int, newest_first: bool = False) -> DataFrame:
    """The n-th row of each group in time order, counted from 1."""
    order = [F.desc(ts), F.desc(tie)] if newest_first else [F.asc(ts), F.asc(tie)]
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__rn") == n).drop("__rn")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Last write wins: per key the row that is greatest in ``order``; a combiner works before the shuffle."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in keep])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First write wins: later rows of a key are ignored."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in keep])


def _chunked(df: DataFrame, ts: str) -> DataFrame:
    """df with the day of a row as its chunk, so that a large account is many partitions."""
    return df.withColumn("__chunk", F.to_date(F.col(ts)))


def running_balance(df: DataFrame, by: Sequence[str], order: Sequence[str], delta: str, opening: int = 0) -> DataFrame:
    """delta added up in order within each account; ``order`` begins with the time.

    Windows run within days; what the days before add up to comes from one row
    per account and day, so an account of any size is spread.
    """
    c = _chunked(df, order[0])
    days = c.groupBy(*by, "__chunk").agg(F.sum(delta).alias("__total"))
    before = F.sum("__total").over(W.partitionBy(*by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1))
    days = days.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], F.col("__chunk").alias("__day"), F.coalesce(before, F.lit(0)).alias("__before"))
    same = F.col("__chunk").eqNullSafe(F.col("__day"))
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inner = F.sum(delta).over(W.partitionBy(*by, "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = c.withColumn("__inner", inner).join(days, same)
    return out.withColumn("balance_after", (F.coalesce("__inner", F.lit(0)) + F.col("__before") + opening).cast("long")).select(*df.columns, "balance_after")


def crossings(df: DataFrame, threshold: int) -> DataFrame:
    """Entries that take a balance from at or above a threshold to below it."""
    before = F.col("balance_after") - F.col("delta")
    return df.where((before >= threshold) & (F.col("balance_after") < threshold))


def active(df: DataFrame) -> DataFrame:
    """Rows that are not deleted."""
    return df.where("deleted_at is null")


def upsert_status(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], values: Sequence[str], failed: Column | None = None) -> DataFrame:
    """new, updated, duplicate, failed or kept for every key of two tables, by a full join; ``failed``: of an incoming row."""
    a = stored.select(*keys, F.struct(*values).alias("old"), F.lit(1).alias("has_old"))
    b = incoming.select(*keys, F.struct(*values).alias("new"), F.lit(1).alias("has_new"), (F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))).alias("failed"))
    j = a.join(b, list(keys), "full_outer")
    status = F.when(F.col("has_new").isNull(), "kept").when(F.col("failed"), "failed").when(F.col("has_old").isNull(), "new").when(F.col("old").eqNullSafe(F.col("new")), "duplicate").otherwise("updated")
    return j.select(*keys, status.alias("status"))


def soft_delete(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """df with deleted_at set to the earliest time that ``gone`` (key, deleted_at) names, where it was not deleted before."""
    when = gone.groupBy(key).agg(F.min("deleted_at").alias("__at"))
    return df.join(when, key, "left").withColumn("deleted_at", F.coalesce("deleted_at", "__at")).drop("__at")


def needs_run(plan: DataFrame, done: DataFrame, keys: Sequence[str], fingerprint: str = "fingerprint") -> DataFrame:
    """Planned cells without a stored result of the same fingerprint; a stored result without one counts as done."""
    stored = done.groupBy(*keys).agg(F.max(F.col(fingerprint).isNull().cast("int")).alias("legacy"), F.collect_set(fingerprint).alias("prints"))
    j = plan.join(stored, list(keys), "left")
    return j.where(F.col("legacy").isNull() | ((F.col("legacy") == 0) & ~F.array_contains("prints", F.col(fingerprint)))).drop("legacy", "prints")


def observed_last(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], fresh_seconds: int | None = None) -> DataFrame:
    """The last value that is not null of each column up to each row, no older than ``fresh_seconds``; ``order`` begins with the time.

    By days as in running_balance: a day's last values are carried to the next ones.
    """
    ts = order[0]
    c = _chunked(df, ts)
    seen = lambda v: F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("v"), F.col(ts).alias("at")))
    last_of_day = [F.max_by(seen(v), F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"__l{i}") for i, v in enumerate(values)]
    days = c.groupBy(*by, "__chunk").agg(*last_of_day)
    earlier = W.partitionBy(*by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    days = days.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], F.col("__chunk").alias("__day"), *[F.last(f"__l{i}", ignorenulls=True).over(earlier).alias(f"__c{i}") for i in range(len(values))])
    same = F.col("__chunk").eqNullSafe(F.col("__day"))
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inner = W.partitionBy(*by, "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    for i, v in enumerate(values):
        c = c.withColumn(f"__s{i}", F.last(seen(v), ignorenulls=True).over(inner))
    out = c.join(days, same)
    for i, v in enumerate(values):
        known = F.coalesce(f"__s{i}", f"__c{i}")
        fresh = F.lit(True) if fresh_seconds is None else F.expr(f"timestampdiff(MICROSECOND, coalesce(__s{i}, __c{i}).at, {ts})") <= fresh_seconds * 1_000_000
        out = out.withColumn(f"{v}_seen", F.when(fresh, known["v"]))
    return out.select(*df.columns, *[f"{v}_seen" for v in values])


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of both and the share in which they are equal; rows with a null in one are not compared."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.groupBy(*by).agg(F.count_if(both).alias("compared"), F.try_divide(F.count_if(both & (F.col(a) == F.col(b))).cast("double"), F.count_if(both)).alias("agreement"))
