"""Evaluation of picks and candidates: selection reports, look-ups and gates."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.operators.joins import small


def selection_report(picked: DataFrame, ood: Sequence[str]) -> DataFrame:
    """Per data set, domain and overall: picks, mean score (macro over data sets is the mean of the rows), cost, invalid costs as 0."""
    cost = F.when(F.col("cost").isNull() | F.isnan("cost") | (F.col("cost") < 0), 0.0).otherwise(F.col("cost"))
    p = picked.withColumn("domain", F.when(F.col("dataset_id").isin(*ood), "OOD").otherwise("In-Dist")).withColumn("c", cost)
    g = p.groupingSets([["domain", "dataset_id"], ["domain"], []], "domain", "dataset_id").agg(
        F.count("*").alias("n"), F.avg("score").alias("accuracy"), F.sum("c").alias("total_cost"), F.avg("c").alias("cost_per_query"), F.try_divide(F.sum("c"), F.count_if(F.col("score") > 0)).alias("cost_per_correct"),
        F.coalesce(F.sum(F.when(F.col("score") > 0, F.col("c"))), F.lit(0.0)).alias("correct_cost"),
    )
    return g


def selection_counts(picked: DataFrame) -> DataFrame:
    """How often each model is picked, per data set and in all, with its share."""
    n = picked.groupingSets([["dataset_id", "model_name"], ["model_name"]], "dataset_id", "model_name").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("dataset_id")))


def routing_cost(picked: DataFrame, ood: Sequence[str]) -> DataFrame:
    """Costs of the picks in all, per domain, per data set and per model: total, per query, per right answer, of right and of wrong answers.

    ``efficiency`` is the share of right answers over the cost per query; an
    invalid or negative cost counts 0.  ``grain`` says what a row is about.
    """
    cost = F.when(F.col("cost").isNull() | F.isnan("cost") | (F.col("cost") < 0), 0.0).otherwise(F.col("cost"))
    p = picked.withColumn("domain", F.when(F.col("dataset_id").isin(*ood), "OOD").otherwise("In-Dist")).withColumn("c", cost).withColumn("right", F.coalesce(F.col("score") > 0, F.lit(False)))
    g = p.groupingSets([["domain"], ["dataset_id"], ["model_name"], []], "domain", "dataset_id", "model_name").agg(
        F.count("*").alias("n"), F.sum("c").alias("total"), F.avg("c").alias("per_query"), F.try_divide(F.sum("c"), F.count_if("right")).alias("per_correct"),
        F.sum(F.when(F.col("right"), F.col("c")).otherwise(0.0)).alias("correct_cost"), F.sum(F.when(F.col("right"), 0.0).otherwise(F.col("c"))).alias("incorrect_cost"),
        F.try_divide(F.count_if("right") / F.count("*"), F.nullif(F.avg("c"), F.lit(0.0))).alias("efficiency"),
    )
    grain = F.when(F.col("domain").isNotNull(), "domain").when(F.col("dataset_id").isNotNull(), "dataset").when(F.col("model_name").isNotNull(), "model").otherwise("all")
    return g.select(grain.alias("grain"), F.coalesce("domain", "dataset_id", "model_name", F.lit("")).alias("name"), "n", "total", "per_query", "per_correct", "correct_cost", "incorrect_cost", "efficiency")


def against_baselines(picked: DataFrame, records: DataFrame) -> DataFrame:
    """Per data set the accuracy of the picks, the best single model, the difference in points of a percent, and how many data sets that model covers.

    Scores above 1 are taken for percents already.
    """
    percent = lambda c: F.when(F.col(c) > 1, F.col(c)).otherwise(100 * F.col(c))
    single = records.groupBy("dataset_id", "model_name").agg(F.avg("score").alias("a"))
    covered = single.where("a is not null").groupBy("model_name").agg(F.count("*").alias("covered"))
    total = single.agg(F.count_distinct("dataset_id").alias("datasets"))  # one row
    best = single.groupBy("dataset_id").agg(F.max_by("model_name", F.struct(F.round("a", 9), "model_name")).alias("best_model"), F.max("a").alias("best"))
    best = best.join(small(covered.withColumnRenamed("model_name", "best_model")), "best_model").crossJoin(F.broadcast(total))
    mine = picked.groupBy("dataset_id").agg(F.avg("score").alias("accuracy"))
    j = mine.join(best, "dataset_id")
    return j.select("dataset_id", percent("accuracy").alias("accuracy"), "best_model", percent("best").alias("best"), (percent("accuracy") - percent("best")).alias("difference"), (F.col("covered") / F.col("datasets")).alias("coverage"))


def mean_over_covered(records: DataFrame) -> DataFrame:
    """model_name, mean of its data sets' means, covered: the share of all data sets it has records in."""
    single = records.groupBy("dataset_id", "model_name").agg(F.avg("score").alias("a")).where("a is not null")
    total = single.agg(F.count_distinct("dataset_id").alias("datasets"))  # one row
    return single.groupBy("model_name").agg(F.avg("a").alias("mean"), F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("model_name", "mean", (F.col("n") / F.col("datasets")).alias("covered"))


def category_accuracy(records: DataFrame) -> DataFrame:
    """Share of scores of exactly 1 per category and model."""
    return records.groupBy("dataset_id", "model_name").agg((F.count_if(F.col("score") == 1.0) / F.count("*")).alias("accuracy"))


def top_k_accuracy(scored: DataFrame, key: str, k: int) -> DataFrame:
    """Share of keys whose label is among its k best scored ones."""
    w = W.partitionBy(key).orderBy(F.desc("sim"), "cluster_id")
    hit = scored.withColumn("rank", F.row_number().over(w)).groupBy(key).agg(F.max(((F.col("rank") <= k) & (F.col("cluster_id") == F.col("label"))).cast("int")).alias("hit"))
    return hit.agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))


def dominant_label(near: DataFrame, label: str = "label") -> DataFrame:
    """The most frequent label of the members of each cluster, ties to the smaller one."""
    n = near.groupBy("cluster_id", label).agg(F.count("*").alias("n"))
    w = W.partitionBy("cluster_id").orderBy(F.desc("n"), label)
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("cluster_id", label, "n")


def mix_difference(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Percentage points between the shares of two samples; 0 where a value is missing from one."""
    share = lambda df, name: df.groupBy(by).agg(F.count("*").alias("n")).withColumn(name, 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).drop("n")
    j = share(a, "x").join(share(b, "y"), by, "full_outer")
    return j.select(by, (F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))).alias("points"))


def soft_filter(candidates: DataFrame, by: str, flag: Column) -> DataFrame:
    """Candidates without the flag; all of a group if none is left."""
    left = F.max((~flag).cast("int")).over(W.partitionBy(by))
    return candidates.withColumn("__left", left).where(~flag | (F.col("__left") == 0)).drop("__left")


def similar_cached(requests: DataFrame, stored: DataFrame, threshold: float, ttl_seconds: int) -> DataFrame:
    """request_id, stored_id, sim: the newest stored row of the same bucket, within its life, that is similar enough.

    A stored row meets only requests of its bucket and of its own or the next
    stretch of ``ttl_seconds``; both tables have id, bucket, at and vec.
    """
    from quaymark.operators.matrix import cosine

    slot = lambda c: F.floor(F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})") / ttl_seconds)
    r = requests.select(F.col("id").alias("request_id"), "bucket", F.col("at").alias("t"), F.col("vec").alias("v")).withColumn("slot", F.explode(F.array(slot("t"), slot("t") - 1)))
    s = stored.select(F.col("id").alias("stored_id"), "bucket", F.col("at").alias("u"), F.col("vec").alias("x")).withColumn("slot", slot("u"))
    age = F.expr("timestampdiff(SECOND, u, t)")
    p = r.join(s, ["bucket", "slot"]).where((F.col("u") < F.col("t")) & (age <= ttl_seconds)).withColumn("sim", F.round(cosine(F.col("v"), F.col("x")), 6)).where(F.col("sim") >= threshold)
    w = W.partitionBy("request_id").orderBy(F.desc("u"), F.desc("stored_id"))
    return p.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("request_id", "stored_id", "sim")


def envelope(frontiers: dict[str, DataFrame], budgets: Sequence[float]) -> DataFrame:
    """Best score within each budget per rule and over all rules."""
    from quaymark.operators.rules import quality_at_cost

    parts = [quality_at_cost(f, budgets).withColumn("rule", F.lit(name)) for name, f in frontiers.items()]
    union = None
    for f in frontiers.values():
        f = f.select("score", "cost")
        union = f if union is None else union.unionByName(f)
    out = quality_at_cost(union, budgets).withColumn("rule", F.lit("union"))
    for p in parts:
        out = out.unionByName(p)
    return out


def point_within(points: DataFrame, budget: float) -> DataFrame:
    """The whole point of the highest score within a budget."""
    return points.where(F.col("cost") <= budget).orderBy(F.desc(F.round("score", 9)), "cost", "param").limit(1)


def compare_picks(a: DataFrame, b: DataFrame, key: str = "prompt_key") -> DataFrame:
    """Cases of two picks per prompt: same, cheaper_both_right, cheaper_wrong, dearer_right, both_wrong, other."""
    x = a.select(key, F.col("model_name").alias("ma"), F.col("score").alias("sa"), F.col("cost").alias("ca"))
    y = b.select(key, F.col("model_name").alias("mb"), F.col("score").alias("sb"), F.col("cost").alias("cb"))
    j = x.join(y, key)
    right = lambda c: F.col(c) > 0.5
    kind = F.when(F.col("ma") == F.col("mb"), "same").when((F.col("cb") < F.col("ca")) & right("sa") & right("sb"), "cheaper_both_right").when((F.col("cb") < F.col("ca")) & right("sa"), "cheaper_wrong").when(right("sb") & ~right("sa"), "second_right").when(~right("sa") & ~right("sb"), "both_wrong").otherwise("other")
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min(key).alias("example"))


def best_of_tiers(estimates: DataFrame, tiers: DataFrame, key: str) -> DataFrame:
    """Best value of each tier per key, and the member that has it."""
    j = estimates.join(small(tiers), "model_name")
    w = W.partitionBy(key, "tier").orderBy(F.desc(F.round("value", 9)), "model_name")
    return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, "tier", "model_name", "value")


def interpolate(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through the points, flat outside."""
    p = sorted(points)
    out = F.when(x <= p[0][0], F.lit(p[0][1]))
    for (a, u), (b, v) in zip(p, p[1:]):
        out = out.when(x <= b, u + (x - a) * ((v - u) / (b - a)))
    return out.otherwise(F.lit(p[-1][1]))


def positions(df: DataFrame, key: str, items: str) -> DataFrame:
    """First place of each item of a list, counted without repeats from 0."""
    e = df.select(key, F.posexplode(items).alias("pos", "item")).groupBy(key, "item").agg(F.min("pos").alias("pos"))
    return e.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("pos")).cast("long") - 1).select(key, "item", "rank")


def trailing_texts(df: DataFrame, by: str, ts: str, tie: str, text: str, last: int = 12, least_chars: int = 40, times: int = 3) -> DataFrame:
    """Groups in whose last texts one of some length occurs several times; case and white space don't count."""
    w = W.partitionBy(by).orderBy(F.desc(ts), F.desc(tie))
    norm = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    t = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last).withColumn("t", norm).where(F.length("t") >= least_chars)
    n = t.groupBy(by, "t").agg(F.count("*").alias("n")).groupBy(by).agg(F.max("n").alias("n"))
    return n.where(F.col("n") >= times)


def two_best(df: DataFrame, key: str, value: str, label: str) -> DataFrame:
    """Best and second label of each key and the margin between them."""
    w = W.partitionBy(key).orderBy(F.desc(F.round(value, 9)), label)
    r = df.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return r.groupBy(key).agg(F.max(F.when(F.col("rn") == 1, F.col(label))).alias("best"), F.max(F.when(F.col("rn") == 2, F.col(label))).alias("second"), (F.max(F.when(F.col("rn") == 1, F.col(value))) - F.max(F.when(F.col("rn") == 2, F.col(value)))).alias("margin"))


def fold_pins(turns: DataFrame, by: str, ts: str, tie: str, model: str, failed: Column) -> DataFrame:
    """State of each pin after its turns: count, model, models used, switches, failures in a row of that model, and its paired model.

    The paired model is the one that served before the last change; a change
    back to it keeps the pair, only turned round.  By windows and one
    aggregation; no list of a pin's turns is built.
    """
    w = W.partitionBy(by).orderBy(ts, tie)
    t = turns.withColumn("__f", failed.cast("int")).withColumn("__pos", F.row_number().over(w))
    t = t.withColumn("__before", F.lag(model).over(w)).withColumn("__new", F.when((F.col("__pos") > 1) & F.col("__before").eqNullSafe(F.col(model)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    # failures in a row: turns since the last success or change of model
    reset = F.max(F.when((F.col("__f") == 0) | (F.col("__new") == 1), F.col("__pos") - F.when(F.col("__f") == 1, 1).otherwise(0))).over(w.rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("__bad", F.col("__pos") - reset)
    changed = (F.col("__new") == 1) & (F.col("__pos") > 1) & F.col("__before").isNotNull()
    return t.groupBy(by).agg(
        F.count("*").alias("turn_count"), F.max_by(model, "__pos").alias("model"), F.countDistinct(model).alias("n_models"), (F.max("__run") - 1).alias("switches"), F.max_by("__bad", "__pos").cast("long").alias("failures_in_a_row"),
        F.max_by(F.when(changed, F.col("__before")), F.when(changed, F.col("__pos"))).alias("paired_model"),
    )


def cached_until(lookups: DataFrame, key: str, ts: str, tie: str, ttl_seconds: int) -> DataFrame:
    """lookups with ``hit``: whether the key's entry, written by the last miss, still lives; entries end ``ttl_seconds`` after they were written.

    Times are cut by the life of the entry: the first look-up of a stretch is
    found by following the misses, which is a fold over each key's rows.
    """
    kind = lookups.schema[key].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "tie"])
        until, hits = None, []
        for t in pdf["t"]:
            hits.append(until is not None and t < until)
            if not hits[-1]:
                until = t + ttl_seconds * 1_000_000
        return pdf.assign(hit=hits)[["key", "tie", "hit"]]

    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")
    out = lookups.select(F.col(key).alias("key"), micros.alias("t"), F.col(tie).cast("long").alias("tie")).groupBy("key").applyInPandas(fold, f"key {kind}, tie long, hit boolean")
    return out.select(F.col("key").alias(key), F.col("tie").alias(tie), "hit")
