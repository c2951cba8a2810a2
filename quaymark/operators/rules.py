"""Decision rules over estimates, their frontiers and what their picks earn.

Estimates are long: key, model_name, value.  Picks are key, model_name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.operators.joins import small
from quaymark.operators.matrix import argmax_first, minmax
from quaymark.operators.percentiles import percentiles, stretch

ALPHAS = tuple(i / 20 for i in range(21))


def _sweep(estimates: DataFrame, by_model: DataFrame, key: str, column: str, params: Sequence[float], value) -> DataFrame:
    """The best model per key and grid value: a key's models are a short list, so each grid value is one pass over it, not a sort."""
    e = estimates.select(key, "model_name", "value").join(small(by_model.select("model_name", F.col(column).alias("__c"))), "model_name")
    lists = e.groupBy(key).agg(F.collect_list(F.struct("model_name", "value", "__c")).alias("__m"))
    grid_ = F.explode(F.array(*[F.lit(float(p)) for p in params])).alias("param")
    score = lambda m: F.struct((F.lit(0.0) - F.round(value(m, F.col("__m"), F.col("param")), 9)).alias("v"), m["model_name"].alias("model_name"))
    return lists.select(key, "__m", grid_).select(key, "param", F.array_min(F.transform("__m", score))["model_name"].alias("model_name"))


def alpha_sweep(estimates: DataFrame, cost_norm: DataFrame, key: str, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Pick of argmax alpha * minmax(estimate) + (1 - alpha) * (1 - cost) per key and alpha.  The grid is a fixed list."""

    def value(m: Column, all_: Column, alpha: Column) -> Column:
        values = F.transform(all_, lambda x: x["value"])
        low, high = F.array_min(values), F.array_max(values)
        q = F.coalesce(F.try_divide(m["value"] - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0))
        return alpha * q + (1 - alpha) * (1 - m["__c"])

    return _sweep(estimates, cost_norm, key, "c_norm", alphas, value)


def dollar_sweep(estimates: DataFrame, cost: DataFrame, key: str, lambdas: Sequence[float]) -> DataFrame:
    """Pick of argmax value - lambda * cost per key and lambda."""
    return _sweep(estimates, cost, key, "cost_hat", lambdas, lambda m, _, rate: m["value"] - rate * m["__c"])


def earned(picks: DataFrame, records: DataFrame, key: str = "prompt_key") -> DataFrame:
    """What the picks realised: score and cost of the picked outcome."""
    return picks.join(records.select(key, "model_name", "score", "cost"), [key, "model_name"])


def frontier(realised: DataFrame, references: DataFrame) -> DataFrame:
    """param, score, cost, gap recovered: (score - cheapest) / (oracle - cheapest), from the reference points (name, score)."""
    f = realised.groupBy("param").agg(F.avg("score").alias("score"), F.avg("cost").alias("cost"), F.countDistinct("model_name").alias("n_models"))
    ends = references.agg(F.max(F.when(F.col("name") == "cheapest", F.col("score"))).alias("__cheap"), F.max(F.when(F.col("name") == "oracle", F.col("score"))).alias("__oracle"))  # one row
    gap = F.try_divide(F.col("score") - F.col("__cheap"), F.nullif(F.col("__oracle") - F.col("__cheap"), F.lit(0.0)))
    return f.crossJoin(F.broadcast(ends)).withColumn("gap_recovered", gap).drop("__cheap", "__oracle")


def quality_at_cost(points: DataFrame, budgets: Sequence[float]) -> DataFrame:
    """Highest score of a mean cost within each budget; null if there is none."""
    b = F.explode(F.array(*[F.lit(float(x)) for x in budgets])).alias("budget")
    return points.select("score", "cost", b).groupBy("budget").agg(F.max(F.when(F.col("cost") <= F.col("budget"), F.col("score"))).alias("score"))


def compare_rules(frontiers: dict[str, DataFrame], budgets: Sequence[float], least: float = 0.008) -> DataFrame:
    """budget, rule, delta, wins: what each further rule gains on the first one within each budget; a gain counts above ``least``."""
    names = list(frontiers)
    base = quality_at_cost(frontiers[names[0]], budgets).withColumnRenamed("score", "base")
    out = None
    for name in names[1:]:
        one = quality_at_cost(frontiers[name], budgets).join(base, "budget").select("budget", F.lit(name).alias("rule"), (F.col("score") - F.col("base")).alias("delta"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("wins", F.coalesce(F.col("delta") > least, F.lit(False)))


def parity_cost(points: DataFrame, single: DataFrame, slack: float = 0.0) -> DataFrame:
    """Lowest cost of a score that is not more than ``slack`` below the single's, and the saving against its cost; ``single``: one row (score, cost)."""
    one = single.select((F.col("score") - slack).alias("__least"), F.col("cost").alias("__cost"))
    p = points.crossJoin(F.broadcast(one)).agg(F.min(F.when(F.col("score") >= F.col("__least"), F.col("cost"))).alias("parity_cost"), F.max("__cost").alias("__cost"))
    return p.select("parity_cost", (1 - F.try_divide(F.col("parity_cost"), F.col("__cost"))).alias("saving"))


def pareto(points: DataFrame, score: str = "score", cost: str = "cost") -> DataFrame:
    """Points that no other beats in one and equals in the other; equal points stay.

    By sorting instead of comparing pairs: per cost only the best score can
    stay, and only if it is above every score of a lower cost.  Costs are put
    in order within stretches of the number line; the best score of the
    stretches before comes from one row each.
    """
    best = points.groupBy(cost).agg(F.max(score).alias("__top")).withColumn("__s", stretch(F.col(cost).cast("double")))
    parts = best.groupBy("__s").agg(F.max("__top").alias("__part"))  # at most some thousand
    lower = F.max("__part").over(W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(F.col("__s").alias("__t"), lower.alias("__lower"))
    inner = F.max("__top").over(W.partitionBy("__s").orderBy(cost).rowsBetween(W.unboundedPreceding, -1))
    placed = best.withColumn("__inner", inner).join(parts, F.col("__s").eqNullSafe(F.col("__t")))
    before = F.greatest("__inner", "__lower")
    edge = placed.where(before.isNull() | (F.col("__top") > before)).select(F.col(cost).alias("__c"), "__top")
    return points.join(edge, (points[cost] == edge["__c"]) & (points[score] == edge["__top"]), "left_semi")


def frontier_area(points: DataFrame) -> DataFrame:
    """Area under the undominated points, cost scaled to [0, 1], by trapezia."""
    p = pareto(points).groupBy("cost").agg(F.max("score").alias("score"))
    w = W.orderBy("cost")
    scaled = p.withColumn("x", minmax("cost"))
    steps = scaled.withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("mid", (F.col("score") + F.lag("score").over(w)) / 2)
    return steps.agg(F.coalesce(F.sum(F.col("dx") * F.col("mid")), F.lit(0.0)).alias("area"))


def entropy(picks: DataFrame, by: Sequence[str], n_models: int) -> DataFrame:
    """Shannon entropy of the model shares over ln(number of models); 0 for one model."""
    n = picks.groupBy(*by, "model_name").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*by)))
    scale = F.lit(0.0) if n_models < 2 else F.ln(F.lit(float(n_models)))
    return p.groupBy(*by).agg(F.coalesce(F.try_divide(-F.sum(F.col("p") * F.ln("p")), F.nullif(scale, F.lit(0.0))), F.lit(0.0)).alias("entropy"))


def utility(records: DataFrame, alpha: float, key: str = "prompt_key") -> DataFrame:
    """alpha * scaled score + (1 - alpha) * (1 - scaled cost) within each prompt."""
    return records.withColumn("utility", alpha * minmax("score", [key]) + (1 - alpha) * (1 - minmax("cost", [key])))


def regret(picks: DataFrame, records: DataFrame, alpha: float, key: str = "prompt_key") -> DataFrame:
    """Per pick the highest utility of its prompt less the utility of the pick."""
    u = utility(records, alpha, key).withColumn("best", F.max("utility").over(W.partitionBy(key)))
    return picks.join(u.select(key, "model_name", "utility", "best"), [key, "model_name"]).withColumn("regret", F.col("best") - F.col("utility"))


def cost_fit(records: DataFrame, x: str, y: str = "cost", by: str = "model_name", floor: float = 1e-7) -> DataFrame:
    """Least squares of cost on a size per model, with the tenth percentile of the cost as its floor."""
    fit = records.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    low = percentiles(records, [by], y, {"p10": 0.1})
    return fit.join(low, by, "left").select(by, "slope", "intercept", F.greatest("p10", F.lit(floor)).alias("floor"))


def breakpoints(picks: DataFrame, key: str) -> DataFrame:
    """Grid values at which the mix of picks changes, the first one and the last."""
    mix = picks.groupBy("param", "model_name").agg(F.count("*").alias("n")).groupBy("param").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "model_name", F.col("n").cast("string")))), ",").alias("mix"))
    w = W.orderBy("param")
    m = mix.withColumn("prev", F.lag("mix").over(w)).withColumn("last", F.max("param").over(W.partitionBy(F.lit(1))))
    return m.where("prev is null or prev <> mix or param = last").select("param", "mix")


def distribution(picks: DataFrame, by: Sequence[str] = ("param",)) -> DataFrame:
    """Share of each model among the picks of a grid value."""
    n = picks.groupBy(*by, "model_name").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def winner_segments(picks: DataFrame, key: str) -> DataFrame:
    """Ranges of grid values over which the pick of a key stays the same."""
    w = W.partitionBy(key).orderBy("param")
    new = F.coalesce((F.lag("model_name").over(w) != F.col("model_name")).cast("int"), F.lit(0))
    s = picks.withColumn("new", new).withColumn("segment", F.sum("new").over(w))
    return s.groupBy(key, "segment", "model_name").agg(F.min("param").alias("lo"), F.max("param").alias("hi"))


def threshold_cascade(candidates: DataFrame, key: str, order: str, distance: str, thresholds: dict[int, float]) -> DataFrame:
    """The first model in order whose distance is below the threshold of its place; the last one takes what is left."""
    limit = F.coalesce(*[F.when(F.col(order) == k, F.lit(float(v))) for k, v in thresholds.items()], F.lit(float("inf")))
    accepted = F.min(F.when(F.col(distance) < limit, F.struct(order, "model_name")))
    last = F.max(F.struct(order, "model_name"))
    return candidates.groupBy(key).agg(F.coalesce(accepted, last).alias("p")).select(key, "p.model_name")


def cascade_result(picks: DataFrame, records: DataFrame, budget: float, key: str = "prompt_key") -> DataFrame:
    """accuracy, cost, over_budget of a cascade's picks; a total above budget times the prompts costs infinitely much."""
    r = earned(picks, records, key).agg(F.avg("score").alias("accuracy"), F.sum("cost").alias("total"), F.count("*").alias("n"))
    over = F.col("total") > budget * F.col("n")
    return r.select("accuracy", F.when(over, float("inf")).otherwise(F.col("total")).alias("cost"), over.alias("over_budget"))


def cascade_search(candidates: DataFrame, key: str, steps: Sequence[float], budget: float, order: str = "ord", distance: str = "distance") -> DataFrame:
    """Every setting of a cascade of three places: t1, t2, accuracy, cost, the best within the budget first.

    A step q is the quantile 1 - q of the distances that reach a place; what
    the first place accepts does not reach the second.  The last place takes
    the rest.  All settings share one pass: per prompt there is one row.
    """
    at = lambda k, c: F.max(F.when(F.col(order) == k, F.col(c)))
    wide = candidates.where(F.col(order) < 3).groupBy(key).agg(*[at(k, c).alias(f"{c[0]}{k}") for k in range(3) for c in (distance, "score", "cost")])
    qs = F.array(*[F.lit(float(1 - q)) for q in steps])
    first = wide.agg(F.percentile("d0", qs).alias("p")).select(F.posexplode("p").alias("i", "t1"))  # one row per step
    behind = wide.crossJoin(F.broadcast(first)).where(F.col("d0") >= F.col("t1"))
    second = behind.groupBy("i", "t1").agg(F.percentile("d1", qs).alias("p")).select("i", "t1", F.posexplode("p").alias("j", "t2"))  # steps squared
    place = F.when(F.col("d0") < F.col("t1"), 0).when(F.col("d1") < F.col("t2"), 1).otherwise(2)
    taken = lambda c: F.when(place == 0, F.col(f"{c}0")).when(place == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    out = wide.crossJoin(F.broadcast(second)).groupBy("i", "j", "t1", "t2").agg(F.avg(taken("s")).alias("accuracy"), F.sum(taken("c")).alias("cost"), F.count("*").alias("n"))
    fits = F.col("cost") <= budget * F.col("n")
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc(fits), F.desc(F.round("accuracy", 9)), F.round("cost", 9), "i", "j")).cast("long")).drop("n")


def explore_band(scored: DataFrame, key: str, width: float, value: str = "value") -> DataFrame:
    """Models within ``width`` of the best value, each with its chance of being drawn."""
    w = W.partitionBy(key)
    band = scored.withColumn("best", F.round(F.max(value).over(w), 9)).where(F.round(value, 9) >= F.col("best") - width)
    return band.withColumn("propensity", 1 / F.count("*").over(w)).drop("best")


def confidence_gate(near: DataFrame, key: str, quantile: float = 0.25) -> DataFrame:
    """0.6 * highest similarity + 0.4 / (1 + mean distance) per key; low: below the quantile of all keys."""
    c = near.groupBy(key).agg((0.6 * F.max("sim") + 0.4 / (1 + F.avg(1 - F.col("sim")))).alias("confidence"))
    cut = percentiles(c, [], "confidence", {"cut": quantile}).select("cut")  # one row
    return c.crossJoin(F.broadcast(cut)).select(key, "confidence", (F.round("confidence", 9) < F.round("cut", 9)).alias("low"))


def balance_score(stats: DataFrame, by: str, accuracy_weight: float, cost_weight: float, least: float = 0.0) -> DataFrame:
    """weight * accuracy scaled within the group (flat counts 1) + weight * (1 - cost / highest cost); below ``least`` 0."""
    w = W.partitionBy(by)
    low, high = F.min("accuracy").over(w), F.max("accuracy").over(w)
    acc = F.coalesce(F.try_divide(F.col("accuracy") - low, F.nullif(high - low, F.lit(0.0))), F.lit(1.0))
    cost = 1 - F.coalesce(F.try_divide(F.col("avg_cost"), F.nullif(F.max("avg_cost").over(w), F.lit(0.0))), F.lit(0.0))
    return stats.withColumn("balance", F.when(F.col("accuracy") < least, 0.0).otherwise(accuracy_weight * acc + cost_weight * cost))


def paired_outcomes(records: DataFrame, a: str, b: str, key: str = "prompt_key") -> DataFrame:
    """Outcomes of two models on the same prompt, both there, with the winner."""
    x = records.where(F.col("model_name") == a).select(key, "dataset_id", F.col("score").alias("score_a"), F.col("cost").alias("cost_a"))
    y = records.where(F.col("model_name") == b).select(key, F.col("score").alias("score_b"), F.col("cost").alias("cost_b"))
    p = x.join(y, key)
    return p.withColumn("winner", F.when(F.col("score_a") > F.col("score_b"), "model_a").when(F.col("score_a") < F.col("score_b"), "model_b").otherwise("tie"))


def pair_evaluation(pairs: DataFrame, ood: Sequence[str], by: str = "dataset_id") -> DataFrame:
    """Ties, decisive pairs, wins of the first, mean and population deviation of the groups' win rates, in and out of domain, and both costs."""
    g = pairs.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("winner") == "tie").alias("ties"), F.count_if(F.col("winner") == "model_a").alias("wins"), F.sum("cost_a").alias("ca"), F.sum("cost_b").alias("cb"))
    g = g.withColumn("win_rate", F.try_divide(F.col("wins").cast("double"), F.col("n") - F.col("ties")))
    outside = F.col(by).isin(*ood)
    return g.agg(
        F.sum("n").alias("n"), F.sum("ties").alias("ties"), F.sum(F.col("n") - F.col("ties")).alias("decisive"), F.sum("wins").alias("wins"), F.avg("win_rate").alias("win_rate_mean"), F.stddev_pop("win_rate").alias("win_rate_std"),
        F.avg(F.when(~outside, F.col("win_rate"))).alias("in_domain"), F.avg(F.when(outside, F.col("win_rate"))).alias("out_of_domain"), F.sum("ca").alias("cost_a"), F.sum("cb").alias("cost_b"),
    )


def with_projected_cost(shares: DataFrame, cost: DataFrame, by: Sequence[str] = ("param",)) -> DataFrame:
    """shares with what a request is expected to cost at each grid value: the models' mean costs by their shares."""
    j = shares.join(small(cost), "model_name")
    return j.withColumn("projected_cost", F.sum(F.col("share") * F.col("cost_hat")).over(W.partitionBy(*by))).drop("cost_hat")


def first_rank(scores: DataFrame, realised: DataFrame, key: str) -> DataFrame:
    """Rank (0 best) of the picked model among the realised scores of its prompt; share of rank 0 and means."""
    w = W.partitionBy(key).orderBy(F.desc("score"), "model_name")
    r = realised.withColumn("rank", F.row_number().over(w) - 1).withColumn("best", F.max("score").over(W.partitionBy(key)))
    p = scores.select(key, "model_name").join(r, [key, "model_name"])
    return p.agg(F.count("*").alias("n"), F.avg("rank").alias("mean_rank"), (F.count_if(F.col("rank") == 0) / F.count("*")).alias("share_best"), F.avg("score").alias("selected"), F.avg("best").alias("oracle"))


def blend_models(near: DataFrame, quality: DataFrame, axes: DataFrame, key: str, alpha: Column, eligible: Column, speed_weight: float = 0.0, output_cost_ratio: float = 1.0, expected_tokens: int = 500, verbosity: bool = False, bonus: Column | None = None) -> DataFrame:
    """key, model_name, value: per near cluster quality, cheapness and speed of each eligible model, added up.

    Quality is scaled within its cluster, cost and time over all models, also
    those that are not eligible.  Cost is input plus ratio times output price,
    the latter times the model's verbosity over the median one.  A model
    without times counts as the slowest; if no two models differ in time, the
    weight of speed goes to quality and cost in proportion.  ``alpha`` is the
    weight of quality by cluster_id; ``bonus`` is added once per cluster.
    """
    everything = W.partitionBy(F.lit(1))  # the roster: a few rows
    median = axes.agg(F.percentile("verbosity_tokens", 0.5).alias("__median"))
    v = F.coalesce(F.try_divide(F.col("verbosity_tokens"), F.nullif(F.col("__median"), F.lit(0.0))), F.lit(1.0)) if verbosity else F.lit(1.0)
    a = axes.crossJoin(F.broadcast(median)).withColumn("__c", F.coalesce("input_per_1k_usd", F.lit(0.0)) + output_cost_ratio * F.coalesce("output_per_1k_usd", F.lit(0.0)) * v)
    a = a.withColumn("__t", F.when(F.col("tps") > 0, F.col("ttft_s") + F.lit(float(expected_tokens)) / F.col("tps")))
    span = lambda c: F.max(c).over(everything) - F.min(c).over(everything)
    a = a.withColumn("__cn", F.coalesce(F.try_divide(F.col("__c") - F.min("__c").over(everything), F.nullif(span("__c"), F.lit(0.0))), F.lit(0.0)))
    a = a.withColumn("__timed", F.coalesce(span("__t") > 0, F.lit(False)) & F.lit(speed_weight > 0)).withColumn("__tn", F.coalesce(F.try_divide(F.col("__t") - F.min("__t").over(everything), F.nullif(span("__t"), F.lit(0.0))), F.lit(1.0)))
    a = a.select("model_name", "__cn", "__tn", "__timed", eligible.alias("__ok"), (F.lit(0.0) if bonus is None else F.coalesce(bonus, F.lit(0.0))).alias("__bonus"))
    q = quality.withColumn("__q", minmax("mean", ["cluster_id"])).join(small(a.where("__ok")), "model_name")
    wq, ws = alpha, F.lit(float(speed_weight))
    wc = 1.0 - wq - ws
    rest = wq + wc
    without = F.when(rest > 0, wq / rest * F.col("__q") + wc / rest * (1.0 - F.col("__cn"))).otherwise(F.col("__q"))
    blend = F.when(F.col("__timed"), wq * F.col("__q") + wc * (1.0 - F.col("__cn")) + ws * (1.0 - F.col("__tn"))).otherwise(without) + F.col("__bonus")
    scored = q.withColumn("__v", blend).select("cluster_id", "model_name", "__v")
    return near.select(key, "cluster_id").join(scored, "cluster_id").groupBy(key, "model_name").agg(F.sum("__v").alias("value"))


def preference_bonus(rank: Column, base: float = 0.15, decay: float = 0.55) -> Column:
    """base * decay ** rank; nothing for a negative or absent rank."""
    return F.when(rank >= 0, base * F.pow(F.lit(decay), rank)).otherwise(0.0)


def price_of(text: Column, input_per_1k: Column, output_per_1k: Column, expected_tokens: int = 512, chars_per_token: float = 3.5) -> Column:
    """What a prompt is expected to cost by the length of its text."""
    return (F.length(text) / chars_per_token * input_per_1k + expected_tokens * output_per_1k) / 1000.0


def cost_of_usage(cost: Column, prompt_tokens: Column, completion_tokens: Column, input_per_million: Column, output_per_million: Column) -> Column:
    """The reported cost, else tokens by price, else 0."""
    return F.coalesce(cost, (prompt_tokens * input_per_million + completion_tokens * output_per_million) / 1e6, F.lit(0.0))


def floored(alpha: Column, floor: Column) -> Column:
    return F.greatest(alpha, F.coalesce(floor, F.lit(0.0)))


def adaptive_k(n: Column, target: int, low: int, high: int) -> Column:
    """n / target clusters, within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(n / target)))


def cheapest_model(candidates: DataFrame, by: Sequence[str], allowed: Column | None = None, denied: Column | None = None) -> DataFrame:
    """Per group the allowed model of the lowest price, the first of the roster in a tie; models without a price don't count."""
    c = candidates.where(F.col("price").isNotNull())
    if allowed is not None:
        c = c.where(allowed)
    if denied is not None:
        c = c.where(~F.coalesce(denied, F.lit(False)))
    return c.groupBy(*by).agg(F.min_by("model", F.struct("price", "ord")).alias("model"))


def fastest_model(candidates: DataFrame, by: Sequence[str], allowed: Column | None = None, denied: Column | None = None) -> DataFrame:
    """Per group the allowed model of the most tokens a second; where none has a speed, the cheapest one."""
    c = candidates if allowed is None else candidates.where(allowed)
    c = c if denied is None else c.where(~F.coalesce(denied, F.lit(False)))
    return c.groupBy(*by).agg(
        F.coalesce(F.min_by(F.when(F.col("tps") > 0, F.col("model")), F.when(F.col("tps") > 0, F.struct(-F.col("tps"), F.col("ord")))), F.min_by(F.when(F.col("price").isNotNull(), F.col("model")), F.when(F.col("price").isNotNull(), F.struct("price", "ord")))).alias("model")
    ).where("model is not null")


def routed_success(scored: DataFrame, records: DataFrame, key: str, category: str) -> DataFrame:
    """Per category and in all: prompts, the share whose best scored model was right, and the mean over categories next to that over prompts."""
    best = argmax_first(scored, [key]).select(key, "model_name")
    hit = best.join(records.select(key, "model_name", category, (F.col("score") > 0.5).cast("int").alias("hit")), [key, "model_name"])
    per = hit.groupBy(category).agg(F.count("*").alias("n"), F.avg("hit").alias("success"))
    both = per.agg(F.sum("n").alias("n"), F.avg("success").alias("category_mean"), (F.sum(F.col("success") * F.col("n")) / F.sum("n")).alias("success"))
    return per.select(F.col(category).alias("category"), "n", "success", F.lit(None).cast("double").alias("category_mean")).unionByName(both.select(F.lit("all").alias("category"), "n", "success", "category_mean"))


def hash_share(key: Column, salt: str = "") -> Column:
    """A number below 100,000 that depends on the key only; for seeded choices that every engine repeats."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 8), 16, 10).cast("long") % 100_000
