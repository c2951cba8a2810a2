"""Queries that evaluate picks, and the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators import evaluation as E
from quaymark.operators import matrix as M
from quaymark.operators import rules as U
from quaymark.operators.percentiles import percentiles
from quaymark.plans.fixtures import oracle, view
from quaymark.plans.outcome_queries import rounded
from quaymark.plans.registry import Registry
from quaymark.plans.rule_queries import EST, FRONT, NEAR, PICKS, V, alpha_frontier, alpha_picks, estimates, near, out
from quaymark.sources.tables import load

R = Registry()


def picked(s: SparkSession, d: str, param: float = 0.5) -> DataFrame:
    return alpha_picks(s, d).where(F.col("param") == param).select("prompt_key", "model_name").join(out(s, d), ["prompt_key", "model_name"])


PICKED = PICKS + ", pk as (select o.* from picks p join outcomes o using (prompt_key, model_name) where p.param = 0.5)"
_AGG = "count(*) as n, round(avg(score), 6) as accuracy, round(sum(cost), 6) as total_cost, round(avg(cost), 6) as cost_per_query, round(sum(cost) / nullif(count(*) filter (score > 0), 0), 6) as cost_per_correct, round(coalesce(sum(cost) filter (score > 0), 0), 6) as correct_cost"
R.add("agg_routing_eval", lambda s, d: rounded(E.selection_report(picked(s, d), ["ds8", "ds9"])), oracle(PICKED + f", dm as (select *, case when dataset_id in ('ds8', 'ds9') then 'OOD' else 'In-Dist' end as domain from pk) select domain, dataset_id, {_AGG} from dm group by grouping sets ((domain, dataset_id), (domain), ())", *V))
R.add("agg_pick_shares", lambda s, d: rounded(E.selection_counts(picked(s, d))), oracle(PICKED + ", n as (select dataset_id, model_name, count(*) as n from pk group by grouping sets ((dataset_id, model_name), (model_name))) select dataset_id, model_name, n, round(n / sum(n) over (partition by dataset_id), 6) as share from n", *V))
R.add("agg_routing_cost", lambda s, d: rounded(rounded(E.routing_cost(picked(s, d).withColumn("cost", F.when(F.col("record_index") % 17 == 0, -F.col("cost")).otherwise(F.col("cost"))), ["ds8", "ds9"]), "efficiency", digits=4), digits=7), oracle(PICKED + """, c as (select *, case when record_index % 17 = 0 then 0 else cost end as c, case when dataset_id in ('ds8', 'ds9') then 'OOD' else 'In-Dist' end as domain from pk),
e as (select unnest([{'g': 'all', 'v': ''}, {'g': 'domain', 'v': domain}, {'g': 'dataset', 'v': dataset_id}, {'g': 'model', 'v': model_name}]) as k, score, c from c)
select k.g as grain, k.v as name, count(*) as n, round(sum(c), 7) as total, round(avg(c), 7) as per_query, round(sum(c) / nullif(count(*) filter (score > 0), 0), 7) as per_correct, round(coalesce(sum(c) filter (score > 0), 0), 7) as correct_cost, round(coalesce(sum(c) filter (not score > 0), 0), 7) as incorrect_cost, round(count(*) filter (score > 0) / count(*) / nullif(avg(c), 0), 4) as efficiency from e group by 1, 2""", *V))
R.add("agg_baseline_compare", lambda s, d: rounded(E.against_baselines(picked(s, d), out(s, d).where("not (dataset_id = 'ds3' and ord = 4)")), digits=4), oracle(PICKED + ", sgl as (select dataset_id, model_name, avg(score) as a from outcomes where not (dataset_id = 'ds3' and ord = 4) group by all), cv as (select model_name, count(*) / (select count(distinct dataset_id) from sgl) as coverage from sgl group by 1), b as (select dataset_id, arg_max(model_name, (round(a, 9), model_name)) as best_model, max(a) as best from sgl group by 1), m as (select dataset_id, avg(score) as accuracy from pk group by 1) select dataset_id, round(100 * accuracy, 4) as accuracy, best_model, round(100 * best, 4) as best, round(100 * accuracy - 100 * best, 4) + 0 as difference, round(coverage, 4) as coverage from m join b using (dataset_id) join cv on cv.model_name = best_model", *V))
R.add("agg_model_coverage", lambda s, d: rounded(E.mean_over_covered(out(s, d).where("not (dataset_id = 'ds3' and ord = 4)"))), oracle(", g as (select dataset_id, model_name, avg(score) as a from outcomes where not (dataset_id = 'ds3' and ord = 4) group by all) select model_name, round(avg(a), 6) as mean, round(count(*) / (select count(distinct dataset_id) from g), 6) as covered from g group by 1", "outcomes"))
R.add("category_accuracy", lambda s, d: rounded(E.category_accuracy(out(s, d))), oracle("select dataset_id, model_name, round(count(*) filter (score = 1.0) / count(*), 6) as accuracy from outcomes group by all", "outcomes"))
R.add("topk_accuracy", lambda s, d: rounded(E.top_k_accuracy(M.centroid_similarities(view(s, d, "vectors"), view(s, d, "centroids"), "vec_id", "embedding"), "vec_id", 3)), oracle(", r as (select *, row_number() over (partition by vec_id order by sim desc, cluster_id) as rank from sims), h as (select vec_id, max(case when rank <= 3 and cluster_id = label then 1 else 0 end) as hit from r group by 1) select count(*) as n, round(avg(hit), 6) as accuracy from h", "sims"))
R.add("agg_cluster_label", lambda s, d: E.dominant_label(near(s, d).where("rank = 1").join(view(s, d, "vectors").select("vec_id", "label"), "vec_id")), oracle(NEAR + ", c as (select n.cluster_id, v.label, count(*) as n from near n join vectors v using (vec_id) where rank = 1 group by all) select cluster_id, label, n from (select *, row_number() over (partition by cluster_id order by n desc, label) as rn from c) where rn = 1", *V))
R.add("agg_mix_diff", lambda s, d: rounded(E.mix_difference(load(s, d, "request_telemetry", "decision_model", "turn_type").where("turn_type = 'main_loop' and decision_model is not null"), load(s, d, "request_telemetry", "decision_model").where("decision_model is not null"), "decision_model")), "with a as (select decision_model, 100.0e0 * count(*) / sum(count(*)) over () as x from request_telemetry where turn_type = 'main_loop' and decision_model is not null group by 1), b as (select decision_model, 100.0e0 * count(*) / sum(count(*)) over () as y from request_telemetry where decision_model is not null group by 1) select coalesce(a.decision_model, b.decision_model) as decision_model, round(coalesce(x, 0) - coalesce(y, 0), 6) + 0 as points from a full join b on a.decision_model = b.decision_model")
R.add("soft_filter", lambda s, d: E.soft_filter(out(s, d).select("prompt_key", "model_name", "score"), "prompt_key", F.col("score") < 0.85).select("prompt_key", "model_name"), oracle("select prompt_key, model_name from (select *, max(case when score >= 0.85 then 1 else 0 end) over (partition by prompt_key) as l from outcomes) where score >= 0.85 or l = 0", "outcomes"))


def _cache(s: SparkSession, d: str) -> DataFrame:
    v = view(s, d, "vectors").select(F.col("vec_id").alias("id"), F.col("label").alias("bucket"), F.timestamp_add("SECOND", F.col("vec_id").cast("int") * 60, F.lit("2024-01-01").cast("timestamp_ntz")).alias("at"), F.col("embedding").alias("vec"))
    return E.similar_cached(v, v, 0.2, 36_000)


R.add("join_semantic_cache", _cache, oracle(", p as (select a.vec_id as request_id, b.vec_id as stored_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[])), 6) as sim from vectors a join vectors b using (label) where b.vec_id < a.vec_id and (a.vec_id - b.vec_id) * 60 <= 36000) select request_id, stored_id, sim from (select *, row_number() over (partition by request_id order by stored_id desc) as rn from p where sim >= 0.2) where rn = 1", "vectors"))


def _envelope(s: SparkSession, d: str) -> DataFrame:
    f = alpha_frontier(s, d)
    return rounded(E.envelope({"low": f.where("param <= 0.5"), "high": f.where("param > 0.5")}, [0.003, 0.006, 0.012]))


_ENV = FRONT + ", b as (select unnest([0.003, 0.006, 0.012]::double[]) as budget), x as (select budget, case when param <= 0.5 then 'low' else 'high' end as rule, case when cost <= budget then score end as s from fr cross join b) select budget, rule, round(max(s), 6) as score from x group by 1, 2 union all select budget, 'union', round(max(s), 6) from x group by 1"
R.add("union_envelope", _envelope, oracle(_ENV, *V))
R.add("q_at_point", lambda s, d: rounded(E.point_within(alpha_frontier(s, d), 0.008).select("param", "score", "cost")), oracle(FRONT + " select round(param, 6) as param, round(score, 6) as score, round(cost, 6) as cost from fr where cost <= 0.008e0 order by round(fr.score, 9) desc, fr.cost, fr.param limit 1", *V))
R.add("downgrade_cases", lambda s, d: E.compare_picks(picked(s, d, 1.0), picked(s, d, 0.5)), oracle(PICKS + ", j as (select p.prompt_key, p.model_name as ma, q.model_name as mb, a.score as sa, b.score as sb, a.cost as ca, b.cost as cb from picks p join picks q using (prompt_key) join outcomes a on a.prompt_key = p.prompt_key and a.model_name = p.model_name join outcomes b on b.prompt_key = q.prompt_key and b.model_name = q.model_name where p.param = 1 and q.param = 0.5) select case when ma = mb then 'same' when cb < ca and sa > 0.5 and sb > 0.5 then 'cheaper_both_right' when cb < ca and sa > 0.5 then 'cheaper_wrong' when sb > 0.5 and not sa > 0.5 then 'second_right' when not sa > 0.5 and not sb > 0.5 then 'both_wrong' else 'other' end as kind, count(*) as n, min(prompt_key) as example from j group by 1", *V))
R.add("tier_aggregate", lambda s, d: rounded(E.best_of_tiers(estimates(s, d), view(s, d, "models").select(F.col("model").alias("model_name"), F.when(F.col("ord") < 2, "low").otherwise("high").alias("tier")), "prompt_key"), digits=5), oracle(EST + ", t as (select e.*, case when ord < 2 then 'low' else 'high' end as tier from est e join models m on m.model = e.model_name) select prompt_key, tier, model_name, round(value, 5) as value from (select *, row_number() over (partition by prompt_key, tier order by round(value, 9) desc, model_name) as rn from t) where rn = 1", *V, "models"))
R.add("dial_to_alpha", lambda s, d: rounded(load(s, d, "events", "event_id").select("event_id", E.interpolate((F.col("event_id") % 101) / 100.0, [(0.0, 0.1), (0.4, 0.5), (1.0, 0.9)]).alias("alpha"))), "with x as (select event_id, event_id % 101 / 100.0e0 as t from events) select event_id, round(case when t <= 0 then 0.1e0 when t <= 0.4e0 then 0.1e0 + t * ((0.5e0 - 0.1e0) / 0.4e0) when t <= 1 then 0.5e0 + (t - 0.4e0) * ((0.9e0 - 0.5e0) / 0.6e0) else 0.9e0 end, 6) as alpha from x")
R.add("preference_rank", lambda s, d: E.positions(load(s, d, "request_telemetry", "row_id", "candidate_models"), "row_id", "candidate_models"), "with e as (select row_id, unnest(candidate_models) as item, generate_subscripts(candidate_models, 1) as pos from request_telemetry), m as (select row_id, item, min(pos) as pos from e group by 1, 2) select row_id, item, row_number() over (partition by row_id order by pos) - 1 as rank from m")
R.add("text_repetition", lambda s, d: E.trailing_texts(view(s, d, "busy"), "session_key", "ts", "call_id", "text"), oracle(r", r as (select session_key, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as t, row_number() over (partition by session_key order by ts desc, call_id desc) as rn from busy), c as (select session_key, t, count(*) as n from r where rn <= 12 and length(t) >= 40 group by 1, 2) select session_key, max(n) as n from c group by 1 having max(n) >= 3", "busy"))
R.add("cache_ttl", lambda s, d: E.cached_until(view(s, d, "busy").withColumn("entry", F.concat(F.col("session_key"), F.lit(":"), "sig")), "entry", "ts", "call_id", 120), oracle(", b as (select concat(session_key, ':', sig) as entry, ts, call_id from busy), f as (select *, row_number() over (partition by entry order by ts, call_id) as pos from b), w as (with recursive x as (select entry, pos, ts, call_id, false as hit, ts as written from f where pos = 1 union all select f.entry, f.pos, f.ts, f.call_id, f.ts < x.written + interval 120 seconds, case when f.ts < x.written + interval 120 seconds then x.written else f.ts end from x join f on f.entry = x.entry and f.pos = x.pos + 1) select * from x) select entry, call_id, hit from w", "busy"))
R.add("prev_state_margins", lambda s, d: rounded(E.two_best(estimates(s, d), "prompt_key", "value", "model_name"), digits=5), oracle(EST + ", r as (select *, row_number() over (partition by prompt_key order by round(value, 9) desc, model_name) as rn from est) select prompt_key, max(model_name) filter (rn = 1) as best, max(model_name) filter (rn = 2) as second, round(max(value) filter (rn = 1) - max(value) filter (rn = 2), 5) as margin from r group by 1", *V))
R.add("ensemble_mean", lambda s, d: rounded(estimates(s, d).withColumnRenamed("value", "a").join(out(s, d).groupBy("model_name").agg(F.avg("score").alias("b")), "model_name").select("prompt_key", "model_name", (0.7 * F.col("a") + 0.3 * F.col("b")).alias("value")), digits=5), oracle(EST + ", g as (select model_name, avg(score) as b from outcomes group by 1) select prompt_key, model_name, round(0.7e0 * value + 0.3e0 * b, 5) as value from est join g using (model_name)", *V))
R.add(
    "upsert_pin",
    lambda s, d: E.fold_pins(load(s, d, "request_telemetry", "row_id", "session_id", "ts", "decision_model", "upstream_status_code").where("session_id is not null"), "session_id", "ts", "row_id", "decision_model", F.coalesce(F.col("upstream_status_code") >= 400, F.lit(False))),
    "with t as (select session_id, decision_model as m, lag(decision_model) over w as b, coalesce(upstream_status_code >= 400, false) as f, row_number() over w as pos, case when row_number() over w > 1 and lag(decision_model) over w is not distinct from decision_model then 0 else 1 end as n from request_telemetry where session_id is not null window w as (partition by session_id order by ts, row_id)), g as (select *, sum(n) over (partition by session_id order by pos) as run, max(case when not f or n = 1 then pos - case when f then 1 else 0 end end) over (partition by session_id order by pos) as reset from t) select session_id, count(*) as turn_count, any_value(case when pos = mx then m end) as model, count(distinct m) as n_models, cast(max(run) - 1 as bigint) as switches, cast(max(case when pos = mx then pos - reset end) as bigint) as failures_in_a_row, arg_max(b, pos) filter (n = 1 and pos > 1 and b is not null) as paired_model from (select *, max(pos) over (partition by session_id) as mx from g) group by 1",
)
R.add("major_minor", lambda s, d: rounded(out(s, d).groupBy("prompt_key").agg(F.collect_list(F.struct("model_name", "score")).alias("c")).select("prompt_key", F.filter("c", lambda x: x["model_name"] == "EUROPE")[0]["score"].alias("major"), F.filter("c", lambda x: x["model_name"] == "ASIA")[0]["score"].alias("minor"))), oracle("select prompt_key, round(max(score) filter (model_name = 'EUROPE'), 6) as major, round(max(score) filter (model_name = 'ASIA'), 6) as minor from outcomes group by 1", "outcomes"))
R.add("score_window", lambda s, d: load(s, d, "request_telemetry", "row_id", "cluster_ids").where("size(cluster_ids) > 0").select("row_id", F.array_join(F.slice(F.concat("cluster_ids", F.array_repeat(F.element_at("cluster_ids", -1), 10)), 1, 10).cast("array<string>"), ",").alias("w")), "select row_id, array_to_string(list_transform(range(1, 11), lambda i: cast(cluster_ids[least(i, len(cluster_ids))] as varchar)), ',') as w from request_telemetry where len(cluster_ids) > 0")
R.add("agg_percentiles", lambda s, d: rounded(percentiles(load(s, d, "events", "event_type", "value"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n").join(load(s, d, "events", "event_type", "value").groupBy("event_type").agg(F.avg("value").alias("mean")), "event_type")), "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(avg(value), 6) as mean from events group by 1")
R.add("agg_prompt_max", lambda s, d: rounded(out(s, d).groupBy("prompt_key").agg(F.max("score").alias("score"), F.max(F.struct("score", "model_name"))["model_name"].alias("model"))), oracle("select prompt_key, round(max(score), 6) as score, arg_max(model_name, (score, model_name)) as model from outcomes group by 1", "outcomes"))
R.add("agg_model_avg_cost", lambda s, d: rounded(view(s, d, "sparse").groupBy("model_name").agg(F.avg("cost").alias("cost"))), oracle("select model_name, round(avg(cost), 6) as cost from sparse group by 1", "sparse"))
R.add("weight_grid", lambda s, d: _weights(s, d), oracle(PICKS + ", r as (select p.param, avg(o.score) as score, avg(o.cost) as cost from picks p join outcomes o using (prompt_key, model_name) group by 1), gg as (select *, score - lag(score) over (order by param) as ds, cost - lag(cost) over (order by param) as dc from r) select round(corr(param, score), 5) as corr_score, round(corr(param, cost), 5) as corr_cost, round(avg(ds), 6) as grad_mean, round(stddev_pop(ds), 6) as grad_std, round(max(ds), 6) as grad_max, round(min(ds), 6) as grad_min, count(*) filter (abs(round(ds, 9)) < 0.002e0) as n_stable, case when regr_slope(score, param) > 1e-6 then 'rising' when regr_slope(score, param) < -1e-6 then 'falling' else 'flat' end as trend from gg", *V))


def _weights(s: SparkSession, d: str) -> DataFrame:
    r = U.earned(alpha_picks(s, d), out(s, d)).groupBy("param").agg(F.avg("score").alias("score"), F.avg("cost").alias("cost"))
    g = r.withColumn("ds", F.expr("score - lag(score) over (order by param)"))  # one row per grid value
    slope = F.regr_slope("score", "param")
    out_ = g.agg(F.round(F.corr("param", "score"), 5).alias("corr_score"), F.round(F.corr("param", "cost"), 5).alias("corr_cost"), F.avg("ds").alias("grad_mean"), F.stddev_pop("ds").alias("grad_std"), F.max("ds").alias("grad_max"), F.min("ds").alias("grad_min"), F.count_if(F.abs(F.round("ds", 9)) < 0.002).alias("n_stable"), F.when(slope > 1e-6, "rising").when(slope < -1e-6, "falling").otherwise("flat").alias("trend"))
    return rounded(out_)


R.add("selection_costs", lambda s, d: rounded(picked(s, d).groupBy("dataset_id").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count("*").alias("n"))), oracle(PICKED + " select dataset_id, round(coalesce(sum(cost), 0), 6) as cost, count(*) as n from pk group by 1", *V))
R.add("em_cost_mean", lambda s, d: rounded(picked(s, d).agg(F.avg((F.col("score") == 1).cast("int")).alias("em"), F.avg("cost").alias("cost"))), oracle(PICKED + " select round(avg(case when score = 1 then 1 else 0 end), 6) as em, round(avg(cost), 6) as cost from pk", *V))
