"""Queries over outcome records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymark.operators import outcomes as O
from quaymark.plans.fixtures import oracle, view
from quaymark.plans.registry import Registry
from quaymark.sources.tables import load

R = Registry()
_STATS = "round(avg(score), 6) as avg_score, count(*) as n_records, cast(count(*) filter (score > 0) as bigint) as n_correct, round(sum(cost), 6) as total_cost, round(avg(cost), 6) as avg_cost, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens"


def rounded(df, *names, digits=6):
    """Doubles rounded at the very end, where values of two engines are compared."""
    todo = names or [c for c, t in df.dtypes if t == "double"]
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in todo else F.col(c) for c in df.columns])


for _name, _by in (("agg_group_stats", ["dataset_id", "split", "model_name"]), ("agg_by_model", ["model_name"]), ("agg_by_dataset", ["dataset_id"])):
    R.add(_name, lambda s, d, by=_by: rounded(O.group_stats(view(s, d, "sparse"), by)), oracle(f"select {', '.join(_by)}, {_STATS} from sparse group by all", "sparse"))

R.add(
    "agg_global",
    lambda s, d: rounded(O.global_stats(view(s, d, "sparse"))),
    oracle("select count(*) as n_records, count(distinct (dataset_id, split)) as n_datasets, count(distinct model_name) as n_models, count(distinct (dataset_id, split, record_index)) as n_prompts, round(sum(cost), 6) as total_cost, cast(sum(prompt_tokens + completion_tokens) as bigint) as total_tokens, string_agg(distinct model_name, ',' order by model_name) as models from sparse", "sparse"),
)
R.add("agg_macro_micro", lambda s, d: rounded(O.macro_micro(view(s, d, "sparse"))), oracle(", d as (select model_name, dataset_id, avg(score) as m, sum(score) as s, count(score) as n from sparse group by all) select model_name, round(avg(m), 6) as macro, round(sum(s) / sum(n), 6) as micro from d group by 1", "sparse"))

_DUP = ("prompt_id", "model_id", ["score", "cost_cents"])
_CONFLICT = ", cells as (select prompt_id, model_id, count(distinct (score, cost_cents)) as k, count(*) as n from raw_dups group by all)"
R.add("conflict_reject", lambda s, d: O.reject_conflicts(view(s, d, "raw_dups"), *_DUP), oracle(_CONFLICT + " select distinct prompt_id, model_id, score, cost_cents from raw_dups where prompt_id not in (select prompt_id from cells where k > 1)", "raw_dups"))
R.add("load_audit", lambda s, d: O.load_audit(view(s, d, "raw_dups"), *_DUP, n_models=4), oracle(_CONFLICT + ", p as (select prompt_id, sum(n) as n, max(k) as k, count(*) as m from cells group by 1) select cast(sum(n) as bigint) as raw_rows, count(*) filter (k = 1 and m = 4) as accepted, count(*) filter (k > 1) as rejected_conflict, count(*) filter (k = 1 and m <> 4) as rejected_incomplete from p", "raw_dups"))
R.add("complete_roster", lambda s, d: rounded(O.complete_roster(view(s, d, "sparse"), "prompt_key", "model_name", 5).select("prompt_key", "model_name", "score")), oracle("select prompt_key, model_name, round(score, 6) as score from sparse where prompt_key in (select prompt_key from sparse group by 1 having count(distinct model_name) = 5)", "sparse"))
R.add(
    "fill_missing",
    lambda s, d: rounded(O.fill_missing(view(s, d, "sparse"), view(s, d, "models").withColumnRenamed("model", "model_name"), ["prompt_key"], ["score", "cost"])),
    oracle("select p.prompt_key, m.model as model_name, round(coalesce(o.score, 0), 6) as score, round(coalesce(o.cost, 0), 6) as cost, o.score is null as filled from (select distinct prompt_key from sparse) p cross join models m left join sparse o on o.prompt_key = p.prompt_key and o.model_name = m.model", "sparse", "models"),
)
R.add("drop_dup_prompts", lambda s, d: load(s, d, "documents", "doc_id", "text").where("text is not null").groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "select min(doc_id) as doc_id from documents where text is not null group by text")

_ANY = ", p as (select dataset_id, split, record_index, max(case when score > 0 then 1 else 0 end) as hit, coalesce(min(case when score > 0 then cost end), min(cost)) as c from sparse group by all)"
R.add("oracle_accuracy", lambda s, d: rounded(O.oracle_any_correct(view(s, d, "sparse")).drop("oracle_cost")), oracle(_ANY + " select dataset_id, split, round(avg(hit), 6) as oracle_accuracy, count(*) as n_prompts from p group by all", "sparse"))
R.add("oracle_cost", lambda s, d: rounded(O.oracle_any_correct(view(s, d, "sparse")).drop("oracle_accuracy")), oracle(_ANY + " select dataset_id, split, round(sum(c), 6) as oracle_cost, count(*) as n_prompts from p group by all", "sparse"))
R.add("max_expert", lambda s, d: rounded(O.max_expert(view(s, d, "sparse"))), oracle(", g as (select dataset_id, split, model_name, avg(score) as a, sum(cost) as c, row_number() over (partition by dataset_id, split order by avg(score) desc, model_name) as rn from sparse group by dataset_id, split, model_name) select dataset_id, split, model_name as expert, round(a, 6) as expert_score, round(c, 6) as expert_cost from g where rn = 1", "sparse"))
R.add("oracle_max_cheapest", lambda s, d: rounded(O.best_then_cheapest(view(s, d, "outcomes"))), oracle(", r as (select *, row_number() over (partition by prompt_key order by score desc, cost, ord) as rn from outcomes) select prompt_key, model_name, round(score, 6) as score, round(cost, 6) as cost from r where rn = 1", "outcomes"))
_REF = """, s as (select model_name, avg(score) as score, avg(cost) as cost from outcomes group by 1),
b as (select * from (select *, row_number() over (partition by prompt_key order by score desc, cost, ord) as rn from outcomes) where rn = 1)
select 'single:' || model_name as name, round(score, 6) as score, round(cost, 6) as cost from s
union all (select 'best_single', round(score, 6), round(cost, 6) from s order by round(score, 9) desc, model_name desc limit 1)
union all (select 'cheapest', round(score, 6), round(cost, 6) from s order by round(cost, 9), model_name limit 1)
union all select 'random_mean', round(avg(score), 6), round(avg(cost), 6) from s
union all select 'oracle', round(avg(score), 6), round(avg(cost), 6) from b"""
R.add("references_singles", lambda s, d: rounded(O.reference_points(view(s, d, "outcomes"))), oracle(_REF, "outcomes"))


_DRAW = ", smp as (select dataset_id, split, record_index, arg_min(struct_pack(score := score, cost := cost), (sha256('42|' || dataset_id || '|' || split || '|' || record_index || '|' || model_name), model_name)) as x from sparse group by 1, 2, 3)"
_DOM = "case when dataset_id in ('ds8', 'ds9') then 'OOD' else 'In-Dist' end as domain"
_SUMMARY = oracle(
    _DRAW + f""", r as (select *, {_DOM} from sparse),
c as (select model_name as "row", dataset_id, domain, avg(score) as v, sum(score) as s, count(score) as n from r group by all
 union all select 'Oracle', dataset_id, domain, avg(hit), sum(hit), count(hit) from (select dataset_id, split, record_index, domain, max(case when score > 0 then 1 else 0 end) as hit from r group by all) group by 2, 3
 union all select 'Random Router', dataset_id, {_DOM}, avg(x.score), sum(x.score), count(x.score) from smp group by 2, 3),
m as (select "row", dataset_id as "column", v as value from c
 union all select "row", domain || '-Avg', avg(v) from c group by "row", domain
 union all select "row", domain || '-Sample-Avg', sum(s) / sum(n) from c group by "row", domain
 union all select "row", 'Dataset-Avg', avg(v) from c group by "row"
 union all select "row", 'All-Sample-Avg', sum(s) / sum(n) from c group by "row"),
o as (select * from m where "row" not in ('Oracle', 'Random Router'))
select "row", "column", round(value, 6) as value from (
 select * from m union all select 'AVG', "column", avg(value) from o group by 2
 union all select 'Max Expert', "column", max(value) from o where "column" <> 'Dataset-Avg' group by 2
 union all select 'Max Expert', 'Dataset-Avg', avg(x) from (select max(v) as x from c where "row" not in ('Oracle', 'Random Router') group by dataset_id))""",
    "sparse",
)
_COSTS = oracle(
    _DRAW + f""", r as (select *, {_DOM} from sparse),
q as (select model_name, dataset_id, domain, sum(cost) as v, round(avg(score), 9) as quality from r group by all),
c as (select model_name as "row", dataset_id, domain, v from q
 union all select 'Oracle', dataset_id, domain, sum(p) from (select dataset_id, split, record_index, domain, coalesce(min(case when score > 0 then cost end), min(cost)) as p from r group by all) group by 2, 3
 union all select 'Random Router', dataset_id, {_DOM}, sum(x.cost) from smp group by 2, 3
 union all select 'Max Expert', dataset_id, domain, v from (select *, row_number() over (partition by dataset_id order by quality desc, model_name) as rn from q) where rn = 1),
m as (select "row", dataset_id as "column", v as value from c
 union all select "row", domain || '-Avg', avg(v) from c group by "row", domain union all select "row", domain || '-Sum', sum(v) from c group by "row", domain
 union all select "row", 'Dataset-Avg', avg(v) from c group by "row" union all select "row", 'Dataset-Sum', sum(v) from c group by "row"),
o as (select * from m where "row" not in ('Oracle', 'Random Router', 'Max Expert'))
select "row", "column", round(value, 8) as value from (
 select * from m where not ("row" = 'Max Expert' and "column" like '%-Sum')
 union all select 'AVG', "column", avg(value) from o group by 2
 union all select 'Max Expert', "column", max(value) from o where "column" like '%-Sum' group by 2)""",
    "sparse",
)
R.add("summary_perf", lambda s, d: rounded(O.summary_table(view(s, d, "sparse"), ["ds8", "ds9"])), _SUMMARY)
R.add("summary_cost", lambda s, d: rounded(O.cost_table(view(s, d, "sparse"), ["ds8", "ds9"]), digits=8), _COSTS)
R.add("random_router", lambda s, d: rounded(O.random_router(view(s, d, "sparse"))), oracle(_DRAW + " select dataset_id, split, round(avg(x.score), 6) as score, round(sum(x.cost), 6) as total_cost, round(avg(x.cost), 6) as avg_cost, count(*) as n_prompts from smp group by 1, 2", "sparse"))
R.add("sample_avg", lambda s, d: O.summary_table(view(s, d, "sparse"), ["ds8", "ds9"]).where("column like '%Sample-Avg'").select("row", "column", F.round("value", 6).alias("value")), f"select * from ({_SUMMARY}) where \"column\" like '%Sample-Avg'")
_DS = [f"ds{i}" for i in range(10)]
R.add("agg_pivot_label", lambda s, d: rounded(O.pivot_models(view(s, d, "sparse"), _DS)), oracle("select model_name, " + ", ".join(f"round(avg(score) filter (dataset_id = '{x}'), 6) as {x}" for x in _DS) + ', round(avg(score), 6) as "ALL", round(avg(cost) * 1000, 6) as cost_per_1k, quantile_cont(completion_tokens, 0.5) as median_tokens, round(avg(completion_tokens), 6) as mean_tokens from sparse group by 1', "sparse"))
R.add("agg_extra_metrics", lambda s, d: rounded(O.metric_means(view(s, d, "outcomes").withColumn("m", F.create_map(F.lit("score"), "score", F.lit("cost"), F.when(F.col("ord") > 0, F.col("cost")), F.lit("seconds"), F.col("score") - 0.5, F.lit("none"), F.col("score") - 2)), "m", ["seconds", "none"])), oracle("select 'score' as metric, round(avg(score), 6) as mean, count(score) as n from outcomes union all select 'cost', round(avg(cost), 6), count(cost) from outcomes where ord > 0 union all select 'seconds', round(avg(score - 0.5e0) filter (score > 0.5), 6), count(*) from outcomes union all select 'none', -1, count(*) from outcomes", "outcomes"))
_LINES = "case event_id % 9 when 0 then null when 1 then 'x' else cast(event_id as varchar(20)) end as prompt_tokens, case event_id % 8 when 1 then 'much' when 2 then null else '0.5' end as cost"
R.add("parse_strict", lambda s, d: O.parse_audit(O.parse_strict(load(s, d, "events", "event_id").selectExpr("event_id", *[x + " as " + y for x, y in (("case event_id % 9 when 0 then null when 1 then 'x' else cast(event_id as string) end", "prompt_tokens"), ("case event_id % 8 when 1 then 'much' when 2 then null else '0.5' end", "cost"))]), {"prompt_tokens": "long", "cost": "double"}, ["prompt_tokens"])), f"with l as (select {_LINES} from events) select case when prompt_tokens is null or try_cast(prompt_tokens as bigint) is null then 'prompt_tokens' when cost is not null and try_cast(cost as double) is null then 'cost' end as problem, count(*) as n from l group by 1")
R.add("agg_baseline_scores", lambda s, d: O.baseline_scores(view(s, d, "sparse")), oracle("select model_name, dataset_id, round(100 * avg(score), 2) as score from sparse group by all", "sparse"))
R.add("agg_cost_efficiency", lambda s, d: rounded(O.cost_efficiency(view(s, d, "sparse")), digits=4), oracle(", p as (select dataset_id, model_name, avg(score) as accuracy, avg(cost) as avg_cost from sparse group by all), b as (select p.dataset_id, p.model_name, 100.0e0 * count(*) filter (s.cost < p.avg_cost) / count(*) as x from p join sparse s using (dataset_id) group by all) select dataset_id, model_name, round(accuracy, 4) as accuracy, round(avg_cost, 4) as avg_cost, round(x, 4) as cost_percentile, round(accuracy / (avg_cost + 1e-8), 4) as efficiency from p join b using (dataset_id, model_name)", "sparse"))
R.add("agg_latency_stats", lambda s, d: rounded(O.latency_stats(load(s, d, "request_telemetry", "span_type", "upstream_latency_ms"), "upstream_latency_ms", ["span_type"])), "select span_type, count(*) filter (upstream_latency_ms > 0) as n, round(avg(upstream_latency_ms) filter (upstream_latency_ms > 0), 6) as mean, round(quantile_cont(upstream_latency_ms, 0.5) filter (upstream_latency_ms > 0), 6) as p50, round(quantile_cont(upstream_latency_ms, 0.95) filter (upstream_latency_ms > 0), 6) as p95, round(quantile_cont(upstream_latency_ms, 0.99) filter (upstream_latency_ms > 0), 6) as p99, round(count(*) filter (upstream_latency_ms is null or upstream_latency_ms <= 0) / count(*), 6) as missing_share from request_telemetry group by 1")
R.add("agg_run_totals", lambda s, d: rounded(view(s, d, "sparse").groupBy("dataset_id").agg(F.avg("score").alias("performance"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").alias("cost"))), oracle("select dataset_id, round(avg(score), 6) as performance, cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens, round(sum(cost), 6) as cost from sparse group by 1", "sparse"))
R.add("agg_rollup", lambda s, d: rounded(view(s, d, "sparse").groupingSets([["dataset_id", "model_name"], ["dataset_id"], []], "dataset_id", "model_name").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))), oracle("select dataset_id, model_name, round(avg(score), 6) as mean, count(*) as n from sparse group by grouping sets ((dataset_id, model_name), (dataset_id), ())", "sparse"))
