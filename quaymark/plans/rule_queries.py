"""Queries over estimates, decision rules and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators import matrix as M
from quaymark.operators import outcomes as O
from quaymark.operators import policies as Y
from quaymark.operators import rules as U
from quaymark.operators.joins import small
from quaymark.plans.fixtures import oracle, view
from quaymark.plans.outcome_queries import rounded
from quaymark.plans.registry import Registry
from quaymark.sources.tables import load

R = Registry()
P, TEMP = 3, 0.1


def out(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "outcomes")


def cost_norm(s: SparkSession, d: str) -> DataFrame:
    return out(s, d).groupBy("model_name").agg(F.avg("cost").alias("c")).withColumn("c_norm", M.minmax("c")).select("model_name", "c_norm")


def near(s: SparkSession, d: str) -> DataFrame:
    sims = M.centroid_similarities(view(s, d, "vectors"), view(s, d, "centroids"), "vec_id", "embedding")
    return M.softmax_weights(M.top_p(sims, "vec_id", P), "sim", ["vec_id"], TEMP).select("vec_id", "cluster_id", "sim", "rank", "weight")


def means(s: SparkSession, d: str) -> DataFrame:
    labels = view(s, d, "vectors").select("vec_id", F.col("label").alias("cluster_id"))
    return M.cluster_means(out(s, d).join(labels, F.col("record_index") == F.col("vec_id")))


def estimates(s: SparkSession, d: str) -> DataFrame:
    return M.score_blend(near(s, d), means(s, d), "vec_id").withColumn("prompt_key", F.concat(F.lit("p"), F.col("vec_id").cast("string"))).select("prompt_key", "model_name", "value")


def alpha_picks(s: SparkSession, d: str) -> DataFrame:
    return U.alpha_sweep(estimates(s, d), cost_norm(s, d), "prompt_key")


def alpha_frontier(s: SparkSession, d: str) -> DataFrame:
    r = out(s, d)
    return U.frontier(U.earned(alpha_picks(s, d), r), O.reference_points(r))


# DuckDB chains
NEAR = f""", near0 as (select * from (select *, row_number() over (partition by vec_id order by sim desc, cluster_id) as rank from sims) where rank <= {P}),
near1 as (select *, exp((sim - max(sim) over (partition by vec_id)) / {TEMP}e0) as e from near0),
near as (select vec_id, cluster_id, sim, rank, e / sum(e) over (partition by vec_id) as weight from near1),
means as (select v.label as cluster_id, o.model_name, avg(o.score) as mean, count(*) as n from outcomes o join vectors v on v.vec_id = o.record_index group by all)"""
EST = NEAR + """, est as (select 'p' || n.vec_id as prompt_key, m.model_name, sum(n.weight * m.mean) as value from near n join means m using (cluster_id) group by all),
cn0 as (select model_name, avg(cost) as c from outcomes group by 1), cn as (select model_name, (c - min(c) over ()) / (max(c) over () - min(c) over ()) as c_norm, c from cn0)"""
MINMAX = "coalesce((value - min(value) over (partition by prompt_key)) / nullif(max(value) over (partition by prompt_key) - min(value) over (partition by prompt_key), 0), 0)"
PICKS = EST + f""", g as (select i / 20.0e0 as param from range(21) t(i)), q as (select *, {MINMAX} as q from est),
sc as (select prompt_key, param, q.model_name, param * q + (1 - param) * (1 - c_norm) as value from q join cn using (model_name) cross join g),
picks as (select prompt_key, param, model_name from (select *, row_number() over (partition by prompt_key, param order by round(value, 9) desc, model_name) as rn from sc) where rn = 1)"""
V = ("outcomes", "sims")
REFS = """, sg as (select model_name, avg(score) as score, avg(cost) as cost from outcomes group by 1),
bst as (select * from (select *, row_number() over (partition by prompt_key order by score desc, cost, ord) as rn from outcomes) where rn = 1),
ref as (select (select score from sg order by round(cost, 9), model_name limit 1) as cheap, (select avg(score) from bst) as orc)"""
FRONT = PICKS + REFS + """, er as (select p.param, o.score, o.cost, o.model_name from picks p join outcomes o using (prompt_key, model_name)),
fr as (select param, avg(score) as score, avg(cost) as cost, count(distinct model_name) as n_models from er group by 1)"""

R.add("zscore_prompt", lambda s, d: rounded(out(s, d).withColumn("z", M.zscore("score", ["prompt_key"])).select("prompt_key", "model_name", "z")), oracle("select prompt_key, model_name, round(coalesce((score - avg(score) over w) / nullif(stddev_pop(score) over w, 0), 0), 6) as z from outcomes window w as (partition by prompt_key)", "outcomes"))
R.add("zscore_clip01", lambda s, d: rounded(out(s, d).withColumn("z", M.clip01(M.zscore("score", ["prompt_key"]))).select("prompt_key", "model_name", "z")), oracle("select prompt_key, model_name, round((greatest(-3, least(3, coalesce((score - avg(score) over w) / nullif(stddev_pop(score) over w, 0), 0))) + 3) / 6, 6) as z from outcomes window w as (partition by prompt_key)", "outcomes"))
R.add("minmax_prompt", lambda s, d: rounded(out(s, d).withColumn("q", M.minmax("score", ["prompt_key"])).select("prompt_key", "model_name", "q")), oracle("select prompt_key, model_name, round(coalesce((score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0), 0), 6) as q from outcomes window w as (partition by prompt_key)", "outcomes"))
R.add("minmax_task_cost", lambda s, d: rounded(out(s, d).withColumn("c", M.minmax("cost", ["dataset_id"])).select("prompt_key", "model_name", "c")), oracle("select prompt_key, model_name, round(coalesce((cost - min(cost) over w) / nullif(max(cost) over w - min(cost) over w, 0), 0), 6) as c from outcomes window w as (partition by dataset_id)", "outcomes"))
R.add("minmax_models", lambda s, d: rounded(cost_norm(s, d)), oracle(", c as (select model_name, avg(cost) as c from outcomes group by 1) select model_name, round((c - min(c) over ()) / (max(c) over () - min(c) over ()), 6) as c_norm from c", "outcomes"))
R.add(
    "shrink_eb",
    lambda s, d: rounded(means(s, d).join(small(out(s, d).groupBy("model_name").agg(F.avg("score").alias("g"))), "model_name").select("cluster_id", "model_name", M.shrink(F.col("mean"), F.col("n"), F.col("g"), 20.0).alias("shrunk"))),
    oracle(NEAR + ", g as (select model_name, avg(score) as g from outcomes group by 1) select cluster_id, model_name, round((n * mean + 20 * g) / (n + 20), 6) as shrunk from means join g using (model_name)", *V),
)
R.add("neff_kish", lambda s, d: rounded(near(s, d).groupBy("vec_id").agg(M.kish("weight").alias("n_eff"))), oracle(NEAR + " select vec_id, round(pow(sum(weight), 2) / sum(weight * weight), 6) as n_eff from near group by 1", *V))
R.add("l2_normalize", lambda s, d: rounded(view(s, d, "vectors").select("vec_id", M.dot(M.l2_normalize(F.transform("embedding", lambda x: x * 3)), F.col("embedding")).alias("x")), digits=4), oracle("select vec_id, round(list_dot_product(list_transform(embedding, lambda x: cast(x as double) * 3), cast(embedding as double[])) / sqrt(list_dot_product(list_transform(embedding, lambda x: cast(x as double) * 3), list_transform(embedding, lambda x: cast(x as double) * 3))), 4) as x from vectors", "vectors"))
R.add("cosine", lambda s, d: M.centroid_similarities(view(s, d, "vectors"), view(s, d, "centroids"), "vec_id", "embedding").select("vec_id", "cluster_id", "sim"), oracle("select vec_id, cluster_id, sim from sims", "sims"))
R.add("topp_clusters", lambda s, d: near(s, d).groupBy("vec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("cluster_id")), lambda x: x.cast("string")), ",").alias("clusters")), oracle(NEAR + " select vec_id, string_agg(cast(cluster_id as varchar), ',' order by cluster_id) as clusters from near group by 1", *V))
R.add("softmax_weights", lambda s, d: rounded(near(s, d).select("vec_id", "cluster_id", "weight"), digits=5), oracle(NEAR + " select vec_id, cluster_id, round(weight, 5) as weight from near", *V))
R.add("agg_cluster_means", lambda s, d: rounded(means(s, d)), oracle(NEAR + " select cluster_id, model_name, round(mean, 6) as mean, n from means", *V))
R.add("agg_cluster_rankings", lambda s, d: rounded(M.cluster_rankings(means(s, d)).withColumn("rank", F.col("rank").cast("long"))), oracle(NEAR + " select cluster_id, model_name, round(mean, 6) as mean, n, row_number() over (partition by cluster_id order by mean desc, model_name) as rank from means", *V))
R.add("rank_score", lambda s, d: rounded(M.rank_score(near(s, d), M.cluster_rankings(means(s, d)), "vec_id"), digits=5), oracle(NEAR + ", rk as (select *, row_number() over (partition by cluster_id order by mean desc, model_name) as r from means) select vec_id, model_name, round(sum(weight / r), 5) as value from near join rk using (cluster_id) group by all", *V))
R.add("score_blend", lambda s, d: rounded(estimates(s, d), digits=5), oracle(EST + " select prompt_key, model_name, round(value, 5) as value from est", *V))
R.add(
    "blend_alpha",
    lambda s, d: rounded(M.blend_alpha(near(s, d), means(s, d).withColumn("mean", F.round("mean", 9)).withColumn("q_norm", M.minmax("mean", ["cluster_id"])), cost_norm(s, d), "vec_id", 0.6), digits=5),
    oracle(EST + ", rm as (select cluster_id, model_name, round(mean, 9) as mean from means), q as (select *, coalesce((mean - min(mean) over w) / nullif(max(mean) over w - min(mean) over w, 0), 0) as q_norm from rm window w as (partition by cluster_id)) select vec_id, model_name, round(sum(0.6e0 * q_norm + 0.4e0 * (1 - c_norm)), 5) + 0 as value from near join q using (cluster_id) join cn using (model_name) group by all", *V),
)
R.add("argmax_first", lambda s, d: M.argmax_first(estimates(s, d), ["prompt_key"], digits=6).select("prompt_key", "model_name"), oracle(EST + " select prompt_key, model_name from (select *, row_number() over (partition by prompt_key order by round(value, 6) desc, model_name) as rn from est) where rn = 1", *V))
R.add("runner_up", lambda s, d: M.runner_up(estimates(s, d), ["prompt_key"], digits=6).select("prompt_key", "model_name"), oracle(EST + " select prompt_key, model_name from (select *, row_number() over (partition by prompt_key order by round(value, 6) desc, model_name) as rn from est) where rn = 2", *V))
R.add("rule_alpha_sweep", alpha_picks, oracle(PICKS + " select prompt_key, param, model_name from picks", *V))
LAMBDAS = (0.0, 1.0, 5.0, 20.0, 50.0, 100.0)
R.add(
    "rule_dollar_ev_sweep",
    lambda s, d: U.dollar_sweep(estimates(s, d), out(s, d).groupBy("model_name").agg(F.avg("cost").alias("cost_hat")), "prompt_key", LAMBDAS),
    oracle(EST + f", g as (select unnest({list(LAMBDAS)}::double[]) as param), sc as (select prompt_key, param, model_name, value - param * c as value from est join cn using (model_name) cross join g) select prompt_key, param, model_name from (select *, row_number() over (partition by prompt_key, param order by round(value, 9) desc, model_name) as rn from sc) where rn = 1", *V),
)
R.add("frontier_sweep", lambda s, d: rounded(alpha_frontier(s, d)), oracle(FRONT + " select round(param, 6) as param, round(score, 6) as score, round(cost, 6) as cost, n_models, round((score - cheap) / (orc - cheap), 6) + 0 as gap_recovered from fr cross join ref", *V))
R.add("quality_at_cost", lambda s, d: rounded(U.quality_at_cost(alpha_frontier(s, d), [0.0, 0.003, 0.006, 0.012, 1.0])), oracle(FRONT + " select b as budget, round(max(case when cost <= b then score end), 6) as score from fr cross join (select unnest([0.0, 0.003, 0.006, 0.012, 1.0]::double[]) as b) group by 1", *V))


def _parity(s: SparkSession, d: str) -> DataFrame:
    return rounded(U.parity_cost(alpha_frontier(s, d), O.reference_points(out(s, d)).where("name = 'best_single'"), 0.2))


R.add("parity_cost", _parity, oracle(FRONT + ", b as (select score, cost from sg order by round(score, 9) desc, model_name desc limit 1), p as (select min(case when fr.score >= b.score - 0.2e0 then fr.cost end) as c, any_value(b.cost) as bc from fr cross join b) select round(c, 6) as parity_cost, round(1 - c / bc, 6) as saving from p", *V))
R.add("pareto", lambda s, d: rounded(U.pareto(alpha_frontier(s, d).select("param", F.round("score", 6).alias("score"), F.round("cost", 6).alias("cost")))), oracle(FRONT + ", r as (select param, round(score, 6) as score, round(cost, 6) as cost from fr) select round(param, 6) as param, score, cost from r a where not exists (select 1 from r b where b.score >= a.score and b.cost <= a.cost and (b.score > a.score or b.cost < a.cost))", *V))
R.add("frontier_area", lambda s, d: rounded(U.frontier_area(alpha_frontier(s, d).select("param", F.round("score", 6).alias("score"), F.round("cost", 6).alias("cost"))), digits=5), oracle(FRONT + ", r as (select round(score, 6) as score, round(cost, 6) as cost from fr), nd as (select cost, max(score) as score from r a where not exists (select 1 from r b where b.score >= a.score and b.cost <= a.cost and (b.score > a.score or b.cost < a.cost)) group by 1), x as (select score, (cost - min(cost) over ()) / nullif(max(cost) over () - min(cost) over (), 0) as x from nd), t as (select (x - lag(x) over (order by x)) * (score + lag(score) over (order by x)) / 2 as a from x) select round(coalesce(sum(a), 0), 5) as area from t", *V))
UTIL = ", u as (select prompt_key, model_name, 0.7e0 * coalesce((score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0), 0) + 0.3e0 * (1 - coalesce((cost - min(cost) over w) / nullif(max(cost) over w - min(cost) over w, 0), 0)) as utility from outcomes window w as (partition by prompt_key))"
R.add("regret_norm", lambda s, d: rounded(U.regret(alpha_picks(s, d), out(s, d), 0.7).groupBy("param").agg(F.avg("regret").alias("regret"))), oracle(PICKS + UTIL + ", b as (select *, max(utility) over (partition by prompt_key) as best from u) select round(param, 6) as param, round(avg(best - utility), 6) as regret from picks join b using (prompt_key, model_name) group by 1", *V))
R.add("oracle_utility", lambda s, d: M.argmax_first(U.utility(out(s, d), 0.7), ["prompt_key"], "utility", digits=7).select("prompt_key", "model_name"), oracle(UTIL + " select prompt_key, model_name from (select *, row_number() over (partition by prompt_key order by round(utility, 7) desc, model_name) as rn from u) where rn = 1", "outcomes"))
R.add("agg_entropy", lambda s, d: rounded(U.entropy(alpha_picks(s, d), ["param"], 5)), oracle(PICKS + ", n as (select param, model_name, count(*) as n from picks group by all), p as (select param, n / sum(n) over (partition by param) as p from n) select round(param, 6) as param, round(-sum(p * ln(p)) / ln(5), 6) + 0 as entropy from p group by 1", *V))
R.add("cost_ols", lambda s, d: rounded(U.cost_fit(out(s, d), "prompt_tokens"), digits=8), oracle("select model_name, round(regr_slope(cost, prompt_tokens), 8) as slope, round(regr_intercept(cost, prompt_tokens), 8) as intercept, round(greatest(quantile_cont(cost, 0.1), 1e-7), 8) as floor from outcomes group by 1", "outcomes"))
MIX = ", n as (select param, model_name, count(*) as n from picks group by all), m as (select param, string_agg(model_name || ':' || n, ',' order by model_name || ':' || n) as mix from n group by 1)"
R.add("dial_breakpoints", lambda s, d: rounded(U.breakpoints(alpha_picks(s, d), "prompt_key")), oracle(PICKS + MIX + ", l as (select *, lag(mix) over (order by param) as prev, max(param) over () as last from m) select round(param, 6) as param, mix from l where prev is null or prev <> mix or param = last", *V))
R.add("routing_distribution", lambda s, d: rounded(U.with_projected_cost(U.distribution(alpha_picks(s, d)), out(s, d).groupBy("model_name").agg(F.avg("cost").alias("cost_hat")))), oracle(PICKS + ", n as (select param, model_name, count(*) as n from picks group by all), sh as (select *, n / sum(n) over (partition by param) as share from n) select round(param, 6) as param, model_name, n, round(share, 6) as share, round(sum(share * c) over (partition by param), 6) as projected_cost from sh join cn using (model_name)", *V))


def _centroid_picks(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "centroids").select(F.col("cluster_id").alias("vec_id"), F.col("centroid").alias("embedding"))
    near_c = M.softmax_weights(M.top_p(M.centroid_similarities(c, view(s, d, "centroids"), "vec_id", "embedding"), "vec_id", P), "sim", ["vec_id"], TEMP)
    return U.alpha_sweep(M.score_blend(near_c.select("vec_id", "cluster_id", "sim", "rank", "weight"), means(s, d), "vec_id"), cost_norm(s, d), "vec_id")


R.add("routing_by_centroid", lambda s, d: rounded(U.distribution(_centroid_picks(s, d))), oracle(NEAR + f""", cs as (select a.cluster_id as vec_id, b.cluster_id, round(list_dot_product(a.centroid, b.centroid) / sqrt(list_dot_product(b.centroid, b.centroid)), 6) as sim from centroids a cross join centroids b),
c0 as (select * from (select *, row_number() over (partition by vec_id order by sim desc, cluster_id) as rank from cs) where rank <= {P}), c1 as (select *, exp((sim - max(sim) over (partition by vec_id)) / {TEMP}e0) as e from c0), c2 as (select *, e / sum(e) over (partition by vec_id) as weight from c1),
est as (select vec_id as prompt_key, m.model_name, sum(weight * m.mean) as value from c2 join means m using (cluster_id) group by all),
cn0 as (select model_name, avg(cost) as c from outcomes group by 1), cn as (select model_name, (c - min(c) over ()) / (max(c) over () - min(c) over ()) as c_norm, c from cn0), g as (select i / 20.0e0 as param from range(21) t(i)), q as (select *, {MINMAX} as q from est),
sc as (select prompt_key, param, q.model_name, param * q + (1 - param) * (1 - c_norm) as value from q join cn using (model_name) cross join g),
picks as (select prompt_key, param, model_name from (select *, row_number() over (partition by prompt_key, param order by round(value, 9) desc, model_name) as rn from sc) where rn = 1),
n as (select param, model_name, count(*) as n from picks group by all) select round(param, 6) as param, model_name, n, round(n / sum(n) over (partition by param), 6) as share from n""", *V))
R.add("winner_segments", lambda s, d: rounded(U.winner_segments(alpha_picks(s, d), "prompt_key")), oracle(PICKS + ", l as (select *, coalesce(cast(lag(model_name) over w <> model_name as int), 0) as new from picks window w as (partition by prompt_key order by param)), sg as (select *, cast(sum(new) over (partition by prompt_key order by param) as bigint) as segment from l) select prompt_key, segment, model_name, round(min(param), 6) as lo, round(max(param), 6) as hi from sg group by all", *V))
R.add("threshold_cascade", lambda s, d: U.threshold_cascade(out(s, d).withColumn("distance", 1 - F.col("score")), "prompt_key", "ord", "distance", {0: 0.15, 1: 0.35, 2: 0.55}), oracle(", c as (select prompt_key, arg_min(model_name, ord) filter (1 - score < case ord when 0 then 0.15e0 when 1 then 0.35e0 when 2 then 0.55e0 else 'inf'::double end) as a, arg_max(model_name, ord) as l from outcomes group by 1) select prompt_key, coalesce(a, l) as model_name from c", "outcomes"))
R.add("explore_band", lambda s, d: rounded(U.explore_band(estimates(s, d), "prompt_key", 0.05).select("prompt_key", "model_name", "propensity")), oracle(EST + ", b as (select *, round(max(value) over (partition by prompt_key), 9) as best from est) select prompt_key, model_name, round(1 / count(*) over (partition by prompt_key), 6) as propensity from b where round(value, 9) >= best - 0.05e0", *V))
R.add("confidence_gate", lambda s, d: rounded(U.confidence_gate(near(s, d), "vec_id"), "confidence", digits=5), oracle(NEAR + ", c as (select vec_id, 0.6e0 * max(sim) + 0.4e0 / (1 + avg(1 - sim)) as confidence from near group by 1), q as (select quantile_cont(confidence, 0.25) as cut from c) select vec_id, round(confidence, 5) as confidence, round(confidence, 9) < round(cut, 9) as low from c cross join q", *V))
R.add("balance_score", lambda s, d: rounded(U.balance_score(O.cost_efficiency(out(s, d)).select("dataset_id", "model_name", "accuracy", "avg_cost"), "dataset_id", 0.7, 0.3, 0.3)), oracle(", p as (select dataset_id, model_name, avg(score) as accuracy, avg(cost) as avg_cost from outcomes group by all) select dataset_id, model_name, round(accuracy, 6) as accuracy, round(avg_cost, 6) as avg_cost, round(case when accuracy < 0.3e0 then 0 else 0.7e0 * coalesce((accuracy - min(accuracy) over w) / nullif(max(accuracy) over w - min(accuracy) over w, 0), 1) + 0.3e0 * (1 - avg_cost / max(avg_cost) over w) end, 6) as balance from p window w as (partition by dataset_id)", "outcomes"))
R.add("eval_selection", lambda s, d: rounded(U.first_rank(alpha_picks(s, d).where("param = 0.5"), out(s, d), "prompt_key")), oracle(PICKS + ", r as (select *, row_number() over (partition by prompt_key order by score desc, model_name) - 1 as rank, max(score) over (partition by prompt_key) as best from outcomes) select count(*) as n, round(avg(rank), 6) as mean_rank, round(count(*) filter (rank = 0) / count(*), 6) as share_best, round(avg(score), 6) as selected, round(avg(best), 6) as oracle from picks join r using (prompt_key, model_name) where param = 0.5", *V))
PAIR = ", pr as (select a.prompt_key, a.dataset_id, a.score as score_a, a.cost as cost_a, b.score as score_b, b.cost as cost_b, case when a.score > b.score then 'model_a' when a.score < b.score then 'model_b' else 'tie' end as winner from sparse a join sparse b using (prompt_key) where a.model_name = 'EUROPE' and b.model_name = 'AFRICA')"
R.add("adapt_routellm", lambda s, d: rounded(U.paired_outcomes(view(s, d, "sparse"), "EUROPE", "AFRICA")), oracle(PAIR + " select prompt_key, dataset_id, round(score_a, 6) as score_a, round(cost_a, 6) as cost_a, round(score_b, 6) as score_b, round(cost_b, 6) as cost_b, winner from pr", "sparse"))
R.add("agg_pair_eval", lambda s, d: rounded(U.pair_evaluation(U.paired_outcomes(view(s, d, "sparse"), "EUROPE", "AFRICA"), ["ds8", "ds9"])), oracle(PAIR + """, g as (select dataset_id, count(*) as n, count(*) filter (winner = 'tie') as ties, count(*) filter (winner = 'model_a') as wins, sum(cost_a) as ca, sum(cost_b) as cb from pr group by 1), w as (select *, wins / nullif(n - ties, 0) as r, dataset_id in ('ds8', 'ds9') as ood from g)
select cast(sum(n) as bigint) as n, cast(sum(ties) as bigint) as ties, cast(sum(n - ties) as bigint) as decisive, cast(sum(wins) as bigint) as wins, round(avg(r), 6) as win_rate_mean, round(stddev_pop(r), 6) as win_rate_std, round(avg(r) filter (not ood), 6) as in_domain, round(avg(r) filter (ood), 6) as out_of_domain, round(sum(ca), 6) as cost_a, round(sum(cb), 6) as cost_b from w""", "sparse"))
KNN = ", ab as (select a.vec_id as query, b.vec_id as neighbour, round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[])) * list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[]))), 6) as sim from vectors a join vectors b on a.vec_id <> b.vec_id), kn as (select * from (select *, row_number() over (partition by query order by sim desc, neighbour) as rank from ab) where rank <= 10)"
R.add("join_vec_vec_knn", lambda s, d: M.nearest(view(s, d, "vectors"), view(s, d, "vectors"), "vec_id", "embedding", 10).select("query", "neighbour", "sim"), oracle(KNN + " select query, neighbour, sim from kn", "vectors"))
R.add("est_knn", lambda s, d: rounded(M.nearest(view(s, d, "vectors"), view(s, d, "vectors"), "vec_id", "embedding", 10).join(out(s, d), F.col("neighbour") == F.col("record_index")).groupBy("query", "model_name").agg(F.avg("score").alias("estimate"))), oracle(KNN + " select query, model_name, round(avg(score), 6) as estimate from kn join outcomes o on o.record_index = kn.neighbour group by all", "vectors", "outcomes"))
R.add("est_knn_classifier", lambda s, d: M.nearest(view(s, d, "vectors"), view(s, d, "vectors"), "vec_id", "embedding", 10).join(view(s, d, "vectors").select(F.col("vec_id").alias("neighbour"), "label"), "neighbour").groupBy("query", "label").count().groupBy("query").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("label")), oracle(KNN + ", c as (select query, label, count(*) as n from kn join vectors v on v.vec_id = kn.neighbour group by all) select query, label from (select *, row_number() over (partition by query order by n desc, label) as rn from c) where rn = 1", "vectors"))
R.add("cascade_result", lambda s, d: rounded(U.cascade_result(U.threshold_cascade(out(s, d).withColumn("distance", 1 - F.col("score")), "prompt_key", "ord", "distance", {0: 0.15, 1: 0.35, 2: 0.55}), out(s, d), 0.02)), oracle(", c as (select prompt_key, coalesce(arg_min(model_name, ord) filter (1 - score < case ord when 0 then 0.15e0 when 1 then 0.35e0 when 2 then 0.55e0 else 'inf'::double end), arg_max(model_name, ord)) as model_name from outcomes group by 1), r as (select avg(score) as accuracy, sum(cost) as total, count(*) as n from c join outcomes using (prompt_key, model_name)) select round(accuracy, 6) as accuracy, case when total > 0.02e0 * n then 'inf'::double else round(total, 6) end as cost, total > 0.02e0 * n as over_budget from r", "outcomes"))
_STEPS = [0.1, 0.3, 0.5, 0.7, 0.9]
R.add(
    "cascade_search",
    lambda s, d: rounded(U.cascade_search(out(s, d).withColumn("distance", F.round(1 - F.col("score"), 6)), "prompt_key", _STEPS, 0.006)),
    oracle(f""", w as (select prompt_key, max(round(1 - score, 6)) filter (ord = 0) as d0, max(round(1 - score, 6)) filter (ord = 1) as d1, max(score) filter (ord = 0) as s0, max(score) filter (ord = 1) as s1, max(score) filter (ord = 2) as s2, max(cost) filter (ord = 0) as c0, max(cost) filter (ord = 1) as c1, max(cost) filter (ord = 2) as c2 from outcomes where ord < 3 group by 1),
q as (select i, [{', '.join(f'{1 - x}e0' for x in _STEPS)}][i + 1] as p from range({len(_STEPS)}) t(i)),
f as (select i, (select quantile_cont(d0, [{', '.join(f'{1 - x}e0' for x in _STEPS)}]) from w)[i + 1] as t1 from q),
g as (select f.i, f.t1, quantile_cont(d1, [{', '.join(f'{1 - x}e0' for x in _STEPS)}]) as ts from f join w on w.d0 >= f.t1 group by 1, 2),
h as (select g.i, g.t1, q.i as j, ts[q.i + 1] as t2 from g cross join q),
r as (select h.i, h.j, t1, t2, avg(case when d0 < t1 then s0 when d1 < t2 then s1 else s2 end) as accuracy, sum(case when d0 < t1 then c0 when d1 < t2 then c1 else c2 end) as cost, count(*) as n from h cross join w group by 1, 2, 3, 4)
select i, j, round(t1, 6) as t1, round(t2, 6) as t2, round(accuracy, 6) as accuracy, round(cost, 6) as cost, row_number() over (order by cost <= 0.006e0 * n desc, round(accuracy, 9) desc, round(cost, 9), i, j) as place from r""", "outcomes"),
)


def axes(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "models").select(F.col("model").alias("model_name"), "ord", F.col("input_per_1k").alias("input_per_1k_usd"), F.col("output_per_1k").alias("output_per_1k_usd"), (20.0 + 10 * F.col("ord")).alias("tps"), F.when(F.col("ord") != 3, 0.5 + F.col("ord") / 10).alias("ttft_s"), F.when(F.col("ord") != 2, 100.0 + 50 * F.col("ord")).alias("verbosity_tokens"))


_AXES = """, ax0 as (select model as model_name, ord, coalesce(case when ord <> 2 then 100.0e0 + 50 * ord end, null) as vb, input_per_1k, output_per_1k, case when ord <> 3 then 0.5e0 + ord / 10 end + 400.0e0 / (20.0e0 + 10 * ord) as t from models),
ax1 as (select *, input_per_1k + 2.0e0 * output_per_1k * coalesce(vb / (select quantile_cont(vb, 0.5) from ax0), 1) as c from ax0),
ax as (select model_name, ord, (c - min(c) over ()) / (max(c) over () - min(c) over ()) as cn, coalesce((t - min(t) over ()) / (max(t) over () - min(t) over ()), 1) as tn from ax1),
qn as (select cluster_id, model_name, coalesce((mean - min(mean) over w) / nullif(max(mean) over w - min(mean) over w, 0), 0) as q from (select cluster_id, model_name, round(mean, 9) as mean from means) window w as (partition by cluster_id))"""
for _n, _speed, _blend in (("blend_v2", 0.2, "al * q + (1 - al - 0.2e0) * (1 - cn) + 0.2e0 * (1 - tn)"), ("blend_v2_no_speed", 0.0, "al * q + (1 - al) * (1 - cn)")):
    R.add(
        _n,
        lambda s, d, w=_speed: rounded(U.blend_models(near(s, d), means(s, d).withColumn("mean", F.round("mean", 9)), axes(s, d), "vec_id", 0.3 + 0.05 * F.col("cluster_id"), F.col("ord") != 1, w, 2.0, 400, True, U.preference_bonus(F.col("ord") - 3)), digits=5),
        oracle(NEAR + _AXES + f" select vec_id, model_name, round(sum({_blend} + case ord when 3 then 0.15e0 when 4 then 0.15e0 * 0.55e0 else 0 end), 5) as value from (select n.vec_id, qn.*, cn, tn, ord, 0.3e0 + 0.05e0 * n.cluster_id as al from near n join qn using (cluster_id) join ax using (model_name) where ord <> 1) group by 1, 2", *V, "models"),
    )
R.add("cost_price", lambda s, d: rounded(load(s, d, "documents", "doc_id", "text").where("text is not null").crossJoin(small(view(s, d, "models"))).select("doc_id", "model", U.price_of(F.col("text"), F.col("input_per_1k"), F.col("output_per_1k")).alias("usd"))), oracle(" select doc_id, model, round((length(text) / 3.5e0 * input_per_1k + 512 * output_per_1k) / 1000, 6) as usd from documents cross join models where text is not null", "models"))
R.add("cost_usage", lambda s, d: rounded(out(s, d).join(small(view(s, d, "models").where("ord <> 4").withColumnRenamed("model", "model_name").drop("ord")), "model_name", "left").select("prompt_key", "model_name", U.cost_of_usage(F.when(F.col("record_index") % 3 == 0, F.col("cost")), F.col("prompt_tokens"), F.col("completion_tokens"), F.col("input_per_1k") * 1000, F.col("output_per_1k") * 1000).alias("usd")), digits=7), oracle(" select prompt_key, model_name, round(case when record_index % 3 = 0 then cost when o.ord = 4 then 0 else (prompt_tokens * (input_per_1k * 1000) + completion_tokens * (output_per_1k * 1000)) / 1e6 end, 7) as usd from outcomes o join models m on m.model = o.model_name", "outcomes", "models"))
R.add("est_cost_usd", lambda s, d: rounded(load(s, d, "request_telemetry", "row_id", "estimated_input_tokens", "output_tokens", F.explode("candidate_models").alias("model")).join(small(load(s, d, "model_axes", "model", "input_per_1k_usd", "output_per_1k_usd")), "model").select("row_id", "model", ((F.coalesce("estimated_input_tokens", F.lit(0)) * F.col("input_per_1k_usd") * 1000 + F.coalesce("output_tokens", F.lit(0)) * F.col("output_per_1k_usd") * 1000) / 1e6).alias("usd")), digits=7), "with e as (select row_id, estimated_input_tokens as i, output_tokens as o, unnest(candidate_models) as model from request_telemetry) select row_id, model, round((coalesce(i, 0) * input_per_1k_usd * 1000 + coalesce(o, 0) * output_per_1k_usd * 1000) / 1e6, 7) as usd from e join model_axes using (model)")
R.add("dial_floor", lambda s, d: rounded(view(s, d, "vectors").select("vec_id", U.floored(F.col("vec_id") % 101 / 100.0, F.when(F.col("label") > 4, F.col("label") / 10.0)).alias("alpha"))), oracle(" select vec_id, round(greatest(vec_id % 101 / 100.0e0, case when label > 4 then label / 10.0e0 else 0 end), 6) as alpha from vectors", "vectors"))
R.add("adaptive_k", lambda s, d: view(s, d, "sparse").groupBy("model_name").agg(F.count("*").alias("n")).select("model_name", U.adaptive_k(F.col("n"), 50, 4, 9).cast("long").alias("k")), oracle(" select model_name, cast(greatest(4, least(9, floor(count(*) / 50))) as bigint) as k from sparse group by 1", "sparse"))


def _candidates(s: SparkSession, d: str) -> DataFrame:
    a = load(s, d, "model_axes", "model", "provider", "input_per_1k_usd", "tps").withColumn("price", F.col("input_per_1k_usd")).withColumn("ord", F.col("model"))
    served = load(s, d, "request_telemetry", F.col("decision_model").alias("model")).distinct()
    return a.join(served, "model", "left_semi")


_CAND = "with served as (select distinct decision_model as model from request_telemetry), c as (select * from model_axes where model in (select model from served) and model not in ('basalt-9b', 'orrin-4'))"
R.add("cheapest_model", lambda s, d: U.cheapest_model(_candidates(s, d), ["provider"], denied=F.col("model").isin("basalt-9b", "orrin-4")), _CAND + " select provider, arg_min(model, (input_per_1k_usd, model)) as model from c where input_per_1k_usd is not null group by 1")
R.add("fastest_model", lambda s, d: U.fastest_model(_candidates(s, d), ["provider"], denied=F.col("model").isin("basalt-9b", "orrin-4")), _CAND + ", f as (select provider, coalesce(arg_min(model, (-tps, model)) filter (tps > 0), arg_min(model, (input_per_1k_usd, model)) filter (input_per_1k_usd is not null)) as model from c group by 1) select * from f where model is not null")
R.add("router_success", lambda s, d: rounded(U.routed_success(estimates(s, d), out(s, d), "prompt_key", "dataset_id")), oracle(EST + ", b as (select prompt_key, model_name from (select *, row_number() over (partition by prompt_key order by round(value, 9) desc, model_name) as rn from est) where rn = 1), h as (select dataset_id, case when score > 0.5 then 1 else 0 end as hit from b join outcomes using (prompt_key, model_name)), p as (select dataset_id, count(*) as n, avg(hit) as success from h group by 1) select dataset_id as category, n, round(success, 6) as success, null::double as category_mean from p union all select 'all', cast(sum(n) as bigint), round(sum(success * n) / sum(n), 6), round(avg(success), 6) from p", *V))
R.add("dataset_report", lambda s, d: rounded(O.macro_micro(U.earned(alpha_picks(s, d).where("param = 0.5"), out(s, d).drop("dataset_id")).join(out(s, d).select("prompt_key", "dataset_id").distinct(), "prompt_key"), [])), oracle(PICKS + ", r as (select o.dataset_id, avg(score) as m, sum(score) as s, count(score) as n from picks p join outcomes o using (prompt_key, model_name) where p.param = 0.5 group by 1) select round(avg(m), 6) as macro, round(sum(s) / sum(n), 6) as micro from r", *V))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    """Every named policy over all prompts, and what its picks earned."""
    o = out(s, d)
    e = estimates(s, d).withColumnRenamed("prompt_key", "key")
    art = {"models": view(s, d, "models").select("ord", F.col("model").alias("model_name")), "outcomes": o, "estimates": e, "cost_norm": cost_norm(s, d), "cost_hat": o.groupBy("model_name").agg(F.avg("cost").alias("cost_hat"))}
    requests = o.select(F.col("prompt_key").alias("key")).distinct()
    all_ = None
    for name in Y.names():
        one = Y.decide(name, requests, art).withColumn("policy", F.lit(name))
        all_ = one if all_ is None else all_.unionByName(one)
    earned = all_.join(o.select(F.col("prompt_key").alias("key"), "model_name", "score", "cost"), ["key", "model_name"])
    return rounded(earned.groupBy("policy").agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg("cost").alias("cost")))


R.add("policy_compare", _decisions, oracle(PICKS + """, sgl as (select model_name, avg(score) as s, avg(cost) as c from outcomes group by 1),
dl as (select prompt_key, model_name from (select *, row_number() over (partition by prompt_key order by round(value - 20.0e0 * c, 9) desc, model_name) as rn from est join cn using (model_name)) where rn = 1),
al as (select 'alpha' as policy, prompt_key, model_name from picks where param = 0.5 union all select 'dollar', prompt_key, model_name from dl
 union all select 'best_estimate', prompt_key, model_name from (select *, row_number() over (partition by prompt_key order by round(value, 9) desc, model_name) as rn from est) where rn = 1
 union all select 'best_single', prompt_key, (select model_name from sgl order by round(s, 9) desc, model_name limit 1) from (select distinct prompt_key from outcomes)
 union all select 'cheapest', prompt_key, (select model_name from sgl order by round(c, 9), model_name limit 1) from (select distinct prompt_key from outcomes)
 union all select 'random', prompt_key, model_name from outcomes where ord = ('0x' || substr(sha256('7|' || prompt_key), 1, 15))::bigint % 5)
select policy, count(*) as n, round(avg(score), 6) as score, round(avg(cost), 6) as cost from al join outcomes using (prompt_key, model_name) group by 1""", *V))
