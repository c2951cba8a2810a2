"""Estimators: with given centroids held against SQL, otherwise by rows, properties and held-out error."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.ml import estimators as E
from quaymark.operators import outcomes as O
from quaymark.operators import rules as U
from quaymark.plans.fixtures import oracle, view
from quaymark.plans.outcome_queries import rounded
from quaymark.plans.registry import Registry
from quaymark.plans.rule_queries import FRONT, KNN, V, alpha_frontier, estimates, out
from quaymark.sources.tables import load

R = Registry()


def vectors(s, d):
    return load(s, d, "embeddings", F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))


def outs(s, d):
    return view(s, d, "outcomes").select(F.col("record_index").alias("key"), "model_name", "score", "cost")


def train():
    return E.is_train()


def centroids(s, d):
    return view(s, d, "centroids")


# sha2 of 'fit|' and the key: the split of is_train
_TR = "('0x' || substr(sha256('fit|' || {}), 1, 8))::bigint % 100000 < 70000"
_NR = """, nr as (select * from (select *, row_number() over (partition by vec_id order by sim desc, cluster_id) as rank from sims) where rank <= {p}),
oc as (select record_index as key, model_name, score, cost from outcomes), lb as (select vec_id as key, cluster_id from nr where rank = 1)"""
_Z = "coalesce((score - avg(score) over (partition by key)) / nullif(stddev_pop(score) over (partition by key), 0), 0)"
_TABLE = ", pr as (select model_name, avg({v}) as prior, avg(cost) as c from {src} group by 1), mn as (select cluster_id, model_name, avg({v}) as mean, count({v}) as n from lb join {src} using (key) group by 1, 2), tb as (select g.cluster_id, p.model_name, case when coalesce(n, 0) = 0 then prior else (n * mean + {k0} * prior) / (n + {k0}) end as q from (select distinct cluster_id from lb) g cross join pr p left join mn on mn.cluster_id = g.cluster_id and mn.model_name = p.model_name)"

R.add("est_cluster", lambda s, d: rounded(E.cluster_estimates(vectors(s, d), outs(s, d), centroids(s, d), 20.0, 3, train()), digits=5), oracle(_NR.format(p=3) + f", z as (select *, {_Z} as z from oc), tz as (select * from z where {_TR.format('key')})" + _TABLE.format(v="z", src="tz", k0="20.0e0") + " select vec_id as key, model_name, round(avg(q), 5) + 0 as value from nr join tb using (cluster_id) group by 1, 2", *V))
R.add("est_equal_top", lambda s, d: rounded(E.equal_top_scores(vectors(s, d), outs(s, d), centroids(s, d), 0.6, 10.0, 3, train()), digits=5), oracle(_NR.format(p=3) + f", tr as (select * from oc where {_TR.format('key')}), tz as (select *, (greatest(-3, least(3, {_Z})) + 3) / 6 as z from tr)" + _TABLE.format(v="z", src="tz", k0="10.0e0") + ", rt as (select cluster_id, model_name, round(q, 9) as q from tb), qn as (select cluster_id, model_name, coalesce((q - min(q) over w) / nullif(max(q) over w - min(q) over w, 0), 0) as qn from rt window w as (partition by cluster_id)), cn as (select model_name, (c - min(c) over ()) / (max(c) over () - min(c) over ()) as cn from pr) select vec_id as key, model_name, round(0.6e0 * sum(qn) + 0.4e0 * 3 * (1 - max(cn)), 5) + 0 as value from nr join qn using (cluster_id) join cn using (model_name) group by 1, 2", *V))
_SOFT = ", ws as (select *, exp((sim - max(sim) over (partition by vec_id)) / {t}) as e from nr), wt as (select *, e / sum(e) over (partition by vec_id) as w from ws)"
R.add("est_centroid", lambda s, d: rounded(E.centroid_scores(vectors(s, d), outs(s, d), centroids(s, d), 5.0, 3, 0.05, train()), digits=5), oracle(_NR.format(p=3) + _SOFT.format(t="0.05e0") + f", tr as (select * from oc where {_TR.format('key')})" + _TABLE.format(v="score", src="tr", k0="5.0e0") + " select vec_id as key, model_name, round(sum(w * q), 5) as value from wt join tb using (cluster_id) group by 1, 2", *V))
_PS, _KS, _TS, _BS = (1, 3), (0.0, 20.0), (0.05, 0.5), (0.5, 0.75, 1.0)
R.add(
    "grid_search",
    lambda s, d: rounded(E.grid_search(vectors(s, d), outs(s, d), centroids(s, d), train(), ~train(), _PS, _KS, _TS, _BS), digits=5),
    oracle(_NR.format(p=3) + f""", tr as (select * from oc where {_TR.format('key')}), ho as (select * from oc where not ({_TR.format('key')})),
pr as (select model_name, avg(score) as prior, avg(cost) as c from tr group by 1), cn as (select *, (c - min(c) over ()) / (max(c) over () - min(c) over ()) as cn from pr),
mn as (select cluster_id, model_name, avg(score) as mean, count(score) as n from lb join tr using (key) group by 1, 2),
tb as (select g.cluster_id, p.model_name, p.cn, k.k0, case when coalesce(n, 0) = 0 then prior else (n * mean + k0 * prior) / (n + k0) end as q from (select distinct cluster_id from lb) g cross join cn p cross join (select unnest({list(_KS)}::double[]) as k0) k left join mn on mn.cluster_id = g.cluster_id and mn.model_name = p.model_name),
st as (select p, t as temperature from (select unnest({list(_PS)}) as p) cross join (select unnest({list(_TS)}::double[]) as t)),
ws as (select nr.*, p, temperature, exp((sim - max(sim) over (partition by vec_id, p, temperature)) / temperature) as e from nr cross join st where rank <= p and vec_id in (select key from ho)),
wt as (select *, e / sum(e) over (partition by vec_id, p, temperature) as w from ws),
est as (select vec_id as key, p, temperature, k0, model_name, sum(w * q) as q, max(cn) as cn from wt join tb using (cluster_id) group by all),
bs as (select unnest({list(_BS)}::double[]) as bias),
pk as (select key, p, temperature, k0, bias, model_name from (select *, row_number() over (partition by key, p, temperature, k0, bias order by round(bias * q + (1 - bias) * (1 - cn), 9) desc, model_name) as rn from est cross join bs) where rn = 1),
u0 as (select ho.*, bias, bias * coalesce((score - min(score) over (partition by key)) / nullif(max(score) over (partition by key) - min(score) over (partition by key), 0), 0) + (1 - bias) * (1 - coalesce((cost - min(cost) over (partition by key)) / nullif(max(cost) over (partition by key) - min(cost) over (partition by key), 0), 0)) as u from ho cross join bs),
u1 as (select *, coalesce((max(u) over w - u) / nullif(max(u) over w - min(u) over w, 0), 0) as regret from u0 window w as (partition by key, bias)),
r1 as (select p, k0, temperature, bias, avg(regret) as r from pk join u1 using (key, bias, model_name) group by 1, 2, 3, 4), r2 as (select p, k0, temperature, avg(r) as objective from r1 group by 1, 2, 3)
select p, k0, temperature, round(objective, 5) as objective, row_number() over (order by round(objective, 9), p, k0, temperature) as place from r2""", *V),
)
R.add("est_ridge", lambda s, d: E.ridge(vectors(s, d), outs(s, d), train()))
R.add("est_gbt", lambda s, d: E.trees(vectors(s, d), outs(s, d), train(), "gbt"))
R.add("est_rf", lambda s, d: E.trees(vectors(s, d), outs(s, d), train(), "forest"))
R.add("est_mf", lambda s, d: E.factor_estimates(outs(s, d), U.hash_share(F.concat_ws("|", "key", "model_name"), "cell|") < 80_000))
R.add("est_hybrid", lambda s, d: (lambda v: E.cluster_estimates(v, outs(s, d), E.centroids_of(v, 10), 20.0, 3, train()))(E.scaled(vectors(s, d))))
R.add("est_kmeans", lambda s, d: E.cluster_estimates(vectors(s, d), outs(s, d), E.centroids_of(vectors(s, d), 10), 20.0, 3, train()))
R.add("held_out_error", lambda s, d: E.held_out_error(E.ridge(vectors(s, d), outs(s, d), train()), outs(s, d)))
R.add("calibrate_isotonic", lambda s, d: E.calibrate(E.centroid_scores(vectors(s, d), outs(s, d), centroids(s, d), 5.0, 3, 0.05, train()).join(outs(s, d), ["key", "model_name"]), train()))
R.add("sensitivity", lambda s, d: rounded(E.sensitivity(vectors(s, d), outs(s, d), 15, 2.0), digits=5), oracle(KNN.replace("rank <= 10", "rank <= 15") + ", w as (select query as key, neighbour, pow(greatest(sim, 0), 2) as w from kn), g as (select key, model_name, sum(w * score) / nullif(sum(w), 0) as m, coalesce(pow(sum(w), 2) / nullif(sum(w * w), 0), 0) as n from w join outcomes o on o.record_index = w.neighbour group by 1, 2), pr as (select model_name, avg(score) as prior from outcomes group by 1) select key, model_name, round(case when n = 0 then prior else (n * m + 5 * prior) / (n + 5) end, 5) as value from g join pr using (model_name)", "vectors", "outcomes"))
R.add("lobo", lambda s, d: rounded(E.leave_family_out(vectors(s, d), outs(s, d), load(s, d, "embeddings", F.col("vec_id").alias("key"), (F.col("vec_id") % 4).alias("family")), centroids(s, d), 5.0, 3, 0.05), digits=5), oracle(_NR.format(p=3) + _SOFT.format(t="0.05e0") + """, f as (select unnest([0, 1, 2, 3]) as family), tr as (select family, oc.* from oc cross join f where key % 4 <> family),
pr as (select family, model_name, avg(score) as prior from tr group by 1, 2), mn as (select family, cluster_id, model_name, avg(score) as mean, count(score) as n from lb join tr using (key) group by 1, 2, 3),
tb as (select p.family, g.cluster_id, p.model_name, case when coalesce(n, 0) = 0 then prior else (n * mean + 5.0e0 * prior) / (n + 5.0e0) end as q from (select distinct cluster_id from lb) g cross join pr p left join mn on mn.family = p.family and mn.cluster_id = g.cluster_id and mn.model_name = p.model_name),
e as (select vec_id as key, tb.family, model_name, sum(w * q) as value from wt join tb on tb.cluster_id = wt.cluster_id and tb.family = vec_id % 4 group by 1, 2, 3) select family, count(*) as n, round(avg(abs(value - score)), 5) as mae from e join oc using (key, model_name) group by 1""", *V))
R.add("pca", lambda s, d: E.reduced(vectors(s, d), 8))
R.add("tfidf_svd", lambda s, d: E.text_vectors(load(s, d, "documents", F.col("doc_id").alias("key"), "text").where("text is not null")))

_U = "((('0x' || substr(sha256({}), 1, 12))::bigint + 0.5e0) / 281474976710656.0e0)"
_POI = "case when u < 0.36787944117144233e0 then 0 when u < 0.7357588823428847e0 then 1 when u < 0.9196986029286058e0 then 2 when u < 0.9810118431238462e0 then 3 when u < 0.9963401531726563e0 then 4 when u < 0.9994058151824183e0 then 5 when u < 0.9999167588507119e0 then 6 when u < 0.9999897508033253e0 then 7 else 8 end"
R.add("bootstrap_ci", lambda s, d: rounded(E.bootstrap(outs(s, d), "score", ["model_name"])), oracle(f", v as (select record_index as key, model_name, score from outcomes), p as (select *, {_U.format(chr(39) + 'boot|' + chr(39) + ' || key || ' + chr(39) + '|' + chr(39) + ' || r')} as u from v cross join range(1, 1001) t(r)), m as (select model_name, r, sum(({_POI}) * score) / sum({_POI}) as m from p group by 1, 2) select model_name, round(avg(a), 6) as mean, round(quantile_cont(m, 0.025), 6) as lo, round(quantile_cont(m, 0.975), 6) as hi from m join (select model_name, avg(score) as a from v group by 1) using (model_name) group by 1", "outcomes"))
R.add("paired_boot", lambda s, d: rounded(E.paired_bootstrap(outs(s, d).where("model_name = 'EUROPE'"), outs(s, d).where("model_name = 'ASIA'"), "score")), oracle(f", v as (select a.record_index as key, a.score - b.score as d from outcomes a join outcomes b using (record_index) where a.model_name = 'EUROPE' and b.model_name = 'ASIA'), p as (select *, {_U.format(chr(39) + 'paired|' + chr(39) + ' || key || ' + chr(39) + '|' + chr(39) + ' || r')} as u from v cross join range(1, 1001) t(r)), m as (select r, sum(({_POI}) * d) / sum({_POI}) as m from p group by 1) select (select round(avg(d), 6) + 0 from v) as mean, round(quantile_cont(m, 0.025), 6) + 0 as lo, round(quantile_cont(m, 0.975), 6) + 0 as hi from m", "outcomes"))


def posterior(s, d):
    p = view(s, d, "outcomes").groupBy(F.substring("dataset_id", 3, 9).cast("int").alias("cluster_id"), "model_name").agg(F.round(F.avg("score"), 9).alias("mean"), F.round(F.var_pop("score") / F.count("*"), 9).alias("variance"))
    return p.where("not (cluster_id < 5 and model_name = 'ASIA')")


_POST = ", ps as (select cast(substr(dataset_id, 3) as int) as cluster_id, model_name, round(avg(score), 9) as mean, round(var_pop(score) / count(*), 9) as variance from outcomes group by 1, 2), po as (select * from ps where not (cluster_id < 5 and model_name = 'ASIA'))"


def _draw(parts):
    tail = " || '|' || ".join(parts)
    r, a = (_U.format(f"'{k}|42|' || {tail}") for k in "ra")
    return f"mean + sqrt(variance) * sqrt(-2 * ln({r})) * cos(2 * pi() * {a})"


R.add("thompson_sample", lambda s, d: E.thompson(posterior(s, d), load(s, d, "embeddings", F.col("vec_id").alias("key"), F.col("label").alias("cluster_id")), "key", outs(s, d).select("key", "model_name", (F.col("score") * 0.5).alias("value"))), oracle(_POST + f", dr as (select vec_id as key, model_name, {_draw(['vec_id', 'cluster_id', 'model_name'])} as draw from vectors join po on cluster_id = label), al as (select * from dr union all select record_index, model_name, score * 0.5e0 from outcomes o where not exists (select 1 from dr where dr.key = o.record_index and dr.model_name = o.model_name)) select key, arg_max(model_name, (round(draw, 9), model_name)) as model_name from al group by 1", "outcomes", "vectors"))
R.add("propensity_mc", lambda s, d: rounded(E.win_shares(posterior(s, d))), oracle(_POST + f", dr as (select cluster_id, model_name, t, {_draw(['cluster_id', 'model_name', 't'])} as draw from po cross join range(1, 1025) r(t)), w as (select cluster_id, model_name, count(*) / 1024 as share from (select *, row_number() over (partition by cluster_id, t order by round(draw, 9) desc, model_name desc) as rn from dr) where rn = 1 group by 1, 2) select po.cluster_id, po.model_name, round(greatest(coalesce(share, 0), 1 / 1024), 6) as propensity from po left join w using (cluster_id, model_name)", "outcomes"))
_BANDS = {"reason": "large", "explore": "small", "execute": "small", "edit": "large"}
R.add("bandswap_head", lambda s, d: rounded(E.band_of(view(s, d, "busy").groupBy(F.col("session_key").alias("key"), "action").agg(F.count("*").alias("n")).withColumn("probability", F.col("n") / F.sum("n").over(W.partitionBy("key"))), _BANDS, 0.4)), oracle(", c as (select session_key as key, count(*) filter (action in ('reason', 'edit')) / count(*) as p from busy group by 1) select key, case when round(p, 9) < 0.4e0 then 'small' else 'large' end as band, round(p, 6) as p_large from c", "busy"))


def _compare(s, d):
    rules = {"alpha": alpha_frontier(s, d), "dollar": U.frontier(U.earned(U.dollar_sweep(estimates(s, d), out(s, d).groupBy("model_name").agg(F.avg("cost").alias("cost_hat")), "prompt_key", (0.0, 5.0, 20.0, 100.0)), out(s, d)), O.reference_points(out(s, d)))}
    return rounded(U.compare_rules(rules, [0.003, 0.006, 0.012]))


R.add("hypotheses", _compare, oracle(FRONT + f""", dg as (select unnest([0.0, 5.0, 20.0, 100.0]::double[]) as param), ds as (select prompt_key, param, model_name, row_number() over (partition by prompt_key, param order by round(value - param * c, 9) desc, model_name) as rn from est join cn using (model_name) cross join dg),
df as (select param, avg(score) as score, avg(cost) as cost from ds join outcomes using (prompt_key, model_name) where rn = 1 group by 1),
b as (select unnest([0.003, 0.006, 0.012]::double[]) as budget), x as (select budget, (select max(score) from fr where cost <= budget) as alpha, (select max(score) from df where cost <= budget) as dollar from b)
select budget, 'dollar' as rule, round(dollar - alpha, 6) + 0 as delta, coalesce(dollar - alpha > 0.008e0, false) as wins from x""", *V))
R.add("hmm_posterior", lambda s, d: E.state_posteriors(view(s, d, "calls").select("session_key", "call_id", "ts", F.array(F.col("is_error").cast("double"), F.col("output_tokens") / 100.0).alias("vec")), [[0.1, 0.3], [0.6, 0.7]], [[0.2, 0.1], [0.3, 0.1]], [[0.8, 0.2], [0.3, 0.7]], [0.6, 0.4]))
