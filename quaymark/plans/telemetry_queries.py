"""Queries over the telemetry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.operators import telemetry as T
from quaymark.plans.outcome_queries import rounded
from quaymark.plans.registry import Registry
from quaymark.sources.tables import canonical_id, load, present_tables

R = Registry()
COSTS = ("requested_input_cost_usd", "requested_output_cost_usd", "actual_input_cost_usd", "actual_output_cost_usd")


def tel(s: SparkSession, d: str, *extra: str) -> DataFrame:
    return load(s, d, "request_telemetry", *dict.fromkeys(("row_id", "ts", "installation_id", "span_type", "decision_model", "input_tokens", "output_tokens", *COSTS, *extra)))


_R = "coalesce(requested_input_cost_usd, 0) + coalesce(requested_output_cost_usd, 0)"
_A = "coalesce(actual_input_cost_usd, 0) + coalesce(actual_output_cost_usd, 0)"
_TOTALS = f"count(*) as requests, cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens, cast(coalesce(sum({_R}), 0) as bigint) as requested_cost, cast(coalesce(sum({_A}), 0) as bigint) as actual_cost, cast(coalesce(sum({_R} - ({_A})), 0) as bigint) as savings"
UP = "span_type = 'router.upstream'"

R.add("agg_summary_total_all", lambda s, d: T.totals(tel(s, d).where(UP)), f"select {_TOTALS} from request_telemetry where {UP}")
R.add("agg_summary_total", lambda s, d: T.totals(tel(s, d).where(UP), ["installation_id"]), f"select installation_id, {_TOTALS} from request_telemetry where {UP} group by 1")
for _g in ("hour", "day", "week"):
    _b = f"strftime(date_trunc('{_g}', ts), '%Y-%m-%d %H:%M:%S') as bucket"
    R.add(f"agg_ts_{_g}_all", lambda s, d, g=_g: T.time_buckets(tel(s, d).where(UP), "ts", g), f"select {_b}, {_TOTALS} from request_telemetry where {UP} group by 1")
    R.add(f"agg_ts_{_g}", lambda s, d, g=_g: T.time_buckets(tel(s, d).where(UP), "ts", g, ["installation_id"]), f"select {_b}, installation_id, {_TOTALS} from request_telemetry where {UP} group by 1, 2")
    R.add(f"agg_model_breakdown_{_g}_all", lambda s, d, g=_g: T.time_buckets(tel(s, d).where(UP).withColumn("model", F.coalesce("decision_model", F.lit(""))), "ts", g, ["model"]), f"select {_b}, coalesce(decision_model, '') as model, {_TOTALS} from request_telemetry where {UP} group by 1, 2")
    R.add(f"agg_model_breakdown_{_g}", lambda s, d, g=_g: T.time_buckets(tel(s, d).where(UP).withColumn("model", F.coalesce("decision_model", F.lit(""))), "ts", g, ["installation_id", "model"]), f"select {_b}, installation_id, coalesce(decision_model, '') as model, {_TOTALS} from request_telemetry where {UP} group by 1, 2, 3")
R.add("time_range", lambda s, d: T.totals(T.in_window(tel(s, d), "ts", "2025-02-01", "2025-03-01"), ["span_type"]), f"select span_type, {_TOTALS} from request_telemetry where ts >= timestamp '2025-02-01' and ts < timestamp '2025-03-01' group by 1")
_STR = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


def stamp(c: str = "ts") -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


R.add("top_rows", lambda s, d: T.newest(tel(s, d, "request_id"), "ts", "row_id", 100).select("row_id", stamp(), "request_id", "decision_model"), f"select row_id, {_STR} as ts, request_id, decision_model from request_telemetry order by request_telemetry.ts desc, row_id desc limit 100")
for _n, _asc in (("nth_turn_asc", True), ("nth_turn_desc", False)):
    _o = "ts, row_id" if _asc else "ts desc, row_id desc"
    R.add(_n, lambda s, d, a=_asc: T.nth_turn(tel(s, d, "session_id", "turn_type").where("turn_type = 'main_loop' and session_id is not null"), ["session_id"], "ts", "row_id", 3, not a).select("session_id", "row_id", stamp()), f"select session_id, row_id, {_STR} as ts from (select *, row_number() over (partition by session_id order by {_o}) as rn from request_telemetry where turn_type = 'main_loop' and session_id is not null) where rn = 3")
R.add("latest_request", lambda s, d: T.latest_by(load(s, d, "request_telemetry", "request_id", "span_type", "created_at", "row_id", "upstream_status_code").where(UP), ["request_id"], ["created_at", "row_id"], ["row_id", "upstream_status_code"]), f"select request_id, row_id, upstream_status_code from (select *, row_number() over (partition by request_id order by created_at desc, row_id desc) as rn from request_telemetry where {UP}) where rn = 1")
R.add("insert_ignore", lambda s, d: T.first_by(load(s, d, "request_telemetry", "installation_id", "request_id", "span_type", "row_id"), ["installation_id", "request_id", "span_type"], ["row_id"], ["row_id"]), "select installation_id, request_id, span_type, min(row_id) as row_id from request_telemetry group by 1, 2, 3")
R.add(
    "upsert_last",
    lambda s, d: T.latest_by(load(s, d, "request_feedback", "request_id", "installation_id", "updated_at", "feedback_id", "rating", "comment_text").withColumns({"request_id": canonical_id("request_id"), "installation_id": canonical_id("installation_id"), "comment_text": F.expr("nullif(trim(comment_text), '')")}), ["installation_id", "request_id"], ["updated_at", "feedback_id"], ["feedback_id", "rating", "comment_text"]),
    r"with f as (select *, nullif(regexp_replace(lower(request_id), '^[\s{}]+|[\s{}]+$', '', 'g'), '') as r, nullif(regexp_replace(lower(installation_id), '^[\s{}]+|[\s{}]+$', '', 'g'), '') as i from request_feedback), k as (select *, row_number() over (partition by i, r order by updated_at desc, feedback_id desc) as rn from f) select i as installation_id, r as request_id, feedback_id, rating, nullif(trim(comment_text, ' '), '') as comment_text from k where rn = 1",
)
R.add("feedback_lookup", lambda s, d: load(s, d, "request_feedback", "feedback_id", "request_id", "rating").join(load(s, d, "request_feedback", "request_id").groupBy("request_id").count().where("count > 1").select("request_id"), "request_id", "left_semi"), "select feedback_id, request_id, rating from request_feedback where request_id in (select request_id from request_feedback group by 1 having count(*) > 1)")
R.add("running_balance", lambda s, d: T.running_balance(tel(s, d).withColumn("delta", -(F.coalesce("actual_input_cost_usd", F.lit(0)) + F.coalesce("actual_output_cost_usd", F.lit(0)))).select("installation_id", "row_id", "ts", "delta"), ["installation_id"], ["ts", "row_id"], "delta", 1_000_000).drop("ts"), f"select installation_id, row_id, cast(-({_A}) as bigint) as delta, cast(1000000 + sum(-({_A})) over (partition by installation_id order by ts, row_id) as bigint) as balance_after from request_telemetry")
R.add("balance_crossing", lambda s, d: T.crossings(R.queries["running_balance"](s, d), 500_000).select("installation_id", "row_id"), f"with b as (select installation_id, row_id, -({_A}) as delta, 1000000 + sum(-({_A})) over (partition by installation_id order by ts, row_id) as bal from request_telemetry) select installation_id, row_id from b where bal - delta >= 500000 and bal < 500000")
R.add("month_spend", lambda s, d: T.time_buckets(tel(s, d), "ts", "month", ["installation_id"]).select("bucket", "installation_id", "actual_cost"), f"select strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') as bucket, installation_id, cast(sum({_A}) as bigint) as actual_cost from request_telemetry group by 1, 2")
R.add("not_deleted", lambda s, d: T.active(load(s, d, "installations", "installation_id", "installation_name", "deleted_at")).drop("deleted_at"), "select installation_id, installation_name from installations where deleted_at is null")
R.add("list_installations", lambda s, d: T.newest(T.active(load(s, d, "installations")), "created_at", "installation_id", 50).select("installation_id", stamp("created_at")), "select installation_id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') as created_at from installations where deleted_at is null order by installations.created_at desc, installation_id desc limit 50")
R.add("list_keys", lambda s, d: T.newest(T.active(load(s, d, "api_keys")), "created_at", "api_key_id", 100).select("api_key_id", "installation_id"), "select api_key_id, installation_id from api_keys where deleted_at is null order by created_at desc, api_key_id desc limit 100")
R.add("join_apikey_install", lambda s, d: T.active(load(s, d, "api_keys", "api_key_id", "installation_id", "deleted_at")).drop("deleted_at").join(T.active(load(s, d, "installations", "installation_id", "external_id", "deleted_at")).drop("deleted_at"), "installation_id"), "select k.api_key_id, i.installation_id, i.external_id from api_keys k join installations i using (installation_id) where k.deleted_at is null and i.deleted_at is null")
R.add("join_telemetry_user", lambda s, d: load(s, d, "request_telemetry", "row_id", "installation_id").join(T.active(load(s, d, "installations", "installation_id", "installation_name", "deleted_at")).drop("deleted_at"), "installation_id", "left"), "select t.row_id, t.installation_id, i.installation_name from request_telemetry t left join installations i on i.installation_id = t.installation_id and i.deleted_at is null")
R.add("exists_pred", lambda s, d: load(s, d, "installations", "installation_id").join(load(s, d, "api_keys", "installation_id", "spend_cap_usd_micros").where("spend_cap_usd_micros is not null"), "installation_id", "left_semi"), "select installation_id from installations i where exists (select 1 from api_keys k where k.installation_id = i.installation_id and k.spend_cap_usd_micros is not null)")
R.add("agg_distinct", lambda s, d: load(s, d, "request_telemetry", "decision_model", "session_id", "installation_id").agg(F.countDistinct("decision_model").alias("models"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("installation_id").alias("installations")), "select count(distinct decision_model) as models, count(distinct session_id) as sessions, count(distinct installation_id) as installations from request_telemetry")
R.add("agg_event_counts", lambda s, d: load(s, d, "request_telemetry", "turn_type", "decision_reason").groupBy("turn_type", "decision_reason").count().withColumnRenamed("count", "n"), "select turn_type, decision_reason, count(*) as n from request_telemetry group by 1, 2")
_PREMIUM = ("orrin-4", "basalt-72b", "quillon-2")
R.add("agg_register_mix", lambda s, d: rounded(_mix(s, d)), f"with c as (select client_app, decision_model, count(*) as n from request_telemetry where decision_model is not null group by 1, 2), k as (select *, row_number() over (partition by client_app order by n desc, decision_model) as rn, sum(n) over (partition by client_app) as total, sum(case when decision_model in {_PREMIUM} then n else 0 end) over (partition by client_app) as premium from c) select client_app, cast(max(total) as bigint) as total, round(100.0e0 * max(premium) / max(total), 6) as premium_percent, string_agg(decision_model || ':' || n, ', ' order by n desc, decision_model) as mix from k where rn <= 3 group by 1")
R.add("shadow_agree", lambda s, d: rounded(T.agreement(load(s, d, "request_telemetry", "requested_model", "decision_model", "turn_type"), "requested_model", "decision_model", ["turn_type"])), "select turn_type, count(*) filter (requested_model is not null and decision_model is not null) as compared, round(count(*) filter (requested_model = decision_model) / nullif(count(*) filter (requested_model is not null and decision_model is not null), 0), 6) as agreement from request_telemetry group by 1")
R.add("usage_observer", lambda s, d: T.observed_last(load(s, d, "request_telemetry", "row_id", "installation_id", "ts", "upstream_latency_ms", "api_key_id"), ["installation_id"], ["ts", "row_id"], ["upstream_latency_ms", "api_key_id"]).select("row_id", "upstream_latency_ms_seen", "api_key_id_seen"), "select row_id, last_value(upstream_latency_ms ignore nulls) over w as upstream_latency_ms_seen, last_value(api_key_id ignore nulls) over w as api_key_id_seen from request_telemetry window w as (partition by installation_id order by ts, row_id rows between unbounded preceding and current row)")
R.add("soft_delete_count", lambda s, d: load(s, d, "api_keys", "installation_id", "deleted_at").groupBy("installation_id").agg(F.count_if(F.col("deleted_at").isNull()).alias("active"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted")), "select installation_id, count(*) filter (deleted_at is null) as active, count(*) filter (deleted_at is not null) as deleted from api_keys group by 1")
R.add("tumbling_cost", lambda s, d: tel(s, d).groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours")).agg(F.sum("actual_input_cost_usd").alias("cost")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "cost"), "select strftime(time_bucket(interval 6 hours, ts, timestamp '2000-01-01'), '%Y-%m-%d %H:%M:%S') as start, cast(sum(actual_input_cost_usd) as bigint) as cost from request_telemetry group by 1")
R.add("sliding_cost", lambda s, d: tel(s, d).groupBy(F.window(F.col("ts").cast("timestamp"), "2 days", "1 day")).agg(F.sum("actual_input_cost_usd").alias("cost")).select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "cost"), "with d as (select cast(ts as date) as d, sum(actual_input_cost_usd) as c from request_telemetry group by 1), e as (select unnest([d, cast(d - interval 1 day as date)]) as start, c from d) select strftime(start, '%Y-%m-%d') as start, cast(sum(c) as bigint) as cost from e group by 1")


def _mix(s: SparkSession, d: str) -> DataFrame:
    c = load(s, d, "request_telemetry", "client_app", "decision_model").where("decision_model is not null").groupBy("client_app", "decision_model").agg(F.count("*").alias("n"))
    w = F.expr("row_number() over (partition by client_app order by n desc, decision_model)")
    k = c.withColumn("rn", w).withColumn("total", F.expr("sum(n) over (partition by client_app)")).withColumn("premium", F.sum(F.when(F.col("decision_model").isin(*_PREMIUM), F.col("n")).otherwise(0)).over(W.partitionBy("client_app")))
    top = k.where("rn <= 3").groupBy("client_app").agg(F.max("total").alias("total"), F.max("premium").alias("premium"), F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(":", "decision_model", F.col("n").cast("string")).alias("t")))).alias("m"))
    return top.select("client_app", "total", (100.0 * F.col("premium") / F.col("total")).alias("premium_percent"), F.array_join(F.transform("m", lambda x: x["t"]), ", ").alias("mix"))


def _plan(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = load(s, d, "model_axes", "model")
    i = load(s, d, "installations", "installation_id")
    plan = i.crossJoin(F.broadcast(m)).withColumn("fingerprint", F.sha2(F.concat_ws("|", "installation_id", "model"), 256))
    done = load(s, d, "request_telemetry", "installation_id", "decision_model").where("decision_model is not null").select("installation_id", F.col("decision_model").alias("model")).distinct()
    done = done.withColumn("fingerprint", F.when(F.substring("installation_id", 1, 1) < "4", F.lit(None)).when(F.substring("installation_id", 1, 1) < "a", F.sha2(F.concat_ws("|", "installation_id", "model"), 256)).otherwise(F.lit("old")))
    return plan, done


_PLAN = "with p as (select installation_id, model, sha256(installation_id || '|' || model) as fingerprint from installations cross join model_axes), d as (select distinct installation_id, decision_model as model, case when substr(installation_id, 1, 1) < '4' then null when substr(installation_id, 1, 1) < 'a' then sha256(installation_id || '|' || decision_model) else 'old' end as fingerprint from request_telemetry where decision_model is not null)"
R.add("plan_needs_run", lambda s, d: T.needs_run(*_plan(s, d), ["installation_id", "model"]), _PLAN + " select p.* from p left join d using (installation_id, model) where d.model is null or (d.fingerprint is not null and d.fingerprint <> p.fingerprint)")
_FOUR = ("input_tokens", "output_tokens", "actual_input_cost_usd", "turn_type")


def _batch(s: SparkSession, d: str, when: str) -> DataFrame:
    t = load(s, d, "request_telemetry", "row_id", "request_id", "span_type", "ts", "upstream_status_code", *_FOUR).where(when)
    return T.first_by(t, ["request_id", "span_type"], ["row_id"], [*_FOUR, "upstream_status_code"])


# what came up to the end of February is stored, what came from the beginning of February on comes in
_OLD, _NEW = "ts < timestamp_ntz '2025-03-01 00:00:00'", "ts >= timestamp_ntz '2025-02-01 00:00:00'"
_ONE = "select request_id, span_type, " + ", ".join(f"arg_min(struct_pack(v := {c}), row_id).v as {c}" for c in (*_FOUR, "upstream_status_code")) + " from request_telemetry where {} group by 1, 2"
R.add(
    "cache_write_status",
    lambda s, d: T.upsert_status(_batch(s, d, _OLD), _batch(s, d, _NEW), ["request_id", "span_type"], _FOUR, F.col("upstream_status_code") >= 500),
    f"with a as ({_ONE.format(_OLD.replace('_ntz', ''))}), b as ({_ONE.format(_NEW.replace('_ntz', ''))}) select coalesce(a.request_id, b.request_id) as request_id, coalesce(a.span_type, b.span_type) as span_type, case when b.request_id is null then 'kept' when coalesce(b.upstream_status_code >= 500, false) then 'failed' when a.request_id is null then 'new' when " + " and ".join(f"a.{c} is not distinct from b.{c}" for c in _FOUR) + " then 'duplicate' else 'updated' end as status from a full join b on a.request_id = b.request_id and a.span_type = b.span_type",
)
R.add("usage_fresh", lambda s, d: T.observed_last(load(s, d, "request_telemetry", "row_id", "installation_id", "ts", "upstream_latency_ms"), ["installation_id"], ["ts", "row_id"], ["upstream_latency_ms"], 3600).select("row_id", "upstream_latency_ms_seen"), "with l as (select row_id, ts, last_value(case when upstream_latency_ms is not null then {'v': upstream_latency_ms, 'at': ts} end ignore nulls) over (partition by installation_id order by ts, row_id rows between unbounded preceding and current row) as x from request_telemetry) select row_id, case when x.at >= ts - interval 3600 seconds then x.v end as upstream_latency_ms_seen from l")
R.add("soft_delete", lambda s, d: T.soft_delete(load(s, d, "api_keys", "api_key_id", "installation_id", "deleted_at"), load(s, d, "installations", "installation_id", "deleted_at").where("deleted_at is not null"), "installation_id").select("api_key_id", stamp("deleted_at")), "select api_key_id, strftime(coalesce(k.deleted_at, i.deleted_at), '%Y-%m-%d %H:%M:%S.%f') as deleted_at from api_keys k left join installations i using (installation_id)")
R.add("list_users", lambda s, d: T.newest(load(s, d, "request_feedback", "router_user_id", "updated_at").where("router_user_id is not null").groupBy("router_user_id").agg(F.max("updated_at").alias("updated_at")), "updated_at", "router_user_id", 50).select("router_user_id", stamp("updated_at")), "select router_user_id, strftime(u, '%Y-%m-%d %H:%M:%S.%f') as updated_at from (select router_user_id, max(updated_at) as u from request_feedback where router_user_id is not null group by 1 order by u desc, router_user_id desc limit 50)")
_NAMES = ("installations", "api_keys", "request_telemetry", "no_such_table")
R.add("table_exists_check", lambda s, d: present_tables(s, d, _NAMES), "select n as name, n in (select view_name from duckdb_views()) as present from (select unnest(" + str(list(_NAMES)) + ") as n)")
