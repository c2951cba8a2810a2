"""Queries over ordered calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymark.operators import sequences as S
from quaymark.plans.fixtures import oracle, view
from quaymark.plans.outcome_queries import rounded
from quaymark.plans.registry import Registry
from quaymark.sources.tables import load

R = Registry()
A = S.ACTIONS
W = "window w as (partition by session_key order by ts, call_id)"
BEFORE = "(partition by session_key order by ts, call_id rows between unbounded preceding and 1 preceding)"
UPTO = "(partition by session_key order by ts, call_id rows between unbounded preceding and current row)"


def q(name, fn, sql, digits=6):
    R.add(name, lambda s, d: rounded(fn(view(s, d, "calls")), digits=digits), oracle(sql, "calls"))


q("lag_onehot", S.lag_actions, "select call_id, " + ", ".join(f"coalesce(lag(action, {k}) over w, 'none') as prev_{k}" for k in range(1, 6)) + f" from calls {W}")
for _k in (5, 12):
    q(f"lastk_hist_{_k}", lambda c, k=_k: S.last_k_counts(c, k), "select call_id, " + ", ".join(f"cast(count(*) filter (action = '{a}') over (partition by session_key order by ts, call_id rows between {_k} preceding and 1 preceding) as bigint) as n_{a}" for a in A) + " from calls")
q("cum_frac", S.cumulative_share, "select call_id, " + ", ".join(f"round(coalesce(count(*) filter (action = '{a}') over {BEFORE} / nullif(count(*) over {BEFORE}, 0), 0), 6) as share_{a}" for a in A) + " from calls")
q("since_last", S.since_last, f", p as (select *, row_number() over w as pos from calls {W}) select call_id, " + ", ".join(f"round(ln(1 + least(coalesce(pos - max(case when action = '{a}' then pos end) over {BEFORE}, 50), 50)), 6) as since_{a}" for a in A) + " from p")
q("streak", lambda c: S.runs(c, F.col("action")).select("call_id", "streak"), f", m as (select *, case when lag(action) over w = action then 0 else 1 end as n from calls {W}), g as (select *, sum(n) over {UPTO} as g from m) select call_id, row_number() over (partition by session_key, g order by ts, call_id) as streak from g")
q("action_entropy", S.action_entropy, f", n as (select call_id, count(*) over {UPTO} as n, " + ", ".join(f"count(*) filter (action = '{a}') over {UPTO} as {a}" for a in A) + " from calls) select call_id, round(-(" + " + ".join(f"case when {a} > 0 then {a} / n * ln({a} / n) else 0 end" for a in A) + "), 6) + 0 as entropy from n")
q("time_gap", S.time_gaps, f", g as (select call_id, lag(ts) over w as b, ts, min(ts) over (partition by session_key) as st from calls {W}) select call_id, round(case when b is null then -1 else ln(1 + (epoch_us(ts) - epoch_us(b)) / 1e6) end, 6) as gap, coalesce((epoch_us(ts) - epoch_us(b)) / 1e6 > 300, false) as long_gap, round(ln(1 + (epoch_us(ts) - epoch_us(st)) / 1e6), 6) as since_start from g")
q("out_tokens", S.token_lags, f"select call_id, round(ln(1 + coalesce(lag(output_tokens) over w, 0)), 6) as prev, round(ln(1 + coalesce(lag(output_tokens, 2) over w, 0)), 6) as prev2, round(ln(1 + coalesce(avg(output_tokens) over {BEFORE}, 0)), 6) as mean from calls {W}")


def busy(name, fn, sql):
    R.add(name, lambda s, d: rounded(fn(view(s, d, "busy"))), oracle(sql, "busy"))


_SEG = f", sg as (select *, sum(cast(user_turn as int)) over {UPTO} as part from busy)"
_LAST = "(partition by session_key{0} order by ts, call_id rows between {1} preceding and current row)"
_PART = ", part"
busy("loop_repeat", lambda c: S.repeated_calls(c, reset="user_turn"), _SEG + f", l as (select *, list(sig) over {_LAST.format(_PART, 9)} as sigs from sg), m as (select session_key, call_id, list_max(list_transform(list_distinct(sigs), lambda s: len(list_filter(sigs, lambda x: x = s)))) as most from l) select session_key, call_id, cast(most as bigint) as most from m where most >= 5")
busy("loop_cyclic", S.cyclic_calls, f", l as (select session_key, call_id, count(*) over {_LAST.format('', 29)} as n, len(list_distinct(list(sig) over {_LAST.format('', 29)})) as kinds, count(*) filter (action = 'edit') over {_LAST.format('', 29)} as edits from busy) select session_key, call_id, n, cast(kinds as bigint) as kinds from l where n >= 24 and kinds / n < 0.4e0 and edits = 0")
busy("no_progress", S.no_progress, f", l as (select *, list(struct_pack(s := sig, t := ts)) over {_LAST.format('', 7)} as last from busy), m as (select session_key, call_id, len(list_filter(last, lambda x: x.s = sig and x.t >= ts - interval 90 seconds)) as same from l) select session_key, call_id, cast(same as bigint) as same from m where same >= 5")
_MONO = f", mo as (select *, row_number() over w as pos from busy {W}), mono as (select *, pos - coalesce(max(case when has_tool then pos when user_turn then pos - 1 end) over {UPTO}, 0) as monologue from mo)"
busy("monologue", lambda c: S.monologue(c).select("call_id", "monologue"), _MONO + " select call_id, monologue from mono")
busy(
    "spiral_signals", S.spiral_signals,
    _MONO + f""", p as (select *, case when coalesce(lag(is_error) over w = is_error, false) then 0 else 1 end as n, 1 - len(list_distinct(list(sig) over {_LAST.format('', 11)})) / count(*) over {_LAST.format('', 11)} as share,
 count(*) filter (action = 'edit') over (partition by session_key, path order by ts, call_id rows between unbounded preceding and current row) as edits from mono {W}),
g as (select *, sum(n) over {UPTO} as g from p), r as (select *, row_number() over (partition by session_key, g order by ts, call_id) as streak from g),
h as (select session_key, pos, unnest([case when is_error and streak >= 3 then 'error_streak' end, case when action = 'edit' and edits >= 5 then 'same_file' end, case when share >= 0.34e0 and pos >= 20 then 'repeats' end, case when monologue >= 4 then 'monologue' end]) as reason from r where pos >= 12)
select session_key, reason, min(pos) as first_pos from h where reason is not null group by 1, 2""",
)
busy("compaction_detect", lambda c: S.compactions(c, ["message_count", "tool_count"]), f", l as (select *, lag(message_count) over w as message_count_before, lag(tool_count) over w as tool_count_before from busy {W}) select session_key, call_id, message_count_before, tool_count_before from l where (message_count < message_count_before and message_count_before >= 8) or (tool_count < tool_count_before and tool_count_before >= 8)")
_RESULT = "case call_id % 6 when 0 then 'ok' when 1 then 'Traceback (most recent call last): x' when 2 then '3 FAILED' when 3 then concat(repeat('.', 2040), ' error: late') when 4 then concat(repeat('.', 2041), ' error: too late') else 'all fine' end"
busy("tool_errors", lambda c: S.tool_errors(c.selectExpr("session_key", "ts", "call_id", "is_error", f"{_RESULT} as text"), "is_error", "text"), f", r as (select session_key, ts, call_id, is_error or (substr(t, 1, 2048) like '%Traceback (most recent call last)%' or substr(t, 1, 2048) like '%FAILED%' or substr(t, 1, 2048) like '%Error:%' or substr(t, 1, 2048) like '%error:%') as bad from (select *, {_RESULT} as t from busy)), b as (select *, sum(case when bad then 0 else 1 end) over (partition by session_key order by ts desc, call_id desc) as g from r) select session_key, count(*) as total, count(*) filter (bad) as errored, count(*) filter (bad and g = 0) as trailing_streak from b group by 1")
busy("distinct_actions", S.distinct_actions, f" select call_id, case when row_number() over w = 1 then 0 else 6 end as distinct_actions from busy {W}")
busy("ext_bucket", lambda c: c.select("call_id", S.extension_class(F.col("path")).alias("bucket")), " select call_id, case call_id % 5 when 0 then 'code' when 1 then 'config' when 2 then 'docs' when 3 then 'none' else 'data' end as bucket from busy")
_TOOL = "case call_id % 7 when 0 then 'Read' when 1 then 'ApplyPatch' when 2 then 'Bash' when 3 then 'TaskList' when 4 then 'mcp__files__read' when 5 then '' end"
busy("action_of_tool", lambda c: c.select("call_id", S.action_of(F.expr(_TOOL)).alias("action")), " select call_id, ['explore', 'edit', 'execute', 'orchestrate', 'integrate', 'reason', 'reason'][call_id % 7 + 1] as action from busy")
busy("turn_window48", lambda c: S.turn_window(S.positions(c).withColumn("role", F.when((F.col("session_key") % 120 == 0) & F.col("user_turn"), "user").when((F.col("session_key") % 240 == 60) & (F.col("pos") == 2), "user").otherwise("assistant")), "session_key", "pos", "role").select("session_key", "call_id"), f", t as (select *, row_number() over w as pos, count(*) over (partition by session_key) as n from busy {W}), u as (select *, case when session_key % 120 = 0 and user_turn then 'user' when session_key % 240 = 60 and pos = 2 then 'user' else 'assistant' end as role from t), b as (select *, case when n <= 48 then 1 else coalesce(min(case when role = 'user' and pos > n - 48 then pos end) over s, max(case when role = 'user' and pos <= n - 48 then pos end) over s) end as begin from u window s as (partition by session_key)) select session_key, call_id from b where pos >= begin")
busy("ranked_fallback", lambda c: S.ranked_fallback(c.selectExpr("session_key", "concat('g', cast(call_id % 6 as string)) as grp", "call_id % 6 as ord", "call_id % 5 / 10 as probability", "call_id % 4 = 1 as eligible").groupBy("session_key", "grp", "ord").agg(F.max("probability").alias("probability"), F.bool_or("eligible").alias("eligible")), "session_key"), ", g as (select session_key, 'g' || call_id % 6 as grp, call_id % 6 as ord, max(call_id % 5 / 10) as probability, bool_or(call_id % 4 = 1) as eligible from busy group by 1, 2, 3), r as (select *, row_number() over (partition by session_key order by probability desc, ord) as place from g), f as (select *, row_number() over (partition by session_key order by place) as rn from r where eligible) select session_key, grp, round(probability, 6) as probability, place from f where rn = 1")
R.add(
    "update_usage_switch",
    lambda s, d: S.model_switches(load(s, d, "request_telemetry", "row_id", "session_id", "ts", "decision_model").where("session_id is not null and decision_model is not null"), "session_id", "ts", "row_id", "decision_model").select("row_id", "turn_count", "has_ever_switched", "last_served_model"),
    "with l as (select *, lag(decision_model) over w as prev, row_number() over w as turn_count from request_telemetry where session_id is not null and decision_model is not null window w as (partition by session_id order by ts, row_id)) select row_id, turn_count, bool_or(coalesce(prev <> decision_model, false)) over (partition by session_id order by ts, row_id) as has_ever_switched, prev as last_served_model from l",
)
R.add("pin_ttl", lambda s, d: S.sessions(view(s, d, "calls"), ["session_key"], "ts", 86_400).select("session_key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n"), oracle(", l as (select session_key, ts, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by session_key order by ts)) < 86400000000 then 0 else 1 end as b from calls), g as (select *, sum(b) over (partition by session_key order by ts rows unbounded preceding) as g from l) select session_key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as end, count(*) as n from g group by session_key, g", "calls"))
