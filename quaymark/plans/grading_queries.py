"""Queries with graders.  Their answers are built case by case, so the oracle states each result instead of deriving it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymark.functions import graders as N
from quaymark.functions import grading as G
from quaymark.functions import text as X
from quaymark.plans.outcome_queries import rounded
from quaymark.plans.registry import Registry
from quaymark.sources.tables import load

R = Registry()

_B = "concat(chr(92), 'boxed{')"
_LETTER = "substr('ABCDEFGHIJ', CAST(doc_id % 10 AS INT) + 1, 1)"
_N = "CAST(doc_id % 7 AS VARCHAR(20))"
#: What a model said, eight forms by doc_id, and the right answer, which fits some of them.
_SAID = f"""CASE doc_id % 8 WHEN 0 THEN concat('so we get Answer: ', {_LETTER}) WHEN 1 THEN concat('first Answer: Z, then ANSWER : $', {_LETTER}, '. Done')
 WHEN 2 THEN concat('thus ', {_B}, {_N}, '}} and ', {_B}, 'no}}') WHEN 3 THEN concat('hence ', {_B}, chr(92), 'dfrac{{', {_N}, '}}{{4}}}} done') WHEN 4 THEN concat('Final Answer', chr(10), chr(10), '42', chr(10), 'bye')
 WHEN 5 THEN '  C' WHEN 6 THEN 'there is nothing to be said' ELSE concat('x ', {_B}, ' {{a}} open') END"""


def said(s, d):
    return load(s, d, "documents", "doc_id").selectExpr("doc_id", f"{_SAID} AS text", f"{_LETTER} AS letter", f"{_N} AS number")


def add(name, column, expected):
    R.add(name, lambda s, d: said(s, d).select("doc_id", column().alias("x")), f"select doc_id, {expected} as x from documents")


add("boxed", lambda: G.boxed(F.col("text")), f"case doc_id % 8 when 2 then {_N} when 3 then '\\dfrac{{' || {_N} || '}}{{4}}' when 7 then '{{a}} open' else '' end")
add("answer_patterns", lambda: X.last_match(F.col("text"), G.letter_pattern("J")), f"case when doc_id % 8 in (0, 1) then {_LETTER} end")
add("normal_answer", lambda: G.normal_answer(F.col("text"), G.letter_pattern("J")), f"case doc_id % 8 when 0 then {_LETTER} when 1 then {_LETTER} when 2 then {_N} when 3 then '\\dfrac{{' || {_N} || '}}{{4}}' when 4 then '42' when 5 then 'C' when 6 then '' else '{{a}} open' end")
for _last, _places in (("B", "0, 1"), ("D", "0, 1, 2, 3"), ("J", "0, 1, 2, 3, 4, 5, 6, 7, 8, 9")):
    add(f"grade_exact_{_last.lower()}", lambda last=_last: G.grade_choice_text(F.col("text"), F.col("letter"), last), f"case when doc_id % 8 in (0, 1) and doc_id % 10 in ({_places}) then 1.0e0 when doc_id % 8 = 5 and doc_id % 10 = 2 then 1.0e0 else 0.0e0 end")
add("grade_math", lambda: G.grade_math(F.col("text"), F.expr("case doc_id % 8 when 3 then concat(cast(doc_id % 7 / 4 as string), '') when 4 then '42.0' when 2 then number else '7' end")), "case when doc_id % 8 in (2, 3, 4) then 1.0e0 else 0.0e0 end")
add("grade_finqa", lambda: G.grade_finance(F.col("text"), F.expr("case when doc_id % 8 = 2 then concat(cast(doc_id % 7 as string), '.4 percent') when doc_id % 8 = 3 then concat(cast(doc_id % 7 as string), '/4') else 'open' end")), "case when doc_id % 8 = 2 or doc_id % 8 = 3 then 1.0e0 else 0.0e0 end")
_GRID = "concat('I see [[1, 2], [3]] and [9] so [[', CAST(doc_id % 3 AS VARCHAR(20)), ', 2],', chr(10), ' [3, -4]]. ', CASE doc_id % 4 WHEN 0 THEN '[[1, 2], [3]]' WHEN 1 THEN '[]' ELSE 'end' END)"
R.add("grade_grid", lambda s, d: load(s, d, "documents", "doc_id").select("doc_id", G.grade_grid(F.expr(_GRID), F.lit("[[1,2],[3,-4]]")).alias("x")), "select doc_id, case when doc_id % 3 = 1 then 1.0e0 else 0.0e0 end as x from documents")
_LABELS = ["A>>B", "A>B", "A=B", "B=A", "B>A", "B>>A"]
_ARENA = "concat('better: [[', element_at(array('A>>B', 'A>B', 'A=B', 'B=A', 'B>A', 'B>>A'), cast({0} % 6 as int) + 1), ']]')"
R.add(
    "arena_score",
    lambda s, d: load(s, d, "documents", "doc_id").select("doc_id", G.arena_score(G.arena_label(F.expr(_ARENA.format("doc_id"))), G.arena_label(F.expr(f"case when doc_id % 11 > 0 then {_ARENA.format('(doc_id - doc_id % 6) / 6')} else 'can not say' end"))).alias("x")),
    "with p as (select doc_id, [-3, -1, 0, 0, 1, 3][cast(doc_id % 6 as int) + 1] as a, [3, 1, 0, 0, -1, -3][cast((doc_id - doc_id % 6) / 6 % 6 as int) + 1] as b from documents) select doc_id, case when doc_id % 11 = 0 then 0.0e0 when a + b > 0 then 1.0e0 when a + b = 0 then 0.5e0 else 0.0e0 end as x from p",
)
R.add("grade_kk", lambda s, d: load(s, d, "documents", "doc_id").select("doc_id", G.grade_statements(F.expr("concat('Zoey is a knave at first. CONCLUSION: (1) Zoey is a knight, (2) Mo is a ', case when doc_id % 3 = 0 then 'knave' else 'knight' end, case when doc_id % 5 = 0 then ', Al is a knave' else '' end)"), F.lit("Mo is a knave; Zoey is a knight")).alias("x")), "select doc_id, case when doc_id % 3 = 0 and doc_id % 5 <> 0 then 1.0e0 else 0.0e0 end as x from documents")
R.add("node_text", lambda s, d: rounded(load(s, d, "request_telemetry", "row_id", "candidate_models").select("row_id", G.node_text_similarity(F.col("candidate_models"), F.array(F.lit("orrin-4-mini"), F.lit("Basalt-9b quillon-2"))).alias("x"))), "with w as (select row_id, list_distinct(list_filter(string_split(lower(array_to_string(candidate_models, ' ')), ' '), lambda v: v <> '')) as a, ['orrin-4-mini', 'basalt-9b', 'quillon-2'] as b, candidate_models from request_telemetry) select row_id, round(case when length(trim(coalesce(array_to_string(candidate_models, ' '), ''))) >= 3 then len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) else 0 end, 6) as x from w")
_DOMAINS = ("code", "math", "writing", "facts", "chat", "other")
R.add("score_onehot", lambda s, d: rounded(said(s, d).select("doc_id", F.posexplode(G.score_onehot(F.col("doc_id") % 11, F.col("doc_id") % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in _DOMAINS]), (F.col("doc_id") % 6 + 1).cast("int")), _DOMAINS)).alias("i", "x")).select("doc_id", F.col("i").cast("long").alias("i"), "x")), "select doc_id, i, case i when 0 then round(doc_id % 11 / 10.0e0, 6) when 1 then cast(doc_id % 2 = 0 as int)::double else cast(doc_id % 6 = i - 2 as int)::double end as x from documents, range(8) t(i)")
R.add("knobs_hash", lambda s, d: load(s, d, "installations", "installation_id", "routing_quality_weight").select("installation_id", G.knobs_hash(F.array(F.coalesce("routing_quality_weight", F.lit(0.5)), F.lit(0.25)), F.lit(0.1), F.lit(2.0), F.lit(500), F.lit(True)).alias("k")))
_BENCH = ("mmlupro", "winogrande", "math500", "nothing")
R.add("grade_by_name", lambda s, d: said(s, d).select("doc_id", N.grade_by_name(F.element_at(F.array(*[F.lit(b) for b in _BENCH]), (F.col("doc_id") % 4 + 1).cast("int")), F.col("text"), F.when(F.col("doc_id") % 4 == 2, F.col("number")).otherwise(F.col("letter"))).alias("x")), "select doc_id, case doc_id % 4 when 3 then null when 2 then case when doc_id % 8 = 2 then 1.0e0 else 0.0e0 end when 1 then case when (doc_id % 8 = 1 and doc_id % 10 in (0, 1)) or (doc_id % 8 = 5 and doc_id % 10 = 2) then 1.0e0 else 0.0e0 end else case when doc_id % 8 = 0 then 1.0e0 else 0.0e0 end end as x from documents")


def _server_events(s, d):
    N.register(s)
    body = "concat('event: a\\ndata: ', event_id, '\\n\\n', case when event_id % 2 = 0 then 'data: x\\ndata: y\\r\\n\\r\\n' else ': ping\\n\\n' end)"
    return s.sql(f"select e.event_id, t.place, t.event, t.data from {{e}} e, lateral server_events({body}) t", e=load(s, d, "events", "event_id"))


R.add("server_events", _server_events, "select event_id, 0 as place, 'a' as event, cast(event_id as varchar) as data from events union all select event_id, 1, 'message', 'x' || chr(10) || 'y' from events where event_id % 2 = 0")
