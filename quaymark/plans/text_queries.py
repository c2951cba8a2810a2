"""Queries with text functions, splits and adaptors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import text as X
from quaymark.operators import adapt as A
from quaymark.operators import splits as S
from quaymark.operators.joins import small
from quaymark.plans.fixtures import oracle, view
from quaymark.plans.outcome_queries import rounded
from quaymark.plans.registry import Registry
from quaymark.session import ensure_checkpoint_dir
from quaymark.sources import files as Z
from quaymark.sources import results as B
from quaymark.sources.tables import load

R = Registry()


def docs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents", "doc_id", "text").where("text is not null")


_DOCS = "select doc_id, {} from documents where text is not null"
_N = r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g')"
# white space as one engine and the other see it: ASCII only
R.add("norm_prompt", lambda s, d: docs(s, d).select("doc_id", F.sha2(X.normal_prompt(F.col("text")), 256).alias("k")), _DOCS.format(f"sha256({_N}) as k"))
R.add("prompt_key", lambda s, d: docs(s, d).groupBy(X.prompt_key(F.col("text")).alias("prompt_key")).count().withColumnRenamed("count", "n"), f"select sha256({_N}) as prompt_key, count(*) as n from documents where text is not null group by 1")
R.add("tail_truncate", lambda s, d: docs(s, d).select("doc_id", F.sha2(X.tail(F.col("text")), 256).alias("k"), F.length(X.tail(F.col("text"))).cast("long").alias("n")), _DOCS.format("sha256(case when length(text) > 1024 then substr(text, length(text) - 1023) else text end) as k, least(length(text), 1024) as n"))
_ALIASES = {"orrin-4-mini": "orrin-4", "basalt-9b": "basalt"}
R.add("norm_model_name", lambda s, d: load(s, d, "request_telemetry", "decision_model").distinct().select("decision_model", X.model_name(F.col("decision_model"), _ALIASES).alias("name")), "select decision_model, case n when 'orrin-4-mini' then 'orrin-4' when 'basalt-9b' then 'basalt' else n end as name from (select distinct decision_model, regexp_replace(lower(trim(decision_model, ' ')), '[ _]+', '-', 'g') as n from request_telemetry)")
R.add("tail_bytes", lambda s, d: docs(s, d).select("doc_id", F.sha2(X.tail_bytes(F.col("text")), 256).alias("k")), r"with b as (select doc_id, text, hex(encode(text)) as h, octet_length(encode(text)) as n from documents where text is not null), c as (select *, substr(h, n * 2 - 2047, 2048) as t from b) select doc_id, case when n <= 1024 then sha256(text) else sha256(decode(unhex(case when substr(t, 1, 1) not in ('8', '9', 'A', 'B') then t when substr(t, 3, 1) not in ('8', '9', 'A', 'B') then substr(t, 3) when substr(t, 5, 1) not in ('8', '9', 'A', 'B') then substr(t, 5) else substr(t, 7) end))) end as k from c")
R.add("prompt_text", lambda s, d: docs(s, d).select("doc_id", F.sha2(X.prompt_text(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('["turn ","'), "doc_id", F.lit('"]'))).otherwise(F.col("text"))), 256).alias("k")), _DOCS.format("sha256(case when doc_id % 2 = 0 then 'turn ' || chr(10) || doc_id else text end) as k"))
R.add("coerce_score", lambda s, d: load(s, d, "events", "event_id", "value").select("event_id", X.coerce_score(F.expr("case event_id % 6 when 0 then null when 1 then 'true' when 2 then 'false' when 3 then cast(event_id as string) when 4 then '0.5' else '\"half\"' end")).alias("score")).where("score is not null"), "select event_id, case event_id % 6 when 1 then 1.0e0 when 3 then cast(event_id as double) when 4 then 0.5e0 else 0.0e0 end as score from events where event_id % 6 <> 5")
R.add("family_map", lambda s, d: load(s, d, "documents", "doc_id").select("doc_id", X.benchmark_family(F.element_at(F.array(*[F.lit(x) for x in ("MMLU-law", "chinese-poems", "mtbench-math", "hellaswag", "grade-school-math", "arc-challenge", "winogrande", "mbpp", "bias")]), (F.col("doc_id") % 9 + 1).cast("int"))).alias("family")), "select doc_id, ['mmlu', 'chinese', 'mtbench', 'hellaswag', 'gsm8k', 'arc', 'winogrande', 'mbpp', 'misc'][cast(doc_id % 9 as int) + 1] as family from documents")
R.add("canonical_json", lambda s, d: load(s, d, "events", "event_id", "event_type").select("event_id", F.sha2(X.canonical_json(F.expr("case event_id % 3 when 0 then concat('{\"b\": {\"z\":1, \"a\": [2, 1]}, \"a\": \"', event_type, '\"}') when 1 then concat('{\"a\":\"', event_type, '\",\"b\":{\"a\":[2,1],\"z\":1}}') else '{broken' end")), 256).alias("k")), """select event_id, case when event_id % 3 < 2 then sha256('{"a":"' || event_type || '","b":{"a":[2,1],"z":1}}') end as k from events""")
R.add("cache_key", lambda s, d: load(s, d, "events", "event_id", "event_type").select("event_id", X.cache_key({"model": F.lit("m-1"), "input": F.col("event_type"), "temperature": F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 3), "user": F.col("event_id")}, ["temperature", "model", "input"]).alias("k")), """select event_id, sha256('{"input":"' || event_type || '","model":"m-1"' || case when event_id % 2 = 0 then ',"temperature":' || event_id % 3 else '' end || '}') as k from events""")
_FLAGS = {"tool": r"(^\s*/|\b(tool|tool call|bash|shell|command|script)\b)", "search": r"\b(search|grep|rg|ripgrep|find|read|open|cat|ls|list|inspect|scan|look through|look at)\b", "explore": r"\b(explore|scour|inventory|survey|map out|read through|background agent|subagent)\b", "edit": r"\b(edit|write|create|implement|fix|patch|change|refactor|update)\b", "test": r"\b(run|execute|test|pytest|npm test|smoke test|validate|verify|check)\b"}
R.add("intent_flags", lambda s, d: load(s, d, "request_telemetry", "row_id", "embed_input").where("embed_input is not null").select("row_id", *[c.alias(k) for k, c in X.intent_flags(F.col("embed_input")).items()]), "with f as (select row_id, " + ", ".join(f"regexp_matches(embed_input, '(?i){p}') as {k}" for k, p in _FLAGS.items()) + " from request_telemetry where embed_input is not null) select *, not (" + " or ".join(_FLAGS) + ") as none from f")
R.add("tool_family", lambda s, d: load(s, d, "events", "event_id").select("event_id", *[c.alias(k) for k, c in X.tool_family_flags(F.expr("array('Read', case event_id % 4 when 0 then 'Bash' when 1 then 'mcp__ripgrep' when 2 then 'ApplyPatch' else 'SpawnAgent' end)")).items()]), "select event_id, event_id % 4 = 0 as bash, true as read, event_id % 4 = 1 as search, event_id % 4 = 2 as edit, event_id % 4 = 3 as task from events")
R.add("corpus_build", lambda s, d: load(s, d, "documents", "doc_id", "source").select("doc_id", F.sha2(X.with_options(F.concat(F.lit("Which one is "), F.col("doc_id"), F.lit("?")), F.array(F.lit("one"), F.lit("two"), F.concat(F.lit("n"), "doc_id")), "Think briefly, then finish with exactly: Answer: <letter>"), 256).alias("k")), "select doc_id, sha256('Which one is ' || doc_id || '?' || chr(10) || chr(10) || 'A. one' || chr(10) || 'B. two' || chr(10) || 'C. n' || doc_id || chr(10) || chr(10) || 'Think briefly, then finish with exactly: Answer: <letter>') as k from documents")
R.add("strip_date_suffix", lambda s, d: load(s, d, "model_axes", "model").select("model", X.without_date(F.concat("model", F.lit("-20250131"))).alias("bare")), "select model, regexp_replace(model || '-20250131', '[-@](20\\d{6}|20\\d\\d-\\d\\d-\\d\\d)$', '') as bare from model_axes")
R.add("family_version", lambda s, d: load(s, d, "model_axes", "model").select("model", X.family(F.col("model")).alias("family"), X.version(F.col("model")).alias("version")), "select model, regexp_extract(model, '^([a-z]+(?:-[a-z]+)*)', 1) as family, regexp_extract(model, '([0-9]+(?:\\.[0-9]+)?)', 1) as version from model_axes")
_CODE, _MATH = r"(```|\bdef\b|\bclass\b|\breturn\b|\bimport\b|[{};])", r"([=+\-*/^<>]|\\frac|\\sum|\d+\.\d+)"
_cnt = lambda p: f"len(regexp_extract_all(text, '{p}'))"
_shr = lambda p, k=1: f"round(coalesce({k} * {_cnt(p)} / nullif(length(text), 0), 0), 6)"
R.add(
    "text_features",
    lambda s, d: rounded(docs(s, d).select("doc_id", *[c.alias(n) for n, c in X.features(F.col("text")).items()])),
    _DOCS.format(
        f"round(length(text) / 1000, 6) as len_k, round(ln(1 + length(text)), 6) as log_len, {_cnt(chr(10))} + 1 as n_lines, {_cnt(chr(92) + 'S+')} as n_words, round(coalesce({_cnt(chr(92) + 'S')} / nullif({_cnt(chr(92) + 'S+')}, 0), 0), 6) as avg_word_len, {_shr(chr(92) + 'p{Nd}')} as frac_digits, {_shr('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} as frac_nonascii, {_shr('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]')} as frac_punct, {_shr(chr(92) + 'p{Lu}')} as frac_upper, {_shr(_CODE, 1000)} as code_hits_k, {_shr(_MATH, 1000)} as math_hits_k, cast(regexp_matches(text, '\\?\\s*$') as int)::double as is_question"
    ),
)
KEYS = {"work": ["token", "router", "cost"], "talk": ["judge", "memory"]}
R.add("kw_features", lambda s, d: rounded(docs(s, d).select("doc_id", *[c.alias(n) for n, c in X.keyword_features(F.col("text"), KEYS).items()])), "with h as (select doc_id, greatest(len(regexp_extract_all(text, '\\S+')), 1) as n, " + ", ".join(" + ".join(f"cast(contains(lower(text), '{k}') as bigint)" for k in ks) + f" as {name}_hits" for name, ks in KEYS.items()) + " from documents where text is not null) select doc_id, " + ", ".join(f"{name}_hits, round({name}_hits / n, 6) as {name}_ratio" for name in KEYS) + " from h")
_ANS = r"replace(upper(list_extract(regexp_extract_all(text, '(?i)answer:?\s*\(?([A-Za-z]\b|-?[0-9][0-9,.]*)', 1), -1)), ',', '')"
R.add("extract_answer", lambda s, d: view(s, d, "answers").select("doc_id", X.answer(F.col("text")).alias("answer")), oracle(f"select doc_id, {_ANS} as answer from answers", "answers"))
R.add("grade_mcq", lambda s, d: view(s, d, "answers").select("doc_id", X.grade_choice(X.answer(F.col("text")), F.col("gold")).alias("score")), oracle(f"select doc_id, coalesce(cast(upper({_ANS}) = upper(gold) as double), 0) as score from answers", "answers"))
R.add("grade_number", lambda s, d: view(s, d, "answers").select("doc_id", X.grade_number(X.answer(F.col("text")), F.col("gold")).alias("score")), oracle(f"select doc_id, coalesce(cast(abs(try_cast({_ANS} as double) - try_cast(gold as double)) < 1e-6 as double), 0) as score from answers", "answers"))
R.add("extract_code", lambda s, d: docs(s, d).select("doc_id", F.sha2(X.code_block(F.col("text")), 256).alias("k")), _DOCS.format(r"sha256(coalesce(list_extract(regexp_extract_all(text, '(?s)```[a-zA-Z0-9_+-]*\n(.*?)```', 1), -1), text)) as k"))
_NORM = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_PAIRS = "CASE doc_id % 6 WHEN 0 THEN 'The answer: A, b!' WHEN 1 THEN 'yes' WHEN 2 THEN 'No.' WHEN 3 THEN '' WHEN 4 THEN concat('reasoning ', CAST(doc_id % 10 AS VARCHAR(20)), ' reasoning') ELSE 'B b b answer' END AS got, CASE doc_id % 5 WHEN 0 THEN 'answer  B' WHEN 1 THEN 'no' WHEN 2 THEN 'yes it is' WHEN 3 THEN 'reasoning 3 reasoning' ELSE 'b answer b' END AS gold"
R.add("em_normalised", lambda s, d: load(s, d, "documents", "doc_id").selectExpr("doc_id", *_PAIRS.split(", CASE")[:1], "CASE" + _PAIRS.split(", CASE")[1]).select("doc_id", (X.normal_answer(F.col("got")) == X.normal_answer(F.col("gold"))).alias("em")), f"select doc_id, {_NORM('got')} = {_NORM('gold')} as em from (select doc_id, {_PAIRS} from documents)")
R.add("token_f1", lambda s, d: rounded(load(s, d, "documents", "doc_id").selectExpr("doc_id", *_PAIRS.split(", CASE")[:1], "CASE" + _PAIRS.split(", CASE")[1]).select("doc_id", X.token_overlap(F.col("got"), F.col("gold")).alias("o")).select("doc_id", "o.*")), rf"""with p as (select doc_id, {_NORM('got')} as a, {_NORM('gold')} as b from (select doc_id, {_PAIRS} from documents)),
w as (select *, list_filter(string_split(a, ' '), lambda v: v <> '') as x, list_filter(string_split(b, ' '), lambda v: v <> '') as y from p),
n as (select *, case when (a in ('yes', 'no', 'noanswer') or b in ('yes', 'no', 'noanswer')) and a <> b then 0 else coalesce(list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))), 0) end as same from w)
select doc_id, round(coalesce(2.0 * same / nullif(len(x) + len(y), 0), 0), 6) as f1, round(coalesce(same / nullif(len(x), 0), 0), 6) as precision, round(coalesce(same / nullif(len(y), 0), 0), 6) as recall from n""")
R.add("json_path", lambda s, d: load(s, d, "events", "event_id", "props").select("event_id", X.json_path(F.col("props"), "k").alias("k"), X.json_path(F.col("props"), "a.b[0].c").alias("none")), "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.a.b[0].c') as none from events")
R.add("parse_score_json", lambda s, d: load(s, d, "events", "event_id", "props").select("event_id", X.score_json(F.concat(F.lit("Sure: "), "props"), "k").alias("score")), "select event_id, greatest(0, least(10, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0))) as score from events")
_USAGE = "concat('event: x', chr(10), 'data: ', case event_id % 6 when 0 then concat('{\"usage\": {\"input_tokens\": ', event_id, '}}') when 1 then concat('{\"message\": {\"usage\": {\"input_tokens\": ', event_id, '}}}') when 2 then concat('{\"response\": {\"usage\": {\"input_tokens\": ', event_id, '}}}') when 3 then concat('{\"usage\": {\"prompt_tokens\": ', event_id, '}}') when 4 then concat('{\"usageMetadata\": {\"promptTokenCount\": ', event_id, '}}') else '[DONE]' end, chr(13), chr(10))"
R.add("usage_extract", lambda s, d: load(s, d, "events", "event_id").select("event_id", B.usage_tokens(B.event_data(F.expr(_USAGE))).alias("tokens")), "select event_id, case when event_id % 6 < 5 then event_id end as tokens from events")
R.add("table_to_text", lambda s, d: load(s, d, "nation").select("n_nationkey", X.table_text(F.array(F.array("n_name", F.col("n_regionkey").cast("string")), F.array(F.lit("x"), F.lit("y")))).alias("t")), "select n_nationkey, '| ' || n_name || ' | ' || n_regionkey || ' |' || chr(10) || '| x | y |' as t from nation")
# all variants of the whole text; without an oracle, since engines differ in the case of some letters
R.add("perturb", lambda s, d: docs(s, d).select("doc_id", F.posexplode(X.variants(F.col("text"))).alias("i", "t")).select("doc_id", F.col("i").cast("long").alias("i"), F.sha2("t", 256).alias("k")))
_TURN = {"max_tokens": "case call_id % 11 when 0 then 3 when 1 then 100 when 2 then 256 end", "title": "call_id % 7 = 0", "system": "case when call_id % 5 = 0 then 'Now Your task is to create a DETAILED summary of it' else 'help' end", "sub": "call_id % 6 = 1", "last": "case when call_id % 4 = 2 then 'tool_result' else 'text' end"}
R.add("turn_type", lambda s, d: view(s, d, "busy").select("call_id", X.turn_type(F.expr(_TURN["max_tokens"]), F.col("has_tool"), F.expr(_TURN["title"]), F.expr(_TURN["system"]), F.expr(_TURN["sub"]), F.col("message_count") - 2, F.expr(_TURN["last"])).alias("kind")), oracle("select call_id, case when call_id % 11 = 0 then 'probe' when not has_tool and call_id % 7 = 0 then 'title' when call_id % 5 = 0 then 'compaction' when call_id % 6 = 1 then 'subagent' when not has_tool and call_id % 11 in (1, 2) and message_count - 2 between 1 and 3 then 'classifier' when call_id % 4 = 2 then 'tool_result' else 'main_loop' end as kind from busy", "busy"))
R.add("session_key", lambda s, d: load(s, d, "request_telemetry", "row_id", "api_key_id", "client_app", "embed_input").select("row_id", X.session_key(F.col("api_key_id"), F.when(F.col("row_id") % 3 > 0, F.col("client_app")), F.col("embed_input")).alias("k")), "select row_id, substr(sha256(encode(coalesce(api_key_id, '')) || unhex('00') || encode(case when row_id % 3 > 0 then coalesce(client_app, '') else '' end || coalesce(embed_input, ''))), 1, 32) as k from request_telemetry")
R.add("holdout_hash", lambda s, d: docs(s, d).select("doc_id", (X.hash_bucket(F.col("doc_id").cast("string"), 100) < 10).alias("held")), "select doc_id, ('0x' || substr(sha256(cast(doc_id as varchar)), 1, 8))::bigint % 100 < 10 as held from documents where text is not null")
R.add("usd_to_micros", lambda s, d: view(s, d, "outcomes").select("prompt_key", "model_name", X.usd_to_micros(F.when(F.col("ord") == 0, -F.col("cost")).when(F.col("ord") == 1, F.lit(float("nan"))).otherwise(F.col("cost"))).alias("micros")), oracle("select prompt_key, model_name, case when ord < 2 then 0 else cast(round(cost * 1e6) as bigint) end as micros from outcomes", "outcomes"))
R.add("kendall_sim", lambda s, d: rounded(load(s, d, "request_telemetry", "row_id", "candidate_models").where("candidate_models is not null").select("row_id", X.kendall(F.col("candidate_models"), F.concat(F.slice("candidate_models", 3, 99), F.slice("candidate_models", 1, 2))).alias("sim"))), "with e as (select row_id, unnest(candidate_models) as m, generate_subscripts(candidate_models, 1) as i, len(candidate_models) as n from request_telemetry where candidate_models is not null), p as (select row_id, m, min(i) as a, min(case when i > 2 then i - 2 else n - 2 + i end) filter (n > 2 or true) as b from e group by 1, 2), c as (select x.row_id, avg(case when x.b < y.b then 1.0e0 else 0.0e0 end) as sim from p x join p y on x.row_id = y.row_id and x.a < y.a group by 1) select t.row_id, round(coalesce(sim, 1.0e0), 6) as sim from request_telemetry t left join c using (row_id) where candidate_models is not null")
R.add("edge_jaccard", lambda s, d: rounded(load(s, d, "request_telemetry", "row_id", "candidate_models").where("candidate_models is not null").select("row_id", X.jaccard(F.col("candidate_models"), F.array(F.lit("orrin-4-mini"), F.lit("basalt-9b"), F.lit("quillon-2"))).alias("j"))), "select row_id, round(len(list_intersect(candidate_models, ['orrin-4-mini', 'basalt-9b', 'quillon-2'])) / len(list_distinct(candidate_models || ['orrin-4-mini', 'basalt-9b', 'quillon-2'])), 6) as j from request_telemetry where candidate_models is not null")

# splits
_B = "('0x' || substr(sha256({}), 1, 8))::bigint"
R.add("split_hash", lambda s, d: docs(s, d).select("doc_id", S.hash_split(X.prompt_key(F.col("text"))).alias("part")), f"with k as (select doc_id, {_B.format(chr(39) + 'split' + chr(39) + f' || sha256({_N})')} % 10000 as b from documents where text is not null) select doc_id, case when b < 7000 then 'train' when b < 8500 then 'validation' else 'test' end as part from k")
R.add("split_group_ratio", lambda s, d: S.ratio_split(view(s, d, "outcomes"), "dataset_id", "prompt_key", 0.7, ["ds9"]), oracle(f", p as (select distinct dataset_id, prompt_key from outcomes), r as (select *, row_number() over (partition by dataset_id order by {_B.format('prompt_key')} % 64, sha256(prompt_key)) as rn, count(*) over (partition by dataset_id) as n from p) select dataset_id, prompt_key, case when rn <= floor(n * 0.7e0) and dataset_id <> 'ds9' then 'train' else 'test' end as part from r", "outcomes"))
R.add("split_no_leak", lambda s, d: S.leaks(docs(s, d).select("text", S.hash_split(X.prompt_key(F.col("text"))).alias("part")), "text", "part").agg(F.count("*").alias("leaks")).withColumn("by", F.lit("prompt")).unionByName(S.leaks(docs(s, d).select("text", S.hash_split(F.col("doc_id").cast("string")).alias("part")), "text", "part").agg(F.count("*").alias("leaks")).withColumn("by", F.lit("record"))), f"with k as (select text, {_B.format(chr(39) + 'split' + chr(39) + ' || doc_id')} % 10000 as b from documents where text is not null), l as (select text from k group by 1 having count(distinct case when b < 7000 then 0 when b < 8500 then 1 else 2 end) > 1) select 'prompt' as by, cast(0 as bigint) as leaks union all select 'record', count(*) from l")
R.add("sample_hash_topn", lambda s, d: S.first_by_hash(docs(s, d).select(F.col("doc_id").cast("string").alias("k")), "k", 50), "select cast(doc_id as varchar) as k from documents where text is not null order by sha256(cast(doc_id as varchar)) limit 50")
R.add("sample_per_category", lambda s, d: S.per_group(load(s, d, "documents", "doc_id", "source").where("source is not null").withColumn("k", F.col("doc_id").cast("string")), "source", "k", 3).select("source", "k"), "select source, k from (select source, cast(doc_id as varchar) as k, row_number() over (partition by source order by sha256(cast(doc_id as varchar))) as rn from documents where source is not null) where rn <= 3")
R.add("cap_per_dataset", lambda s, d: S.cap_per_group(view(s, d, "outcomes"), "dataset_id", "prompt_key", "record_index", 5), oracle(", f as (select dataset_id, prompt_key, min(record_index) as o from outcomes group by 1, 2) select dataset_id, prompt_key from (select *, row_number() over (partition by dataset_id order by o) as rn from f) where rn <= 5", "outcomes"))

# adaptors
R.add("adapt_avengers", lambda s, d: A.prompt_items(view(s, d, "sparse")).select("dataset_id", "prompt_key", "index", F.array_join(F.transform(F.map_entries("records"), lambda e: F.concat_ws(":", e["key"], F.round(e["value"], 2).cast("string"))), ",").alias("records")), oracle("select dataset_id, prompt_key, min(record_index) as \"index\", string_agg(model_name || ':' || cast(round(score, 2) as varchar), ',' order by model_name) as records from sparse group by 1, 2", "sparse"))
R.add("adapt_embedllm", lambda s, d: A.label_matrix(view(s, d, "sparse")), oracle(", p as (select prompt_key, row_number() over (order by prompt_key) - 1 as prompt_id from (select distinct prompt_key from sparse)), m as (select model_name, row_number() over (order by model_name) - 1 as model_id from (select distinct model_name from sparse)) select prompt_id, model_id, cast(case when score > 0 then 1 else 0 end as bigint) as label from p cross join m left join sparse using (prompt_key, model_name)", "sparse"))
R.add("adapt_graphrouter", lambda s, d: rounded(A.graph_rows(view(s, d, "sparse"))), oracle("select dataset_id, prompt_key, model_name, round(score, 6) as score, round(cost, 6) as cost, round(coalesce((cost - min(cost) over w) / nullif(max(cost) over w - min(cost) over w, 0), 0), 6) as cost_scaled from sparse window w as (partition by dataset_id)", "sparse"))
R.add("adapt_hybridllm", lambda s, d: A.candidate_pairs(view(s, d, "sparse"), "ASIA", "EUROPE").select("prompt_key", F.col("candidates")[0]["score"].alias("a"), F.col("candidates")[1]["score"].alias("b")), oracle("select a.prompt_key, a.score as a, b.score as b from sparse a join sparse b using (prompt_key) where a.model_name = 'ASIA' and b.model_name = 'EUROPE'", "sparse"))
R.add("adapt_embedding_triplets", lambda s, d: rounded(A.difficulty(view(s, d, "sparse"))), oracle(", p as (select dataset_id, prompt_key, avg(case when score > 0 then 1 else 0 end) as accuracy from sparse group by 1, 2) select dataset_id, prompt_key, round(accuracy, 6) as accuracy, case accuracy when 1 then 'all_correct' when 0 then 'all_error' else 'normal' end as kind from p", "sparse"))
_ACC = ", p as (select dataset_id, prompt_key, round(avg(case when score > 0 then 1 else 0 end), 6) as accuracy from sparse group by 1, 2)"
R.add("adapt_positive_pairs", lambda s, d: A.neighbour_pairs(A.difficulty(view(s, d, "sparse")).withColumn("accuracy", F.round("accuracy", 6)), "dataset_id", "prompt_key", "prompt_key", 2), oracle(_ACC + ", l as (select dataset_id, prompt_key as anchor, lead(prompt_key, 1) over w as a, lead(prompt_key, 2) over w as b from p window w as (partition by dataset_id, accuracy order by prompt_key)) select * from (select dataset_id, anchor, unnest([a, b]) as positive from l) where positive is not null", "sparse"))
R.add("agg_pair_stats", lambda s, d: A.pair_counts(A.difficulty(view(s, d, "sparse")).withColumn("accuracy", F.round("accuracy", 6)), "dataset_id", 2), oracle(_ACC + ", n as (select dataset_id, accuracy, count(*) as n from p group by 1, 2) select dataset_id, cast(sum(least(2, n - 1) * n - least(2, n - 1) * (least(2, n - 1) + 1) / 2) as bigint) as pairs from n group by 1", "sparse"))
R.add("semi_used_prompts", lambda s, d: A.used_index(view(s, d, "sparse").where("score > 0.9").select(F.col("record_index").alias("vec_id")), load(s, d, "embeddings", "vec_id", "label"), "vec_id", "vec_id"), oracle("select vec_id, label, row_number() over (order by vec_id) - 1 as new_index from embeddings where vec_id in (select record_index from sparse where score > 0.9)", "sparse"))
R.add("anti_missing_test", lambda s, d: view(s, d, "outcomes").select("prompt_key", "model_name").exceptAll(view(s, d, "sparse").select("prompt_key", "model_name")), oracle("select prompt_key, model_name from outcomes except all select prompt_key, model_name from sparse", "sparse"))
R.add("intersect_keys", lambda s, d: load(s, d, "request_telemetry", "decision_model").intersect(load(s, d, "model_axes", F.col("model").alias("decision_model"))), "select decision_model from request_telemetry intersect select model from model_axes")
R.add("agg_median_verbosity", lambda s, d: rounded(load(s, d, "model_axes", "provider", "verbosity_tokens").groupBy("provider").agg(F.percentile("verbosity_tokens", 0.5).alias("median"))), "select provider, round(quantile_cont(verbosity_tokens, 0.5), 6) as median from model_axes group by 1")
R.add("scan_prices", lambda s, d: rounded(load(s, d, "request_telemetry", "row_id", "decision_model", "input_tokens", "output_tokens").join(small(load(s, d, "model_axes", F.col("model").alias("decision_model"), "input_per_1k_usd", "output_per_1k_usd")), "decision_model", "left").select("row_id", ((F.coalesce("input_tokens", F.lit(0)) * F.coalesce("input_per_1k_usd", F.lit(0.001)) + F.coalesce("output_tokens", F.lit(0)) * F.coalesce("output_per_1k_usd", F.lit(0.002))) / 1000).alias("usd")), digits=8), "select row_id, round((coalesce(input_tokens, 0) * coalesce(input_per_1k_usd, 0.001e0) + coalesce(output_tokens, 0) * coalesce(output_per_1k_usd, 0.002e0)) / 1000, 8) as usd from request_telemetry t left join model_axes m on m.model = t.decision_model")
_ITEMS = "string_agg(model_name || ':' || cast(round(score, 2) as varchar), ',' order by model_name) as records"
_flat = lambda i: i.select("dataset_id", "prompt_key", "index", F.array_join(F.transform(F.map_entries("records"), lambda e: F.concat_ws(":", e["key"], F.round(e["value"], 2).cast("string"))), ",").alias("records"))
R.add("adapt_frugal", lambda s, d: _flat(A.prompt_items(view(s, d, "outcomes"))), oracle(f"select dataset_id, prompt_key, min(record_index) as \"index\", {_ITEMS} from outcomes group by 1, 2", "outcomes"))
_roster = lambda s, d: view(s, d, "models").withColumnRenamed("model", "model_name")
R.add("adapt_modelsat", lambda s, d: _flat(A.filled_items(view(s, d, "sparse"), _roster(s, d))), oracle(f", f as (select p.*, m.model as model_name, coalesce(o.score, 0) as score from (select distinct dataset_id, prompt_key, record_index from sparse) p cross join models m left join sparse o on o.prompt_key = p.prompt_key and o.model_name = m.model) select dataset_id, prompt_key, min(record_index) as \"index\", {_ITEMS} from f group by 1, 2", "sparse", "models"))
R.add("adapt_routerdc", lambda s, d: (lambda i: _flat(i).join(i.select("prompt_key", "cluster_id"), "prompt_key"))(A.with_cluster(A.filled_items(view(s, d, "sparse"), _roster(s, d)), view(s, d, "vectors").where("vec_id % 10 > 0").select(F.concat(F.lit("p"), "vec_id").alias("prompt_key"), F.col("label").alias("cluster_id")))), oracle(f", f as (select p.*, m.model as model_name, coalesce(o.score, 0) as score from (select distinct dataset_id, prompt_key, record_index from sparse) p cross join models m left join sparse o on o.prompt_key = p.prompt_key and o.model_name = m.model) select dataset_id, prompt_key, min(record_index) as \"index\", {_ITEMS}, any_value(case when record_index % 10 > 0 then cast(substr(dataset_id, 3) as int) else -1 end) as cluster_id from f group by 1, 2", "sparse", "models"))
_levels = lambda s, d: A.difficulty(view(s, d, "sparse")).withColumn("accuracy", F.round("accuracy", 6))
R.add("neg_sampling", lambda s, d: S.sample_negatives(_levels(s, d), "dataset_id", "prompt_key", 10))
R.add("adapt_triplets", lambda s, d: A.triplets(_levels(s, d), "dataset_id", "prompt_key", 2, 6))
_HR = "row_number() over (partition by {g} order by " + _B.format("{k}") + " % 64, sha256({k}), {k}) - 1"
R.add("split_stratified", lambda s, d: S.stratified_split(view(s, d, "outcomes"), "dataset_id", "prompt_key", 0.3), oracle(f", p as (select distinct dataset_id, prompt_key from outcomes), r as (select *, {_HR.format(g='dataset_id', k='prompt_key')} as rank, count(*) over (partition by dataset_id) as n from p) select dataset_id, prompt_key, case when rank < round_even(n * 0.3e0, 0) then 'test' else 'train' end as part from r", "outcomes"))
R.add("split_record_ratio", lambda s, d: S.record_split(view(s, d, "sparse"), "dataset_id", ["prompt_key", "model_name"], 0.7), oracle(f", p as (select dataset_id, prompt_key, model_name, prompt_key || '|' || model_name as k from sparse), r as (select *, {_HR.format(g='dataset_id', k='k')} as rank, count(*) over (partition by dataset_id) as n from p) select dataset_id, prompt_key, model_name, case when rank < floor(n * 0.7e0) then 'train' else 'test' end as part from r", "sparse"))
R.add("split_pinned", lambda s, d: docs(s, d).select("doc_id", S.pinned_split(X.prompt_key(F.col("text")), 42, b"split-v1").alias("part")), f"with k as (select doc_id, ('0x' || substr(sha256(encode('split-v1') || unhex('00000000000000002a') || unhex(sha256({_N}))), 1, 16))::ubigint % 10000 as b from documents where text is not null) select doc_id, case when b < 7000 then 'train' when b < 8500 then 'validation' else 'test' end as part from k")
R.add("random_policy", lambda s, d: load(s, d, "embeddings", "vec_id").select("vec_id", S.random_policy(F.col("vec_id"), 7, 5).alias("model")), "select vec_id, ('0x' || substr(sha256('7|' || vec_id), 1, 15))::bigint % 5 as model from embeddings")
R.add("seq_documents", lambda s, d: view(s, d, "busy").select("call_id", F.sha2(A.turn_document(F.when(F.col("user_turn"), "user").otherwise("assistant"), F.col("call_id") % 60, F.when(F.col("call_id") % 7 > 0, F.col("text")), F.when(F.col("has_tool"), F.array(F.col("sig"), F.lit(" "))).otherwise(F.array().cast("array<string>"))), 256).alias("k")), oracle("""select call_id, sha256(case when user_turn then 'User message (turn ' || call_id % 60 || '):' || n || 'Request:' || chr(10) || t || n || 'Intent:' || chr(10) || t || n || 'Constraints and guidelines:' || e || n || 'Context supplied:' || e || n || 'Clarifications and corrections:' || e
 else 'Agent reply (turn ' || call_id % 60 || '):' || n || 'Actions:' || chr(10) || '- ' || case when has_tool then sig else 'No tool calls recorded.' end || case when call_id % 7 > 0 then n || 'Observed outcome:' || chr(10) || text else '' end end) as k
 from (select *, chr(10) || chr(10) as n, case when call_id % 7 > 0 then text else '[missing prompt text]' end as t, chr(10) || '- Not visible in this turn.' as e from busy)""", "busy"))
_WIDE = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
R.add("scan_pickle_wide", lambda s, d: rounded(Z.wide_outcomes(Z.to_wide(view(s, d, "sparse"), ["dataset_id", "prompt_key"], _WIDE), ["dataset_id", "prompt_key"], _WIDE)), oracle("select dataset_id, prompt_key, model_name, round(score, 6) as score, round(cost, 6) as cost from sparse", "sparse"))
R.add("fingerprint", lambda s, d: B.content_hash(view(s, d, "sparse").select("dataset_id", "prompt_key", "model_name", "record_index"), ["dataset_id"], ["prompt_key", "model_name", "record_index"]), oracle("""select dataset_id, sha256(string_agg(h, '' order by h)) as fingerprint from (select dataset_id, sha256('{"model_name":"' || model_name || '","prompt_key":"' || prompt_key || '","record_index":' || record_index || '}') as h from sparse) group by 1""", "sparse"))


def _results(s: SparkSession, d: str) -> DataFrame:
    """The outcomes, written as result files into the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(s)}/results-{uuid.uuid4().hex}"
    o = view(s, d, "sparse").withColumns({"prompt": F.col("prompt_key"), "prediction": F.lit("x"), "ground_truth": F.lit("y")})
    Z.write_results(o, folder)
    return B.read_results(s, folder)


R.add("scan_bench_json", lambda s, d: rounded(B.records(B.latest_files(B.select_files(_results(s, d)))).select("dataset_id", "split", "model_name", "record_index", "prompt", "score", "cost", "prompt_tokens", "completion_tokens")), oracle("select dataset_id, split, model_name, record_index, prompt_key as prompt, round(score, 6) as score, round(cost, 6) as cost, prompt_tokens, completion_tokens from sparse", "sparse"))
R.add("list_results", lambda s, d: rounded(B.list_results(_results(s, d))), oracle("select dataset_id as dataset_name, split, model_name, 20250101000000 as stamp, round(avg(score), 6) as performance, count(*) as n_records from sparse group by 1, 2, 3", "sparse"))
R.add("scan_filter_files", lambda s, d: B.records(B.select_files(_results(s, d), only={"model_name": ["ASIA", "EUROPE"]}, without={"dataset_name": ["ds3"], "model_name": ["ASIA"]})).groupBy("dataset_id", "model_name").agg(F.count("*").alias("n")), oracle("select dataset_id, model_name, count(*) as n from sparse where model_name in ('ASIA', 'EUROPE') and dataset_id <> 'ds3' group by 1, 2", "sparse"))
