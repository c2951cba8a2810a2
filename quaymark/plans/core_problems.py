"""Queries of the problems 2, 4 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators import orphans, rolling, schema_drift
from quaymark.plans.registry import Registry
from quaymark.session import cut_table
from quaymark.sources.tables import canonical_id, load

R = Registry()

_ID = r"nullif(regexp_replace(lower({0}), '^[\s{{}}]+|[\s{{}}]+$', '', 'g'), '')"


# -- problem 2 --------------------------------------------------------------


def daily_costs(spark: SparkSession, sf: str) -> DataFrame:
    spans = load(spark, sf, "request_telemetry", "row_id", "installation_id", "request_id", "span_type", "ts", "actual_input_cost_usd", "actual_output_cost_usd").withColumns({"installation_id": canonical_id("installation_id"), "request_id": canonical_id("request_id")})
    once = rolling.count_once(spans, ["installation_id", "request_id", "span_type"], "row_id", ["ts", "actual_input_cost_usd", "actual_output_cost_usd"])
    return once.where("ts is not null").groupBy("installation_id", F.to_date("ts").alias("day")).agg(F.sum("actual_input_cost_usd").alias("input_cost"), F.sum("actual_output_cost_usd").alias("output_cost"))


def rolling_costs(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.rolling_totals(daily_costs(spark, sf), "installation_id", "day", ["input_cost", "output_cost"], (7, 30))


_P2_SQL = f"""
with once as (
  select {_ID.format('installation_id')} as installation_id, {_ID.format('request_id')} as request_id, span_type, row_id, ts,
         actual_input_cost_usd as i, actual_output_cost_usd as o from request_telemetry),
ranked as (select *, row_number() over (partition by installation_id, request_id, span_type,
             case when installation_id is null or request_id is null or span_type is null then row_id end order by row_id) as rn from once),
daily as (select installation_id, cast(ts as date) as day, coalesce(sum(i), 0) as i, coalesce(sum(o), 0) as o from ranked where rn = 1 and ts is not null group by 1, 2),
span as (select installation_id, min(day) as a, max(day) as b from daily group by 1),
cal as (select installation_id, cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 day)) as date) as day from span),
filled as (select c.installation_id, c.day, coalesce(d.i, 0) as i, coalesce(d.o, 0) as o
           from cal c left join daily d on c.installation_id is not distinct from d.installation_id and c.day = d.day),
roll as (select installation_id, day,
  sum(i) over w7 as i7, sum(i) over w30 as i30, sum(o) over w7 as o7, sum(o) over w30 as o30
  from filled window w7 as (partition by installation_id order by day rows between 6 preceding and current row),
                     w30 as (partition by installation_id order by day rows between 29 preceding and current row))
"""


@R.query(
    "p2_rolling",
    _P2_SQL
    + """select installation_id, strftime(day, '%Y-%m-%d') as day_utc, cast(i7 as bigint) as input_cost_sum_7d, cast(i30 as bigint) as input_cost_sum_30d,
cast(o7 as bigint) as output_cost_sum_7d, cast(o30 as bigint) as output_cost_sum_30d,
cast(i7 as double) / 7 as input_cost_avg_7d, cast(i30 as double) / 30 as input_cost_avg_30d,
cast(o7 as double) / 7 as output_cost_avg_7d, cast(o30 as double) / 30 as output_cost_avg_30d from roll""",
)
def p2_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return rolling_costs(spark, sf).withColumn("day_utc", F.date_format("day", "yyyy-MM-dd")).drop("day")


@R.query("p2_found", _P2_SQL + "select installation_id, strftime(day, '%Y-%m-%d') as day_utc from roll where i7 + o7 = 0 and i30 + o30 > 0")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    quiet = "input_cost_sum_7d + output_cost_sum_7d = 0 and input_cost_sum_30d + output_cost_sum_30d > 0"
    return rolling_costs(spark, sf).where(quiet).select("installation_id", F.date_format("day", "yyyy-MM-dd").alias("day_utc"))


# -- problem 4 --------------------------------------------------------------


def references(spark: SparkSession, sf: str) -> list[orphans.Reference]:
    cols = ("row_id", "installation_id", "api_key_id", "request_id", "ts", "created_at")
    tel = load(spark, sf, "request_telemetry", *cols).withColumns({c: canonical_id(c) for c in cols[1:4]})
    fb = load(spark, sf, "request_feedback", "feedback_id", "created_at", "installation_id", "request_id").withColumns({c: canonical_id(c) for c in ("installation_id", "request_id")})
    inst = load(spark, sf, "installations", "installation_id", "created_at", "deleted_at").withColumn("installation_id", canonical_id("installation_id"))
    keys = load(spark, sf, "api_keys", "api_key_id", "created_at", "deleted_at").withColumn("api_key_id", canonical_id("api_key_id"))
    # a feedback row without an installation can't match any request, but its request id is a reference all the same
    home = F.coalesce(F.col("installation_id"), F.lit(""))
    return [
        orphans.Reference("request_telemetry", "api_key_id", tel, F.col("row_id"), [F.col("api_key_id")], F.col("ts"), keys, [F.col("api_key_id")], F.col("created_at"), F.col("deleted_at")),
        orphans.Reference("request_feedback", "installation_id", fb, F.col("feedback_id"), [F.col("installation_id")], F.col("created_at"), inst, [F.col("installation_id")], F.col("created_at"), F.col("deleted_at")),
        orphans.Reference("request_feedback", "request_id", fb, F.col("feedback_id"), [F.col("request_id"), home], F.col("created_at"), tel, [F.col("request_id"), F.col("installation_id")], F.col("created_at")),
    ]


_P4_SQL = f"""
with k as (select {_ID.format('api_key_id')} as id, min(created_at) as c, max(deleted_at) as d, bool_or(deleted_at is null) as alive from api_keys group by 1),
i as (select {_ID.format('installation_id')} as id, min(created_at) as c, max(deleted_at) as d, bool_or(deleted_at is null) as alive from installations group by 1),
r as (select {_ID.format('request_id')} as id, {_ID.format('installation_id')} as inst, min(created_at) as c from request_telemetry group by 1, 2),
refs as (
  select 'request_telemetry' as src_table, 'api_key_id' as src_field, t.row_id as src_id, t.ts as row_at, k.id is not null as found, k.c, case when not k.alive then k.d end as d
  from (select *, {_ID.format('api_key_id')} as x from request_telemetry) t left join k on k.id = t.x where t.x is not null
  union all
  select 'request_feedback', 'installation_id', f.feedback_id, f.created_at, i.id is not null, i.c, case when not i.alive then i.d end
  from (select *, {_ID.format('installation_id')} as x from request_feedback) f left join i on i.id = f.x where f.x is not null
  union all
  select 'request_feedback', 'request_id', f.feedback_id, f.created_at, r.id is not null, r.c, null
  from (select *, {_ID.format('request_id')} as x, {_ID.format('installation_id')} as y from request_feedback) f left join r on r.id = f.x and r.inst = f.y where f.x is not null),
kinds as (select *, case when not found then 'missing' when d <= row_at then 'deleted' when c > row_at then 'late' end as orphan_kind from refs)
"""


@R.query("p4_found", _P4_SQL + "select src_table, src_field, src_id, orphan_kind from kinds where orphan_kind is not null")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.find_orphans(references(spark, sf)).drop("at")


@R.query(
    "p4_report",
    _P4_SQL + "select src_table, src_field, orphan_kind, strftime(row_at, '%Y-%m-%d') as period_utc, count(*) as n_rows from kinds where orphan_kind is not null group by all",
)
def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(orphans.find_orphans(references(spark, sf)), "day")


# -- problem 6 --------------------------------------------------------------


def ranking_tags(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.tagged_files(load(spark, sf, "ranking_files", "bundle_line", "file_seq", "file_id", "raw_json"), "bundle_line", "file_seq", "file_id", "raw_json")


# the fields of the readable files in SQL: paths to values under meta that are no objects, with one form for equal values
_P6_SQL = r"""
with raw as (select bundle_line as line, file_seq as seq, file_id, regexp_replace(ltrim(raw_json, chr(65279)), '^\s+|\s+$', '', 'g') as t from ranking_files where bundle_line is not null and file_seq is not null and file_id is not null and raw_json is not null),
files as (select line, seq, min(file_id) as file_id, arg_min(t, file_id) as t from raw where json_valid(t) group by 1, 2),
spine as (select *, row_number() over (partition by line order by seq) as ord from files),
nodes as (select line, ord, seq, file_id, replace(regexp_replace(n.fullkey, '^\$\.', ''), '"', '') as path, n.type, n.value, n.fullkey from spine, lateral (select fullkey, type, value from json_tree(spine.t, '$.meta')) n),
fields as (select line, ord, seq, file_id, path,
  case type when 'NULL' then null when 'BOOLEAN' then 'boolean' when 'VARCHAR' then 'string' when 'ARRAY' then 'array' else 'number' end as type,
  case type when 'NULL' then null when 'VARCHAR' then json_extract_string(value, '$') when 'ARRAY' then cast(value as varchar) when 'BOOLEAN' then cast(value as varchar) else cast(cast(value as double) as varchar) end as v
  from nodes where type <> 'OBJECT' and fullkey not like '%[%' and path <> 'meta.cost_per_1k_input_usd' and path not like 'meta.cost_per_1k_input_usd.%')
"""


@R.query(
    "p6_found",
    _P6_SQL
    + """, new as (select a.* from fields a where ord > 1 and not exists (select 1 from fields b where b.line = a.line and b.ord = a.ord - 1 and b.path = a.path)),
gone as (select s.file_id, b.line, s.ord, b.path, b.type, b.v from fields b join spine s on s.line = b.line and s.ord = b.ord + 1 where not exists (select 1 from fields a where a.line = b.line and a.ord = b.ord + 1 and a.path = b.path)),
same as (select n.line, n.ord, n.path as new_path, g.path as old_path from new n join gone g on g.line = n.line and g.ord = n.ord and g.type = n.type and g.v = n.v),
runs as (select *, sum(case when before = ord - 1 then 0 else 1 end) over (partition by line, path order by ord) as run from (select *, lag(ord) over (partition by line, path order by ord) as before from fields)),
typed as (select file_id, path, type, last_value(type ignore nulls) over (partition by line, path, run order by ord rows between unbounded preceding and 1 preceding) as old from runs)
select file_id, path as field_path, case when exists (select 1 from same where same.line = new.line and same.ord = new.ord and same.new_path = new.path) then 'renamed' else 'added' end as change_kind from new
union all select file_id, path, 'removed' from gone where not exists (select 1 from same where same.line = gone.line and same.ord = gone.ord and same.old_path = gone.path)
union all select file_id, path, 'retyped' from typed where type is not null and old is not null and type <> old""",
)
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.schema_changes(ranking_tags(spark, sf)).select("file_id", "field_path", "change_kind")


@R.query("p6_types", _P6_SQL + "select path, type, count(*) as n_files, min(seq) as first_seq, max(seq) as last_seq from fields group by 1, 2")
def p6_types(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.union_types(schema_drift.fused_unions(ranking_tags(spark, sf))[0])


@R.query("p6_table")
def p6_table(spark: SparkSession, sf: str) -> DataFrame:
    tagged = cut_table(ranking_tags(spark, sf))
    read = schema_drift.readable_files(tagged)
    return schema_drift.unified_table(read, schema_drift.rename_map(schema_drift.schema_changes(tagged), read))
