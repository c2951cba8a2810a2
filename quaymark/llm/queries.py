"""Queries of the problems tagged llm, with their oracles."""

from __future__ import annotations

import secrets
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm import clusters, packing, pii, quantiles, spans, tokens
from quaymark.operators.joins import pairs_within
from quaymark.plans.registry import Registry
from quaymark.session import cut_table
from quaymark.sources.tables import canonical_id, load

R = Registry()

# -- problem 1 --------------------------------------------------------------


def request_texts(spark: SparkSession, sf: str) -> DataFrame:
    """key, text of each request: spans and repeated deliveries are one; of several texts the first delivered counts."""
    rows = load(spark, sf, "request_telemetry", "row_id", "request_id", "embed_input")
    key = F.coalesce(canonical_id("request_id"), F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    # texts first, then nulls and blanks
    return rows.groupBy(key.alias("key")).agg(F.min(F.struct(F.coalesce(F.trim("embed_input") == "", F.lit(True)).alias("empty"), "row_id", F.col("embed_input").alias("text"))).alias("m")).select("key", "m.text")


@R.query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = cut_table(clusters.cluster_records(request_texts(spark, sf)).where("n_chars >= 40 and key not like 'row:%'").select("cluster_id", "key"))
    return pairs_within(found, "cluster_id", "key", "request_id_a", "request_id_b").drop("cluster_id")


@R.query("p1_members")
def p1_members(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.cluster_records(request_texts(spark, sf)).select("key", "cluster_id", "density")


@R.query("p1_clusters")
def p1_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.describe_clusters(clusters.cluster_records(request_texts(spark, sf)))


# -- problem 3 --------------------------------------------------------------


def surrogate_key(spark: SparkSession) -> bytes:
    """The deployment's key, from spark.quaymark.surrogateKey; without one, a random key that ends with the application."""
    named = spark.conf.get("spark.quaymark.surrogateKey", None)
    return named.encode() if named else _passing_key(spark.sparkContext.applicationId)


@cache
def _passing_key(application: str) -> bytes:
    return secrets.token_bytes(32)


def free_texts(spark: SparkSession, sf: str) -> DataFrame:
    tel = load(spark, sf, "request_telemetry", "row_id", "embed_input").select(F.lit("request_telemetry").alias("src_table"), F.col("row_id").alias("src_id"), F.col("embed_input").alias("text"))
    fb = load(spark, sf, "request_feedback", "feedback_id", "comment_text").select(F.lit("request_feedback").alias("src_table"), F.col("feedback_id").alias("src_id"), F.col("comment_text").alias("text"))
    return tel.unionAll(fb)


def person_names(spark: SparkSession, sf: str) -> pii.Names:
    listed = [(r["name_token"], r["name_kind"]) for r in load(spark, sf, "name_list", "name_token", "name_kind").limit(pii.MAX_NAMES + 1).collect()]
    if len(listed) > pii.MAX_NAMES:
        raise ValueError("more listed names than a worker may hold")
    return pii.learn_names(free_texts(spark, sf), listed)


@R.query("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.detect(free_texts(spark, sf), person_names(spark, sf), surrogate_key(spark)).drop("end_pos", "surrogate")


@R.query("p3_replaced")
def p3_replaced(spark: SparkSession, sf: str) -> DataFrame:
    return pii.replace(free_texts(spark, sf), person_names(spark, sf), surrogate_key(spark))


# -- problem 5 --------------------------------------------------------------

LATENCIES = ("total_latency_ms", "upstream_latency_ms", "route_latency_ms")
PROBS = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
ALPHA = 0.01
VALID_LATENCY = "value >= 0"  # a negative latency is no time


def latencies(spark: SparkSession, sf: str) -> DataFrame:
    model = F.regexp_replace(F.lower(F.trim("decision_model")), "^.*/", "")
    return load(spark, sf, "request_telemetry", "decision_model", "ts", *LATENCIES).select(model.alias("decision_model"), F.date_format("ts", "yyyy-MM-dd").alias("day_utc"), *LATENCIES)


_P5 = f"""
with v as (
  select regexp_replace(lower(trim(decision_model)), '^.*/', '') as decision_model, strftime(ts, '%Y-%m-%d') as day_utc, m as metric, cast(x as double) as value
  from (select decision_model, ts, unnest(['total_latency_ms', 'upstream_latency_ms', 'route_latency_ms']) as m, unnest([total_latency_ms, upstream_latency_ms, route_latency_ms]) as x from request_telemetry) where x is not null),
b as (select *, cast(case when value < 0 then null when abs(value) <= 1e-9 then 0 else 1 end as integer) as sign,
  cast(case when value < 0 then null when abs(value) <= 1e-9 then 0 else ceil(ln(abs(value)) / ln(1.01e0 / 0.99e0)) end as integer) as key from v)
"""


@R.query("p5_sketch", _P5 + "select decision_model, day_utc, metric, sign, key, count(*) as n from b group by all")
def p5_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.sketch(latencies(spark, sf), ["decision_model", "day_utc"], LATENCIES, ALPHA, VALID_LATENCY)


@R.query("p5_percentiles", _P5 + ", s as (select decision_model, metric, sign, key, count(*) as n from b group by all), c as (select *, sum(case when key is not null then n else 0 end) over (partition by decision_model, metric) as total, sum(case when key is not null then n else 0 end) over (partition by decision_model, metric order by sign * (key + 1000000) nulls first rows unbounded preceding) as upto from s) select decision_model, metric, cast(max(total) as bigint) as n, cast(sum(case when key is null then n else 0 end) as bigint) as n_invalid, " + ", ".join(f"round(max(case when upto > floor({p} * (total - 1)) and upto - n <= floor({p} * (total - 1)) and key is not null then sign * pow(1.01e0 / 0.99e0, key) * 2 / (1.01e0 / 0.99e0 + 1) end), 6) as p{p * 100:g}".replace("p99.9", "p99_9") for p in PROBS) + " from c group by 1, 2")
def p5_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    daily = quantiles.sketch(latencies(spark, sf), ["decision_model", "day_utc"], LATENCIES, ALPHA, VALID_LATENCY)
    merged = quantiles.merge(daily, ["decision_model"])
    out = quantiles.percentiles(merged, ["decision_model"], PROBS, ALPHA)
    return out.select("decision_model", "metric", "n", "n_invalid", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("p")])


# -- problem 7 --------------------------------------------------------------


@R.query("p7_ids")
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(load(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


# -- problem 8 --------------------------------------------------------------

CAPACITY = 2048


@R.query("p8_pack")
def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    sizes = tokens.count_tokens(load(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


@R.query("p8_fill")
def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, sf), CAPACITY)


# -- problem 9 --------------------------------------------------------------


# every place of every text with the hash of the 200 characters from it on, in SQL
_P9 = f"""with d as (select doc_id, text, length(text) as n from documents where length(text) >= {spans.MIN_CHARS}),
w as (select doc_id, i, hash(substr(text, i, {spans.MIN_CHARS})) as h from d, lateral (select unnest(range(1, n - {spans.MIN_CHARS - 2})) as i)),
m as (select h from w group by 1 having min(doc_id) <> max(doc_id))"""


@R.query("p9_found", _P9 + ", x as (select distinct doc_id, h from w semi join m using (h)) select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from x a join x b on a.h = b.h and a.doc_id < b.doc_id")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.SharedSpans(load(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").document_pairs()


@R.query("p9_classes")
def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    return spans.SharedSpans(load(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").passage_classes()


@R.query("p9_passages")
def p9_passages(spark: SparkSession, sf: str) -> DataFrame:
    return spans.SharedSpans(load(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").passages()


@R.query("p9_coverage", _P9 + f", s as (select doc_id, i from w semi join m using (h)), c as (select doc_id, sum(least({spans.MIN_CHARS}, coalesce(nxt - i, {spans.MIN_CHARS}))) as k from (select *, lead(i) over (partition by doc_id order by i) as nxt from s) group by 1) select doc_id, n as n_chars, cast(coalesce(k, 0) as bigint) as shared_chars, round(coalesce(k, 0) / n, 6) as shared_share from d left join c using (doc_id)")
def p9_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return spans.SharedSpans(load(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").coverage().withColumn("shared_share", F.round("shared_share", 6))


QUERIES = R.queries
ORACLES = R.oracles
