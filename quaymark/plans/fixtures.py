"""Input views of the reference queries, the same rows in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.sources.tables import load

_MODELS = """SELECT r_name AS model, CAST(r_regionkey AS BIGINT) AS ord,
 CAST(1 + r_regionkey * r_regionkey * 4 AS DOUBLE) / 1000 AS input_per_1k, CAST(3 + r_regionkey * 9 AS DOUBLE) / 1000 AS output_per_1k FROM region"""
_OUTCOMES = """SELECT concat('ds', e.label) AS dataset_id, 'test' AS split, r.r_name AS model_name, CAST(r.r_regionkey AS BIGINT) AS ord, e.vec_id AS record_index,
 concat('p', e.vec_id) AS prompt_key, CAST((e.vec_id * 31 + r.r_regionkey * 17 + e.label * r.r_regionkey * 7) % 11 AS DOUBLE) / 10 AS score,
 CAST(1 + (e.vec_id * 13 + r.r_regionkey * 29) % 50 + 40 * r.r_regionkey AS DOUBLE) / 10000 AS cost,
 50 + (e.vec_id * 7) % 400 AS prompt_tokens, 20 + (e.vec_id * 11 + r.r_regionkey * 5) % 300 AS completion_tokens FROM embeddings e CROSS JOIN region r"""
_CALLS = """SELECT user_id AS session_key, event_id AS call_id, ts,
 CASE event_type WHEN 'click' THEN 'explore' WHEN 'view' THEN 'execute' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'orchestrate' ELSE 'reason' END AS action,
 concat(event_type, ':', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 AS VARCHAR(9))) AS sig, event_type = 'error' AS is_error,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS output_tokens FROM events"""
#: Sessions of sixty calls a few seconds apart, made so that every detector has something to find and something to leave.
_BUSY = """SELECT event_id - event_id % 60 AS session_key, event_id AS call_id, {at} AS ts,
 CASE WHEN event_id % 180 < 60 THEN concat('a', CAST(event_id % 8 AS VARCHAR(20))) WHEN event_id % 180 < 120 THEN concat('b', CAST(CASE WHEN event_id % 7 < 5 THEN 0 ELSE event_id % 7 END AS VARCHAR(20)))
 ELSE concat('c', CAST(event_id % 60 AS VARCHAR(20))) END AS sig,
 CASE WHEN event_id % 360 >= 180 AND event_id % 6 = 0 THEN 'edit' WHEN event_id % 3 = 0 THEN 'explore' WHEN event_id % 3 = 1 THEN 'execute' ELSE 'reason' END AS action,
 concat('src/f', CAST(event_id % 12 AS VARCHAR(20)), CASE event_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.YAML' WHEN 2 THEN '.md' WHEN 3 THEN '' ELSE '.csv' END) AS path,
 event_id % 13 IN (3, 4, 5) AS is_error, event_id % 25 = 0 AS user_turn, event_id % 9 NOT IN (1, 2, 3, 4, 5) AS has_tool,
 4 + event_id % 17 AS message_count, event_id % 11 AS tool_count,
 concat('Now I look at the settings of the second service, part ', CAST(CASE WHEN event_id % 180 < 60 THEN event_id ELSE event_id % 4 END AS VARCHAR(20))) AS text FROM events"""
_BUSY_AT = {"duck": "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id * CASE WHEN event_id % 360 < 180 THEN 7 ELSE 31 END)", "spark": "timestampadd(SECOND, CAST(event_id * CASE WHEN event_id % 360 < 180 THEN 7 ELSE 31 END AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"}
_ANSWERS = """SELECT doc_id, concat('reasoning ', CAST(doc_id AS VARCHAR(20)), ' Answer: ', CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'b' WHEN 2 THEN '1,234' ELSE '-7.5' END) AS text,
 CASE doc_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN '1234' ELSE '-7.5' END AS gold FROM documents"""

#: DuckDB bodies of the views, and those they need.
VIEWS = {
    "models": _MODELS,
    "outcomes": _OUTCOMES,
    "sparse": "SELECT * FROM outcomes WHERE (record_index + ord) % 23 <> 0",
    "raw_dups": "SELECT l_orderkey AS prompt_id, CAST(l_linenumber AS BIGINT) AS model_id, CAST(l_quantity AS BIGINT) AS score, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_cents FROM lineitem",
    "calls": _CALLS,
    "busy": _BUSY.replace("{at}", _BUSY_AT["duck"]),
    "answers": _ANSWERS,
    "vectors": "SELECT vec_id, label, embedding FROM embeddings",
    "centroids": """SELECT label AS cluster_id, list(v ORDER BY dim) AS centroid FROM (SELECT label, pos - 1 AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS v
 FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1""",
    "sims": """SELECT vec_id, label, cluster_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), centroid) / sqrt(list_dot_product(centroid, centroid)), 6) AS sim FROM vectors CROSS JOIN centroids""",
}
NEEDS = {"sparse": ["outcomes"], "sims": ["vectors", "centroids"]}


def oracle(body: str, *views: str) -> str:
    """A DuckDB query over the named views; ``body`` may begin with further CTEs as ', name as (...) select'."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, []):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in order) + " " + body


def busy(events: DataFrame) -> DataFrame:
    """The busy calls of a table or stream of events."""
    return events.sparkSession.sql(_BUSY.replace("{at}", _BUSY_AT["spark"]).replace("FROM events", "FROM {t}"), t=events)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The Spark side of a view."""
    if name == "models":
        return spark.sql(_MODELS.replace("FROM region", "FROM {region}"), region=load(spark, sf, "region"))
    if name == "outcomes":
        # five models: the small side of the product is a fixed roster
        return spark.sql(_OUTCOMES.replace("FROM embeddings e CROSS JOIN region r", "FROM {e} e CROSS JOIN {r} r"), e=load(spark, sf, "embeddings", "vec_id", "label"), r=F.broadcast(load(spark, sf, "region")))
    if name == "sparse":
        return view(spark, sf, "outcomes").where("(record_index + ord) % 23 <> 0")
    if name == "raw_dups":
        return load(spark, sf, "lineitem").selectExpr("l_orderkey AS prompt_id", "CAST(l_linenumber AS BIGINT) AS model_id", "CAST(l_quantity AS BIGINT) AS score", "CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_cents")
    if name == "calls":
        return spark.sql(_CALLS.replace("FROM events", "FROM {t}"), t=load(spark, sf, "events"))
    if name == "busy":
        return busy(load(spark, sf, "events", "event_id"))
    if name == "answers":
        return spark.sql(_ANSWERS.replace("FROM documents", "FROM {t}"), t=load(spark, sf, "documents", "doc_id"))
    if name == "vectors":
        return load(spark, sf, "embeddings", "vec_id", "label", "embedding")
    if name == "centroids":
        dims = load(spark, sf, "embeddings", "label", "embedding").select("label", F.posexplode("embedding").alias("pos", "x"))
        means = dims.groupBy(F.col("label").alias("cluster_id"), "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("v"))
        return means.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("d")).select("cluster_id", F.transform("d", lambda s: s["v"]).alias("centroid"))
    raise KeyError(name)
