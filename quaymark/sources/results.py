"""Result files, append logs, event streams and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECORD = "index long, origin_query string, prompt string, prompt_tokens long, completion_tokens long, cost double, score double, prediction string, ground_truth string, raw_output string"
RESULT = f"model_name string, dataset_name string, split string, demo boolean, performance double, data_fingerprint string, extra_metrics map<string,double>, records array<struct<{', '.join(f.replace(' ', ':') for f in RECORD.split(', ')) }>>"


def read_results(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """One row per result file: header, records, its path and the time in its name as a number.

    Lenient reading leaves a file that can't be parsed with null fields;
    strict reading stops.
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    df = spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", mode).json(folder)
    path = F.col("_metadata.file_path")
    stamp = F.concat(F.regexp_extract(path, r"(\d{8})_(\d{6})\.json$", 1), F.regexp_extract(path, r"(\d{8})_(\d{6})\.json$", 2))
    return df.select("*", path.alias("path"), F.coalesce(F.nullif(stamp, F.lit("")).cast("long"), F.unix_seconds("_metadata.file_modification_time")).alias("stamp"))


def select_files(results: DataFrame, only: dict[str, Sequence[str]] | None = None, without: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Files that are no demo and fit; where a field has a list to keep, its list to leave out does not count."""
    out = results.where(~F.coalesce("demo", F.lit(False)) & F.col("records").isNotNull())
    for field in ("dataset_name", "model_name", "split"):
        if only and only.get(field):
            out = out.where(F.col(field).isin(*only[field]))
        elif without and without.get(field):
            out = out.where(~F.col(field).isin(*without[field]))
    return out


def latest_files(results: DataFrame) -> DataFrame:
    """The newest file of each data set, split and model; ties go to the greater path."""
    w = W.partitionBy("dataset_name", "split", "model_name").orderBy(F.desc("stamp"), F.desc("path"))
    return results.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def records(results: DataFrame) -> DataFrame:
    """Files exploded to outcome records; an absent score, cost or count is 0, an absent text empty."""
    r = results.select(F.col("dataset_name").alias("dataset_id"), "split", "model_name", F.explode("records").alias("r"))
    zero = lambda c, t: F.coalesce(F.col(f"r.{c}"), F.lit(0).cast(t)).alias(c)
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c)
    return r.select("dataset_id", "split", "model_name", F.col("r.index").alias("record_index"), text("prompt"), text("prediction"), text("ground_truth"), zero("score", "double"), zero("cost", "double"), zero("prompt_tokens", "long"), zero("completion_tokens", "long"))


def no_overlap(reference: Sequence[str], models: Sequence[str]) -> None:
    both = sorted(set(reference) & set(models))
    if both:
        raise ValueError(f"models that are references as well: {', '.join(both)}")


def require(results: DataFrame, field: str, wanted: Sequence[str]) -> None:
    """Stops if a wanted value does not occur; the wanted list is short."""
    here = {r[0] for r in results.where(F.col(field).isin(*wanted)).select(field).distinct().collect()}
    missing = sorted(set(wanted) - here)
    if missing:
        raise ValueError(f"{field} without results: {', '.join(missing)}")


def read_log(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """An append log of JSON lines, the last line of each key; lines that can't be read are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "path", "at").where(F.col(f"r.{key}").isNotNull())
    return parsed.groupBy(F.col(f"r.{key}").alias("__k")).agg(F.max_by("r", F.struct("path", "at")).alias("r")).select("r.*")


def split_events(body: Column) -> Column:
    """Events of a server-sent stream: blocks between empty lines, with either kind of line end."""
    return F.filter(F.split(body, r"\r?\n\r?\n"), lambda e: F.trim(e) != "")


def event_data(event: Column) -> Column:
    """What the first data line of an event holds; null without one."""
    return F.nullif(F.regexp_extract(event, r"(?m)^data: ?(.*?)\r?$", 1), F.lit(""))


def usage_tokens(data: Column) -> Column:
    """Input tokens under any of the usual paths of an event's JSON."""
    paths = ("usage.input_tokens", "message.usage.input_tokens", "response.usage.input_tokens", "usage.prompt_tokens", "usageMetadata.promptTokenCount")
    return F.coalesce(*[F.get_json_object(data, f"$.{p}").try_cast("long") for p in paths])


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> str:
    """A hash of the content that no order or layout changes: the sum of the rows' hashes, hashed."""
    h = [F.sum(F.xxhash64(F.lit(s), F.to_json(F.struct(*columns))).cast("decimal(38,0)")).cast("string") for s in (1, 2)]
    r = rows.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *h), 256).alias("f")).first()
    return r["f"]


def write_new(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Writes a table that must not be there yet; files become visible when all are written."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*by) if by else w).parquet(path)


def posteriors(spark: SparkSession, text: str) -> DataFrame:
    """cluster_id, model_name, mean, variance of a nested JSON text; a negative variance stops."""
    inner = "map<string,map<string,struct<mean:double,variance:double>>>"
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", f"posterior {inner}")["posterior"]).alias("cluster_id", "m")).select("cluster_id", F.explode("m").alias("model_name", "v")).select("cluster_id", "model_name", "v.mean", "v.variance")
    if df.where("variance < 0").limit(1).count():
        raise ValueError("negative variance")
    return df


def report(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> str:
    """The first rows as a table of a text document; if there are more, the last line says how many."""
    n = df.count()
    rows = df.select(*columns).limit(limit).collect()
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    more = [f"\n{n - limit} more rows"] if n > limit else []
    return "\n".join([line(columns), line(["-"] * len(columns)), *(line(r) for r in rows), *more])


def list_results(results: DataFrame) -> DataFrame:
    """dataset_name, split, model_name, stamp, performance, n_records of the newest file that is no demo of each cell."""
    latest = latest_files(select_files(results))
    return latest.select("dataset_name", "split", "model_name", "stamp", "performance", F.size("records").cast("long").alias("n_records"))


def content_hash(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """by, fingerprint: the hash over the rows' canonical JSON, in order of their own hashes, so that neither order nor layout matters.

    A row is first hashed to 64 characters, so what a group brings together is
    one hash a row.
    """
    one = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
    return rows.select(*by, one.alias("h")).groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("fingerprint"))
