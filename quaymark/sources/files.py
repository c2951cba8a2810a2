"""Files of other programs: tables of labels, vectors and centroids in binary form, bundles, archives; and sinks for them."""

from __future__ import annotations

import hashlib
import json
import os
import tarfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: how the binary files begin
VECTORS_MAGIC = b"PEM1"
CENTROIDS_HEADER = 16
MATRIX_SCHEMA = "outcome-matrix/1"


# -- readers ----------------------------------------------------------------


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """prompt_id, model_id, label of CSV files with a header; a row that can't be read stops."""
    schema = "prompt_id long, model_id long, category string, label int, prompt string, model_name string"
    head = spark.read.option("header", True).csv(path).columns
    known = {f.split()[0]: f.split()[1] for f in schema.split(", ")}
    df = spark.read.option("header", True).option("mode", "FAILFAST").schema(", ".join(f"`{c}` {known.get(c, 'string')}" for c in head)).csv(path)
    return df.select(*[c for c in known if c in head])


def label_rows(labels: DataFrame, models: Sequence[int]) -> DataFrame:
    """prompt_id and one column of 0 and 1 for each model; absent labels are 0."""
    wide = labels.groupBy("prompt_id").pivot("model_id", list(models)).agg(F.max("label"))
    return wide.select("prompt_id", *[F.coalesce(F.col(str(m)), F.lit(0)).alias(f"m{m}") for m in models])


def wide_outcomes(df: DataFrame, key: Sequence[str], models: Sequence[str], cost: str = "|total_cost") -> DataFrame:
    """Long outcomes of a frame with a score column for each model and a cost column behind a mark; rows without a score are left out."""
    parts = F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(f"`{m}`").cast("double").alias("score"), F.col(f"`{m}{cost}`").cast("double").alias("cost")) for m in models])
    return df.select(*key, F.explode(parts).alias("o")).select(*key, "o.*").where("score is not null")


def to_wide(outcomes: DataFrame, key: Sequence[str], models: Sequence[str], cost: str = "|total_cost") -> DataFrame:
    """The opposite of wide_outcomes."""
    here = lambda m, c: F.max(F.when(F.col("model_name") == m, F.col(c)))
    return outcomes.groupBy(*key).agg(*[here(m, "score").alias(m) for m in models], *[here(m, "cost").alias(f"{m}{cost}") for m in models])


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """id, text, register, note of JSON lines; a line without an id stops."""
    df = spark.read.schema("id string, text string, register string, note string").option("mode", "FAILFAST").json(path)
    return df.withColumn("id", F.coalesce("id", F.raise_error(F.lit("a probe without an id"))))


def _floats(raw: bytes, at: int, n: int, dim: int, what: str) -> np.ndarray:
    if len(raw) != at + 4 * n * dim:
        raise ValueError(f"{what}: {len(raw)} bytes, {at + 4 * n * dim} expected for {n} x {dim}")
    return np.frombuffer(raw, "<f4", n * dim, at).reshape(n, dim)


def read_vectors(spark: SparkSession, path: str, text_hash: str | None = None) -> DataFrame:
    """path, place, vec of binary files with a JSON header; ``text_hash``: what the header must say, so that stale vectors stop."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                raw = bytes(raw)
                if raw[:4] != VECTORS_MAGIC or len(raw) < 8:
                    raise ValueError(f"{name}: no vector file")
                body = 8 + int.from_bytes(raw[4:8], "little")
                head = json.loads(raw[8:body])
                if text_hash is not None and head.get("corpus_sha256") != text_hash:
                    raise ValueError(f"{name}: vectors of another text")
                x = _floats(raw, body, head["n"], head["embed_dim"], name)
                for start in range(0, len(x), 4096):
                    part = x[start : start + 4096]
                    yield pd.DataFrame({"path": name, "place": np.arange(start, start + len(part)), "vec": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, place long, vec array<float>")


def read_centroids(spark: SparkSession, path: str, version: int = 1, dim: int | None = None) -> DataFrame:
    """cluster_id, centroid of a binary file: magic, version, number, dimension, floats in rows."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])  # one file of a few centroids
    if len(raw) < CENTROIDS_HEADER:
        raise ValueError("a centroid file without a header")
    found, k, d = (int(x) for x in np.frombuffer(raw, "<u4", 3, 4))
    if found != version or k == 0 or d == 0 or (dim is not None and d != dim):
        raise ValueError(f"version {found}, {k} centroids of {d} dimensions")
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(_floats(raw, CENTROIDS_HEADER, k, d, path))]
    return spark.createDataFrame(rows, "cluster_id int, centroid array<double>")


@dataclass(frozen=True)
class Bundle:
    """Centroids (cluster_id, centroid), quality (cluster_id, model_name, mean) and axes (model, ...) of one version."""

    version: str
    centroids: DataFrame
    quality: DataFrame
    axes: DataFrame


def read_bundle(spark: SparkSession, root: str, version: str | None = None, dim: int | None = None) -> Bundle:
    """A bundle, the one that the file ``latest`` names unless said otherwise; each model must have axes and a quality in every cluster."""
    version = version or spark.read.text(f"{root}/latest").first()["value"].strip()
    at = f"{root}/{version}"
    text = lambda name: spark.read.option("wholetext", True).text(f"{at}/{name}")
    centroids = read_centroids(spark, f"{at}/centroids.bin", dim=dim)
    means = text("quality_means.json").select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("cluster_id", "m"))
    quality = means.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.explode("m").alias("model_name", "mean"))
    axis = "struct<input_per_1k_usd:double,output_per_1k_usd:double,tps:double,ttft_s:double,verbosity_tokens:double>"
    axes = text("model_axes.json").select(F.explode(F.from_json("value", f"axes map<string,{axis}>")["axes"]).alias("model", "a")).select("model", "a.*")
    whole = centroids.select("cluster_id").crossJoin(F.broadcast(quality.select("model_name").distinct()))
    if whole.join(quality, ["cluster_id", "model_name"], "left_anti").limit(1).count() or quality.join(axes, F.col("model_name") == F.col("model"), "left_anti").limit(1).count():
        raise ValueError(f"{version}: a model without axes or without a quality in some cluster")
    return Bundle(version, centroids, quality, axes)


def extract_archive(path: str, into: str, sha256: str | None = None) -> list[str]:
    """Files of a tar archive, after its hash is checked; links, devices and paths that lead outside stop before anything is written."""
    if sha256 is not None:
        with open(path, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() != sha256:
                raise ValueError("the archive has another hash")
    root = os.path.realpath(into)
    with tarfile.open(path) as tar:
        members = tar.getmembers()
        for m in members:
            target = os.path.realpath(os.path.join(root, m.name))
            if not (m.isfile() or m.isdir()) or os.path.isabs(m.name) or os.path.commonpath([root, target]) != root:
                raise ValueError(f"{m.name} may not be extracted")
        tar.extractall(root, members, filter="data")
    return sorted(m.name for m in members if m.isfile())


# -- sinks ------------------------------------------------------------------


def write_results(outcomes: DataFrame, folder: str, stamp: Column | str = "20250101_000000") -> None:
    """A JSON result file for each data set, split and model: header and records, named by the stamp.

    Records of a file are brought together, as one file is one run over one
    data set; a file is visible only when all are written.
    """
    record = F.struct(F.col("record_index").alias("index"), "prompt", "prompt_tokens", "completion_tokens", "cost", "score", "prediction", "ground_truth")
    by = ["dataset_id", "split", "model_name"]
    files = outcomes.groupBy(*by).agg(F.array_sort(F.collect_list(record)).alias("records"), F.avg("score").alias("performance"))
    body = F.to_json(F.struct("model_name", F.col("dataset_id").alias("dataset_name"), "split", F.lit(False).alias("demo"), "performance", "records"))
    name = F.concat_ws("/", "dataset_id", "split", "model_name", F.concat(F.lit(f"r_{stamp}") if isinstance(stamp, str) else F.concat(F.lit("r_"), stamp), F.lit(".json")))
    rows = files.select(name.alias("name"), body.alias("body"))
    spark = outcomes.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    if hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(folder)):
        raise FileExistsError(folder)
    staged = f"{folder.rstrip('/')}.part-{uuid.uuid4().hex}"
    rows.select("body", "name").write.partitionBy("name").text(staged)
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    done = f"{folder.rstrip('/')}.done-{uuid.uuid4().hex}"
    for status in fs.globStatus(hadoop.Path(f"{staged}/name=*/part-*")) or []:
        path = status.getPath()
        target = hadoop.Path(f"{done}/{_unescape(path.getParent().getName()[5:])}")
        fs.mkdirs(target.getParent())
        fs.rename(path, target)
    fs.rename(hadoop.Path(done), hadoop.Path(folder))
    fs.delete(hadoop.Path(staged), True)


def _unescape(name: str) -> str:
    from urllib.parse import unquote

    return unquote(name)


def write_version(df: DataFrame, root: str, version: str) -> None:
    """A version of a table that must not be there yet; then the file ``latest`` names it."""
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, latest = hadoop.Path(f"{root}/latest.new"), hadoop.Path(f"{root}/latest")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    fs.delete(latest, False)
    fs.rename(fresh, latest)


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{spark.read.text(f'{root}/latest').first()['value']}")


def save_matrix(outcomes: DataFrame, path: str) -> None:
    """Outcomes as a columnar matrix file with its schema's name; an existing one stops."""
    outcomes.withColumn("schema", F.lit(MATRIX_SCHEMA)).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if "schema" not in df.columns or df.where(F.col("schema") != MATRIX_SCHEMA).limit(1).count():
        raise ValueError("a matrix of another schema")
    return df.drop("schema")


def export(df: DataFrame, path: str, form: str, by: Sequence[str] = ()) -> None:
    """JSON lines, CSV with a header, or Parquet; nested columns become JSON in CSV."""
    w = df
    if form == "csv":
        w = df.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes])
    writer = w.write.mode("errorifexists")
    writer = writer.partitionBy(*by) if by else writer
    {"json": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "parquet": writer.parquet}[form](path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Summary tables for a spreadsheet: one CSV file with a header for each."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("errorifexists").option("header", True).csv(f"{folder}/{name}")
