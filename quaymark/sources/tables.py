"""Readers of the parquet tables of a data directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "request_telemetry", "request_feedback", "installations", "api_keys", "ranking_files", "model_axes", "name_list",
)


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str | Column) -> DataFrame:
    """One table; naming columns keeps the scan's ReadSchema narrow."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def present_tables(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> DataFrame:
    """name, present: which tables a data directory has."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.createDataFrame([(n, fs.exists(spark._jvm.org.apache.hadoop.fs.Path(root, f"{n}.parquet"))) for n in names], "name string, present boolean")


def canonical_id(col: Column | str) -> Column:
    """An id without surrounding blanks and braces, in lower case; blank becomes null."""
    col = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.lower(col), r"^[\s{} ]+|[\s{} ]+$", "")
    return F.when(bare != "", bare)
