"""Numeric operators on outcomes and vectors: scaling, similarity, blending and choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.operators.joins import small


def zscore(col: str, by: Sequence[str]) -> Column:
    """(x - mean) / population deviation within a group; 0 where the deviation is 0."""
    w = W.partitionBy(*by)
    return F.coalesce(F.try_divide(F.col(col) - F.avg(col).over(w), F.nullif(F.stddev_pop(col).over(w), F.lit(0.0))), F.lit(0.0))


def clip01(z: Column, limit: float = 3.0) -> Column:
    """Clipped to [-limit, limit] and moved to [0, 1]."""
    return (F.greatest(F.lit(-limit), F.least(F.lit(limit), z)) + limit) / (2 * limit)


def minmax(col: str, by: Sequence[str] = ()) -> Column:
    """(x - min) / (max - min) within a group; 0 for a flat one.  No ``by``: over all rows, for small tables."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    low, high = F.min(col).over(w), F.max(col).over(w)
    return F.coalesce(F.try_divide(F.col(col) - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0))


def shrink(mean: Column, n: Column, prior: Column, k0: float) -> Column:
    """(n * mean + k0 * prior) / (n + k0); the prior where there is nothing."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, prior).otherwise((n * mean + k0 * prior) / (n + k0))


def kish(weight: str) -> Column:
    """Effective number of observations, (sum w)^2 / sum w^2; 0 for no weight."""
    return F.coalesce(F.try_divide(F.pow(F.sum(weight), F.lit(2.0)), F.nullif(F.sum(F.col(weight) * F.col(weight)), F.lit(0.0))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """a / |a|; a vector of zeros stays one."""
    return F.transform(a, lambda x: x.cast("double") / F.when(norm(a) == 0, 1.0).otherwise(norm(a)))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0))), F.lit(0.0))


def _packed(df: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """ids, vs: the rows in lists of about ``rows``, which is what one cell of a blocked product holds."""
    n = max(1, -(-df.count() // rows))
    part = F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("__b")
    return df.groupBy(part).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias("rows"))


def centroid_similarities(vectors: DataFrame, centroids: DataFrame, key: str, vector: str, max_centroids: int = 4096) -> DataFrame:
    """key, cluster_id, sim of every vector and centroid.

    Centroids are few by nature; their number is checked before they are sent
    to all tasks.  Beyond the limit both sides are packed into blocks, and a
    block of vectors meets a block of centroids in one matrix product.
    """
    unit = centroids.select("cluster_id", l2_normalize(F.col("centroid")).alias("c"))
    if centroids.limit(max_centroids + 1).count() <= max_centroids:
        return vectors.crossJoin(F.broadcast(unit)).withColumn("sim", F.round(dot(F.col(vector), F.col("c")), 6)).drop("c", vector)
    import numpy as np
    import pandas as pd

    rest = [c for c in vectors.columns if c not in (key, vector)]
    pairs = _packed(vectors, key, vector, 1024).select(F.col("rows").alias("a")).crossJoin(_packed(unit, "cluster_id", "c", 1024).select(F.col("rows").alias("b")))

    def product(batches):
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"]):
                ids, cs = [r["id"] for r in a], [r["id"] for r in b]
                s = np.array([r["v"] for r in a], np.float64) @ np.array([r["v"] for r in b], np.float64).T
                yield pd.DataFrame({key: np.repeat(ids, len(cs)), "cluster_id": np.tile(cs, len(ids)), "sim": np.round(s, 6).ravel()})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    out = pairs.mapInPandas(product, f"{key} {kind(vectors, key)}, cluster_id {kind(centroids, 'cluster_id')}, sim double")
    return out.join(vectors.select(key, *rest), key).select(key, *rest, "cluster_id", "sim") if rest else out


def top_p(sims: DataFrame, key: str, p: int) -> DataFrame:
    """The p most similar clusters of each key, ties to the smaller id, with their rank."""
    w = W.partitionBy(key).orderBy(F.desc("sim"), "cluster_id")
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p)


def softmax_weights(df: DataFrame, col: str, by: Sequence[str], temperature: float, out: str = "weight") -> DataFrame:
    w = W.partitionBy(*by)
    e = df.withColumn("__e", F.exp((F.col(col) - F.max(col).over(w)) / temperature))
    return e.withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def cluster_means(assigned: DataFrame, value: str = "score", by: Sequence[str] = ("cluster_id", "model_name")) -> DataFrame:
    return assigned.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def cluster_rankings(means: DataFrame) -> DataFrame:
    """Rank of the models within each cluster, from 1; ties by name."""
    w = W.partitionBy("cluster_id").orderBy(F.desc("mean"), "model_name")
    return means.withColumn("rank", F.row_number().over(w))


def rank_score(near: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    """Sum over the nearest clusters of weight / rank."""
    return near.drop("rank").join(ranked, "cluster_id").groupBy(key, "model_name").agg(F.sum(F.col("weight") / F.col("rank")).alias("value"))


def score_blend(near: DataFrame, means: DataFrame, key: str) -> DataFrame:
    """Sum over the nearest clusters of weight * mean."""
    return near.join(means, "cluster_id").groupBy(key, "model_name").agg(F.sum(F.col("weight") * F.col("mean")).alias("value"))


def blend_alpha(near: DataFrame, quality: DataFrame, cost_norm: DataFrame, key: str, alpha: float) -> DataFrame:
    """Sum over the nearest clusters of alpha * quality + (1 - alpha) * (1 - cost)."""
    q = near.select(key, "cluster_id").join(quality.select("cluster_id", "model_name", "q_norm"), "cluster_id").join(small(cost_norm), "model_name")
    return q.groupBy(key, "model_name").agg(F.sum(alpha * F.col("q_norm") + (1 - alpha) * (1 - F.col("c_norm"))).alias("value"))


def argmax_first(scored: DataFrame, by: Sequence[str], value: str = "value", order: str = "model_name", digits: int = 9) -> DataFrame:
    """The row of the highest value per group, the first in ``order`` of equal ones.

    Values are compared rounded, so that sums taken in another order don't decide.
    """
    w = W.partitionBy(*by).orderBy(F.desc(F.round(value, digits)), order)
    return scored.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def runner_up(scored: DataFrame, by: Sequence[str], value: str = "value", order: str = "model_name", digits: int = 9) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc(F.round(value, digits)), order)
    return scored.withColumn("place", F.row_number().over(w)).where("place = 2").drop("place")


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, rows_per_block: int = 4096) -> DataFrame:
    """query, neighbour, sim, rank: the k most similar base rows of each query, by blocks of a matrix product.

    Both sides are packed into blocks of at most about ``rows_per_block`` rows,
    whatever their layout.  A block of queries meets a block of the base once
    and keeps k candidates there, so what is shuffled grows with the queries
    and the number of base blocks, not with the base.  Ties go to the smaller
    neighbour.  The result is exact.
    """
    import numpy as np
    import pandas as pd

    pairs = _packed(queries, key, vector, rows_per_block).select(F.col("rows").alias("qs")).crossJoin(_packed(base, key, vector, rows_per_block).select(F.col("rows").alias("vs")))

    def best(batches):
        for pdf in batches:
            for vs, qs in zip(pdf["vs"], pdf["qs"]):
                ids, x = np.array([r["id"] for r in vs]), np.array([r["v"] for r in vs], np.float64)
                qi, y = np.array([r["id"] for r in qs]), np.array([r["v"] for r in qs], np.float64)
                x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
                y = y / np.maximum(np.linalg.norm(y, axis=1), 1e-12)[:, None]
                for at in range(0, len(qi), 512):  # similarities of a stretch of queries at a time
                    s = np.round(y[at : at + 512] @ x.T, 6)
                    few = np.argpartition(-s, min(k + 1, s.shape[1] - 1), axis=1)[:, : k + 1]
                    least = np.take_along_axis(s, few, 1).min(1)
                    rows, cols = np.nonzero(s >= least[:, None])  # with all that tie with the last one
                    yield pd.DataFrame({"query": qi[at + rows], "neighbour": ids[cols], "sim": s[rows, cols]})

    found = pairs.mapInPandas(best, "query long, neighbour long, sim double").where("query <> neighbour")
    w = W.partitionBy("query").orderBy(F.desc("sim"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
