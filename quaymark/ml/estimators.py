"""Quality estimators: clusters, regressions, trees, factors, calibration.

Training data are long outcomes (key, model_name, score) and vectors (key,
vec).  Estimators are fitted on the keys that ``train`` selects and give values
for every key, with the part it belongs to, so that what was held out can be
told from what was fitted.  k-means and trees depend on the seed and on the
layout of the rows; with given centroids, and for ridge, calibration and draws,
results are the same in any layout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, NGram, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.operators.joins import small
from quaymark.operators.matrix import centroid_similarities, clip01, minmax, nearest, shrink, softmax_weights, top_p, zscore
from quaymark.operators.rules import hash_share


def with_vector(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def is_train(key: str = "key", share: int = 70) -> Column:
    """Whether a key belongs to the fitted part, by its hash."""
    return hash_share(F.col(key), "fit|") < share * 1000


def centroids_of(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """cluster_id, centroid of a k-means."""
    f = with_vector(vectors, "vec")
    found = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(f).clusterCenters()
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(found)], "cluster_id int, centroid array<double>")


def nearest_clusters(vectors: DataFrame, centroids: DataFrame, p: int) -> DataFrame:
    """key, cluster_id, sim, rank of the p centroids most similar to each vector, by cosine to the centroids of length 1."""
    return top_p(centroid_similarities(vectors, centroids, "key", "vec"), "key", p)


def cluster_table(labels: DataFrame, outcomes: DataFrame, value: str, k0: float) -> DataFrame:
    """cluster_id, model_name, q: means of the clusters, shrunk towards the model's mean over all rows; every cluster has every model."""
    prior = outcomes.groupBy("model_name").agg(F.avg(value).alias("prior"))
    means = labels.select("key", "cluster_id").join(outcomes, "key").groupBy("cluster_id", "model_name").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    grid = labels.select("cluster_id").distinct().crossJoin(small(prior))
    return grid.join(means, ["cluster_id", "model_name"], "left").select("cluster_id", "model_name", shrink(F.col("mean"), F.coalesce("n", F.lit(0)), F.col("prior"), k0).alias("q"))


def cluster_estimates(vectors: DataFrame, outcomes: DataFrame, centroids: DataFrame, k0: float = 20.0, p: int = 1, train: Column | None = None) -> DataFrame:
    """key, model_name, value: the mean of the shrunk z-means of the p nearest clusters."""
    near = nearest_clusters(vectors, centroids, p)
    z = outcomes.withColumn("z", zscore("score", ["key"]))
    table = cluster_table(near.where("rank = 1"), z if train is None else z.where(train), "z", k0)
    return near.select("key", "cluster_id").join(table, "cluster_id").groupBy("key", "model_name").agg(F.avg("q").alias("value"))


def equal_top_scores(vectors: DataFrame, outcomes: DataFrame, centroids: DataFrame, bias: float, k0: float, p: int, train: Column | None = None) -> DataFrame:
    """key, model_name, value of the policy of equal top clusters.

    Per prompt scores become clipped z-scores within [0, 1]; clusters hold
    their shrunk means, scaled within the cluster; the p nearest ones are added
    up and weighed against p times the model's cheapness.
    """
    fitted = outcomes if train is None else outcomes.where(train)
    near = nearest_clusters(vectors, centroids, p)
    z = fitted.withColumn("z", clip01(zscore("score", ["key"])))
    table = cluster_table(near.where("rank = 1"), z, "z", k0).withColumn("q", F.round("q", 9)).withColumn("qn", minmax("q", ["cluster_id"]))
    cost = fitted.groupBy("model_name").agg(F.avg("cost").alias("c")).withColumn("cn", minmax("c")).select("model_name", "cn")
    q = near.select("key", "cluster_id").join(table, "cluster_id").groupBy("key", "model_name").agg(F.sum("qn").alias("s"))
    return q.join(small(cost), "model_name").select("key", "model_name", (bias * F.col("s") + (1 - bias) * p * (1 - F.col("cn"))).alias("value"))


def centroid_scores(vectors: DataFrame, outcomes: DataFrame, centroids: DataFrame, k0: float, p: int, temperature: float, train: Column | None = None) -> DataFrame:
    """key, model_name, value: raw scores of the p nearest clusters, shrunk, weighed by the softmax of their similarity."""
    near = softmax_weights(nearest_clusters(vectors, centroids, p), "sim", ["key"], temperature)
    table = cluster_table(near.where("rank = 1"), outcomes if train is None else outcomes.where(train), "score", k0)
    return near.select("key", "cluster_id", "weight").join(table, "cluster_id").groupBy("key", "model_name").agg(F.sum(F.col("weight") * F.col("q")).alias("value"))


def grid_search(vectors: DataFrame, outcomes: DataFrame, centroids: DataFrame, train: Column, held_out: Column, ps: Sequence[int], k0s: Sequence[float], temperatures: Sequence[float], biases: Sequence[float]) -> DataFrame:
    """p, k0, temperature, objective, place of every setting of centroid_scores; the objective is the mean regret over the biases.

    Similarities are computed once; settings are a product of short lists.  A
    pick's regret is the best utility of its prompt less the pick's, scaled by
    the spread of the prompt's utilities.  The smallest setting wins a tie.
    """
    spark = vectors.sparkSession
    near = nearest_clusters(vectors, centroids, max(ps))
    labels = near.where("rank = 1")
    fitted = outcomes.where(train)
    k_grid = spark.createDataFrame([(float(x),) for x in k0s], "k0 double")
    p_grid = spark.createDataFrame([(int(p), float(t)) for p in ps for t in temperatures], "p int, temperature double")
    b_grid = spark.createDataFrame([(float(b),) for b in biases], "bias double")
    prior = fitted.groupBy("model_name").agg(F.avg("score").alias("prior"), F.avg("cost").alias("c")).withColumn("cn", minmax("c"))
    means = labels.select("key", "cluster_id").join(fitted, "key").groupBy("cluster_id", "model_name").agg(F.avg("score").alias("mean"), F.count("score").alias("n"))
    table = labels.select("cluster_id").distinct().crossJoin(small(prior)).join(means, ["cluster_id", "model_name"], "left").crossJoin(F.broadcast(k_grid))
    table = table.select("cluster_id", "model_name", "k0", "cn", shrink(F.col("mean"), F.coalesce("n", F.lit(0)), F.col("prior"), F.col("k0")).alias("q"))
    some = near.join(outcomes.where(held_out).select("key").distinct(), "key", "left_semi").crossJoin(F.broadcast(p_grid)).where(F.col("rank") <= F.col("p"))
    by = W.partitionBy("key", "p", "temperature")
    weighed = some.withColumn("e", F.exp((F.col("sim") - F.max("sim").over(by)) / F.col("temperature"))).withColumn("w", F.col("e") / F.sum("e").over(by))
    est = weighed.join(table, "cluster_id").groupBy("key", "p", "temperature", "k0", "model_name").agg(F.sum(F.col("w") * F.col("q")).alias("q"), F.first("cn").alias("cn"))
    setting = ["key", "p", "temperature", "k0", "bias"]
    scored = est.crossJoin(F.broadcast(b_grid)).withColumn("v", F.col("bias") * F.col("q") + (1 - F.col("bias")) * (1 - F.col("cn")))
    pick = scored.groupBy(*setting).agg(F.min_by("model_name", F.struct(-F.round("v", 9), "model_name")).alias("model_name"))
    useful = outcomes.where(held_out).crossJoin(F.broadcast(b_grid)).withColumn("qs", minmax("score", ["key", "bias"])).withColumn("cs", minmax("cost", ["key", "bias"]))
    useful = useful.withColumn("u", F.col("bias") * F.col("qs") + (1 - F.col("bias")) * (1 - F.col("cs")))
    each = W.partitionBy("key", "bias")
    useful = useful.withColumn("regret", F.coalesce(F.try_divide(F.max("u").over(each) - F.col("u"), F.nullif(F.max("u").over(each) - F.min("u").over(each), F.lit(0.0))), F.lit(0.0)))
    got = pick.join(useful.select("key", "bias", "model_name", "regret"), ["key", "bias", "model_name"])
    per = got.groupBy("p", "k0", "temperature", "bias").agg(F.avg("regret").alias("r")).groupBy("p", "k0", "temperature").agg(F.avg("r").alias("objective"))
    return per.withColumn("place", F.row_number().over(W.orderBy(F.round("objective", 9), "p", "k0", "temperature")).cast("long"))


def ridge(vectors: DataFrame, outcomes: DataFrame, train: Column, penalty: float = 1.0) -> DataFrame:
    """key, model_name, value, part: ridge regressions of all models on the vector, from one pass of sums.

    What leaves a task are the products of the vectors with themselves and
    with the scores, one row per model; a model without training rows gives no
    values.  Values are held within [0, 1].  The constant is not penalised.
    """
    rows = vectors.join(outcomes.where(train).select("key", "model_name", "score"), "key").where("score is not null")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, g in pdf.groupby("model_name"):
                x = np.column_stack([np.ones(len(g)), np.stack(g["vec"].to_numpy()).astype(float), g["score"].to_numpy(float)])
                total[name] = total.get(name, 0) + x.T @ x
        yield pd.DataFrame({"model_name": list(total), "s": [v.tobytes() for v in total.values()]})

    parts: dict[str, np.ndarray] = {}
    for r in rows.select("vec", "model_name", "score").mapInPandas(sums, "model_name string, s binary").toLocalIterator():
        parts[r["model_name"]] = parts.get(r["model_name"], 0) + np.frombuffer(r["s"])
    names = sorted(parts)
    weights = []
    for name in names:
        n = int(np.sqrt(len(parts[name])))
        s = parts[name].reshape(n, n)
        reg = penalty * np.eye(n - 1)
        reg[0, 0] = 0
        weights.append(np.linalg.solve(s[:-1, :-1] + reg + 1e-12 * np.eye(n - 1), s[:-1, -1]))
    b = np.array(weights)  # models x dimensions

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and len(names):
                x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["vec"].to_numpy()).astype(float)])
                v = np.clip(x @ b.T, 0, 1)
                yield pd.DataFrame({"key": np.repeat(pdf["key"].to_numpy(), len(names)), "model_name": np.tile(names, len(pdf)), "value": v.ravel()})

    kind = vectors.schema["key"].dataType.simpleString()
    out = vectors.select("key", "vec").mapInPandas(predict, f"key {kind}, model_name string, value double")
    return out.withColumn("part", F.when(train, "train").otherwise("test"))


MAX_MODELS = 1000  # a roster; each model is a fit of its own


def roster(outcomes: DataFrame) -> list[str]:
    names = [r["model_name"] for r in outcomes.select("model_name").distinct().limit(MAX_MODELS + 1).collect()]
    if len(names) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    return sorted(names)


def trees(vectors: DataFrame, outcomes: DataFrame, train: Column, kind: str = "gbt", seed: int = 42) -> DataFrame:
    """key, model_name, value, part: a tree ensemble for each model of the roster, fitted on the training keys."""
    f = with_vector(vectors, "vec").select("key", "features")
    out = None
    for name in roster(outcomes):
        rows = f.join(outcomes.where((F.col("model_name") == name) & train).select("key", "score"), "key")
        if kind == "gbt":
            estimator = GBTRegressor(featuresCol="features", labelCol="score", maxIter=10, maxDepth=3, seed=seed)
        else:
            estimator = RandomForestRegressor(featuresCol="features", labelCol="score", numTrees=10, maxDepth=4, seed=seed)
        one = estimator.fit(rows).transform(f).select("key", F.lit(name).alias("model_name"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("part", F.when(train, "train").otherwise("test"))


def held_out_error(estimates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """part, n, mae, baseline_mae: the mean absolute error of estimates, and of the mean training score of each model."""
    j = estimates.join(outcomes.select("key", "model_name", "score"), ["key", "model_name"])
    prior = j.where("part = 'train'").groupBy("model_name").agg(F.avg("score").alias("prior"))
    return j.join(small(prior), "model_name").groupBy("part").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("score") - F.col("value"))).alias("mae"), F.avg(F.abs(F.col("score") - F.col("prior"))).alias("baseline_mae"))


def factor_estimates(outcomes: DataFrame, train: Column, rank: int = 4, seed: int = 42) -> DataFrame:
    """key, model_name, value, part: a factorisation of the prompt x model matrix; ``train`` selects its cells."""
    ids = {name: i for i, name in enumerate(roster(outcomes))}
    number = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    data = outcomes.select("key", "model_name", F.col("key").cast("int").alias("user"), F.element_at(number, F.col("model_name")).alias("item"), F.col("score").cast("float").alias("score"), F.when(train, "train").otherwise("test").alias("part"))
    model = ALS(rank=rank, maxIter=5, regParam=0.1, userCol="user", itemCol="item", ratingCol="score", seed=seed, coldStartStrategy="drop").fit(data.where("part = 'train'"))
    return model.transform(data).select("key", "model_name", F.col("prediction").cast("double").alias("value"), "part")


def calibrate(estimates: DataFrame, train: Column, steps: int = 1000) -> DataFrame:
    """key, model_name, value, part: estimates (key, model_name, value, score) made monotone in what was realised on the training rows.

    Values are put on a grid of 1 / steps, so a model of any number of rows is
    at most steps + 1 points, weighed by their rows; pools of adjacent
    violators are merged there and the steps between are interpolated.
    Outside the training range the end values hold.
    """
    grid = F.least(F.lit(steps), F.greatest(F.lit(0), F.round(F.col("value") * steps))).cast("int")
    points = estimates.where(train & F.col("score").isNotNull()).groupBy("model_name", grid.alias("bin")).agg(F.sum("score").alias("s"), F.count("score").alias("n"))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        blocks: list[list[float]] = []
        for s, n in zip(pdf["s"], pdf["n"]):
            blocks.append([s, n, 1])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
                b = blocks.pop()
                blocks[-1] = [x + y for x, y in zip(blocks[-1], b)]
        level = np.repeat([s / n for s, n, _ in blocks], [int(k) for _, _, k in blocks])
        at = np.arange(steps + 1)
        return pd.DataFrame({"model_name": pdf["model_name"].iloc[0], "bin": at.astype(np.int32), "level": np.clip(np.interp(at, pdf["bin"], level), 0, 1)})

    table = points.groupBy("model_name").applyInPandas(pool, "model_name string, bin int, level double")
    out = estimates.withColumn("bin", grid).join(table, ["model_name", "bin"])
    return out.select("key", "model_name", F.col("level").alias("value"), F.when(train, "train").otherwise("test").alias("part"))


def scaled(vectors: DataFrame) -> DataFrame:
    """key, vec: columns with mean 0 and deviation 1."""
    f = with_vector(vectors, "vec")
    return StandardScaler(inputCol="features", outputCol="s", withMean=True, withStd=True).fit(f).transform(f).select("key", vector_to_array("s").alias("vec"))


def reduced(vectors: DataFrame, k: int) -> DataFrame:
    """key, vec: the first k principal components."""
    f = with_vector(vectors, "vec")
    return PCA(k=k, inputCol="features", outputCol="p").fit(f).transform(f).select("key", vector_to_array("p").alias("vec"))


def text_vectors(texts: DataFrame, buckets: int = 1024, k: int = 64) -> DataFrame:
    """key, vec: hashed grams of two to four characters weighted by rarity and reduced; an embedder that needs no model."""
    chars = texts.select("key", F.filter(F.split(F.lower("text"), ""), lambda c: c != "").alias("chars")).where(F.size("chars") >= 4)
    for n in (2, 3, 4):
        chars = NGram(n=n, inputCol="chars", outputCol=f"g{n}").transform(chars)
    grams = chars.select("key", F.concat("g2", "g3", "g4").alias("grams"))
    tf = HashingTF(numFeatures=buckets, inputCol="grams", outputCol="tf").transform(grams)
    weighted = IDF(inputCol="tf", outputCol="features").fit(tf).transform(tf)
    return PCA(k=k, inputCol="features", outputCol="p").fit(weighted).transform(weighted).select("key", vector_to_array("p").alias("vec"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that follows from the parts alone: the same in any layout and engine."""
    n = F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("double")
    return (n + 0.5) / 281474976710656.0


def normal(*parts: Column) -> Column:
    """A standard normal number that follows from the parts alone."""
    return F.sqrt(-2 * F.ln(uniform(F.lit("r"), *parts))) * F.cos(2 * math.pi * uniform(F.lit("a"), *parts))


def bootstrap(values: DataFrame, value: str, by: Sequence[str] = (), replicates: int = 1000, salt: str = "boot") -> DataFrame:
    """mean, lo, hi per group: percentile interval of the mean by Poisson weights.

    A row's weight in a replicate follows from the hash of its key and the
    replicate, so rows are read once and only sums leave a task.
    """
    weight = F.lit(8)
    u = uniform(F.lit(salt), F.col("key"), F.col("r"))
    cdf = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(8)])
    for k in range(7, -1, -1):
        weight = F.when(F.col("__u") < float(cdf[k]), k).otherwise(weight)
    reps = values.select("key", *by, value, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r")).withColumn("__u", u).withColumn("w", weight)
    means = reps.where(F.col(value).isNotNull()).groupBy(*by, "r").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    ends = means.groupBy(*by).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    whole = values.groupBy(*by).agg(F.avg(value).alias("mean"))
    return whole.join(ends, list(by)) if by else whole.crossJoin(F.broadcast(ends))


def paired_bootstrap(a: DataFrame, b: DataFrame, value: str, replicates: int = 1000) -> DataFrame:
    """mean, lo, hi of the difference a - b over the keys of both; a key has the same weight on both sides."""
    both = a.select("key", F.col(value).alias("x")).join(b.select("key", F.col(value).alias("y")), "key")
    return bootstrap(both.select("key", (F.col("x") - F.col("y")).alias("d")), "d", (), replicates, "paired")


def thompson(posterior: DataFrame, near: DataFrame, key: str, fallback: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Pick per key of the highest draw N(mean, variance), the highest of its clusters.

    A model without a posterior in any cluster of a key counts with its
    ``fallback`` value (key, model_name, value).
    """
    draws = near.join(posterior, "cluster_id").withColumn("draw", F.col("mean") + F.sqrt("variance") * normal(F.lit(seed), F.col(key), F.col("cluster_id"), F.col("model_name")))
    best = draws.groupBy(key, "model_name").agg(F.max("draw").alias("draw"))
    if fallback is not None:
        rest = fallback.join(best, [key, "model_name"], "left_anti").select(key, "model_name", F.col("value").alias("draw"))
        best = best.unionByName(rest)
    return best.groupBy(key).agg(F.max_by("model_name", F.struct(F.round("draw", 9), "model_name")).alias("model_name"))


def win_shares(posterior: DataFrame, trials: int = 1024, seed: int = 42) -> DataFrame:
    """Share of replays that each model of a cluster wins, at least 1 / trials."""
    draws = posterior.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("draw", F.col("mean") + F.sqrt("variance") * normal(F.lit(seed), F.col("cluster_id"), F.col("model_name"), F.col("t")))
    wins = draws.groupBy("cluster_id", "t").agg(F.max_by("model_name", F.struct(F.round("draw", 9), "model_name")).alias("model_name")).groupBy("cluster_id", "model_name").agg((F.count("*") / trials).alias("share"))
    return posterior.select("cluster_id", "model_name").join(wins, ["cluster_id", "model_name"], "left").select("cluster_id", "model_name", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(1 / trials)).alias("propensity"))


def band_of(actions: DataFrame, bands: dict[str, str], threshold: float = 0.5) -> DataFrame:
    """key, band, p_large: a head's action probabilities (key, action, probability) added up per band; small below the threshold of large."""
    large = F.sum(F.when(F.col("action").isin(*[a for a, b in bands.items() if b == "large"]), F.col("probability")).otherwise(0.0))
    return actions.groupBy("key").agg(large.alias("p_large")).select("key", F.when(F.round("p_large", 9) < threshold, "small").otherwise("large").alias("band"), "p_large")


def sensitivity(vectors: DataFrame, outcomes: DataFrame, k: int, sharpness: float) -> DataFrame:
    """key, model_name, value: neighbours' scores weighted by similarity ** sharpness, shrunk by the effective number of neighbours."""
    near = nearest(vectors, vectors, "key", "vec", k).withColumn("w", F.pow(F.greatest("sim", F.lit(0.0)), F.lit(float(sharpness))))
    prior = outcomes.groupBy("model_name").agg(F.avg("score").alias("prior"))
    j = near.select(F.col("query").alias("key"), F.col("neighbour"), "w").join(outcomes.select(F.col("key").alias("neighbour"), "model_name", "score"), "neighbour")
    g = j.groupBy("key", "model_name").agg(F.try_divide(F.sum(F.col("w") * F.col("score")), F.nullif(F.sum("w"), F.lit(0.0))).alias("m"), F.coalesce(F.try_divide(F.pow(F.sum("w"), F.lit(2.0)), F.nullif(F.sum(F.col("w") * F.col("w")), F.lit(0.0))), F.lit(0.0)).alias("n"))
    return g.join(small(prior), "model_name").select("key", "model_name", shrink(F.col("m"), F.col("n"), F.col("prior"), 5.0).alias("value"))


def leave_family_out(vectors: DataFrame, outcomes: DataFrame, families: DataFrame, centroids: DataFrame, k0: float, p: int, temperature: float) -> DataFrame:
    """family, n, mae: estimates for each family of prompts (key, family) from the prompts of all other families.

    Cluster sums are taken per family once; a family's table is all sums less
    its own, so nothing is fitted again.
    """
    near = softmax_weights(nearest_clusters(vectors, centroids, p), "sim", ["key"], temperature)
    rows = near.where("rank = 1").select("key", "cluster_id").join(outcomes, "key").join(families, "key")
    own = rows.groupBy("family", "cluster_id", "model_name").agg(F.sum("score").alias("s"), F.count("score").alias("n"))
    whole = own.groupBy("cluster_id", "model_name").agg(F.sum("s").alias("ws"), F.sum("n").alias("wn"))
    mine = own.groupBy("family", "model_name").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    every = own.groupBy("model_name").agg(F.sum("s").alias("as"), F.sum("n").alias("an"))
    table = mine.join(small(every), "model_name").withColumn("prior", F.try_divide(F.col("as") - F.col("fs"), F.nullif(F.col("an") - F.col("fn"), F.lit(0)))).select("family", "model_name", "prior").join(whole, "model_name").join(own, ["family", "cluster_id", "model_name"], "left")
    n = F.col("wn") - F.coalesce("n", F.lit(0))
    table = table.withColumn("q", shrink(F.try_divide(F.col("ws") - F.coalesce("s", F.lit(0.0)), F.nullif(n, F.lit(0))), n, F.col("prior"), k0)).select("family", "cluster_id", "model_name", "q")
    est = near.select("key", "cluster_id", "weight").join(families, "key").join(table, ["family", "cluster_id"]).groupBy("key", "family", "model_name").agg(F.sum(F.col("weight") * F.col("q")).alias("value"))
    return est.join(outcomes.select("key", "model_name", "score"), ["key", "model_name"]).groupBy("family").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("value") - F.col("score"))).alias("mae"))


def state_posteriors(turns: DataFrame, means: Sequence[Sequence[float]], variances: Sequence[Sequence[float]], transition: Sequence[Sequence[float]], start: Sequence[float]) -> DataFrame:
    """session_key, call_id, posterior: forward and backward passes of a hidden Markov model with Gaussian emissions, in logs.

    A session is a sequence of its own and as long as a conversation is.
    """
    mu, var, a, p0 = (np.asarray(x, float) for x in (means, variances, np.log(np.asarray(transition, float) + 1e-300), np.log(np.asarray(start, float) + 1e-300)))

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    def run(pdf):
        pdf = pdf.sort_values(["ts", "call_id"])
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        e = -0.5 * (((x[:, None] - mu) ** 2 / var) + np.log(2 * np.pi * var)).sum(2)
        f = np.zeros_like(e)
        b = np.zeros_like(e)
        f[0] = p0 + e[0]
        for t in range(1, len(e)):
            f[t] = e[t] + lse(f[t - 1][:, None] + a, 0)
        for t in range(len(e) - 2, -1, -1):
            b[t] = lse(a + (e[t + 1] + b[t + 1])[None], 1)
        g = f + b
        post = np.exp(g - lse(g, 1)[:, None])
        return pdf[["session_key", "call_id"]].assign(posterior=list(post))

    return turns.groupBy("session_key").applyInPandas(run, "session_key long, call_id long, posterior array<double>")
