"""Reshaping of outcome records for other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.operators.joins import small
from quaymark.operators.outcomes import fill_missing
from quaymark.session import cut_table


def prompt_items(records: DataFrame) -> DataFrame:
    """One row per data set and prompt: scores and usages by model as maps, in order of the models' names."""
    entry = F.struct("model_name", "score", F.struct("cost", "prompt_tokens", "completion_tokens").alias("usage"))
    items = records.groupBy("dataset_id", "prompt_key").agg(F.min("record_index").alias("index"), F.array_sort(F.collect_list(entry)).alias("e"))
    return items.select("dataset_id", "prompt_key", "index", F.map_from_entries(F.transform("e", lambda x: F.struct(x["model_name"], x["score"]))).alias("records"), F.map_from_entries(F.transform("e", lambda x: F.struct(x["model_name"], x["usage"]))).alias("usages"))


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """df with numbers from 0 in ``order``: sorted in ranges, numbered within each, and moved by the sizes of the ranges before."""
    t = cut_table(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = sorted((r["p"], r["n"]) for r in t.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row for each range
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, "__p long, __at long")
    return t.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(out, F.col("__at") + F.col("__m") - F.shiftleft("__p", 33)).drop("__p", "__m", "__at")


def dense_ids(df: DataFrame, column: str, out: str) -> DataFrame:
    """Numbers from 0 in order of the distinct values; the values are ranked, not the rows."""
    return numbered(df.select(column).distinct(), column, out)


def label_matrix(records: DataFrame) -> DataFrame:
    """prompt_id, model_id, label for every prompt and model, absent outcomes 0."""
    prompts, models = dense_ids(records, "prompt_key", "prompt_id"), dense_ids(records, "model_name", "model_id")
    cells = prompts.crossJoin(small(models)).join(records.select("prompt_key", "model_name", "score"), ["prompt_key", "model_name"], "left")
    return cells.select("prompt_id", "model_id", F.when(F.col("score") > 0, 1).otherwise(0).cast("long").alias("label"))


def graph_rows(records: DataFrame) -> DataFrame:
    """Long rows with raw cost and cost scaled within the data set (flat counts 0)."""
    w = W.partitionBy("dataset_id")
    low, high = F.min("cost").over(w), F.max("cost").over(w)
    return records.select("dataset_id", "prompt_key", "model_name", "score", "cost", F.coalesce(F.try_divide(F.col("cost") - low, F.nullif(high - low, F.lit(0.0))), F.lit(0.0)).alias("cost_scaled"))


def candidate_pairs(records: DataFrame, a: str, b: str) -> DataFrame:
    """Per prompt the outcomes of exactly two models as an array of structs."""
    two = records.where(F.col("model_name").isin(a, b)).groupBy("prompt_key").agg(F.array_sort(F.collect_list(F.struct("model_name", "score", "cost"))).alias("candidates"))
    return two.where(F.size("candidates") == 2)


def difficulty(records: DataFrame) -> DataFrame:
    """all_correct, all_error or normal, and the accuracy, of each prompt."""
    p = records.groupBy("dataset_id", "prompt_key").agg(F.avg((F.col("score") > 0).cast("int")).alias("accuracy"))
    return p.withColumn("kind", F.when(F.col("accuracy") == 1, "all_correct").when(F.col("accuracy") == 0, "all_error").otherwise("normal"))


def neighbour_pairs(prompts: DataFrame, by: str, key: str, order: str, ahead: int) -> DataFrame:
    """Anchor and positive: each prompt with the next ``ahead`` ones of equal accuracy, linear in the prompts."""
    w = W.partitionBy(by, "accuracy").orderBy(order)
    leads = prompts.select(by, F.col(key).alias("anchor"), *[F.lead(key, k).over(w).alias(f"p{k}") for k in range(1, ahead + 1)])
    return leads.select(by, "anchor", F.explode(F.array_compact(F.array(*[f"p{k}" for k in range(1, ahead + 1)]))).alias("positive"))


def pair_counts(prompts: DataFrame, by: str, ahead: int) -> DataFrame:
    """How many pairs neighbour_pairs gives, in closed form from the sizes of the groups."""
    n = prompts.groupBy(by, "accuracy").agg(F.count("*").alias("n"))
    k = F.lit(ahead)
    m = F.least(k, F.col("n") - 1)
    return n.groupBy(by).agg(F.sum(m * F.col("n") - m * (m + 1) / 2).cast("long").alias("pairs"))


def used_index(used: DataFrame, catalog: DataFrame, key: str, order: str) -> DataFrame:
    """Catalogue rows that are used, numbered again from 0."""
    return numbered(catalog.join(used.select(key).distinct(), key, "left_semi"), order, "new_index")


def filled_items(records: DataFrame, models: DataFrame) -> DataFrame:
    """prompt_items with every model of the roster; absent scores are 0."""
    return prompt_items(fill_missing(records, models, ["dataset_id", "prompt_key", "record_index"], ["score", "cost", "prompt_tokens", "completion_tokens"]))


def with_cluster(items: DataFrame, labels: DataFrame, key: str = "prompt_key") -> DataFrame:
    """items with the cluster_id of their prompt, -1 without one."""
    return items.join(labels.select(key, "cluster_id"), key, "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def triplets(prompts: DataFrame, by: str, key: str, ahead: int, negatives: int) -> DataFrame:
    """by, anchor, positive, negatives: each anchor with a prompt of equal accuracy and its sampled ones of another."""
    from quaymark.operators.splits import sample_negatives

    pos = neighbour_pairs(prompts, by, key, key, ahead)
    neg = sample_negatives(prompts, by, key, negatives).groupBy(by, "anchor").agg(F.sort_array(F.collect_list("negative")).alias("negatives"))
    return pos.join(neg, [by, "anchor"], "left").select(by, "anchor", "positive", F.coalesce("negatives", F.array().cast("array<string>")).alias("negatives"))


# fixed values: what stands in the documents of a conversation where there is nothing
NOTHING_VISIBLE = "Not visible in this turn."
NO_TOOL_CALLS = "No tool calls recorded."


def section(title: str, items: Column) -> Column:
    """A title and a list of lines behind dashes."""
    lines = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    some = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(NOTHING_VISIBLE)))
    return F.concat(F.lit(f"{title}:\n- "), F.array_join(some, "\n- "))


def turn_document(role: Column, index: Column, text: Column, actions: Column) -> Column:
    """The document of a turn: a user's request with its sections, or an agent's actions and what came out."""
    clean = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("[missing prompt text]"))
    empty = F.array().cast("array<string>")
    user = F.concat_ws("\n\n", F.concat(F.lit("User message (turn "), index.cast("string"), F.lit("):")), F.concat(F.lit("Request:\n"), clean), F.concat(F.lit("Intent:\n"), clean), section("Constraints and guidelines", empty), section("Context supplied", empty), section("Clarifications and corrections", empty))
    done = F.when(F.size(actions) > 0, section("Actions", actions)).otherwise(F.lit(f"Actions:\n- {NO_TOOL_CALLS}"))
    outcome = F.when(F.trim(text) != "", F.concat(F.lit("Observed outcome:\n"), F.trim(text)))
    agent = F.concat_ws("\n\n", F.concat(F.lit("Agent reply (turn "), index.cast("string"), F.lit("):")), done, outcome)
    return F.when(role == "user", user).otherwise(agent)
