"""Outcome records (prompt x model): cleaning, statistics and reference points.

Records are long: one row per prompt and model with score and cost.  Nulls in
a score are missing outcomes: averages skip them, counts of records keep them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.operators.joins import small
from quaymark.operators.percentiles import percentiles

PROMPT = ("dataset_id", "split", "record_index")


def group_stats(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean score, records, correct ones (score > 0), total and mean cost, tokens per group."""
    return records.groupBy(*by).agg(
        F.avg("score").alias("avg_score"),
        F.count("*").alias("n_records"),
        F.count_if(F.col("score") > 0).alias("n_correct"),
        F.sum("cost").alias("total_cost"),
        F.avg("cost").alias("avg_cost"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )


def global_stats(records: DataFrame) -> DataFrame:
    """One row of totals and distinct counts; zeros on empty input."""
    zero = F.lit(0).cast("long")
    return records.agg(
        F.count("*").alias("n_records"),
        F.countDistinct("dataset_id", "split").alias("n_datasets"),
        F.countDistinct("model_name").alias("n_models"),
        F.countDistinct(*PROMPT).alias("n_prompts"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), zero).alias("total_tokens"),
        F.array_join(F.sort_array(F.collect_set("model_name")), ",").alias("models"),
    )


def macro_micro(records: DataFrame, by: Sequence[str] = ("model_name",), inner: str = "dataset_id") -> DataFrame:
    """macro: mean of the means of ``inner``; micro: mean of all records."""
    one = records.groupBy(*by, inner).agg(F.avg("score").alias("m"), F.sum("score").alias("s"), F.count("score").alias("n"))
    return one.groupBy(*by).agg(F.avg("m").alias("macro"), F.try_divide(F.sum("s"), F.sum("n")).alias("micro"))


def conflicting_prompts(records: DataFrame, prompt: str, model: str, values: Sequence[str]) -> DataFrame:
    """Prompts for which some model has more than one different outcome; equal repeats are no conflict."""
    outcomes = records.select(prompt, model, *values).distinct().groupBy(prompt, model).count()
    return outcomes.where("count > 1").select(prompt).distinct()


def reject_conflicts(records: DataFrame, prompt: str, model: str, values: Sequence[str]) -> DataFrame:
    """Distinct records of prompts without any conflict."""
    clean = records.select(prompt, model, *values).distinct()
    return clean.join(conflicting_prompts(records, prompt, model, values), prompt, "left_anti")


def complete_roster(records: DataFrame, prompt: str, model: str, n_models: int) -> DataFrame:
    """Records of prompts that have an outcome of every model."""
    whole = records.groupBy(prompt).agg(F.countDistinct(model).alias("n")).where(F.col("n") == n_models).select(prompt)
    return records.join(whole, prompt, "left_semi")


def load_audit(records: DataFrame, prompt: str, model: str, values: Sequence[str], n_models: int) -> DataFrame:
    """Raw rows, accepted prompts and rejected ones by reason; a conflict comes before an incomplete roster."""
    cell = records.groupBy(prompt, model, *values).agg(F.count("*").alias("n")).groupBy(prompt, model).agg(F.sum("n").alias("rows"), F.count("*").alias("kinds"))
    per = cell.groupBy(prompt).agg(F.sum("rows").alias("rows"), F.max("kinds").alias("kinds"), F.count("*").alias("models"))
    return per.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("raw_rows"),
        F.count_if((F.col("kinds") == 1) & (F.col("models") == n_models)).alias("accepted"),
        F.count_if(F.col("kinds") > 1).alias("rejected_conflict"),
        F.count_if((F.col("kinds") == 1) & (F.col("models") != n_models)).alias("rejected_incomplete"),
    )


def fill_missing(records: DataFrame, models: DataFrame, prompt: Sequence[str], values: Sequence[str], model: str = "model_name") -> DataFrame:
    """Every prompt with every model of the (small) roster, absent values 0, and whether a row was filled."""
    grid = records.select(*prompt).distinct().crossJoin(small(models.select(model)))
    full = grid.join(records.select(*prompt, model, *values, F.lit(1).alias("__here")), [*prompt, model], "left")
    return full.select(*prompt, model, *[F.coalesce(v, F.lit(0).cast(records.schema[v].dataType)).alias(v) for v in values], F.col("__here").isNull().alias("filled"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def oracle_any_correct(records: DataFrame, by: Sequence[str] = ("dataset_id", "split")) -> DataFrame:
    """Share of questions that any model gets right, and the cost of the cheapest right model, else of the cheapest."""
    prompt = records.groupBy(*PROMPT).agg(F.max(F.when(F.col("score") > 0, 1).otherwise(0)).alias("hit"), F.coalesce(F.min(F.when(F.col("score") > 0, F.col("cost"))), F.min("cost")).alias("c"))
    return prompt.groupBy(*by).agg(F.avg("hit").alias("oracle_accuracy"), F.sum("c").alias("oracle_cost"), F.count("*").alias("n_prompts"))


def max_expert(records: DataFrame, by: Sequence[str] = ("dataset_id", "split")) -> DataFrame:
    """The model of the best mean score per group and what it cost; ties go to the smaller name."""
    per = group_stats(records, [*by, "model_name"])
    w = W.partitionBy(*by).orderBy(F.desc("avg_score"), "model_name")
    return per.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*by, F.col("model_name").alias("expert"), F.col("avg_score").alias("expert_score"), F.col("total_cost").alias("expert_cost"))


def best_then_cheapest(records: DataFrame, prompt: str = "prompt_key") -> DataFrame:
    """Per prompt the outcome of the highest score, the cheapest of equal ones, then the first of the roster."""
    best = records.groupBy(prompt).agg(F.min(F.struct((-F.col("score")).alias("s"), "cost", "ord", "model_name")).alias("b"))
    return best.select(prompt, F.col("b.model_name").alias("model_name"), (-F.col("b.s")).alias("score"), F.col("b.cost").alias("cost"))


def reference_points(records: DataFrame) -> DataFrame:
    """name, score, cost: each model alone, the best and the cheapest one, the mean of all, and the oracle."""
    singles = records.groupBy("model_name").agg(F.avg("score").alias("score"), F.avg("cost").alias("cost"))
    one = singles.agg(
        F.max_by("model_name", F.struct(F.round("score", 9), F.col("model_name"))).alias("bm"), F.max("score").alias("bs"), F.max_by("cost", F.struct(F.round("score", 9), F.col("model_name"))).alias("bc"),
        F.min_by("score", F.struct(F.round("cost", 9), F.col("model_name"))).alias("cs"), F.min("cost").alias("cc"), F.avg("score").alias("rs"), F.avg("cost").alias("rc"),
    )
    points = one.select(F.explode(F.array(
        F.struct(F.lit("best_single").alias("name"), F.col("bs").alias("score"), F.col("bc").alias("cost")),
        F.struct(F.lit("cheapest").alias("name"), F.col("cs").alias("score"), F.col("cc").alias("cost")),
        F.struct(F.lit("random_mean").alias("name"), F.col("rs").alias("score"), F.col("rc").alias("cost")),
    )).alias("p")).select("p.*")
    oracle = best_then_cheapest(records).agg(F.avg("score").alias("score"), F.avg("cost").alias("cost")).select(F.lit("oracle").alias("name"), "score", "cost")
    named = singles.select(F.concat(F.lit("single:"), "model_name").alias("name"), "score", "cost")
    return named.unionByName(points).unionByName(oracle)


def sampled(records: DataFrame, salt: str = "42") -> DataFrame:
    """One record of each question, drawn by a hash of salt, question and model: what a router that picks blindly gets."""
    draw = F.sha2(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in PROMPT], "model_name"), 256)
    one = records.groupBy(*PROMPT).agg(F.min_by(F.struct("model_name", "score", "cost"), F.struct(draw, "model_name")).alias("r"))
    return one.select(*PROMPT, "r.*")


def random_router(records: DataFrame, by: Sequence[str] = ("dataset_id", "split"), salt: str = "42") -> DataFrame:
    """Mean score, total and mean cost of one drawn record per question."""
    return sampled(records, salt).groupBy(*by).agg(F.avg("score").alias("score"), F.sum("cost").alias("total_cost"), F.avg("cost").alias("avg_cost"), F.count("*").alias("n_prompts"))


def _long(df: DataFrame, row: Column, cells: Sequence[tuple[Column, Column]]) -> DataFrame:
    """row, column, value of a frame whose columns are cells."""
    parts = F.array(*[F.struct(name.alias("column"), value.cast("double").alias("value")) for name, value in cells])
    return df.select(row.alias("row"), F.explode(parts).alias("c")).select("row", "c.column", "c.value")


def _domain(ood: Sequence[str]) -> Column:
    return F.when(F.col("dataset_id").isin(*ood), "OOD").otherwise("In-Dist")


def summary_table(records: DataFrame, ood: Sequence[str], salt: str = "42") -> DataFrame:
    """row, column, value of the scores: models, their mean, a blind router, the best expert and the oracle.

    Columns are data sets, the means of data sets in each domain and in all,
    and the means of samples in each domain and in all.  A model without
    records in a domain has a sample mean of 0 there, which draws the mean of
    the models down.  Max Expert is the highest model value of each column, but
    its Dataset-Avg is the mean of the highest values of the data sets.  The
    oracle's value is the share of questions that any model gets right.
    """
    r = records.withColumn("domain", _domain(ood))
    cells = r.groupBy("model_name", "dataset_id", "domain").agg(F.avg("score").alias("v"), F.sum("score").alias("s"), F.count("score").alias("n"))
    models = _columns(cells, "model_name")
    grid = models.select("row").distinct().crossJoin(F.broadcast(models.where("column like '%Sample-Avg'").select("column").distinct()))  # three columns
    models = models.unionByName(grid.join(models, ["row", "column"], "left_anti").withColumn("value", F.lit(0.0)))
    mean = models.groupBy("column").agg(F.avg("value").alias("value")).select(F.lit("AVG").alias("row"), "column", "value")
    top = models.groupBy("column").agg(F.max("value").alias("value")).where("column <> 'Dataset-Avg'").select(F.lit("Max Expert").alias("row"), "column", "value")
    top_all = cells.groupBy("dataset_id").agg(F.max("v").alias("v")).agg(F.avg("v").alias("value")).select(F.lit("Max Expert").alias("row"), F.lit("Dataset-Avg").alias("column"), "value")
    hit = r.groupBy(*PROMPT, "domain").agg(F.max(F.when(F.col("score") > 0, 1).otherwise(0)).alias("hit"))
    oracle = hit.groupBy("dataset_id", "domain").agg(F.avg("hit").alias("v"), F.sum("hit").alias("s"), F.count("hit").alias("n"))
    blind = sampled(records, salt).withColumn("domain", _domain(ood)).groupBy("dataset_id", "domain").agg(F.avg("score").alias("v"), F.sum("score").alias("s"), F.count("score").alias("n"))
    out = models.unionByName(mean).unionByName(top).unionByName(top_all)
    for name, one in (("Oracle", oracle), ("Random Router", blind)):
        out = out.unionByName(_columns(one.withColumn("model_name", F.lit(name)), "model_name"))
    return out


def _columns(cells: DataFrame, row: str) -> DataFrame:
    """Values of rows in the columns of a summary, from cells with mean v, sum s and number n per data set."""
    sets = cells.groupingSets([[row, "domain"], [row]], row, "domain").agg(F.avg("v").alias("a"), (F.sum("s") / F.sum("n")).alias("m"))
    data = cells.select(F.col(row).alias("row"), F.col("dataset_id").alias("column"), F.col("v").alias("value"))
    return data.unionByName(_long(sets, F.col(row), [(F.concat(F.coalesce("domain", F.lit("Dataset")), F.lit("-Avg")), F.col("a")), (F.concat(F.coalesce("domain", F.lit("All")), F.lit("-Sample-Avg")), F.col("m"))]))


def cost_table(records: DataFrame, ood: Sequence[str], salt: str = "42") -> DataFrame:
    """row, column, value of the total costs, with the rows of summary_table.

    Columns are data sets and, per domain and in all, the mean and the sum over
    data sets.  Max Expert is what the model of the best mean score cost in
    each data set, but its sums are the highest sum of any model.  The oracle
    pays the cheapest right answer of each question, or its cheapest one.
    """
    r = records.withColumn("domain", _domain(ood))
    cells = r.groupBy("model_name", "dataset_id", "domain").agg(F.sum("cost").alias("v"), F.avg("score").alias("quality"))
    models = _cost_columns(cells)
    mean = models.groupBy("column").agg(F.avg("value").alias("value")).select(F.lit("AVG").alias("row"), "column", "value")
    best = cells.groupBy("dataset_id", "domain").agg(F.min_by("v", F.struct(-F.round("quality", 9), "model_name")).alias("v")).withColumn("model_name", F.lit("Max Expert"))
    sums = models.where("column like '%-Sum'").groupBy("column").agg(F.max("value").alias("value")).select(F.lit("Max Expert").alias("row"), "column", "value")
    paid = r.groupBy(*PROMPT, "domain").agg(F.coalesce(F.min(F.when(F.col("score") > 0, F.col("cost"))), F.min("cost")).alias("c")).groupBy("dataset_id", "domain").agg(F.sum("c").alias("v")).withColumn("model_name", F.lit("Oracle"))
    blind = sampled(records, salt).withColumn("domain", _domain(ood)).groupBy("dataset_id", "domain").agg(F.sum("cost").alias("v")).withColumn("model_name", F.lit("Random Router"))
    out = models.unionByName(mean).unionByName(_cost_columns(best).where("column not like '%-Sum'")).unionByName(sums)
    return out.unionByName(_cost_columns(paid)).unionByName(_cost_columns(blind))


def _cost_columns(cells: DataFrame) -> DataFrame:
    sets = cells.groupingSets([["model_name", "domain"], ["model_name"]], "model_name", "domain").agg(F.avg("v").alias("a"), F.sum("v").alias("t"))
    part = F.coalesce("domain", F.lit("Dataset"))
    data = cells.select(F.col("model_name").alias("row"), F.col("dataset_id").alias("column"), F.col("v").cast("double").alias("value"))
    return data.unionByName(_long(sets, F.col("model_name"), [(F.concat(part, F.lit("-Avg")), F.col("a")), (F.concat(part, F.lit("-Sum")), F.col("t"))]))


def pivot_models(records: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Model x dataset pivot of the mean score, with ALL, cost per thousand, median and mean tokens."""
    wide = records.groupBy("model_name").pivot("dataset_id", list(sources)).agg(F.avg("score"))
    total = records.groupBy("model_name").agg(F.avg("score").alias("ALL"), (F.avg("cost") * 1000).alias("cost_per_1k"), F.avg("completion_tokens").alias("mean_tokens"))
    median = percentiles(records, ["model_name"], "completion_tokens", {"median_tokens": 0.5}).drop("n")
    return wide.join(total, "model_name").join(median, "model_name", "left")


def metric_means(records: DataFrame, maps: str, positive: Sequence[str] = ()) -> DataFrame:
    """metric, mean, n over the entries of a map column; null values are no entries.

    Of the metrics in ``positive``, such as times, only values above 0 count; -1 without any.
    """
    e = records.select(F.explode(maps).alias("metric", "v")).where("v is not null")
    some = F.col("metric").isin(*positive) if positive else F.lit(False)
    g = e.groupBy("metric").agg(F.avg("v").alias("all"), F.avg(F.when(F.col("v") > 0, F.col("v"))).alias("pos"), F.count("*").alias("n"))
    return g.select("metric", F.when(some, F.coalesce("pos", F.lit(-1.0))).otherwise(F.col("all")).alias("mean"), "n")


def parse_strict(rows: DataFrame, fields: dict[str, str], required: Sequence[str] = ()) -> DataFrame:
    """rows with their fields in the given types, and ``problem``: the first field that is missing or can't be read, null for a good row."""
    problem = None
    typed = {c: F.col(c).try_cast(t) for c, t in fields.items()}
    for c in fields:
        bad = (F.col(c).isNotNull() & typed[c].isNull()) | (F.col(c).isNull() if c in required else F.lit(False))
        problem = F.when(bad, c) if problem is None else problem.when(bad, c)
    return rows.withColumn("problem", problem).withColumns(typed)


def parse_audit(parsed: DataFrame) -> DataFrame:
    """problem, n: how many rows were good (null) and how many failed by which field."""
    return parsed.groupBy("problem").agg(F.count("*").alias("n"))


def baseline_scores(records: DataFrame) -> DataFrame:
    """round(100 * mean, 2) per model and dataset."""
    return records.groupBy("model_name", "dataset_id").agg(F.round(100 * F.avg("score"), 2).alias("score"))


def cost_efficiency(records: DataFrame, by: str = "dataset_id") -> DataFrame:
    """accuracy, mean cost, efficiency and the percentile of the mean cost among all costs of the group.

    The percentile comes from counts per different cost: both are put in order
    and counted in one running sum, so no record meets a model.
    """
    per = records.groupBy(by, "model_name").agg(F.avg("score").alias("accuracy"), F.avg("cost").alias("avg_cost"))
    costs = records.groupBy(by, F.col("cost").alias("c")).agg(F.count("*").alias("n")).select(by, "c", "n", F.lit(None).cast("string").alias("model_name"))
    marks = per.select(by, F.col("avg_cost").alias("c"), F.lit(0).cast("long").alias("n"), "model_name")
    before = W.partitionBy(by).orderBy("c", F.col("model_name").isNull()).rowsBetween(W.unboundedPreceding, -1)  # marks before costs of one value
    ranked = costs.unionByName(marks).withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(W.partitionBy(by)))
    below = ranked.where("model_name is not null").select(by, "model_name", (100.0 * F.col("below") / F.col("total")).alias("cost_percentile"))
    return per.join(below, [by, "model_name"]).withColumn("efficiency", F.col("accuracy") / (F.col("avg_cost") + 1e-8))


def latency_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, p50, p95, p99 of positive values and the share of rows without one."""
    ok = df.select(*by, F.when(F.col(value) > 0, F.col(value).cast("double")).alias("__ok"))
    whole = ok.groupBy(*by).agg(F.count("__ok").alias("n"), F.avg("__ok").alias("mean"), (F.count_if(F.col("__ok").isNull()) / F.count("*")).alias("missing_share"))
    p = percentiles(ok, by, "__ok", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")
    same = F.lit(True)
    for i, k in enumerate(by):
        p = p.withColumnRenamed(k, f"__g{i}")
        same = same & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    return whole.join(p, same, "left").select(*by, "n", "mean", "p50", "p95", "p99", "missing_share")
