"""Splits and samples by the hash of a key: the same in every engine, layout and order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymark.functions.text import hash_bucket


def hash_split(key: Column, train: int = 7000, validation: int = 1500, salt: str = "split") -> Column:
    """train, validation or test by ten-thousandths of the hash of the key."""
    b = hash_bucket(F.concat(F.lit(salt), key), 10_000)
    return F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test")


def pinned_bucket(digest: Column, seed: int, salt: bytes, buckets: int = 10_000) -> Column:
    """The first 64 bits of sha256(salt, a zero, the seed in eight bytes, the digest), modulo; ``digest`` in hexadecimal."""
    head = F.unhex(F.lit((salt + b"\0" + seed.to_bytes(8, "big")).hex()))
    first = F.conv(F.substring(F.sha2(F.concat(head, F.unhex(digest)), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(first, F.lit(buckets).cast("decimal(20,0)")).cast("int")


def pinned_split(digest: Column, seed: int, salt: bytes, train: int = 7000, validation: int = 1500) -> Column:
    b = pinned_bucket(digest, seed, salt)
    return F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test")


def hash_ranks(rows: DataFrame, group: Sequence[str], key: str, slices: int = 64) -> DataFrame:
    """rows with ``rank``, from 0 in the order of the key's hash within its group, and ``total``; a group is ranked in slices of the hash."""
    w = rows.withColumn("__b", hash_bucket(F.col(key), slices)).withColumn("__h", F.sha2(key, 256))
    sizes = w.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__b").alias("__c"), before.alias("__before"), F.sum("__n").over(W.partitionBy(*group)).alias("total"))
    same = F.col("__b") == F.col("__c")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inner = F.row_number().over(W.partitionBy(*group, "__b").orderBy("__h", key)) - 1
    return w.withColumn("__r", inner).join(sizes, same).select(*rows.columns, (F.col("__before") + F.col("__r")).alias("rank"), "total")


def stratified_split(rows: DataFrame, group: str, key: str, test_share: float) -> DataFrame:
    """Of each group round(n * share) keys, half to even, in hash order are test."""
    r = hash_ranks(rows.select(group, key).distinct(), [group], key)
    return r.select(group, key, F.when(F.col("rank") < F.bround(F.col("total") * F.lit(float(test_share))), "test").otherwise("train").alias("part"))


def record_split(records: DataFrame, group: str, keys: Sequence[str], ratio: float) -> DataFrame:
    """Of each group floor(n * ratio) records in hash order are train; one prompt's records may fall on both sides."""
    r = records.select(group, *keys).distinct().withColumn("__key", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    ranked = hash_ranks(r, [group], "__key")
    return ranked.select(group, *keys, F.when(F.col("rank") < F.floor(F.col("total") * ratio), "train").otherwise("test").alias("part"))


def random_policy(key: Column, seed: int, n_models: int) -> Column:
    """A model's place for each key, by a hash."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256), 1, 15), 16, 10).cast("long"), F.lit(n_models))


STRATA = ((0.5, 0.5), (0.8, 0.3), (1.0, 0.2))  # where a stratum of negatives ends, and its share of the sample


def sample_negatives(prompts: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """by, anchor, negative, gap: up to k prompts of other accuracy for each prompt, half from the nearer half, three tenths from the next, the rest from the farthest fifth.

    No prompt meets another: the levels of accuracy within a group are few (one
    more than there are models), so their sizes say which ranks a stratum
    holds; each anchor takes consecutive ranks from a place of its own, and a
    rank is looked up among the numbered prompts of its level.  What a stratum
    can't give comes from the next ones.
    """
    levels = prompts.groupBy(by, "accuracy").agg(F.count("*").alias("n"))
    a, b = levels.select(by, F.col("accuracy").alias("own")), levels.select(by, F.col("accuracy").alias("other"), "n")
    order = W.partitionBy(by, "own").orderBy("gap", "other")
    pairs = a.join(b, by).where("own <> other").withColumn("gap", F.round(F.abs(F.col("own") - F.col("other")), 9))
    pairs = pairs.withColumn("first", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(W.partitionBy(by, "own")))
    sizes = pairs.groupBy(by, "own").agg(F.max("total").alias("total"))
    at = [F.ceil(F.col("total") * F.lit(end)).cast("long") for end, _ in STRATA[:2]]
    begin, size = [F.lit(0).cast("long"), *at], [at[0], at[1] - at[0], F.col("total") - at[1]]
    want = F.least(F.lit(k).cast("long"), F.col("total"))
    near, mid = F.floor(want * 0.5), F.floor(want * 0.3)
    target = [near, mid, want - near - mid]
    take = [F.least(t, s) for t, s in zip(target, size)]
    left = want - take[0] - take[1] - take[2]
    for i in range(3):
        extra = F.least(left, size[i] - take[i])
        take[i], left = take[i] + extra, left - extra
    plan = sizes.select(by, "own", *[F.struct(x.alias("begin"), s.alias("size"), t.alias("take")).alias(f"s{i}") for i, (x, s, t) in enumerate(zip(begin, size, take))])
    anchors = prompts.select(by, F.col(key).alias("anchor"), F.col("accuracy").alias("own")).join(plan, [by, "own"])
    turn = F.conv(F.substring(F.sha2(F.col("anchor").cast("string"), 256), 1, 8), 16, 10).cast("long")

    def ranks_of(s: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0).cast("long"), s["take"] - 1), lambda j: s["begin"] + F.pmod(turn + j, F.greatest(s["size"], F.lit(1))))
        return F.when(s["take"] > 0, some).otherwise(F.array().cast("array<bigint>"))

    picks = F.flatten(F.array(*[ranks_of(F.col(f"s{i}")) for i in range(3)]))
    ranks = anchors.select(by, "own", "anchor", F.explode(picks).alias("rank"))
    placed = ranks.join(pairs.select(by, "own", "other", "gap", "first", "n"), [by, "own"]).where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    numbered = hash_ranks(prompts.select(by, F.col(key).alias("negative"), F.col("accuracy").alias("other")), [by, "other"], "negative").select(by, "other", "negative", F.col("rank").alias("inner"))
    return placed.withColumn("inner", F.col("rank") - F.col("first")).join(numbered, [by, "other", "inner"]).select(by, "anchor", "negative", "gap")


def ratio_split(prompts: DataFrame, group: str, key: str, ratio: float, all_test: Sequence[str] = ()) -> DataFrame:
    """Of each group floor(n * ratio) keys in hash order are train; ``all_test`` groups are all test.

    Ranking needs a group's keys in order; partial windows are cut by the hash
    itself, so that a group of any size is ranked in parallel.
    """
    ranked = hash_ranks(prompts.select(group, key).distinct(), [group], key)
    train = (F.col("rank") < F.floor(F.col("total") * ratio)) & ~F.col(group).isin(*all_test)
    return ranked.select(group, key, F.when(train, "train").otherwise("test").alias("part"))


def leaks(split: DataFrame, key: str, part: str) -> DataFrame:
    """Keys that stand in more than one part."""
    return split.groupBy(key).agg(F.countDistinct(part).alias("parts")).where("parts > 1")


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n keys of the smallest hash: a sample that does not depend on order."""
    return df.orderBy(F.sha2(key, 256)).limit(n)


def per_group(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows of each group in hash order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(group).orderBy(F.sha2(key, 256)))).where(F.col("__rn") <= n).drop("__rn")


def cap_per_group(df: DataFrame, group: str, key: str, order: str, n: int) -> DataFrame:
    """The first n different keys of each group."""
    first = df.groupBy(group, key).agg(F.min(order).alias("__o"))
    keep = first.withColumn("__rn", F.row_number().over(W.partitionBy(group).orderBy("__o"))).where(F.col("__rn") <= n)
    return keep.select(group, key)
