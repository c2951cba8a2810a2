import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaymark.llm import packing, tokens


def check(spark, sizes, capacity):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k long, n long")
    rows = packing.pack(df, "k", "n", capacity).collect()
    load, seen = {}, {}
    for r in rows:
        seen.setdefault(r["k"], []).append((r["piece_start"], r["piece_size"]))
        if r["container_id"] is not None:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["piece_size"]
            assert r["piece_size"] > 0
        else:
            assert r["piece_size"] == 0
    assert max(load.values(), default=0) <= capacity
    assert sorted(load) == list(range(len(load)))
    for i, n in enumerate(sizes):
        parts = sorted(seen[i])
        assert sum(p for _, p in parts) == max(n or 0, 0)
        if (n or 0) <= capacity:
            assert len(parts) == 1
        at = 0
        for start, size in parts:
            assert start == at
            at += size
    return load


def test_small_cases(spark):
    assert len(check(spark, [5, 5, 5, 5], 10)) == 2
    assert len(check(spark, [10], 10)) == 1
    check(spark, [None, 0, -3, 25, 1], 10)
    assert check(spark, [0], 10) == {}
    check(spark, [2100, 2048, 2047, 1025, 1030, 4097], 2050)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "k long, n long, container_id int")
    assert packing.pack(df, "k", "n", 10).collect() == []
    df = spark.createDataFrame([("a", 3, 1), ("a", 3, 2), (None, 4, 3)], "k string, n int, container_id int")
    assert {r["container_id"] for r in packing.pack(df, "k", "n", 10).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=33, max_size=33))
def test_plan_holds_every_item_once(counts):
    hist = np.array([0, *counts[1:]])
    used = np.zeros_like(hist)
    for n, content in packing.plan_containers(hist):
        assert n > 0 and sum(k * m for k, m in content.items()) <= len(hist) - 1
        for k, m in content.items():
            used[k] += n * m
    assert (used == hist).all()


def test_fill_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    sizes = np.minimum(512, (rng.lognormal(4.3, 0.9, 20_000) + 1).astype(int))
    hist = np.bincount(sizes, minlength=513)
    n = sum(g[0] for g in packing.plan_containers(hist))
    assert sizes.sum() / (n * 512) > 0.995


@pytest.mark.parametrize("capacity", [512, 2048, 8192])
def test_documents(spark, sf, capacity):
    sizes = tokens.count_tokens(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    row = packing.fill_report(packing.pack(sizes, "doc_id", "n_tokens", capacity), capacity).first()
    assert row["n_tokens"] == sizes.groupBy().sum("n_tokens").first()[0]
    assert row["fill"] > {512: 0.98, 2048: 0.97, 8192: 0.9}[capacity]
