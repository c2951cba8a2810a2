import math

import pytest

from quaymark.llm import quantiles

PROBS = (0.0, 0.25, 0.5, 0.99, 1.0)


def exact(values, p):
    return sorted(values)[math.floor(p * (len(values) - 1))]


@pytest.mark.parametrize("alpha", [0.01, 0.05])
def test_relative_error_is_kept_after_merging(spark, alpha):
    values = [(-1.5) ** i * (1 + i % 7) for i in range(60)] + [0.0, 0.0, 1e-12, 3.0, 3.0]
    df = spark.createDataFrame([("g", str(i % 4), v, i) for i, v in enumerate(values)], "g string, day string, x double, key int")
    merged = quantiles.merge(quantiles.sketch(df, ["g", "day"], ["x"], alpha), ["g"])
    row = quantiles.percentiles(merged, ["g"], PROBS, alpha).first()
    assert row["n"] == len(values) and row["n_invalid"] == 0
    for p in PROBS:
        want = exact(values, p)
        assert abs(row[f"p{p * 100:g}"] - want) <= alpha * abs(want) + 1e-9
    whole = quantiles.percentiles(quantiles.sketch(df, ["g"], ["x"], alpha), ["g"], PROBS, alpha).first()
    assert whole == row


def test_nulls_invalid_values_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), ("a", -1.0), ("a", float("nan")), ("b", float("inf")), ("b", 2.0)], "g string, x double")
    out = {r["g"]: r for r in quantiles.percentiles(quantiles.sketch(df, ["g"], ["x"], valid="value >= 0"), ["g"], [0.5]).collect()}
    assert out[None]["n"] == 1 and out["a"]["n"] == 0 and out["a"]["n_invalid"] == 1 and out["a"]["p50"] is None
    assert out["b"]["n"] == 1 and out["b"]["n_invalid"] == 1 and abs(out["b"]["p50"] - 2) <= 0.02
    assert quantiles.percentiles(quantiles.sketch(df.limit(0), ["g"], ["x"]), ["g"], [0.5]).collect() == []
