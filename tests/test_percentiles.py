import numpy as np
import pytest

from quaymark.operators import rules
from quaymark.operators.percentiles import percentiles


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.lognormal(3, 2, 500).round(2), "b": np.r_[rng.normal(0, 5, 300), np.zeros(40)], "c": np.array([7.0]), None: rng.integers(-5, 5, 100).astype(float)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("d", None)]
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g]["n"] == len(x)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(x, p))
    one = percentiles(spark.createDataFrame(rows, "g string, v double"), [], "v", {"p50": 0.5}).collect()
    assert len(one) == 1 and one[0]["p50"] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), 0.5))


def test_undominated_points(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(s), float(c)) for i, (s, c) in enumerate(zip(rng.integers(0, 12, 300) / 10, np.r_[rng.integers(0, 40, 250) / 100, rng.lognormal(0, 3, 50)]))]
    got = {r["i"] for r in rules.pareto(spark.createDataFrame(pts, "i int, score double, cost double")).collect()}
    assert got == {i for i, s, c in pts if not any(t >= s and d <= c and (t > s or d < c) for _, t, d in pts)}
