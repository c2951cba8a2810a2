import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.ml import estimators as E
from quaymark.operators import matrix as M
from quaymark.operators import splits as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    score = {m: np.clip(0.5 + x @ rng.normal(scale=0.1, size=5), 0, 1) for m in ("a", "b")}
    vectors = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "key long, vec array<double>")
    outcomes = spark.createDataFrame([(i, m, float(s[i]), 1.0) for m, s in score.items() for i in range(300)], "key long, model_name string, score double, cost double")
    return x, score, vectors, outcomes


def test_ridge_is_the_closed_form_in_any_layout(data):
    x, score, vectors, outcomes = data
    got = {(r["key"], r["model_name"]): r for r in E.ridge(vectors, outcomes.repartition(7), E.is_train(), 2.0).collect()}
    assert len(got) == 600
    train = np.array([got[(i, "a")]["part"] == "train" for i in range(300)])
    assert 150 < train.sum() < 260
    z = np.column_stack([np.ones(300), x])
    for m, s in score.items():
        w = np.linalg.solve(z[train].T @ z[train] + 2.0 * np.diag([0, 1, 1, 1, 1, 1]), z[train].T @ s[train])
        assert all(abs(got[(i, m)]["value"] - min(1, max(0, z[i] @ w))) < 1e-9 for i in range(300))


def test_what_is_held_out_is_estimated_better_than_by_the_mean(data):
    _, _, vectors, outcomes = data
    for est in (E.ridge(vectors, outcomes, E.is_train()), E.trees(vectors, outcomes, E.is_train(), "forest")):
        rows = {r["part"]: r for r in E.held_out_error(est, outcomes).collect()}
        assert rows["test"]["mae"] < rows["test"]["baseline_mae"] and rows["train"]["n"] + rows["test"]["n"] == 600


def test_calibration_is_the_isotonic_fit(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 40, 200) / 40
    y = np.clip(v + rng.normal(scale=0.3, size=200), 0, 1)
    df = spark.createDataFrame([(i, "m", float(a), float(b)) for i, (a, b) in enumerate(zip(v, y))], "key long, model_name string, value double, score double")
    got = {r["key"]: r["value"] for r in E.calibrate(df, F.lit(True), steps=40).collect()}
    at = sorted(set(v))
    n = {a: (v == a).sum() for a in at}
    s = {a: y[v == a].sum() for a in at}
    for i, a in enumerate(v):
        k = at.index(a)
        want = max(min(sum(s[b] for b in at[j : e + 1]) / sum(n[b] for b in at[j : e + 1]) for e in range(k, len(at))) for j in range(k + 1))
        assert abs(got[i] - want) < 1e-9
    lone = spark.createDataFrame([(1, "m", 0.2, 1.0), (2, "m", 0.9, 1.0)], df.schema)
    assert [r["value"] for r in E.calibrate(lone, F.col("key") == 1).collect()] == [1.0, 1.0]


def test_draws_do_not_depend_on_the_layout(spark):
    df = spark.range(20_000).select(F.col("id"), E.normal(F.lit(7), F.col("id")).alias("z"))
    r = df.agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(r["m"]) < 0.03 and abs(r["s"] - 1) < 0.03
    assert sorted(df.where("id < 50").collect()) == sorted(df.repartition(9).where("id < 50").collect())


def test_nearest_in_blocks_of_any_size(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(60, 4)), 1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    s = np.round(u @ u.T, 6)
    want = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i), key=lambda j: (-s[i, j], j))[:5]}
    for block in (7, 4096):
        assert {(r["query"], r["neighbour"]) for r in M.nearest(df, df, "id", "v", 5, block).collect()} == want
    c = df.select(F.col("id").cast("int").alias("cluster_id"), F.col("v").alias("centroid"))
    few, many = (M.centroid_similarities(df, c, "id", "v", n).collect() for n in (4096, 3))
    assert {(r["id"], r["cluster_id"]): r["sim"] for r in few} == pytest.approx({(r["id"], r["cluster_id"]): r["sim"] for r in many}, abs=2e-6)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_negatives_come_from_their_strata(spark, k):
    rng = np.random.default_rng(3)
    rows = [("d", f"p{i}", float(a) / 5) for i, a in enumerate(rng.integers(0, 6, 80))] + [("e", "one", 0.2), ("e", "two", 0.2), ("f", "x", 0.0), ("f", "y", 1.0)]
    acc = {(d, p): a for d, p, a in rows}
    got = S.sample_negatives(spark.createDataFrame(rows, "d string, p string, accuracy double"), "d", "p", k).collect()
    by = {}
    for r in got:
        by.setdefault((r["d"], r["anchor"]), []).append(r)
    assert set(by) == {x for x in acc if x[0] != "e"}
    for (d, p), mine in by.items():
        gaps = sorted(round(abs(acc[(d, p)] - a), 9) for (e, _), a in acc.items() if e == d and a != acc[(d, p)])
        n, want = len(gaps), min(k, len(gaps))
        assert len(mine) == want == len({r["negative"] for r in mine})
        assert all(r["gap"] == round(abs(acc[(d, p)] - acc[(d, r["negative"])]), 9) > 0 for r in mine)
        if k == 4 and n >= 20:
            near, mid = gaps[math.ceil(n * 0.5) - 1], gaps[math.ceil(n * 0.8) - 1]
            taken = sorted(r["gap"] for r in mine)
            assert taken[1] <= near and taken[2] <= mid


def test_knobs_hash(spark):
    import hashlib
    import struct

    from quaymark.functions.grading import knobs_hash

    row = spark.createDataFrame([([0.5, 0.25], 0.1, 2.0, 500, True)], "a array<double>, s double, r double, n int, v boolean").select(knobs_hash(*[F.col(c) for c in "asrnv"]).alias("k")).first()
    want = hashlib.sha256(struct.pack("<I", 2) + struct.pack("<dddd", 0.5, 0.25, 0.1, 2.0) + struct.pack("<I", 500) + b"\x01").digest()
    assert int(row["k"], 16) == int.from_bytes(want[:8], "little")
