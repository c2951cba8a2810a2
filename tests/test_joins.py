from itertools import combinations

import pytest

from quaymark.operators import joins


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_pairs_within_groups_of_any_size(spark, block):
    rows = [("hot", i) for i in range(40)] + [("one", 1), ("two", 1), ("two", 5), (None, 1), (None, 2)]
    got = joins.pairs_within(spark.createDataFrame(rows, "g string, v int"), "g", "v", "a", "b", block).collect()
    want = {("hot", a, b) for a, b in combinations(range(40), 2)} | {("two", 1, 5)}
    assert len(got) == len(want) and {(r["g"], r["a"], r["b"]) for r in got} == want
