"""Queries of the subpackage with an oracle give the oracle's rows at the smallest scale."""

import importlib.util
import os

import pytest

from quaymark.llm import queries

_spec = importlib.util.spec_from_file_location("core_oracles", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "test_oracles.py"))
core = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(core)
duck = core.duck


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    got, want = queries.QUERIES[name](spark, core.SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert core.rows(core.number(got)) == core.rows(core.number(want))
