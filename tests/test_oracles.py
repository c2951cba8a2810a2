"""Every query of the core with an oracle gives the oracle's rows at the smallest scale."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quaymark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v) or v is pd.NA:
        return None
    return f"{v + 0.0:.9g}" if isinstance(v, (float, np.floating)) else str(v)


def rows(df):
    cols = sorted(df.columns)
    whole = [c for c in cols if df[c].dtype.kind == "f" and df[c].dropna().mod(1).eq(0).all()]
    df = df.astype({c: "Float64" for c in whole})
    return sorted(map(str, ([plain(v if v is None or v is pd.NA else float(v) if c in whole else v) for c, v in zip(cols, r)] for r in df[cols].itertuples(index=False, name=None))))


def number(df):
    return df.assign(**{c: df[c].astype(float) for c in df.columns if df[c].dtype.kind in "iuf"})


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(number(got)) == rows(number(want))


def test_every_query_has_a_stable_schema(spark):
    for name in ("references_singles", "p2_found", "p4_found", "p6_found"):
        assert catalog.QUERIES[name](spark, SF).dtypes == catalog.QUERIES[name](spark, SF).dtypes
