"""Every registered query against its SQL in an independent engine, on the smallest tables."""

from __future__ import annotations

import glob
import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from gristmill.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        x = df[c]
        if pd.api.types.is_numeric_dtype(x.dtype) and not pd.api.types.is_bool_dtype(x.dtype):
            df[c] = x.astype(float)
        else:
            df[c] = x.map(lambda v: "" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v)[:10] if hasattr(v, "year") else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    got = QUERIES[name](spark, SF).toPandas()
    spark.catalog.clearCache()  # what the query held
    if name not in ORACLE_SQL:
        assert len(got.columns)
        return
    want = engine.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for c in a:
        if a[c].dtype == float:
            np.testing.assert_allclose(a[c], b[c].astype(float), rtol=0, atol=2e-6 * max(1.0, np.nanmax(np.abs(a[c]), initial=0)), equal_nan=True, err_msg=c)
        else:
            assert (a[c] == b[c]).all(), c


def test_sql_has_no_engine_settings():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert not any(re.search(r"\bSET\b|\bPRAGMA\b", s) for s in ORACLE_SQL.values())
