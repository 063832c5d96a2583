"""Every query that has SQL, against its SQL on the same tables; the others by shape and invariants."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from cadenza.plans import registry

SF = os.environ.get("TEST_ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def even(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, dates as text, rows in order."""
    out = df[sorted(df.columns)].copy()
    for c in out:
        if not pd.api.types.is_numeric_dtype(out[c]) or pd.api.types.is_bool_dtype(out[c]):
            out[c] = out[c].map(lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else str(v)[:10] if hasattr(v, "year") else str(v))
        else:
            out[c] = out[c].astype(float)
    return out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_is_its_sql(spark, con, name):
    got, want = even(registry.QUERIES[name](spark, SF).toPandas()), even(con.execute(registry.SQL[name]).df())
    assert len(want) > 0 and list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-6, atol=2e-4)


NO_SQL = sorted(set(registry.QUERIES) - set(registry.SQL))


@pytest.mark.parametrize("name", NO_SQL)
def test_query_without_sql_makes_sound_rows(spark, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    assert len(found) > 0
    for c in found.columns:
        if c in ("y_pred", "liq", "oil", "f", "weight", "share", "coherence", "p", "cp_months"):
            known = found[c].dropna()
            assert len(known) and np.isfinite(known).all() and (known >= 0).all(), c
        if c in ("f", "share", "coherence", "p"):
            assert (found[c].dropna() <= 1 + 1e-3).all(), c


def test_entry_is_the_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert {r["model"] for r in df.collect()} == {"naive", "exp24"}


def test_keys_of_the_oracle_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
