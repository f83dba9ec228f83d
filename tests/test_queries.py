"""Every query of the catalogue against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import gridframe.queries as catalogue

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(SF)).toPandas()
    assert len(got)
    if name in catalogue.ORACLE_SQL:
        pd.testing.assert_frame_equal(ordered(got), ordered(duck.sql(catalogue.ORACLE_SQL[name]).df()), check_dtype=False, check_exact=True)


def test_nextafter_matches_numpy(spark):
    got = catalogue.nextafter_spacing(spark, str(SF)).toPandas().sort_values("i0")
    prices = catalogue.prices(spark, str(SF)).to_numpy()
    assert np.array_equal(got["n"], np.nextafter(prices, np.inf)) and np.array_equal(got["s"], np.spacing(prices))


def test_signs_of_negative_zeros(spark, tmp_path):
    balances = pd.DataFrame({"c_custkey": np.arange(6), "c_acctbal": [-0.0, 0.0, -1.5, 2.5, -0.0, 150.0]})
    balances.to_parquet(tmp_path / "customer.parquet")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{tmp_path / p.name if p.stem == 'customer' else p}')")
    got = catalogue.QUERIES["sign_minmax"](spark, str(tmp_path)).toPandas().sort_values("i0")
    want = con.sql(catalogue.ORACLE_SQL["sign_minmax"]).df().sort_values("i0")
    for c in want:
        assert np.array_equal(got[c], want[c]) and np.array_equal(np.signbit(got[c].astype(float)), np.signbit(want[c].astype(float))), c
    a = catalogue.balances(spark, str(tmp_path))  # the functions themselves are NumPy's
    for f in (np.sign, np.signbit, lambda x: np.copysign(2.0, x)):
        assert np.array_equal(np.signbit(np.asarray(f(a).to_numpy(), float)), np.signbit(np.asarray(f(balances["c_acctbal"].to_numpy()), float)))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 550
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
