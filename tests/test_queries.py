"""Every registered query of the markup operators against DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from loomtext.plans import ORACLES, QUERIES

DATA = Path(os.environ.get("LOOMTEXT_TESTDATA", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or not isinstance(v, (list, tuple)) and pd.isna(v):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    return sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, duck):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
