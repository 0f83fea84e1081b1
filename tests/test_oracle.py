"""Every query of the library against its SQL on the smallest tables, where these are there."""

import os
from pathlib import Path

import pandas as pd
import pytest

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables")

from lodequery import catalogue  # noqa: E402


def canonical(df):
    rows = []
    columns = sorted(df.columns)
    for row in df[columns].itertuples(index=False):
        out = []
        for v in row:
            if pd.isna(v):
                out.append(None)
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                out.append(bool(v))
            elif hasattr(v, "isoformat"):
                out.append(v.isoformat()[:19])
            elif isinstance(v, str):
                out.append(v)
            else:
                out.append(round(float(v), 5) + 0.0)
        rows.append(tuple(out))
    return columns, sorted(rows, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert list(got.columns)
    if name in catalogue.oracle_sql():
        assert canonical(got) == canonical(con.execute(catalogue.oracle_sql()[name]).df())
