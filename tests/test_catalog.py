"""Every query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tideweave import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = ([None if pd.isna(v) else getattr(v, "item", lambda v=v: v)() for v in r] for r in frame.values)
    return sorted(map(repr, plain))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name in catalog.oracles():
        want = duck.execute(catalog.oracles()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
