from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entries
from corpusloom import registry

SF = "/root/testdata/sf0.001"


def rows(frame, names):
    told = lambda v: "~" if pd.isna(v) else f"{v:.4f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(told, r)) for r in frame[names].astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = entries.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLE_SQL:
        c = duckdb.connect()
        for f in os.listdir(SF):
            c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
        want = c.execute(registry.ORACLE_SQL[name]).df()
        names = sorted(want.columns)
        assert names == sorted(got.columns)
        assert rows(want, names) == rows(got, names)
