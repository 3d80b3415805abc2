"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from ledgerlight.plans.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SMALL}/{t}'")
    return con


def rows(pdf, columns):
    def plain(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return None
        x = x.item() if hasattr(x, "item") else x
        # whole numbers of a column with nulls come as floats from one side
        return float(x) if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 1 << 53 else x

    return sorted(tuple(map(repr, map(plain, r))) for r in pdf[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLE:
        wanted = duck.execute(ORACLE[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found, sorted(found.columns)) == rows(wanted, sorted(found.columns))
