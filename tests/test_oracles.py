"""Every registered query of the engine against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from lattica import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(frame, columns):
    def one(x):
        return None if x is None or x != x else x if isinstance(x, (bool, str)) else round(float(x), 6)

    return sorted((tuple(one(x) for x in row) for row in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want, found = con.sql(registry.ORACLES[name]).df(), registry.QUERIES[name](spark, DIR).toPandas()
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    assert plain(found, columns) == plain(want, columns)
