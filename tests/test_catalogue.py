"""Each query of the catalogue against its SQL."""

import glob
import os

import duckdb
import pytest

from weftspark.plans import catalogue, crawled, kept  # noqa: F401  their queries join the catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(found, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([None if r[i] is None else round(r[i], 6) if isinstance(r[i], float) else str(r[i]) for i in at]) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(got.fetchall(), names)
