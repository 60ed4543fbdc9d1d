"""Queries against their SQL on the smallest tables, and the driver contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from strataframe import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = ("zonal_gradient", "quality_report", "crop_grid", "moran", "knn", "first_break", "sonic", "dipmeter", "bouguer", "dn", "rtp", "edges", "raps", "hvsr", "nmo", "sip", "steepest")
TABLES = "region nation customer supplier part orders lineitem events".split()


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in [*TABLES, "embeddings"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(repr, zip(*[d[c].tolist() for c in sorted(d.columns)], strict=True)))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
