"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

import clauseloom.plans.curation_queries
import clauseloom.plans.pair_queries
import clauseloom.plans.record_queries
import clauseloom.plans.stream_queries
import clauseloom.plans.text_queries  # noqa: F401
from clauseloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    rel = db.sql(registry.SQL[name])
    cols = sorted(rel.columns)
    assert cols == sorted(df.columns)
    order = [rel.columns.index(c) for c in cols]
    expected = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == expected


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["x11_capital_phrases", "x12_citations", "e20_bullets", "e18_order_sections", "m06_m11_fuzzy_ratios", "e25_link_names", "e31_pillar_actions", "e29_numbered_sections"])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
