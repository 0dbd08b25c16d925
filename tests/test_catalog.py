import duckdb
import pytest

import __spark_entry__ as entry
from corvella import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"
SAMPLE = ["w1_h_index", "a6_summary_rollup", "n4_co_authorship", "e5_pool_fixed", "p18_word_chunks", "d2_merge_records", "m1_impact_factor", "b13_disruption", "r2_tumbling_counts", "s17_ris", "g16_triangles"]


def _plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 200


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    mine = sorted(repr(tuple(_plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    rel = con.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert mine == sorted(repr(tuple(_plain(r[i]) for i in at)) for r in rel.fetchall())
