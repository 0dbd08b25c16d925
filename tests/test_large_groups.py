"""What only shows in large groups or tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corvella.operators import graph, indices, networks, similarity, trends


def test_squares_of_ranks_do_not_overflow(spark):
    n = 46_400  # the square of this many exceeds 2^31
    p = spark.range(n).select(F.lit("j").alias("journal"), F.col("id").alias("paper_id"), F.lit(50_000).alias("citations"), F.lit(2000).alias("year"))
    assert indices.h_index(p, ["journal"], tie=("paper_id",)).first()[1:] == (n, n, n)
    assert indices.compute_all(p, ["journal"], 2002, ("paper_id",)).select("h_index", "g_index").first() == (n, n)


def test_profiles_keep_the_sign_of_a_mean_that_rounds_to_zero(spark, tmp_path):
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings AS SELECT * FROM (VALUES (0::BIGINT, [-1e-7, 0.25, 1e-7, 0.0]::FLOAT[], 1), (1, [-2e-7, -0.5, 0.0, 0.0]::FLOAT[], 2)) t(vec_id, embedding, label)")
    con.sql("CREATE TABLE events AS SELECT i::BIGINT AS event_id, (i // 2)::BIGINT AS user_id, 'purchase' AS event_type FROM range(4) t(i)")
    for name in ("embeddings", "events"):
        con.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    mine = sorted((r.user_id, repr(r.embedding)) for r in entry.queries()["b20_user_profiles"](spark, str(tmp_path)).collect())
    assert mine == sorted((u, repr(e)) for u, e in con.sql(entry.oracle_sql()["b20_user_profiles"]).fetchall())


def test_projection_by_counts_equals_that_by_arrays(spark):
    rows = [(p, a) for p in range(30) for a in range(9) if (p * 7 + a * a) % 4 == 0]
    m = spark.createDataFrame([*rows, *rows[:5], (None, 3)], "g long, i long")
    size = lambda x, y: F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)) * 2
    want = {tuple(r) for r in networks.generic_projection(m, "g", "i", size).collect()}
    found = networks.generic_projection(m, "g", "i", lambda s, x, y: s / (x + y) * 2, counts=True)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 10
    assert "collect_set" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("keep_self", [False, True])
def test_top_by_cosine_equals_a_plain_search(keep_self):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(9_000, 6)), 1)  # many ties
    x[5] = 0
    xid = r.permutation(20_000)[: len(x)]
    pick = r.integers(0, len(x), 1_100)
    q, qid = x[pick], xid[pick]
    unit = lambda g: g / np.where((n := np.linalg.norm(g, axis=1, keepdims=True)) > 0, n, 1.0)
    for k in (1, 7, 9_500):
        few = slice(None) if k < 100 else slice(0, 3)
        got = similarity.top_by_cosine(q[few], x, qid[few], xid, k, keep_self)
        want = similarity._top_plainly(unit(q[few]), unit(x), qid[few], xid, k, keep_self)
        assert all(np.array_equal(a, b) for a, b in zip(got[:2], want[:2], strict=True)) and np.allclose(got[2], want[2], atol=1.1e-9, rtol=0)


def test_an_exact_search_copies_rows_few_times(spark, monkeypatch):
    e = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("embedding"))
    dealt, run = [], similarity.best_of_cells
    monkeypatch.setattr(similarity, "best_of_cells", lambda q, x, *rest: dealt.append((q, x)) or run(q, x, *rest))
    trends.nearest(e, e, 3)
    assert [(df.count(), df.schema["v"].dataType.simpleString()) for df in dealt[0]] == [(160_000, "array<float>")] * 2


def test_candidates_are_scored_in_their_buckets(spark, monkeypatch):
    """Copies of one vector make large buckets; vectors travel per bucket, not per pair."""
    r = np.random.default_rng(5)
    rows = [(i, [float(z) for z in (r.normal(size=5) if i % 3 else np.ones(5))]) for i in range(600)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {(x.query_id, x.vec_id, x.rank) for x in similarity.nearest(e, e, 4, bits=3).collect()}
    monkeypatch.setattr(similarity, "HOT_ROWS", 40)
    assert {(x.query_id, x.vec_id, x.rank) for x in similarity.nearest(e, e, 4, bits=3).collect()} == whole
    assert {(x.query_id, x.vec_id, x.rank) for x in trends.nearest(e, e, 4).collect()} == {(x.query_id, x.vec_id, x.rank) for x in similarity.nearest(e, e, 4, bits=0).collect()}


def test_peeling_writes_edges_seldom_and_looks_at_what_can_change(spark, monkeypatch):
    r = np.random.default_rng(9)
    rows = {tuple(sorted(p)) for p in r.integers(0, 60, (170, 2)).tolist() if p[0] != p[1]} | {(i, i + 1) for i in range(60, 84)}  # and a chain
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left, layers, cores, core, layer = {v: set(n) for v, n in near.items()}, {}, {}, 1, 0
    while left:
        layer, core = layer + 1, max(core, min(map(len, left.values())))
        go = [v for v, n in left.items() if len(n) <= core]
        for v in go:
            layers[v], cores[v] = layer, core
            for u in left.pop(v):
                if u in left:
                    left[u].discard(v)
    written, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, label: written.append(label) or write(df, label))
    e = spark.createDataFrame(sorted(rows), "src long, dst long")
    assert dict(graph.onion_layers(e).collect()) == layers and layer > 8
    assert written.count("onion-edges") < layer / 2
    assert dict(graph.core_numbers(e).collect()) == cores
    assert "core-hit" in written
