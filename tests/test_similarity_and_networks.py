import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.operators import evidence, merging, similarity, topics, trends


def brute(a, b, least):
    x, y = set(a) - {None}, set(b) - {None}
    return bool(x and y) and len(x & y) / len(x | y) >= least


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_against_all_pairs(spark, least):
    r = random.Random(int(least * 10))
    rows = [(i, [f"t{r.randrange(12) if r.random() < 0.8 else 0}" for _ in range(r.randrange(9))]) for i in range(60)] + [(100, None), (101, [None, "t0"]), (102, ["t0"]), (103, ["x", "y"])]
    frame = spark.createDataFrame(rows, "id long, tokens array<string>")
    sets = {i: frozenset(t or []) - {None} for i, t in rows}
    lead = {}
    for i, s in sets.items():
        lead.setdefault(s, i)
    got = {(x.a, x.b): x.similarity for x in similarity.similar_sets(frame, least).collect()}
    want = {tuple(sorted((lead[p], lead[q]))) for p, q in itertools.combinations(lead, 2) if brute(p, q, least)} | {(lead[s], i) for i, s in sets.items() if s and lead[s] != i}
    assert set(got) == want
    known = frame.filter("id % 2 = 0")
    got = {(x.a, x.b) for x in similarity.similar_to(frame, known, least).collect()}
    assert got == {(i, j) for i in sets for j in sets if j % 2 == 0 and brute(sets[i], sets[j], least)}


def test_titles_and_collapse_through_the_join(spark):
    w = spark.createDataFrame([(1, ["deep", "graph", "nets"], 2000), (2, ["rare"], 2001), (3, None, 2000)], "id long, tokens array<string>, year int")
    k = spark.createDataFrame([(10, ["deep", "graph", "nets", "now"], 2000), (11, ["deep", "graph", "nets"], 2009), (12, ["rare", "a", "b", "c"], 2001)], "id long, tokens array<string>, year int")
    assert {(r.id, r.match): r.score for r in merging.resolve_titles(w, k).collect()} == {(1, 10): 0.75}
    items = spark.createDataFrame([(1, ["a", "b"], 1.0), (2, ["a", "b"], 3.0), (3, ["b", "a", "c"], 2.0), (4, ["z"], 0.5)], "id long, keywords array<string>, score double")
    assert {(r.id, r.members) for r in merging.collapse_similar(items).collect()} == {(2, 3), (4, 1)}


def test_candidates_of_random_projections(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    v = np.concatenate([c + 0.3 * rng.normal(size=(50, 16)) for c in centres])
    rows = [(2**60 + i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (5, None), (6, [1.0, 2.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = trends.nearest(e.filter("size(embedding) = 16"), e.filter("size(embedding) = 16"), 5)
    found = similarity.nearest(e, e, 5)
    r = similarity.recall(found, exact).first()
    assert r.queries == 2000 and r.recall >= 0.9
    assert found.filter("query_id < 1000").count() == 0  # alone in its dimension
    assert {x.query_id for x in exact.collect()} == {2**60 + i for i in range(2000)}


def test_non_negative_factors_against_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.random((12, 3)) @ rng.random((3, 9)) * (rng.random((12, 9)) < 0.5)
    cells = spark.createDataFrame([(f"d{2**40 + i}", int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "row string, col long, w double")
    rows, cols, residual = topics.non_negative_factors(cells, 3, tol=5e-3)
    best = math.inf
    for seed in range(5):
        g = np.random.default_rng(seed)
        w, h = g.random((12, 3)), g.random((3, 9))
        for _ in range(400):
            h *= (w.T @ m) / (w.T @ w @ h + 1e-12)
            w *= (m @ h.T) / (w @ h @ h.T + 1e-12)
        best = min(best, np.linalg.norm(m - w @ h) / np.linalg.norm(m))
    assert residual <= 1.5 * best
    x, y = {r.row: r.x for r in rows.collect()}, {r.col: r.x for r in cols.collect()}
    full = np.array([[np.dot(x[f"d{2**40 + i}"], y[j]) if f"d{2**40 + i}" in x and j in y else 0 for j in range(9)] for i in range(12)])
    assert np.linalg.norm(m - full) / np.linalg.norm(m) == pytest.approx(residual, abs=1e-6)
    assert min(map(min, x.values())) >= 0


CONTRASTS = [("n", "A", "B", 0.5, 0.1), ("n", "A", "B", 0.7, 0.2), ("n", "B", "C", 0.2, 0.1), ("n", "C", "A", -1.2, 0.2), ("n", "C", "D", 0.3, 0.3), ("m", "A", "B", 0.1, 0.1)]


def test_network_model_against_numpy(spark):
    c = spark.createDataFrame(CONTRASTS, "network string, treatment_a string, treatment_b string, effect_size double, se double")
    mine = [x for x in CONTRASTS if x[0] == "n"]
    x = np.zeros((len(mine), 3))
    for i, (_, a, b, _, _) in enumerate(mine):
        for t, s in ((a, -1), (b, 1)):
            if t != "A":
                x[i, "BCD".index(t)] += s
    y, w = np.array([r[3] for r in mine]), np.array([r[4] ** -2 for r in mine])
    cov = np.linalg.inv(x.T @ (w[:, None] * x))
    beta = cov @ x.T @ (w * y)
    effect = dict(zip("ABCD", [0, *beta], strict=True))
    league = {(r.treatment, r.against): r for r in evidence.league_table(c, "network").filter("network = 'n'").collect()}
    assert len(league) == 12 and all(r.effect == pytest.approx(effect[a] - effect[b]) for (a, b), r in league.items())
    assert league["B", "A"].upper - league["B", "A"].effect == pytest.approx(1.959963984540054 * math.sqrt(cov[0, 0]), rel=1e-6)
    rss = float((w * (y - x @ beta) ** 2).sum())
    fit = evidence.network_fit(c, "network").filter("network = 'n'").first()
    loglik = -0.5 * (rss + np.log(2 * math.pi / w).sum())
    assert (fit.rss, fit.aic, fit.bic) == pytest.approx((rss, 6 - 2 * loglik, 3 * math.log(5) - 2 * loglik))
    ranks = evidence.rank_probabilities(c, "network").filter("network = 'n'")
    assert all(r.s == pytest.approx(1) for r in ranks.groupBy("treatment").agg(F.sum("probability").alias("s")).collect())
    sucra = {r.treatment: r.sucra for r in evidence.network_meta(c, "network").filter("network = 'n'").collect()}
    assert sorted(sucra, key=sucra.get) == sorted(effect, key=effect.get) and sum(sucra.values()) == pytest.approx(2)


def test_loops(spark):
    c = spark.createDataFrame(CONTRASTS, "network string, treatment_a string, treatment_b string, effect_size double, se double")
    t = evidence.loop_tests(c, "network").collect()
    w = np.array([0.1, 0.2]) ** -2
    direct, v = (np.array([0.5, 0.7]) * w).sum() / w.sum(), 1 / w.sum()
    z = (direct - (1.2 - 0.2)) / math.sqrt(v + 0.1**2 + 0.2**2)
    assert [(r.a, r.b, r.c, r.comparison) for r in t] == [("A", "B", "C", "B vs A")] and t[0].z == pytest.approx(z)
    got = {r.network: r for r in evidence.loop_inconsistency(c, "network").collect()}
    assert (got["n"].q, got["n"].loops) == (pytest.approx(z * z), 1) and got["n"].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)
    assert (got["m"].q, got["m"].loops, got["m"].p) == (0, 0, 1)


def test_recommendations(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 0.9])], "vec_id long, embedding array<double>")
    h = spark.createDataFrame([(7, 1), (8, 3), (8, 4)], "user_id long, vec_id long")
    got = {(r.user_id, r.rank): r.vec_id for r in trends.recommend_for_users(h, e, 2).collect()}
    assert got == {(7, 1): 2, (7, 2): 4, (8, 1): 2, (8, 2): 1}
    items = spark.createDataFrame([(3, ["x"]), (2, ["y"])], "vec_id long, keywords array<string>")
    top = trends.recommend_for_topic(items, e, e.filter("vec_id = 1"), "x", 2, boost=5.0).collect()
    assert [r.vec_id for r in top] == [3, 1]
    docs = spark.createDataFrame([(1, "Graphs help search. Trees help graphs and search. Nothing else matters here today."), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.summary for r in trends.extractive_summary(docs, 9, 2).collect()} == {1: "Graphs help search. Trees help graphs and search."}
