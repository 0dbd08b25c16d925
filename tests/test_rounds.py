"""Rounds of power iterations read the last one once; triangles are counted, not listed."""

import itertools
import random

import numpy as np
import pytest

from corvella.operators import blocks, graph


@pytest.fixture
def some_edges():
    r = random.Random(8)
    return sorted({(a, b) for a, b in itertools.permutations(range(14), 2) if r.random() < 0.3} | {(a, b) for a, b in itertools.combinations(range(20, 27), 2)} | {(40, 41)})


def test_plans_of_rounds_do_not_grow_by_powers(spark, some_edges, monkeypatch):
    joins = []
    write = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, label: (joins.append(df._jdf.queryExecution().analyzed().toString().count("Join ")), write(df, label))[1])
    e = spark.createDataFrame([x for x in some_edges if x[0] < 20], "src long, dst long")
    ids = sorted({i for x in some_edges if x[0] < 20 for i in x})
    m = np.array([[float((a, b) in set(some_edges)) for b in ids] for a in ids])
    hub, x = np.ones(len(ids)), np.ones(len(ids))
    for _ in range(400):
        authority = m.T @ hub
        hub = m @ authority
        hub /= hub.sum()
        x = x + (m + m.T) @ x
        x /= np.linalg.norm(x)
    got = {r.id: r for r in graph.hits(e, tol=1e-9).collect()}
    assert np.allclose([got[i].hub for i in ids], hub, atol=1e-7) and np.allclose([got[i].authority for i in ids], authority / authority.sum(), atol=1e-7)
    got = {r.id: r.x for r in graph.eigenvector(e, tol=1e-9).collect()}
    assert np.allclose([got[i] for i in ids], x, atol=1e-6)
    k = np.linalg.solve(np.eye(len(ids)) - 0.005 * (m + m.T), np.ones(len(ids)))
    assert np.allclose([r.x for r in sorted(graph.katz(e, tol=1e-9).collect(), key=lambda r: r.id)], k, atol=1e-6)
    assert max(joins) <= 8


@pytest.mark.parametrize("size,dense", [(4, 3), (512, 8192)])
def test_triangles_are_counted_without_a_list(spark, some_edges, monkeypatch, size, dense):
    monkeypatch.setattr(blocks, "BLOCK", size)
    monkeypatch.setattr(blocks, "DENSE", dense)
    monkeypatch.setattr(graph, "_triangles", None)
    near = {}
    for a, b in some_edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    got = {r.id: (r.triangles, r.k) for r in graph.triangle_counts(spark.createDataFrame(some_edges, "src long, dst long")).collect()}
    assert got == {a: (sum(y in near[x] for x, y in itertools.combinations(n, 2)), len(n)) for a, n in near.items()}


def test_betweenness_and_distances_share_one_search(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(graph, "_hops", lambda *a, hops=graph._hops: (runs.append(1), hops(*a))[1])
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 4)], "src long, dst long")
    found = graph.searched(e, graph.vertices(e))
    got = {r.id: r.betweenness for r in graph.betweenness(e, graph.vertices(e), found=found).collect()}
    assert got == {1: 0.0, 2: 2.0, 3: 0.0, 4: 0.0} and len(runs) == 1
    assert {(r.source, r.id): r.dist for r in graph.searched_distances(found).collect()}[1, 4] == 2
