import math
import random

import pytest
from pyspark.sql import functions as F

from corvella.operators import blocks, graph, paths


@pytest.mark.parametrize("directed, cutoff", [(True, 2), (True, 4), (False, 3), (False, 2.5), (True, 0), (True, math.inf)])
def test_paths_of_few_steps_grow_forwards(spark, monkeypatch, directed, cutoff):
    written = []
    kept = paths.materialise
    monkeypatch.setattr(paths, "materialise", lambda df, label: written.append(label) or kept(df, label))
    r = random.Random(6)
    edges = {(a, b) for a, b in (r.choices(range(12), k=2) for _ in range(30))} | {(20, 21), (21, 20), (21, 22), (5, 5)}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            if not directed:
                near.setdefault(b, set()).add(a)
    want = set()
    for s in {x for e in edges for x in e} | {77}:
        layer, seen, d = [(s,)], set(), 0
        while layer and d <= cutoff:
            want |= {(s, p[-1], float(d), p) for p in layer}
            seen |= {p[-1] for p in layer}
            layer, d = [(*p, x) for p in layer for x in near.get(p[-1], ()) if x not in seen], d + 1
    e = spark.createDataFrame([*edges, (1, 2)], "src long, dst long")
    sources = graph.vertices(e).union(spark.createDataFrame([(77,), (None,)], "id long"))
    got = paths.all_shortest_paths(e, sources, cutoff, directed=directed)
    assert sorted((x.source, x.id, x.dist, tuple(x.path)) for x in got.collect()) == sorted(want)
    if cutoff == 2:  # nothing but the edges is written, and who counts the paths does not make them
        assert written == ["path-edges"]
        assert "concat" not in got.groupBy("source", "dist").agg(F.count(F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("dense, directed", [(1, False), (5, True), (10**6, False)])
def test_weighted_paths_by_blocks_and_rows(spark, monkeypatch, dense, directed):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    monkeypatch.setattr(blocks, "DENSE", dense)
    r = random.Random(dense)
    edges = {tuple(sorted(r.sample(range(10), 2))): r.choice([1.0, 2.0, 3.0, 0.5]) for _ in range(30)} | {(20, 21): 1.0, (21, 22): 2.0, (22, 10): 1.0}
    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {}).update({} if directed else {a: w})
    dist = {s: {s: 0.0} for s in near}
    for _ in near:
        for s in near:
            for u, d in list(dist[s].items()):
                for x, w in near[u].items():
                    dist[s][x] = min(dist[s].get(x, math.inf), d + w)
    before = lambda s, t: sorted(u for u in near if u in dist[s] and dist[s][u] + near[u].get(t, math.inf) == dist[s][t])
    every = lambda s, t: [(s,)] if s == t else [(*p, t) for u in before(s, t) for p in every(s, u)]
    first = lambda s, t: (s,) if s == t else (*first(s, before(s, t)[0]), t)
    e = spark.createDataFrame([(f"v{a:02}", f"v{b:02}", w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    of = lambda rows: sorted((x.source, x.id, x.dist, tuple(x.path)) for x in rows.collect())
    name = lambda p: tuple(f"v{x:02}" for x in p)
    pairs = [(s, t) for s in dist for t in dist[s]]
    assert of(paths.shortest_paths(e, graph.vertices(e), directed=directed)) == sorted((*name((s, t)), dist[s][t], name(first(s, t))) for s, t in pairs)
    assert of(paths.all_shortest_paths(e, graph.vertices(e), 3, "weight", directed)) == sorted((*name((s, t)), dist[s][t], name(p)) for s, t in pairs if dist[s][t] <= 3 for p in every(s, t))
    want = dict.fromkeys(near, 0.0)
    for s, t in pairs:
        for p in every(s, t):
            for x in p[1:-1]:
                want[x] += 1 / len(every(s, t)) / (1 if directed else 2)
    got = {x.id: x.betweenness for x in paths.weighted_betweenness(e, graph.vertices(e), directed=directed).collect()}
    assert set(got) == {f"v{x:02}" for x in near} and all(math.isclose(got[f"v{x:02}"], b, abs_tol=1e-9) for x, b in want.items())


def test_weighted_edges_of_a_dense_graph_are_one_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "DENSE", 100)
    e = spark.createDataFrame([(i, j, 1.0) for i in range(40) for j in range(i + 1, 40)], "src long, dst long, weight double")
    _, costs, best = paths._nearest(e, graph.vertices(e), "weight", False, None)
    assert costs.rows is None and costs.blocks.count() == 1
    assert {(x.dist, x.parent == x.s) for x in best.collect() if x.s != x.v} == {(1.0, True)}


def test_community_scores_pair_ends_within_their_community_only(spark, monkeypatch):
    r = random.Random(9)
    edges = {tuple(sorted(r.sample(range(14), 2))) for _ in range(36)}
    label = {i: [None, 0, 1, 2][i % 4] for i in range(14)}
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(14)}
    e = spark.createDataFrame([*edges], "src long, dst long")
    lab = spark.createDataFrame([*label.items()], "id long, label int")
    made, kept = [], graph.wedges
    monkeypatch.setattr(graph, "wedges", lambda *x: made.append(kept(*x)) or made[-1])
    scores, shares, inter = {}, {}, {}
    for a in near:
        for b in near:
            both = near[a] & near[b] if a < b and b not in near[a] and label[a] is not None and label[a] == label[b] else set()
            own = [m for m in both if label[m] == label[a]]
            if both:
                scores[a, b] = len(both) + len(own)
            if own:
                shares[a, b], inter[a, b] = sum(1 / len(near[m]) for m in own), len(own) / (len(both) - len(own) + 0.001)
    of = lambda rows: {(x.a, x.b): round(x.score, 9) for x in rows.collect()}
    assert of(graph.community_link_scores(e, lab)) == scores
    assert of(graph.community_allocation(e, lab)) == {k: round(x, 9) for k, x in shares.items()}
    assert of(graph.within_inter_scores(e, lab)) == {k: round(x, 9) for k, x in inter.items()}
    for pairs in made:  # before anything is filtered
        assert all(label[x.a] == label[x.b] for x in pairs.collect())
