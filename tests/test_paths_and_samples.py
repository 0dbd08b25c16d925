import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corvella.operators import graph, networks, paths


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, weight double")


def random_graph(n, m, seed, base=0):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
    return [(a + base, b + base, r.choice([1, 2, 2, 5])) for a, b in sorted(pairs)]


def adjacency(rows, directed):
    near = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = min(w, near.get(a, {}).get(b, math.inf))
        near.setdefault(b, {})
        if not directed:
            near[b][a] = min(w, near[b].get(a, math.inf))
    return near


def dijkstra(near, s):
    dist, heap = {}, [(0, s)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in dist:
            dist[v] = d
            for u, w in near.get(v, {}).items():
                heapq.heappush(heap, (d + w, u))
    return dist


def ways(near, dist, s, t):
    if s == t:
        return [[s]]
    return [p + [t] for u in near if u in dist and t in near[u] and dist[u] + near[u][t] == dist[t] for p in ways(near, dist, s, u)]


@pytest.mark.parametrize("directed", [False, True])
def test_weighted_paths_against_brute_force(spark, directed):
    rows = random_graph(14, 24, 5) + [(20, 21, 1)]
    e, near = edges_of(spark, rows), adjacency(rows, directed)
    got = {(r.source, r.id): r for r in paths.shortest_paths(e, graph.vertices(e), directed=directed).collect()}
    every = {}
    for r in paths.all_shortest_paths(e, graph.vertices(e), 6, "weight", directed).collect():
        every.setdefault((r.source, r.id), set()).add(tuple(r.path))
    want = {(s, t): d for s in near for t, d in dijkstra(near, s).items()}
    assert {k: r.dist for k, r in got.items()} == want
    for (s, t), r in got.items():
        assert r.path[0] == s and r.path[-1] == t and sum(near[a][b] for a, b in itertools.pairwise(r.path)) == r.dist
    assert every == {(s, t): {tuple(p) for p in ways(near, dijkstra(near, s), s, t)} for (s, t), d in want.items() if d <= 6}
    pairs = spark.createDataFrame([(a, b) for a in near for b in near] + [(0, 99), (98, 98)], "a long, b long")
    assert {(r.a, r.b): r.found for r in paths.has_path(e, pairs, directed).collect()} == {(a, b): (a, b) in want for a in near for b in near} | {(0, 99): False, (98, 98): False}


def test_weights_must_be_above_zero(spark):
    e = edges_of(spark, [(1, 2, 0)])
    with pytest.raises(ValueError):
        paths.weighted_distances(e, graph.vertices(e))
    none = edges_of(spark, [])
    assert paths.shortest_paths(none, graph.vertices(none)).count() == 0


def test_sampled_centralities_are_exact_with_all_pivots(spark):
    rows = random_graph(12, 20, 8)
    e = edges_of(spark, rows)
    v = graph.vertices(e)
    n = v.count()
    exact = {r.id: r.betweenness for r in graph.betweenness(e, v).collect()}
    got = {r.id: r.betweenness for r in graph.sampled_betweenness(e, n, normalized=False).collect()}
    assert got == pytest.approx(exact)
    close = {r.id: (r.closeness, r.harmonic) for r in graph.closeness(graph.distances(e, v), n).collect()}
    for r in graph.sampled_closeness(e, n).collect():
        assert (r.closeness, r.harmonic) == pytest.approx(close[r.id])
    few = [r.betweenness for r in graph.sampled_betweenness(e, 6).collect()]
    assert len(few) == n and max(few) <= n / 6 + 1e-9
    assert graph.pivots(v, 5).collect() == graph.pivots(v.repartition(3), 5).collect()


@pytest.mark.parametrize("block", [2, 512])
def test_wedges_of_hubs(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "WEDGE_BLOCK", block)
    links = [(1, x, 7) for x in range(30)] + [(2, x, 8) for x in (3, 1)] + [(3, 5, 9)]
    got = graph.wedges(spark.createDataFrame(links, "m long, e long, c int"), "m", "e", "c").collect()
    want = {(m, a, b, c) for m, c in ((1, 7), (2, 8)) for a, b in itertools.combinations(sorted(x for k, x, _ in links if k == m), 2)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_adjusted_mutual_information_against_the_sum(spark):
    r = random.Random(1)
    x, y = [r.randrange(4) for _ in range(60)], [r.randrange(5) for _ in range(60)]
    y = [a if r.random() < 0.5 else b for a, b in zip(x, y, strict=True)]
    frame = lambda c: spark.createDataFrame(list(enumerate(c)), "id long, label int")
    got = graph.adjusted_mutual_information(frame(x), frame(y)).first()
    n = len(x)
    a, b = [x.count(k) for k in set(x)], [y.count(k) for k in set(y)]
    mi = sum(c / n * math.log(n * c / (x.count(i) * y.count(j))) for i in set(x) for j in set(y) if (c := sum(p == i and q == j for p, q in zip(x, y, strict=True))))
    expected = sum(k / n * math.log(n * k / (p * q)) * math.comb(p, k) * math.comb(n - p, q - k) / math.comb(n, q) for p in a for q in b for k in range(max(1, p + q - n), min(p, q) + 1))
    h = lambda s: -sum(k / n * math.log(k / n) for k in s)
    assert (got.mi, got.expected, got.ami) == pytest.approx((mi, expected, (mi - expected) / ((h(a) + h(b)) / 2 - expected)), abs=1e-9)
    assert graph.adjusted_mutual_information(frame(x), frame(x)).first().ami == pytest.approx(1.0)


def test_community_measures(spark):
    e = edges_of(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1), (4, 5, 1), (1, 2, 1)])
    lab = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 2)], "id long, label int")
    assert {r.label: (r.nodes, r.inner, r.density) for r in graph.community_density(e, lab).collect()} == {0: (3, 3, 1.0), 1: (2, 1, 1.0), 2: (1, 0, 0.0)}
    s = {r.id: r.silhouette for r in graph.hop_silhouette(e, lab).collect()}
    assert s[1] == pytest.approx((2.5 - 1) / 2.5) and s[3] == pytest.approx((1.5 - 1) / 1.5) and s[4] == pytest.approx((5 / 3 - 1) / (5 / 3))


def test_pagerank_series_is_the_power_iteration(spark):
    rows = [(1, 2, 1), (2, 3, 1), (3, 1, 2), (3, 4, 1), (5, 3, 1)]
    got = {r.id: r.rank for r in graph.pagerank(edges_of(spark, rows), tol=1e-12, weighted=True).collect()}
    ids, out = sorted({x for a, b, _ in rows for x in (a, b)}), {}
    for a, _, w in rows:
        out[a] = out.get(a, 0) + w
    p = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(400):
        lost = sum(p[i] for i in ids if i not in out)
        new = {i: 0.15 / len(ids) + 0.85 * lost / len(ids) for i in ids}
        for a, b, w in rows:
            new[b] += 0.85 * p[a] * w / out[a]
        p = new
    assert got == pytest.approx(p, abs=1e-9)


def test_two_colouring(spark):
    rows = [(1, 2), (2, 3), (3, 4), (4, 1), (10, 11), (11, 12), (12, 10), (12, 13), (20, 21), (30, 30)]
    e = spark.createDataFrame(rows, "src long, dst long")
    got = {r.id: (r.component, r.side) for r in networks.two_colouring(e).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 0), 4: (1, 1), 10: (10, None), 11: (10, None), 12: (10, None), 13: (10, None), 20: (20, 0), 21: (20, 1), 30: (30, None)}
    b = networks.is_bipartite(e).first()
    assert (b.bipartite, b.zeros, b.ones, b.components, b.odd_components) == (False, 3, 3, 4, 2)
    m = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (1, "b"), (2, "b"), (4, "c")], "g long, i string")
    assert {r.i: r.redundancy for r in networks.redundancy(m, "g", "i").collect()} == {"a": pytest.approx(1 / 3), "b": 1.0, "c": None}


def test_community_scores(spark):
    e = edges_of(spark, [(1, 3, 1), (2, 3, 1), (1, 4, 1), (2, 4, 1), (4, 5, 1)])
    lab = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)], "id long, label int")
    assert {(r.a, r.b): r.score for r in graph.community_allocation(e, lab).collect()} == {(1, 2): 0.5}
    assert {(r.a, r.b): r.score for r in graph.within_inter_scores(e, lab).collect()} == {(1, 2): pytest.approx(1 / 1.001)}


def test_communities_of_many_graphs_at_once(spark):
    clique = lambda part, ids: [(part, a, b, 1) for a, b in itertools.combinations(ids, 2)]
    rows = clique(0, range(5)) + clique(0, range(5, 10)) + [(0, 4, 5, 1)] + clique(1, range(4)) + clique(1, range(4, 8)) + clique(1, range(8, 12)) + [(1, 3, 4, 1), (1, 7, 8, 1), (1, 11, 0, 1)] + [(2, 1, 2, 1)]
    e = spark.createDataFrame(rows, "part int, src long, dst long, weight long")
    got, found = {}, graph.louvain_many(e)
    for r in found.collect():
        got.setdefault((r.part, r.label), set()).add(r.id)
    assert {(p, frozenset(v)) for (p, _), v in got.items()} == {(0, frozenset(range(5))), (0, frozenset(range(5, 10))), *((1, frozenset(range(i, i + 4))) for i in (0, 4, 8)), (2, frozenset({1, 2}))}
    one = e.filter("part = 0").drop("part")
    mine = found.filter("part = 0").drop("part")
    assert graph.modularity(one, mine).first().modularity == pytest.approx(graph.modularities(e, found).filter("part = 0").first().modularity)
    assert graph.louvain(one.limit(0)).count() == 0
    settled = {r.id: r.label for r in graph.label_propagation(one.withColumn("weight", F.lit(1.0))).collect()}
    assert len({settled[i] for i in range(4)}) == 1 and len({settled[i] for i in range(6, 10)}) == 1
    two = spark.createDataFrame([(1, 2, 3.0)], "src long, dst long, weight double")
    assert graph.label_propagation(two).count() == 2  # labels that change places end it


@pytest.mark.parametrize("directed", [False, True])
def test_weighted_betweenness_against_brute_force(spark, directed):
    rows = random_graph(9, 15, 4)
    e, near = edges_of(spark, rows), adjacency(rows, directed)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        dist = dijkstra(near, s)
        for t in dist:
            if t != s:
                every = ways(near, dist, s, t)
                for path in every:
                    for x in path[1:-1]:
                        want[x] += 1 / len(every) / (1 if directed else 2)
    got = {r.id: r.betweenness for r in paths.weighted_betweenness(e, graph.vertices(e), directed=directed).collect()}
    assert got == pytest.approx(want)
