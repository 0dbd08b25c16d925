import math
import random

import pytest

from corvella.operators import blocks, graph, hops


def linked(n, m, seed, extra=()):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)} | set(extra))


def searched(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    dist = {}
    for s in near:
        dist[s, s], layer, d = 0, [s], 0
        while layer:
            d += 1
            layer = sorted({y for x in layer for y in near[x] if (s, y) not in dist})
            dist |= {(s, y): d for y in layer}
    return near, dist


@pytest.mark.parametrize("size, dense", [(4, 1), (4, 6)])
def test_measures_on_hops_make_no_row_per_pair(spark, monkeypatch, size, dense):
    monkeypatch.setattr(blocks, "BLOCK", size)
    monkeypatch.setattr(blocks, "DENSE", dense)
    monkeypatch.setattr(hops.Search, "rows", None)
    pairs = linked(10, 20, size, [(20, 21), (21, 22), (22, 9)])
    near, dist = searched(pairs)
    e = spark.createDataFrame(pairs, "src long, dst long")
    counts = graph.hop_counts(e, graph.vertices(e))
    far = {s: [d for (x, _), d in dist.items() if x == s and d] for s in near}
    for r in graph.closeness(counts, len(near)).collect():
        d = far[r.id]
        assert math.isclose(r.closeness, len(d) / sum(d) * len(d) / (len(near) - 1)) and math.isclose(r.harmonic, sum(1 / x for x in d))
    assert {r.id: r.eccentricity for r in graph.eccentricities(counts).collect()} == {s: max(d) for s, d in far.items()}
    mean = lambda v, c: (lambda d: sum(d) / len(d) if d else None)([dist[s, v] for s in near if s % 4 == c and s != v and (s, v) in dist])
    for r in graph.hop_silhouette(e, graph.vertices(e).selectExpr("id", "id % 4 AS label")).collect():
        a, b = mean(r.id, r.id % 4), min((x for c in range(4) if c != r.id % 4 and (x := mean(r.id, c)) is not None), default=None)
        assert math.isclose(r.silhouette, 0.0 if a is None or b is None else (b - a) / max(a, b), abs_tol=1e-12)


def test_blocks_are_packed_without_loss():
    import numpy as np

    r = np.random.default_rng(0)
    for m in (r.integers(0, 3, (5, 7)) * 1.0, r.integers(0, 300, (5, 7)) * 1.0, r.random((5, 7)) * (r.random((5, 7)) < 0.3), np.zeros((5, 7)), np.full((5, 7), 2.0**40), np.full((5, 7), 70000.0)):
        assert (hops.unpacked(hops.packed(m), 5, 7) == m).all()
    assert len(hops.packed(np.ones((512, 512)))) < 2000


@pytest.mark.parametrize("seed", [1, 2])
def test_triad_census_lists_no_open_triples(spark, monkeypatch, seed):
    import itertools

    monkeypatch.setattr(graph, "wedges", None)
    r = random.Random(seed)
    made = sorted({tuple(r.sample(range(9), 2)) for _ in range(22)}) + [(9, 9), (0, 0)]
    has = {x for x in made if x[0] != x[1]}
    nodes = {x for e in made for x in e}
    names = "003 012 102 021D 021U 021C 111D 111U 030T 030C 201 120D 120U 120C 210 300".split()
    kinds = {}  # a triple's class by its smallest code over all orders of the nodes
    code = lambda t, has: min(sum((o[p], o[q]) in has and 1 << k or 0 for k, (p, q) in enumerate(itertools.permutations(range(3), 2))) for o in itertools.permutations(t))
    examples = {"003": [], "012": [(0, 1)], "102": [(0, 1), (1, 0)], "021D": [(1, 0), (1, 2)], "021U": [(0, 1), (2, 1)], "021C": [(0, 1), (1, 2)], "111D": [(0, 1), (1, 0), (2, 1)], "111U": [(0, 1), (1, 0), (1, 2)], "030T": [(0, 1), (1, 2), (0, 2)],
                "030C": [(0, 1), (1, 2), (2, 0)], "201": [(0, 1), (1, 0), (1, 2), (2, 1)], "120D": [(1, 0), (1, 2), (0, 2), (2, 0)], "120U": [(0, 1), (2, 1), (0, 2), (2, 0)], "120C": [(0, 1), (1, 2), (0, 2), (2, 0)], "210": [(0, 1), (1, 2), (2, 1), (0, 2), (2, 0)], "300": [(p, q) for p in range(3) for q in range(3) if p != q]}
    for name, links in examples.items():
        kinds[code((0, 1, 2), set(links))] = name
    want = dict.fromkeys(names, 0)
    for t in itertools.combinations(sorted(nodes), 3):
        want[kinds[code(t, has)]] += 1
    assert len(kinds) == 16
    assert {x.triad: x.n for x in graph.triad_census(spark.createDataFrame(made, "src long, dst long")).collect()} == want


def test_tables_of_pairs_are_not_broadcast(spark, monkeypatch):
    from corvella.operators import paths

    plans, kept = [], paths.materialise
    monkeypatch.setattr(paths, "materialise", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), kept(df, label))[1])
    pairs = linked(8, 14, 5)
    e = spark.createDataFrame([(a, b, 1 + (a * b) % 3) for a, b in pairs], "src long, dst long, weight long")
    got = {(r.source, r.id): (r.dist, r.path) for r in paths.shortest_paths(e, graph.vertices(e)).collect()}
    cost = {(x, y): 1 + (a * b) % 3 for a, b in pairs for x, y in ((a, b), (b, a))}
    assert all(dist == sum(cost[x, y] for x, y in zip(path, path[1:], strict=False)) for dist, path in got.values()) and len(got) == len({x for p in pairs for x in p}) ** 2
    joins = [p for label, p in plans if label in ("path-front", "path-ways") and "Join" in p]
    assert joins and not any("BroadcastHashJoin [s#" in p or "BroadcastHashJoin [source#" in p for p in joins)


def test_frequent_pairs_are_counted_in_blocks(spark, monkeypatch):
    import itertools
    from collections import Counter

    from corvella.operators import networks

    monkeypatch.setattr(networks, "SALT_ROWS", 40)
    monkeypatch.setattr(networks, "MOST_PAIRS", 7)
    r = random.Random(6)
    rows = [(g, f"i{r.randrange(11):02}") for g in range(60) for _ in range(r.randrange(7))] + [(None, "i01"), (3, None), (1, "i00"), (1, "i00")]
    groups = {}
    for g, i in rows:
        if g is not None and i is not None:
            groups.setdefault(g, set()).add(i)
    want = Counter(p for s in groups.values() for p in itertools.combinations(sorted(s), 2))
    d = spark.createDataFrame(rows, "g long, i string")
    assert {(x.a, x.b): x.weight for x in networks.frequent_pair_counts(d, "g", "i").collect()} == want  # few groups an item
    monkeypatch.setattr(networks, "pair_counts", None)
    got = networks.frequent_pair_counts(d, "g", "i", size=4, often=1)
    assert sorted((x.a, x.b, x.weight) for x in got.collect()) == sorted((*k, n) for k, n in want.items())
    assert sorted((x.a, x.b) for x in networks.frequent_pair_counts(d, "g", "i", 5, size=4, often=1).collect()) == sorted(k for k, n in want.items() if n >= 5)
