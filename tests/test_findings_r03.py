import itertools
import math
import random

import numpy as np
import pytest

from corvella.llm import range_coder
from corvella.operators import blocks, graph, trends
from corvella.sources import records


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_adjacency_lines_are_split_once_and_not_carried_along(spark):
    lines = spark.createDataFrame([("1 2 3",), ("  7   8 ",), ("9",), ("",)], "value string")
    got = records.read_adjacency_lines(lines)
    assert sorted(map(tuple, got.collect())) == [("1", "2"), ("1", "3"), ("7", "8")]
    steps = plan(got).splitlines()
    at = next(i for i, s in enumerate(steps) if "Generate explode" in s)
    assert not any("split(" in s for s in steps[: at + 1])


def test_strength_keeps_a_row_per_pair(spark):
    r = random.Random(4)
    kept = {(a, k): r.randrange(1, 9) for a in range(12) for k in [f"k{i}" for i in range(6)] if r.random() < 0.6 and a != 5}
    pairs = [(a, b, r.choice([None, 1990, 1999])) for a in range(13) for b in range(a + 1, 13)]
    keywords = spark.createDataFrame([(a, k, c) for (a, k), c in kept.items()] + [(3, None, 4)], "author long, keyword string, c long")
    got = trends.collaboration_strength(spark.createDataFrame(pairs, "a long, b long, last_year int"), keywords, 2000)
    found = {(x.a, x.b): x.strength for x in got.collect()}
    assert len(found) == len(pairs)
    vec = lambda a: {k: c for (x, k), c in kept.items() if x == a} | ({None: 4} if a == 3 else {})
    for a, b, year in pairs:
        x, y = vec(a), vec(b)
        both = set(x) & set(y)
        jac = len(both) / (len(x) + len(y) - len(both)) if x and y else 0
        cos = sum(x[k] * y[k] for k in both) / math.sqrt(sum(c * c for c in x.values()) * sum(c * c for c in y.values())) if x and y else 0
        want = None if year is None else 0.4 * jac + 0.3 * cos + 0.3 * math.exp(-(2000 - year) / 5)
        assert (found[a, b] is None) == (want is None) and (want is None or math.isclose(found[a, b], want, rel_tol=1e-12))
    # no join on keywords: a pair never becomes one row per shared keyword
    assert "keyword" not in plan(got)


@pytest.mark.parametrize("size, dense", [(4, 1), (4, 5)])
def test_sums_over_edges_by_blocks_and_rows(spark, monkeypatch, size, dense):
    monkeypatch.setattr(blocks, "BLOCK", size)
    monkeypatch.setattr(blocks, "DENSE", dense)
    r = random.Random(size)
    made = {tuple(sorted(r.sample(range(10), 2))) for _ in range(24)} | {(20, 21), (21, 22), (22, 23), (23, 10), (10, 9)}
    e = spark.createDataFrame([(f"v{a:02}", f"v{b:02}") for a, b in made], "src string, dst string")
    near = {}
    for a, b in made:
        near.setdefault(f"v{a:02}", set()).add(f"v{b:02}")
        near.setdefault(f"v{b:02}", set()).add(f"v{a:02}")
    want = {}
    for s in near:
        dist, paths, layer = {s: 0}, {s: 1}, [s]
        while layer:
            after = {}
            for x in layer:
                for y in near[x]:
                    if y not in dist:
                        after[y] = after.get(y, 0) + paths[x]
            for y, n in after.items():
                dist[y], paths[y] = dist[layer[0]] + 1, n
            layer = list(after)
        want |= {(s, y): (dist[y], paths[y]) for y in dist}
    got = graph.distances(e, graph.vertices(e))
    assert {(x.source, x.id): (x.dist, x.paths) for x in got.collect()} == want
    passed = {v: sum(want[s, v][1] * want[v, t][1] / want[s, t][1] for s in near for t in near if s < t and v not in (s, t) and (s, t) in want and (s, v) in want and (v, t) in want and want[s, v][0] + want[v, t][0] == want[s, t][0]) for v in near}
    for x in graph.betweenness(e, graph.vertices(e)).collect():
        assert math.isclose(x.betweenness, passed[x.id], abs_tol=1e-9)
    walks = {(a, b): 0.005 * (b in near[a]) + 0.005**2 * len(near[a] & near[b]) + 0.005**3 * sum(len(near[c] & near[b]) for c in near[a]) for a in near for b in near if a < b}
    found = {(x.src, x.dst): x.score for x in graph.katz_similarity(e).collect()}
    assert set(found) == {k for k, x in walks.items() if x}
    assert all(math.isclose(x, walks[k], rel_tol=1e-9) for k, x in found.items())


def test_a_dense_graph_is_not_expanded_into_a_row_per_front_row_and_edge(spark, monkeypatch):
    monkeypatch.setattr(blocks, "DENSE", 100)
    e = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40)], "src long, dst long")
    known, b, start = graph._numbered_graph(graph.both_ways(e), graph.vertices(e))
    assert b.rows is None and b.blocks.count() == 1
    assert {x.paths for x in graph.distances(e, graph.vertices(e)).collect()} == {1.0}


def test_intervals_of_events_come_from_the_packed_weights():
    model = range_coder.EncoderModel(np.zeros((4, 3), dtype=np.uint32))
    r = np.random.default_rng(1)
    for _ in range(200):
        model.predict()
        low, size = zip(*(model.interval(np.full(3, e)) for e in range(4)), strict=True)
        assert (low[0] == 0).all() and (sum(size) == 1 << range_coder.WEIGHT_BITS).all() and min(x.min() for x in size) >= 16
        assert all((low[e] + size[e] == low[e + 1]).all() for e in range(3))
        assert np.shares_memory(model.packed, model.w)  # updates are written back without a copy
        model.counts[:] = 0
        model.ranks = np.zeros((model.seen + 2, 3), dtype=np.uint16)
        model.update(r.integers(0, 3, 3).astype(np.uint32), r.integers(0, 4, 3))


def test_bursts_of_many_series_go_through_the_automaton_together(spark):
    r = random.Random(3)
    series = {f"k{i:02}": [r.choice([0, 1, 2, 3, 30]) if i % 3 else 2 for _ in range(1 + i % 9)] for i in range(40)} | {None: [1, 1, 9, 9, 1]}
    rows = [(k, 1990 + t, c) for k, cs in series.items() for t, c in enumerate(cs)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "entity string, year int, count long")

    def states(c, s, tops, up, start):
        base = sum(c) / len(c)
        best = None
        for way in itertools.product(range(tops + 1), repeat=len(c)):
            cost = sum(base * s**q - x * math.log(base * s**q) for q, x in zip(way, c, strict=True)) + up * sum(max(0, b - a) for a, b in zip((start, *way), way, strict=False))
            best = cost if best is None or cost < best else best
        return best

    found = {}
    for x in trends.two_state_bursts(d, "entity", s=3.0).collect():
        found.setdefault(x.entity, []).append((x.start - 1990, x.end - 1990))
        c = series[x.entity]
        base = sum(c) / len(c)
        gain = sum((base - v * math.log(base)) - (3 * base - v * math.log(3 * base)) for v in c[x.start - 1990 : x.end - 1989])
        assert math.isclose(x.strength, gain, rel_tol=1e-9, abs_tol=1e-9)
    assert found[None] == [(2, 3)]
    for k, c in series.items():
        if len(c) < 2 or sum(c) == 0:
            assert k not in found
            continue
        base, up = sum(c) / len(c), math.log(len(c))
        way = [int(any(a <= t <= b for a, b in found.get(k, []))) for t in range(len(c))]
        cost = sum(base * 3.0**q - x * math.log(base * 3.0**q) for q, x in zip(way, c, strict=True)) + up * sum(b > a for a, b in zip([0, *way], way, strict=False))
        assert math.isclose(cost, states(c, 3.0, 1, up, 0), rel_tol=1e-9, abs_tol=1e-9)
    assert {x.entity for x in trends.multi_level_bursts(d, "entity").collect()} <= set(series)
    # no group is a call of its own
    for q in (trends.two_state_bursts(d, "entity"), trends.multi_level_bursts(d, "entity")):
        assert "FlatMapGroupsInPandas" not in plan(q) and "MapInPandas" in plan(q)
