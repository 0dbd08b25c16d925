import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corvella.functions import scalars as S
from corvella.functions import stats
from corvella.operators import evidence, graph, indices, merging, networks, trends
from corvella.plans.components import components

CITED = [120, 45, 30, 12, 8, 5, 3, 1, 0, 0]
YEARS = [2018, 2019, 2020, 2021, 2022, 2023, 2024, 2025, 2025, 2025]


@pytest.fixture(scope="module")
def author(spark):
    return spark.createDataFrame([("x", i, c, y, n) for i, (c, y, n) in enumerate(zip(CITED, YEARS, [3, 4, 2, 5, 6, 2, 3, 4, 1, 1], strict=True))], "author string, paper_id int, citations int, year int, n_authors int")


def test_textbook_indices(author):
    r = indices.compute_all(author, ["author"], 2025, ("paper_id",)).first()
    assert (r.h_index, r.g_index, r.i10_index) == (5, 10, 4)
    assert math.isclose(r.e_index, math.sqrt(190))


@pytest.mark.parametrize(("values", "h"), [([10, 8, 5, 4, 3], 4), ([0, 0], 0), ([10, 5, 3, 1, 0], 3)])
def test_h(spark, values, h):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "author string, id int, citations int")
    assert indices.h_index(d, ["author"], tie=("id",)).first().h_index == h


def test_dersimonian_laird(spark):
    rows = [("m", math.log(o), s * s) for o, s in zip([0.62, 0.45, 0.62, 0.43, 0.42], [0.105, 0.145, 0.235, 0.230, 0.295], strict=True)]
    r = evidence.pool_random(spark.createDataFrame(rows, "meta_id string, y double, v double"), ["meta_id"], True).first()
    assert (round(r.value, 4), round(r.q, 4), round(r.tau2, 6)) == (0.5245, 5.3606, 0.010779)


def test_mantel_haenszel_and_empty(spark):
    rows = [("m", 30, 100, 45, 100), ("m", 25, 80, 35, 80), ("m", 40, 120, 55, 120)]
    d = spark.createDataFrame(rows, "meta_id string, a int, n1 int, c int, n2 int")
    num = sum(a * (n2 - c) / (n1 + n2) for _, a, n1, c, n2 in rows)
    den = sum((n1 - a) * c / (n1 + n2) for _, a, n1, c, n2 in rows)
    assert math.isclose(evidence.mantel_haenszel(d, ["meta_id"]).first().value, num / den)
    assert evidence.pool_fixed(evidence.dichotomous(d.limit(0)), ["meta_id"]).count() == 0


def test_sucra_order(spark):
    rows = [("n", "A", "B", 0.9, 0.1), ("n", "A", "C", 1.5, 0.1), ("n", "B", "C", 0.6, 0.1)]
    got = {r.treatment: r.sucra for r in evidence.network_meta(spark.createDataFrame(rows, "net string, treatment_a string, treatment_b string, effect_size double, se double"), "net").collect()}
    assert got["C"] > 0.95 and got["A"] < 0.05


def test_tails():
    assert abs(float(stats.chi2_tail(3.841459, 1)) - 0.05) < 1e-6
    assert abs(float(stats.t_two_sided(2.228139, 10)) - 0.05) < 1e-6
    assert abs(stats.normal_quantile(0.975) - 1.959964) < 1e-6


KARATE = "0-1 0-2 0-3 0-4 0-5 0-6 0-7 0-8 0-10 0-11 0-12 0-13 0-17 0-19 0-21 0-31 1-2 1-3 1-7 1-13 1-17 1-19 1-21 1-30 2-3 2-7 2-8 2-9 2-13 2-27 2-28 2-32 3-7 3-12 3-13 4-6 4-10 5-6 5-10 5-16 6-16 8-30 8-32 8-33 9-33 13-33 14-32 14-33 15-32 15-33 18-32 18-33 19-33 20-32 20-33 22-32 22-33 23-25 23-27 23-29 23-32 23-33 24-25 24-27 24-31 25-31 26-29 26-33 27-33 28-31 28-33 29-32 29-33 30-32 30-33 31-32 31-33 32-33"


@pytest.fixture(scope="module")
def karate(spark):
    return spark.createDataFrame([(*map(int, e.split("-")), 1.0) for e in KARATE.split()], "src long, dst long, weight double").cache()


def test_karate(spark, karate):
    assert karate.count() == 78
    both = graph.both_ways(karate)
    assert abs(graph.pagerank(both, rounds=12).agg(F.sum("rank")).first()[0] - 1) < 1e-6
    d = graph.distances(karate, spark.createDataFrame([(0,)], "id long"))
    assert d.filter("id = 33").first().dist == 2
    assert components(karate).select("component").distinct().count() == 1
    q = graph.modularity(karate, graph.louvain(karate)).first()
    assert q.modularity > 0.33 and 2 <= q.communities <= 7
    assert graph.core_numbers(karate).agg(F.max("core")).first()[0] == 4
    assert graph.transitivity(karate).first().triangles == 45


def test_components_chain_and_loops(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (None, 3)], "src long, dst long")
    got = {r.id: r.component for r in components(e).collect()}
    assert got[40] == 0 and got[100] == 100 and len(got) == 42


def test_pagerank_settles_whatever_the_size(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(7, 0), (0, 3)], "src long, dst long")
    out, rank, tol = {i: [i + 1] for i in range(7)} | {7: [0]}, [1 / 8] * 8, 0.01
    out[0] = [1, 3]
    for _ in range(500):
        rank = [0.15 / 8 + 0.85 * sum(rank[j] / len(out[j]) for j in out if i in out[j]) for i in range(8)]
    got = {r.id: r.rank for r in graph.pagerank(e, tol=tol).collect()}
    # a change below tol leaves at most tol * alpha / (1 - alpha); tested against n * tol it ended sooner
    assert sum(abs(got[i] - rank[i]) for i in range(8)) < tol * 0.85 / 0.15


def test_long_chain_distances(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(36)], "src long, dst long")
    d = graph.distances(e, spark.createDataFrame([(0,)], "id long"))
    assert {r.id: (r.dist, r.paths) for r in d.collect()} == {i: (i, 1.0) for i in range(37)}
    with pytest.raises(RuntimeError):
        graph.distances(e, spark.createDataFrame([(0,)], "id long"), most=3)


def test_strong_components_of_a_long_cycle(spark):
    cycle = [(i, i % 70 + 1) for i in range(1, 71)]
    e = spark.createDataFrame([*cycle, (70, 300), (300, 301), (400, 401), (401, 400), (500, 500)], "src long, dst long")
    got = {r.id: r.component for r in graph.strongly_connected(e).collect()}
    assert got == {i: 1 for i in range(1, 71)} | {300: 300, 301: 301, 400: 400, 401: 400, 500: 500}


def test_bursts_from_history(spark):
    h = {2018: 2, 2019: 3, 2020: 2, 2021: 25, 2022: 40, 2023: 18, 2024: 5}
    d = spark.createDataFrame([("p", y, c) for y, c in h.items()], "entity string, year int, count int")
    assert trends.two_state_bursts(d, "entity").count() >= 1
    flat = spark.createDataFrame([("p", y, 3) for y in range(2018, 2025)], "entity string, year int, count int")
    assert trends.two_state_bursts(flat, "entity").count() == 0


def test_scalars(spark):
    d = spark.createDataFrame([("DOI:10.1/AB", "=1+1", "a; b and c"), (None, None, None)], "d string, c string, a string")
    r = d.select(S.doi(F.col("d")).alias("d"), S.safe_cell(F.col("c")).alias("c"), S.authors(F.col("a")).alias("a")).collect()
    assert (r[0].d, r[0].c, r[0].a) == ("10.1/ab", "'=1+1", ["a", "b", "c"])
    assert r[1].d is None


def test_merge_transitive(spark):
    d = spark.createDataFrame([(1, "10.1/a", "T one", 3), (2, None, "t ONE!", 9), (3, "10.1/b", "Other", 1)], "seq int, doi string, title string, citations_count int")
    got = {r.seq: (r.merged, r.citations_count) for r in merging.merge_records(d).collect()}
    assert got == {1: (2, 9), 3: (1, 1)}


def test_pairs_cap_is_off_by_default(spark):
    d = spark.createDataFrame([(1, i) for i in range(30)], "g int, x int")
    assert networks.pair_counts(d, "g", "x").count() == 435
    assert networks.pair_counts(d, "g", "x", max_items=10).count() == 0


def random_graph(r, n, m):
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)} - {(i, i) for i in range(n)})


def test_triads_layers_and_shells_by_brute_force(spark):
    r = random.Random(11)
    edges = random_graph(r, 14, 40)
    e = spark.createDataFrame(edges, "src long, dst long")
    nodes = sorted({v for x in edges for v in x})
    has, want = set(edges), {}
    for a, b, c in itertools.combinations(nodes, 3):
        m = sum((x, y) in has and (y, x) in has for x, y in ((a, b), (a, c), (b, c)))
        n = sum(((x, y) in has) != ((y, x) in has) for x, y in ((a, b), (a, c), (b, c)))
        out = sorted(sum((x, y) in has for y in (a, b, c) if y != x) for x in (a, b, c))
        ins = sorted(sum((y, x) in has for y in (a, b, c) if y != x) for x in (a, b, c))
        kind = f"{m}{n}{3 - m - n}"
        if kind == "021":
            kind += "D" if out[2] == 2 else "U" if ins[2] == 2 else "C"
        elif kind == "111":
            kind += "D" if ins[2] == 2 else "U"
        elif kind == "030":
            kind += "T" if out[2] == 2 else "C"
        elif kind == "120":
            kind += "D" if ins[0] == 0 else "U" if out[0] == 0 else "C"
        want[kind] = want.get(kind, 0) + 1
    got = {x.triad: x.n for x in graph.triad_census(e).collect()}
    assert sum(got.values()) == math.comb(len(nodes), 3)
    assert {k: v for k, v in got.items() if v} == want
    near = {v: {y for x in has for y in x if v in x and y != v} for v in nodes}
    core, left, k = {}, set(nodes), 0
    while left:
        low = [v for v in left if len(near[v] & left) <= k]
        if low:
            core.update(dict.fromkeys(low, k))
            left -= set(low)
        else:
            k += 1
    layer, left, k, depth = {}, set(nodes), 1, 0
    while left:
        deg = {v: len(near[v] & left) for v in left}
        k, depth = max(k, min(deg.values())), depth + 1
        go = {v for v in left if deg[v] <= k}
        layer.update(dict.fromkeys(go, depth))
        left -= go
    assert {x.id: x.core for x in graph.core_numbers(e).collect()} == core
    assert {x.id: x.layer for x in graph.onion_layers(e).collect()} == layer
    for x in graph.core_parts(e, 3).collect():
        assert (x.in_core, x.in_shell, x.in_crust) == (core[x.id] >= 3, core[x.id] == 3, core[x.id] <= 3)


def test_long_paths_are_whole(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert graph.distances(chain, chain.limit(1).selectExpr("0L AS id")).count() == 41
    assert graph.distances(chain, chain.limit(1).selectExpr("0L AS id"), radius=5).count() == 6
    assert graph.strongly_connected(chain).select("component").distinct().count() == 41


def test_betweenness_by_brute_force(spark):
    r = random.Random(12)
    edges = random_graph(r, 12, 18)
    near = {v: {y for x in edges for y in x if v in x and y != v} for x in edges for v in x}

    def paths(a, b):
        level, seen = [[a]], {a}
        while level and not any(p[-1] == b for p in level):
            level = [[*p, y] for p in level for y in near[p[-1]] if y not in seen]
            seen |= {p[-1] for p in level}
        return [p for p in level if p[-1] == b]

    want = dict.fromkeys(near, 0.0)
    for a, b in itertools.combinations(near, 2):
        found = paths(a, b)
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found)
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {x.id: x.betweenness for x in graph.betweenness(e, graph.vertices(e)).collect()}
    assert all(math.isclose(got[v], want[v], abs_tol=1e-9) for v in want)


def test_dbscan_and_pairs_by_brute_force(spark):
    from corvella.operators import topics

    r = random.Random(13)
    rows = [(i, [r.choice((0.0, 4.0)) + r.gauss(0, 0.4), r.gauss(0, 0.4)]) for i in range(60)] + [(100, [50.0, 50.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = dict(rows)
    pairs = {(a, b) for a in x for b in x if a < b and math.dist(x[a], x[b]) <= 0.5}
    assert {(p.a, p.b) for p in topics.within(d, 0.5, block=16).collect()} == pairs
    near = {v: {v} | {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in x}
    core = {v for v in x if len(near[v]) >= 5}
    label = {}
    for v in sorted(core):
        if v not in label:
            todo = [v]
            while todo:
                u = todo.pop()
                if u not in label:
                    label[u] = v
                    todo += near[u] & core
    want = {v: label.get(v, min((label[u] for u in near[v] & core), default=-1)) for v in x}
    assert {c.id: c.cluster for c in topics.dbscan(d, 0.5, 5).collect()} == want


def test_fronts_and_themes(spark):
    from corvella.operators import frontiers, themes, topics

    t = spark.createDataFrame([(i, [0.9, 0.1] if i < 9 else [0.1, 0.9]) for i in range(10)], "doc_id long, topics array<double>")
    y = spark.createDataFrame([(i, 2000 + i // 2 if i < 9 else 2004) for i in range(10)], "doc_id long, year int")
    b = frontiers.boundary_topics(t, y, 0.02, 0.15).collect()
    assert [(x.topic, x.papers) for x in b] == [(1, 1)] and math.isclose(b[0].novelty, 0.5 * (1 - 0.1 / 0.15))
    assert math.isclose(sum(x["count"] for x in frontiers.topic_series(t, y).collect()), 10.0)
    g = spark.createDataFrame([("a", 2000, 1), ("a", 2001, 2), ("a", 2005, 3), ("b", 2000, 5)], "k string, year int, n int")
    assert {x.k: x.growth for x in frontiers.growth_rate(g, "k").collect()} == {"a": 0.75, "b": 0.0}
    texts = spark.createDataFrame([(i, "solar panel power" if i % 2 else "ocean wave height") for i in range(8)], "id long, text string")
    got = {x.theme: (set(x.terms), x.support) for x in themes.themes(texts, 2).collect()}
    assert sorted(map(sorted, (v[0] for v in got.values()))) == [["height", "ocean", "wave"], ["panel", "power", "solar"]] and {v[1] for v in got.values()} == {4}
    assert themes.study_themes(texts.selectExpr("id AS study_id", "text"), ["text"], 2).count() == 4
    s = spark.createDataFrame([(2, 0.1, 9.0), (3, -0.2, 5.0), (4, -0.1, 4.5)], "k int, silhouette double, cost double")
    assert topics.optimal_k(s).first().asDict() == {"k": 2, "reason": "silhouette"}
    assert topics.optimal_k(s.withColumn("silhouette", F.lit(-1.0))).first().asDict() == {"k": 3, "reason": "elbow"}
    tops = spark.createDataFrame([(0, "a", 0.6), (0, "b", 0.4)], "topic int, term string, weight double")
    docs = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "b"]), (2, ["c"]), (3, ["c"])], "doc_id int, tokens array<string>")
    assert math.isclose(topics.coherence(tops, docs).first().coherence, 1.0)


def test_xml_files_and_lines(spark, tmp_path):
    from corvella.sources import records

    hit = '<hit id="7"><info><authors><author>A</author></authors><title>T.</title><year>2001</year><ee>https://doi.org/10.1/x</ee></info></hit>'
    (tmp_path / "a.xml").write_text(f"<hits>{hit}{hit.replace('7', '8')}</hits>")
    want = [("7", "T", ["A"], 2001, "10.1/x"), ("8", "T", ["A"], 2001, "10.1/x")]
    cols = ["paper_id", "title", "authors", "year", "doi"]
    assert sorted(tuple(r) for r in records.from_dblp(spark, f"file://{tmp_path}/a.xml").select(*cols).collect()) == want
    assert tuple(records.from_dblp(spark, spark.createDataFrame([(hit,)], "value string")).select(*cols).first()) == want[0]


def test_running_totals_and_cume_dist_without_one_task(spark):
    from corvella.plans.ordered import cume_dist, running_totals

    rows = [(i, None if i % 17 == 0 else i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v int")
    got = {r["id"]: (r["pos"], r["total"]) for r in running_totals(df, [F.desc("v"), "id"], {"pos": F.lit(1), "total": F.coalesce("v", F.lit(0))}).collect()}
    run = 0
    for k, (i, v) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1):
        run += v or 0
        assert got[i] == (k, run)
    low = lambda v: -1 if v is None else v
    for r in cume_dist(df, "v", "share").collect():
        assert abs(r["share"] - sum(low(v) <= low(r["v"]) for _, v in rows) / len(rows)) < 1e-12
    assert cume_dist(df.limit(0), "v", "share").count() == 0
