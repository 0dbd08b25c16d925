"""Queries G1-G34, M4, M5, K5, K6 over co-author, citation and customer graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.operators import graph as G
from corvella.operators import paths as P
from corvella.plans.components import components
from corvella.plans.q_aggregates import rounded
from corvella.plans.registry import Registry
from corvella.plans.storage import materialise

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
C = F.col
S = "coauthors"
CITED = "WITH s AS (SELECT src, dst, 1 AS weight FROM cites), u AS (SELECT src, dst, weight FROM s UNION ALL SELECT dst, src, weight FROM s), v AS (SELECT DISTINCT src AS id FROM u) "
WHOLE = "WITH s AS (SELECT a AS src, b AS dst, weight FROM coauthors), u AS (SELECT src, dst, weight FROM s UNION ALL SELECT dst, src, weight FROM s), v AS (SELECT DISTINCT src AS id FROM u) "


def coauthors(v):
    """All co-author pairs."""
    return v.coauthors.select(C("a").alias("src"), C("b").alias("dst"), "weight")


def coauthors_once(v):
    """The same, written once for queries that read them several times."""
    return materialise(coauthors(v), "author-pairs")


def cites(v):
    return v.cites.withColumn("weight", F.lit(1))


@R.add("g1_degrees", S, WHOLE + "SELECT id, out_degree, in_degree, out_degree + in_degree AS degree, weighted_degree, round((out_degree + in_degree) / ((SELECT count(*) FROM v) - 1), 6) AS centrality FROM (SELECT v.id, (SELECT count(*) FROM s WHERE s.src = v.id) AS out_degree, (SELECT count(*) FROM s WHERE s.dst = v.id) AS in_degree, (SELECT sum(weight)::BIGINT FROM u WHERE u.src = v.id) AS weighted_degree FROM v)")
def g1(v):
    return rounded(G.degrees(coauthors(v)))


def _unrolled_pagerank(k: int) -> str:
    body = "WITH e AS (SELECT src, dst FROM cites), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM v), o AS (SELECT src, count(*) AS o FROM e GROUP BY 1), r0 AS (SELECT id, 1.0 / n AS r FROM v, n)"
    for i in range(k):
        body += f", d{i} AS (SELECT coalesce(sum(r), 0) AS lost FROM r{i} WHERE id NOT IN (SELECT src FROM o)), g{i} AS (SELECT dst, sum(r / o) AS g FROM e JOIN o USING (src) JOIN r{i} ON id = src GROUP BY 1), r{i + 1} AS (SELECT v.id, 0.85::DOUBLE * (coalesce(g, 0) + lost / n) + 0.15::DOUBLE / n AS r FROM v LEFT JOIN g{i} ON v.id = g{i}.dst, n, d{i})"
    return body + f" SELECT id, round(r * 1000, 4) AS rank FROM r{k}"


@R.add("g2_pagerank", "cites", _unrolled_pagerank(70))
def g2(v):
    """To convergence; the SQL goes on for more rounds than that takes."""
    return G.pagerank(v.cites, tol=1e-10).select("id", F.round(C("rank") * 1000, 4).alias("rank"))


def _walks(edges: str, start: str, alpha: float, rounds: int) -> str:
    """Shares of all walks from ``start`` (id, v) over ``edges`` (src, dst, w), each step keeping ``alpha`` of them: frame r (id, r)."""
    return f"o AS (SELECT src, sum(w) AS o FROM {edges} GROUP BY 1), p AS (SELECT src, dst, sum(w) / any_value(o) AS p FROM {edges} JOIN o USING (src) GROUP BY src, dst), t AS (SELECT 0 AS k, id, v::DOUBLE AS v FROM {start} UNION ALL SELECT k + 1, dst, sum({alpha}::DOUBLE * p * v) FROM t JOIN p ON src = id WHERE k < {rounds} GROUP BY k, dst), x AS (SELECT id, sum(v) AS x FROM t GROUP BY 1), r AS (SELECT id, x / (SELECT sum(x) FROM x) AS r FROM x)"


def _recursive_over(views: str, body: str) -> str:
    """``body`` behind the views, with RECURSIVE allowed."""
    from corvella.plans.views import sql

    return sql(views, body).replace("WITH ", "WITH RECURSIVE ", 1)


@R.add("g2_personalised_pagerank")
def g2p(v):
    return rounded(G.pagerank(coauthors(v), weighted=True, personal=v.spark.createDataFrame([(1, 1.0)], "id long, share double"), tol=1e-9))


R.ORACLES["g2_personalised_pagerank"] = _recursive_over(S, WHOLE + ", e AS (SELECT src, dst, weight::DOUBLE AS w FROM s), b AS (SELECT 1 AS id, 1 AS v), " + _walks("e", "b", 0.85, 60) + " SELECT v.id, round(coalesce(r, 0), 6) AS rank FROM v LEFT JOIN r USING (id)")


def _unrolled_hits(k: int) -> str:
    body = WHOLE + ", h0 AS (SELECT id, 1.0::DOUBLE AS h FROM v)"
    for i in range(k):
        body += f", a{i + 1} AS (SELECT dst AS id, sum(h) AS a FROM s JOIN h{i} ON id = src GROUP BY 1), b{i + 1} AS (SELECT src AS id, sum(a) AS h FROM s JOIN a{i + 1} ON id = dst GROUP BY 1), h{i + 1} AS (SELECT v.id, coalesce(h, 0) / (SELECT sum(h) FROM b{i + 1}) AS h FROM v LEFT JOIN b{i + 1} USING (id))"
    return body + f" SELECT v.id, round(h, 5) AS hub, round(coalesce(a, 0) / (SELECT sum(a) FROM a{k}), 5) AS authority FROM v LEFT JOIN h{k} USING (id) LEFT JOIN a{k} USING (id)"


@R.add("g3_hits", S, _unrolled_hits(24))
def g3(v):
    return G.hits(coauthors(v)).select("id", F.round("hub", 5).alias("hub"), F.round("authority", 5).alias("authority"))


@R.add("g4_katz", "cites", CITED + ", x0 AS (SELECT id, 1.0::DOUBLE AS x FROM v), " + ", ".join(f"g{i} AS (SELECT dst AS id, sum(x) AS g FROM u JOIN x{i} ON x{i}.id = u.src GROUP BY 1), x{i + 1} AS (SELECT v.id, 0.005::DOUBLE * coalesce(g, 0) + 1 AS x FROM v LEFT JOIN g{i} USING (id))" for i in range(10)) + " SELECT id, round(x, 6) AS x FROM x10")
def g4(v):
    return rounded(G.katz(cites(v), tol=1e-10))


@R.add("g4_eigenvector", S, WHOLE + ", x0 AS (SELECT id, 1.0::DOUBLE AS x FROM v), " + ", ".join(f"g{i} AS (SELECT dst AS id, sum(x) AS g FROM u JOIN x{i} ON x{i}.id = u.src GROUP BY 1), y{i} AS (SELECT x{i}.id, x + coalesce(g, 0) AS x FROM x{i} LEFT JOIN g{i} USING (id)), x{i + 1} AS (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM y{i}) AS x FROM y{i})" for i in range(16)) + " SELECT id, round(x, 5) AS x FROM x16")
def g4e(v):
    """To convergence; the SQL goes on for more rounds than that takes."""
    return G.eigenvector(coauthors(v), tol=1e-9).select("id", F.round("x", 5).alias("x"))


BFS = WHOLE.replace("WITH s", "WITH RECURSIVE s") + ", w AS (SELECT id AS source, id, 0 AS dist FROM v UNION SELECT w.source, u.dst, w.dist + 1 FROM w JOIN u ON u.src = w.id WHERE w.dist < 4), d AS (SELECT source, id, min(dist) AS dist FROM w GROUP BY ALL) "


@R.add("g5_closeness", S, None)
def g5(v):
    e = coauthors_once(v)
    s = G.vertices(e)
    return rounded(G.closeness(G.hop_counts(e, s), s.count()))


def _recursive(body: str) -> str:
    """The view text with RECURSIVE allowed in front."""
    from corvella.plans.views import sql

    return sql(S, body.replace("WITH RECURSIVE", "WITH", 1)).replace("WITH ", "WITH RECURSIVE ", 1)


R.ORACLES["g5_closeness"] = _recursive(BFS + "SELECT source AS id, round(count(*) / sum(dist) * count(*) / ((SELECT count(*) FROM v) - 1), 6) AS closeness, round(sum(1.0 / dist), 6)::DOUBLE AS harmonic FROM d WHERE dist > 0 GROUP BY 1")


@R.add("g5_sampled_closeness", S, None)
def g5s(v):
    """From 16 pivots."""
    return rounded(G.sampled_closeness(coauthors(v), 16))


PIVOTS = "p AS (SELECT id FROM v ORDER BY md5(id || ':0'), id LIMIT 16)"
R.ORACLES["g5_sampled_closeness"] = _recursive(BFS + ", " + PIVOTS + ", g AS (SELECT d.id, count(*) AS k, sum(dist) AS s, sum(1.0 / dist) AS h FROM d JOIN p ON p.id = source WHERE dist > 0 GROUP BY 1), n AS (SELECT count(*) AS n FROM v), q AS (SELECT v.id, (SELECT count(*) FROM p) - count(p.id) AS asked FROM v LEFT JOIN p USING (id) GROUP BY 1) SELECT v.id, round(coalesce(1.0 * k / asked * k / s, 0), 6)::DOUBLE AS closeness, round(coalesce(h * (n - 1) / asked, 0), 6)::DOUBLE AS harmonic FROM v JOIN q USING (id) LEFT JOIN g USING (id), n")

# Numbers of shortest paths up to four hops, and with them the shares of the pairs that pass a vertex.
COUNTED = ", e AS (SELECT DISTINCT src, dst FROM u), d1 AS (SELECT src AS s, dst AS t, 1 AS d, 1::DOUBLE AS n FROM e)" + "".join(f", d{k} AS (SELECT x.s, e.dst AS t, {k} AS d, sum(x.n) AS n FROM d{k - 1} x JOIN e ON e.src = x.t WHERE e.dst <> x.s AND (x.s, e.dst) NOT IN (SELECT (s, t) FROM d1{''.join(f' UNION ALL SELECT (s, t) FROM d{j}' for j in range(2, k))}) GROUP BY ALL)" for k in (2, 3, 4)) + ", d AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4)"
PASSED = "b AS (SELECT y.s AS id, sum(x.n * y.n / z.n) / 2 AS b FROM d x JOIN d y ON y.s = x.t JOIN d z ON z.s = x.s AND z.t = y.t WHERE x.d + y.d = z.d{} GROUP BY 1)"


@R.add("g6_betweenness", S, WHOLE + COUNTED + ", " + PASSED.format("") + " SELECT id, round(coalesce(b, 0), 6) AS betweenness FROM v LEFT JOIN b USING (id)")
def g6(v):
    e = coauthors_once(v)
    return rounded(G.betweenness(e, G.vertices(e)))


@R.add("g6_weighted_betweenness")
def g6w(v):
    """Co-authors are the nearer the more they wrote together."""
    e = coauthors_once(v).withColumn("cost", F.expr("1000 div weight"))
    return rounded(P.weighted_betweenness(e, G.vertices(e), "cost"))


@R.add("g6_sampled_betweenness", S, WHOLE + COUNTED + ", " + PIVOTS + ", " + PASSED.format(" AND x.s IN (SELECT id FROM p)") + ", n AS (SELECT count(*) AS n FROM v) SELECT id, round(coalesce(b, 0) * n / least(16, n) / ((n - 1) * (n - 2) / 2), 6)::DOUBLE AS betweenness FROM v LEFT JOIN b USING (id), n")
def g6s(v):
    """From 16 pivots, normalised."""
    return rounded(G.sampled_betweenness(coauthors(v), 16))


def customer_chain(v):
    """Consecutive orders of a customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return v.table("orders").select(C("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst")).filter("dst IS NOT NULL")


@R.add("g7_components", "", "WITH c AS (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT id, component FROM c WHERE n > 1")
def g7(v):
    return components(customer_chain(v))


# Within each customer, an order leads to the next one, and the last returns to the first where the customer's key is even.
RINGS = "WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n, lead(o_orderkey) OVER w AS nxt, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), e AS (SELECT o_orderkey AS src, coalesce(nxt, first) AS dst FROM n WHERE n > 1 AND (nxt IS NOT NULL OR o_custkey % 2 = 0)) "


def rings(v):
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = v.table("orders").select("o_custkey", C("o_orderkey").alias("src"), F.lead("o_orderkey").over(by).alias("nxt"), F.first("o_orderkey").over(by).alias("first"))
    closed = F.coalesce("nxt", F.when((C("o_custkey") % 2 == 0) & (C("first") != C("src")), C("first")))
    return o.select("src", closed.alias("dst")).filter("dst IS NOT NULL")


@R.add("g8_strong_components", "", RINGS + "SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN min(o_orderkey) OVER (PARTITION BY o_custkey) ELSE o_orderkey END AS component FROM n WHERE n > 1")
def g8(v):
    return G.strongly_connected(rings(v))


@R.add("g8_condensation", "", RINGS + ", c AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN min(o_orderkey) OVER (PARTITION BY o_custkey) ELSE o_orderkey END AS c FROM n WHERE n > 1) SELECT x.c AS src, y.c AS dst, count(*) AS edges FROM e JOIN c x ON x.id = src JOIN c y ON y.id = dst WHERE x.c <> y.c GROUP BY ALL")
def g8c(v):
    e = rings(v)
    return G.condensation(e, G.strongly_connected(e))


@R.add("g9_louvain")
def g9(v):
    e = coauthors_once(v)
    return rounded(G.modularity(e, G.louvain(e)))


@R.add("g10_modularity", S, WHOLE + ", l AS (SELECT id, id % 4 AS label FROM v), m AS (SELECT sum(weight)::DOUBLE AS m FROM s), i AS (SELECT x.label, sum(weight) AS w FROM s JOIN l x ON src = x.id JOIN l y ON dst = y.id WHERE x.label = y.label GROUP BY 1), k AS (SELECT label, sum(weight) AS w FROM u JOIN l ON src = id GROUP BY 1) SELECT round(sum(coalesce(i.w, 0) / m - pow(k.w / (2 * m), 2)), 6) AS modularity, count(*) AS communities FROM k LEFT JOIN i USING (label), m")
def g10(v):
    e = coauthors(v)
    return rounded(G.modularity(e, G.vertices(e).withColumn("label", C("id") % 4)))


@R.add("g11_label_propagation", S, WHOLE + ", l0 AS (SELECT id, id AS label FROM v), " + ", ".join(f"l{i + 1} AS (SELECT id, arg_max(label, (n, -label)) AS label FROM (SELECT id, label, sum(w) AS n FROM (SELECT dst AS id, label, weight::DOUBLE AS w FROM u JOIN l{i} ON l{i}.id = src UNION ALL SELECT id, label, 1.0 FROM l{i}) GROUP BY ALL) GROUP BY 1)" for i in range(3)) + " SELECT id, label FROM l3")
def g11(v):
    return G.label_propagation(coauthors(v), 3)


@R.add("g12_partition_quality", S, WHOLE + ", l AS (SELECT id, id % 4 AS label FROM v), c AS (SELECT count(*) FILTER (x.label = y.label) AS intra, count(*) AS m FROM s JOIN l x ON src = x.id JOIN l y ON dst = y.id), z AS (SELECT sum(k) AS n, sum(k * (k - 1) / 2) AS inside FROM (SELECT count(*) AS k FROM l GROUP BY label)) SELECT round(intra / m, 6) AS coverage, round((intra + (n * (n - 1) / 2 - inside) - (m - intra)) / (n * (n - 1) / 2), 6) AS performance FROM c, z")
def g12(v):
    e = coauthors(v)
    return rounded(G.partition_quality(e, G.vertices(e).withColumn("label", C("id") % 4)))


@R.add("g12_community_density", S, WHOLE + ", l AS (SELECT id, id % 4 AS label FROM v), i AS (SELECT x.label, count(*) AS inner FROM s JOIN l x ON src = x.id JOIN l y ON dst = y.id WHERE x.label = y.label GROUP BY 1), k AS (SELECT label, count(*) AS nodes FROM l GROUP BY 1) SELECT label, nodes, coalesce(i.inner, 0) AS inner, round(CASE WHEN nodes > 1 THEN 2 * coalesce(i.inner, 0) / (nodes * (nodes - 1)) ELSE 0 END, 6) AS density FROM k LEFT JOIN i USING (label)")
def g12d(v):
    e = coauthors(v)
    return rounded(G.community_density(e, G.vertices(e).withColumn("label", C("id") % 4)))


@R.add("g12_hop_silhouette", S, None)
def g12s(v):
    e = coauthors_once(v)
    return rounded(G.hop_silhouette(e, G.vertices(e).withColumn("label", C("id") % 4)))


R.ORACLES["g12_hop_silhouette"] = _recursive(BFS + ", m AS (SELECT d.id, source % 4 AS c, avg(dist) AS mean FROM d WHERE dist > 0 GROUP BY ALL), x AS (SELECT id, max(mean) FILTER (c = id % 4) AS a, min(mean) FILTER (c <> id % 4) AS b FROM m GROUP BY 1) SELECT v.id, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM v LEFT JOIN x USING (id)")


@R.add("g13_adjusted_information", "", "WITH c AS (SELECT o_orderpriority AS x, o_orderstatus AS y, count(*)::DOUBLE AS k FROM orders GROUP BY ALL), a AS (SELECT x, sum(k) AS a FROM c GROUP BY 1), b AS (SELECT y, sum(k) AS b FROM c GROUP BY 1), n AS (SELECT sum(k) AS n FROM c), m AS (SELECT sum(k / n * ln(n * k / (a * b))) AS mi FROM c JOIN a USING (x) JOIN b USING (y), n), w AS (SELECT a, b, n, unnest(range(greatest(1, a + b - n)::BIGINT, least(a, b)::BIGINT + 1)) AS k FROM a, b, n), e AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS expected FROM w), h AS (SELECT ((SELECT -sum(a / n * ln(a / n)) FROM a, n) + (SELECT -sum(b / n * ln(b / n)) FROM b, n)) / 2 AS h) SELECT round(mi, 6) AS mi, round(expected, 6) AS expected, round((mi - expected) / (h - expected), 6) AS ami FROM m, e, h")
def g13a(v):
    o = v.table("orders")
    return rounded(G.adjusted_mutual_information(o.select(C("o_orderkey").alias("id"), C("o_orderpriority").alias("label")), o.select(C("o_orderkey").alias("id"), C("o_orderstatus").alias("label"))))


@R.add("g13_compare_labels", "", "WITH c AS (SELECT o_orderpriority AS x, o_orderstatus AS y, count(*)::DOUBLE AS k FROM orders GROUP BY ALL), a AS (SELECT sum(k) AS k FROM c GROUP BY x), b AS (SELECT sum(k) AS k FROM c GROUP BY y), t AS (SELECT (SELECT sum(k) FROM c) AS n, (SELECT sum(k * ln(k)) FROM c) AS kxy, (SELECT sum(k * ln(k)) FROM a) AS kx, (SELECT sum(k * ln(k)) FROM b) AS ky, (SELECT sum(k * (k - 1) / 2) FROM c) AS pxy, (SELECT sum(k * (k - 1) / 2) FROM a) AS px, (SELECT sum(k * (k - 1) / 2) FROM b) AS py), h AS (SELECT *, ln(n) - kx / n AS hx, ln(n) - ky / n AS hy, ln(n) - kxy / n AS hxy, px * py / (n * (n - 1) / 2) AS e FROM t) SELECT round(2 * (hx + hy - hxy) / (hx + hy), 6) AS nmi, round(2 * hxy - hx - hy, 6) AS vi, round((pxy - e) / ((px + py) / 2 - e), 6) AS ari FROM h")
def g13(v):
    o = v.table("orders")
    return rounded(G.compare_labels(o.select(C("o_orderkey").alias("id"), C("o_orderpriority").alias("label")), o.select(C("o_orderkey").alias("id"), C("o_orderstatus").alias("label"))))


# Each node's number becomes the h-index of its neighbours', round after round.
PEELED = "h AS (SELECT 0 AS k, src AS id, count(*) AS c FROM e GROUP BY src UNION ALL SELECT k + 1, id, max(least(c, r)) FROM (SELECT k, e.src AS id, c, row_number() OVER (PARTITION BY k, e.src ORDER BY c DESC) AS r FROM h JOIN e ON e.dst = h.id WHERE k < 40) GROUP BY k, id), c AS (SELECT id, c AS core FROM h WHERE k = 40)"
R.add("g14_core_numbers")(lambda v: G.core_numbers(v.cites))
R.ORACLES["g14_core_numbers"] = _recursive_over("cites", CITED + ", e AS (SELECT DISTINCT src, dst FROM u), " + PEELED + " SELECT id, core FROM c")
R.add("g14_shells")(lambda v: G.core_parts(v.cites, 3))
R.ORACLES["g14_shells"] = _recursive_over("cites", CITED + ", e AS (SELECT DISTINCT src, dst FROM u), " + PEELED + ", n AS (SELECT src AS id, count(*) AS n FROM e JOIN c ON c.id = dst WHERE core >= 3 GROUP BY 1) SELECT c.id, core, core >= 3 AS in_core, core = 3 AS in_shell, core <= 3 AS in_crust, core = 3 AND coalesce(n, 0) = 3 AS in_corona FROM c LEFT JOIN n USING (id)")
R.add("g15_k_truss")(lambda v: G.k_truss(v.cites.select("src", "dst"), 3))
R.add("g15_onion_layers")(lambda v: G.onion_layers(v.cites.select("src", "dst")))
R.add("g22_triad_census")(lambda v: G.triad_census(v.cites))
TRI = CITED + ", e AS (SELECT DISTINCT src, dst FROM u), t AS (SELECT x.src AS id, count(*) / 2 AS triangles FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src GROUP BY 1), k AS (SELECT src AS id, count(*) AS k FROM e GROUP BY 1) "


@R.add("g16_triangles", "cites", TRI + "SELECT id, coalesce(triangles, 0)::BIGINT AS triangles, round(CASE WHEN k > 1 THEN 2 * coalesce(triangles, 0) / (k * (k - 1)) ELSE 0 END, 6) AS clustering, k FROM k LEFT JOIN t USING (id)")
def g16(v):
    return rounded(G.triangle_counts(cites(v)))


@R.add("g16_transitivity", "cites", TRI + "SELECT round(2 * sum(coalesce(triangles, 0)) / sum(k * (k - 1)), 6) AS transitivity, round(avg(CASE WHEN k > 1 THEN 2 * coalesce(triangles, 0) / (k * (k - 1)) ELSE 0 END), 6) AS average_clustering, floor(sum(coalesce(triangles, 0)) / 3)::BIGINT AS triangles FROM k LEFT JOIN t USING (id)")
def g16t(v):
    return rounded(G.transitivity(cites(v)))


@R.add("g17_shortest_paths")
def g17(v):
    e = coauthors_once(v)
    return G.hop_rows(e, G.vertices(e)).select("source", "id", "dist")


R.ORACLES["g17_shortest_paths"] = _recursive(BFS + "SELECT source, id, dist FROM d")


COSTS = ", c AS (SELECT src, dst, (1000 // weight)::DOUBLE AS w FROM u), t AS (SELECT 0 AS k, id AS source, id, 0::DOUBLE AS d FROM v UNION ALL SELECT k + 1, source, dst, min(d + w) FROM t JOIN c ON src = id WHERE k < 8 GROUP BY k, source, dst), best AS (SELECT source, id, min(d) AS dist FROM t GROUP BY ALL), parent AS (SELECT y.source, y.id, min(src) AS parent FROM best y JOIN c ON c.dst = y.id JOIN best x ON x.source = y.source AND x.id = src WHERE y.id <> y.source AND x.dist + w = y.dist GROUP BY ALL), way AS (SELECT source, id, id AS here, id::VARCHAR AS path FROM best UNION ALL SELECT way.source, way.id, parent, parent || '-' || path FROM way JOIN parent ON parent.source = way.source AND parent.id = way.here)"


@R.add("g17_weighted_paths")
def g17w(v):
    """Co-authors are the nearer the more they wrote together."""
    e = coauthors_once(v).withColumn("cost", F.expr("1000 div weight"))
    return P.shortest_paths(e, G.vertices(e), "cost").select("source", "id", "dist", F.array_join("path", "-").alias("path"))


# Numbers of cheapest ways, by the number of steps they take, and the shares of those that pass a vertex.
WAYS = COSTS.split(", parent AS")[0] + ", step AS (SELECT y.source, src, y.id FROM best y JOIN c ON c.dst = y.id JOIN best x ON x.source = y.source AND x.id = src WHERE y.id <> y.source AND x.dist + w = y.dist), n AS (SELECT 0 AS k, id AS source, id, 1::DOUBLE AS n FROM v UNION ALL SELECT k + 1, n.source, step.id, sum(n) FROM n JOIN step ON step.source = n.source AND step.src = n.id GROUP BY k, n.source, step.id), d AS (SELECT source AS s, id AS t, any_value(dist) AS d, sum(n) AS n FROM n JOIN best USING (source, id) WHERE source <> id GROUP BY ALL)"
R.ORACLES["g6_weighted_betweenness"] = _recursive_over(S, WHOLE + WAYS + ", " + PASSED.format("") + " SELECT id, round(coalesce(b, 0), 6) AS betweenness FROM v LEFT JOIN b USING (id)")
R.ORACLES["g17_weighted_paths"] = _recursive_over(S, WHOLE + COSTS + " SELECT source, id, dist, path FROM way JOIN best USING (source, id) WHERE here = source")


@R.add("g17_has_path", "", RINGS + ", w AS (SELECT o_custkey, min(o_orderkey) FILTER (k = 1) AS a, min(o_orderkey) FILTER (k = n) AS b FROM n WHERE n > 1 GROUP BY 1) SELECT a, b, true AS found FROM w UNION ALL SELECT b, a, o_custkey % 2 = 0 FROM w")
def g17h(v):
    """From each customer's first order to the last and back, over the next order (and back to the first, in rings)."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = v.table("orders").select("o_custkey", "o_orderkey", F.row_number().over(by).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("n")).filter("n > 1")
    w = o.groupBy("o_custkey").agg(F.min(F.when(C("k") == 1, C("o_orderkey"))).alias("a"), F.min(F.when(C("k") == C("n"), C("o_orderkey"))).alias("b"))
    return P.has_path(rings(v), w.select("a", "b").union(w.select("b", "a")))


@R.add("g18_all_shortest_paths", "cites", "WITH w AS (SELECT x.src AS source, y.dst AS id, 2 AS dist FROM cites x JOIN cites y ON x.dst = y.src WHERE y.dst <> x.src AND (x.src, y.dst) NOT IN (SELECT (src, dst) FROM cites)), a AS (SELECT src AS source, dst AS id, 1 AS dist FROM cites UNION ALL SELECT * FROM w UNION ALL SELECT id, id, 0 FROM (SELECT src AS id FROM cites UNION SELECT dst FROM cites)) SELECT source, dist::DOUBLE AS dist, count(*) AS paths FROM a GROUP BY ALL")
def g18a(v):
    """All shortest ways along citations, two steps at most."""
    e = v.cites
    return P.all_shortest_paths(e, G.vertices(e), 2, directed=True).groupBy("source", "dist").agg(F.count(F.lit(1)).alias("paths"))


@R.add("g18_average_path")
def g18(v):
    e = coauthors_once(v)
    pairs = F.sum("many")
    return rounded(G.hop_counts(e, G.vertices(e)).filter("dist > 0").agg((F.sum(C("dist") * C("many")) / pairs).alias("average_path"), F.coalesce(pairs, F.lit(0)).alias("pairs")))


R.ORACLES["g18_average_path"] = _recursive(BFS + "SELECT round(avg(dist), 6) AS average_path, count(*) AS pairs FROM d WHERE dist > 0")


@R.add("g19_eccentricity")
def g19(v):
    e = coauthors_once(v)
    return G.eccentricities(G.hop_counts(e, G.vertices(e)))


R.ORACLES["g19_eccentricity"] = _recursive(BFS + ", e AS (SELECT source AS id, max(dist) AS eccentricity FROM d GROUP BY 1) SELECT *, eccentricity = (SELECT min(eccentricity) FROM e) AS is_center, eccentricity = (SELECT max(eccentricity) FROM e) AS is_periphery FROM e")


@R.add("g20_citation_chains", "cites", "WITH a AS (SELECT [c.src, c.dst] AS path FROM cites c), b AS (SELECT list_append(path, dst) AS path FROM a JOIN cites ON src = path[2]) SELECT path[1] AS start, len(path) - 1 AS length, count(*) AS walks FROM (SELECT path FROM a UNION ALL SELECT path FROM b) GROUP BY ALL")
def g20(v):
    return G.chains(v.cites, v.cites.select(C("src").alias("id")).distinct(), 2).groupBy(C("path")[0].alias("start"), C("length").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("walks"))


@R.add("g21_summary", "cites", "WITH v AS (SELECT src AS id FROM cites UNION SELECT dst FROM cites) SELECT (SELECT count(*) FROM v) AS nodes, count(*) AS edges, round(count(*) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 6) AS density, round(count(*) FILTER (EXISTS (SELECT 1 FROM cites y WHERE y.src = x.dst AND y.dst = x.src)) / count(*), 6) AS reciprocity FROM cites x")
def g21(v):
    return rounded(G.summary(v.cites))


@R.add("g21_assortativity", "cites papers", "WITH x AS (SELECT p.journal AS x, q.journal AS y FROM cites JOIN papers p ON src = p.paper_id JOIN papers q ON dst = q.paper_id), m AS (SELECT * FROM x UNION ALL SELECT y, x FROM x), e AS (SELECT sum(k * k) / pow((SELECT count(*) FROM m), 2) AS e FROM (SELECT count(*) AS k FROM m GROUP BY x)) SELECT round(((SELECT avg((x = y)::INT) FROM m) - e) / (1 - e), 6) AS assortativity FROM e")
def g21a(v):
    return rounded(G.assortativity(v.cites, v.papers.withColumnRenamed("paper_id", "id"), "journal"))


@R.add("g23_link_scores", "cites", CITED + ", e AS (SELECT DISTINCT src, dst FROM u), k AS (SELECT src, count(*) AS k FROM e GROUP BY 1), p AS (SELECT x.dst AS a, y.dst AS b, count(*) AS common, sum(1 / ln(k)) AS aa, sum(1.0 / k) AS ra FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst JOIN k ON k.src = x.src GROUP BY ALL) SELECT a, b, common, round(common / (ka.k + kb.k - common), 6) AS jaccard, round(aa, 6) AS adamic_adar, round(ra, 6)::DOUBLE AS resource_allocation, ka.k * kb.k AS preferential FROM p JOIN k ka ON ka.src = a JOIN k kb ON kb.src = b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = a AND e.dst = b)")
def g23(v):
    return rounded(G.link_scores(cites(v)))


@R.add("g24_community_links", "cites", CITED + ", e AS (SELECT DISTINCT src, dst FROM u) SELECT x.dst AS a, y.dst AS b, count(*) + count(*) FILTER (x.src % 4 = x.dst % 4) AS score FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst WHERE x.dst % 4 = y.dst % 4 AND NOT EXISTS (SELECT 1 FROM e z WHERE z.src = x.dst AND z.dst = y.dst) GROUP BY ALL")
def g24(v):
    e = cites(v)
    return G.community_link_scores(e, G.vertices(e).withColumn("label", C("id") % 4))


SHARED = CITED + ", e AS (SELECT DISTINCT src, dst FROM u), k AS (SELECT src, count(*) AS k FROM e GROUP BY 1), c AS (SELECT x.dst AS a, y.dst AS b, k, x.src % 4 = x.dst % 4 AS own FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst JOIN k ON k.src = x.src WHERE x.dst % 4 = y.dst % 4 AND (x.dst, y.dst) NOT IN (SELECT (src, dst) FROM e)) "


@R.add("g24_community_allocation", "cites", SHARED + "SELECT a, b, round(sum(1.0 / k), 6)::DOUBLE AS score FROM c WHERE own GROUP BY ALL")
def g24a(v):
    e = cites(v)
    return rounded(G.community_allocation(e, G.vertices(e).withColumn("label", C("id") % 4)))


@R.add("g24_within_inter", "cites", SHARED + "SELECT a, b, round(count(*) FILTER (own) / (count(*) FILTER (NOT own) + 0.001), 6)::DOUBLE AS score FROM c GROUP BY ALL HAVING count(*) FILTER (own) > 0")
def g24w(v):
    e = cites(v)
    return rounded(G.within_inter_scores(e, G.vertices(e).withColumn("label", C("id") % 4)))


@R.add("g25_katz_similarity", S, WHOLE + ", e AS (SELECT DISTINCT src, dst FROM u), w2 AS (SELECT x.src, y.dst, count(*)::DOUBLE AS w FROM e x JOIN e y ON x.dst = y.src GROUP BY ALL), w3 AS (SELECT x.src, y.dst, sum(w) AS w FROM w2 x JOIN e y ON x.dst = y.src GROUP BY ALL), a AS (SELECT src, dst, 0.005::DOUBLE AS s FROM e UNION ALL SELECT src, dst, w * 0.005::DOUBLE ** 2 FROM w2 UNION ALL SELECT src, dst, w * 0.005::DOUBLE ** 3 FROM w3) SELECT src, dst, round(sum(s), 6) AS score FROM a WHERE src < dst GROUP BY ALL")
def g25(v):
    return rounded(G.katz_similarity(coauthors_once(v)))


def net(v, e=None):
    e = coauthors(v) if e is None else e
    return G.vertices(e).withColumn("kind", C("id") % 3), e


@R.add("g26_degree_range", "cites", CITED + ", k AS (SELECT src AS id FROM u GROUP BY 1 HAVING count(*) BETWEEN 6 AND 9) SELECT src, dst, weight FROM s WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def g26(v):
    return G.degree_range(6, 9)(net(v, cites(v)))[1].select("src", "dst", "weight")


@R.add("g27_giant_component", "", "WITH n AS (SELECT o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst, o_orderkey AS src FROM orders), t AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1) SELECT src, dst, 1 AS weight FROM n JOIN t USING (o_custkey) WHERE dst IS NOT NULL")
def g27(v):
    """Of the chains of all customers, the longest."""
    return G.giant_component(net(v, customer_chain(v).withColumn("weight", F.lit(1))))[1].select("src", "dst", "weight")


@R.add("g28_ego_network", "cites", CITED + ", m AS (SELECT min(id) AS c FROM v), k AS (SELECT c AS id FROM m UNION SELECT dst FROM u, m WHERE src = c) SELECT src, dst, weight FROM s WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def g28(v):
    graph = net(v, cites(v))
    return G.ego_network(graph[0].agg(F.min("id")).first()[0], 1)(graph)[1].select("src", "dst", "weight")


@R.add("g29_mutual_edges", "", RINGS + "SELECT x.src, x.dst, 1 AS weight FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def g29(v):
    e = rings(v).withColumn("weight", F.lit(1))
    return G.mutual_edges((G.vertices(e), e))[1]


@R.add("g30_between_groups", S, WHOLE + "SELECT src, dst, weight FROM s WHERE src % 3 <> dst % 3")
def g30(v):
    return G.between_groups("kind")(net(v))[1].select("src", "dst", "weight")


@R.add("g30_partition", S, WHOLE + "SELECT src, dst, weight FROM s WHERE src % 3 IN (0, 2) AND dst % 3 IN (0, 2)")
def g30p(v):
    return G.property_in("kind", [0, 2])(net(v))[1].select("src", "dst", "weight")


@R.add("g30_equal_property", S, WHOLE + "SELECT src, dst, weight FROM s WHERE src % 3 = 1 AND dst % 3 = 1")
def g30q(v):
    return G.equal_property("kind", 1)(net(v))[1].select("src", "dst", "weight")


@R.add("g30_edge_type", "cites authorship", "SELECT src, dst, type FROM (SELECT src, dst, 'citation' AS type FROM cites UNION ALL SELECT paper_id, -1 - author, 'authorship' FROM authorship) WHERE type = 'citation'")
def g30e(v):
    """Of papers' citations and authorships, the citations."""
    e = v.cites.withColumn("type", F.lit("citation")).union(v.authorship.select("paper_id", -1 - C("author"), F.lit("authorship")))
    return G.edge_type(["citation"])((G.vertices(e), e))[1]


@R.add("g31_time_range", "authorship papers", "SELECT x.author AS a, y.author AS b FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author JOIN papers ON papers.paper_id = x.paper_id WHERE year BETWEEN 1996 AND 1996 GROUP BY ALL")
def g31(v):
    from corvella.plans.q_networks import temporal

    t = temporal(v)
    return G.time_range(1996, 1996)((t, t))[1].select("a", "b")


@R.add("g32_filter_chain", S, WHOLE + "SELECT src, dst, weight FROM s WHERE src % 3 IN (0, 1) AND dst % 3 IN (0, 1) AND src % 3 <> dst % 3 AND weight >= 10")
def g32(v):
    return G.chain(G.property_in("kind", [0, 1]), G.between_groups("kind"), G.weight_range(10))(net(v))[1].select("src", "dst", "weight")


R.add("u3_user_filter")(lambda v: G.chain(lambda g: (g[0], g[1].filter("src % 2 = 0")), G.k_core(2))(net(v, cites(v)))[1].select("src", "dst", "weight"))
R.ORACLES["u3_user_filter"] = _recursive_over("cites", "WITH s AS (SELECT DISTINCT src, dst FROM cites WHERE src % 2 = 0), e AS (SELECT src, dst FROM s UNION SELECT dst, src FROM s), " + PEELED + " SELECT src, dst, 1 AS weight FROM s WHERE src IN (SELECT id FROM c WHERE core >= 2) AND dst IN (SELECT id FROM c WHERE core >= 2)")


@R.add("g33_all_centralities")
def g33(v):
    """Per author: degrees, closeness, clustering, betweenness, eigenvector centrality, papers and years of activity."""
    e = materialise(coauthors(v), "author-pairs")
    s = materialise(G.vertices(e), "authors")
    found = G.searched(e, s)
    d = found.counts()
    life = v.authorship.join(v.papers.select("paper_id", "year"), "paper_id").groupBy(C("author").alias("id")).agg(F.count_distinct("paper_id").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    x = G.degrees(e).join(G.closeness(d, s.count()), "id").join(G.triangle_counts(e).select("id", "clustering"), "id")
    return rounded(x.join(G.betweenness(e, s, found=found), "id").join(G.eigenvector(e, tol=1e-9).select("id", F.round("x", 5).alias("eigenvector")), "id").join(life, "id", "left"))


def _over(views: str, body: str) -> str:
    from corvella.plans.views import sql

    return sql(views, body)


LOCAL = _over(S, TRI.replace(CITED, WHOLE) + "SELECT id, round(CASE WHEN k > 1 THEN 2 * coalesce(triangles, 0) / (k * (k - 1)) ELSE 0 END, 6)::DOUBLE AS clustering FROM k LEFT JOIN t USING (id)")
LIVES = _over("authorship papers", "SELECT author AS id, count(DISTINCT paper_id) AS papers, min(year) AS first_year, max(year) AS last_year FROM authorship JOIN papers USING (paper_id) GROUP BY 1")
R.ORACLES["g33_all_centralities"] = f"SELECT g.*, c.closeness, c.harmonic, l.clustering, b.betweenness, e.x AS eigenvector, papers, first_year, last_year FROM ({R.ORACLES['g1_degrees']}) g JOIN ({R.ORACLES['g5_closeness']}) c USING (id) JOIN ({LOCAL}) l USING (id) JOIN ({R.ORACLES['g6_betweenness']}) b USING (id) JOIN ({R.ORACLES['g4_eigenvector']}) e USING (id) LEFT JOIN ({LIVES}) y USING (id)"

R.add("g34_spectral_groups")(lambda v: G.spectral_groups(coauthors(v), 3))


@R.add("m4_eigenfactor")
def m4(v):
    p = v.papers.filter("year BETWEEN 1996 AND 2000")
    e = v.cites.join(p.select(C("paper_id").alias("src")), "src", "left_semi").join(p.select(C("paper_id").alias("dst")), "dst", "left_semi")
    r = G.pagerank(e, tol=1e-9).join(p.select(C("paper_id").alias("id"), "journal"), "id")
    n = p.groupBy("journal").agg(F.count(F.lit(1)).alias("n"))
    ef = r.groupBy("journal").agg((F.sum("rank") * 100).alias("eigenfactor")).join(n, "journal")
    return rounded(ef.select("journal", "eigenfactor", (C("eigenfactor") / (0.01 * C("n"))).alias("article_influence")))


R.ORACLES["m4_eigenfactor"] = _recursive_over("cites papers", "WITH i AS (SELECT paper_id, journal FROM papers WHERE year BETWEEN 1996 AND 2000), e AS (SELECT src, dst, 1::DOUBLE AS w FROM cites WHERE src IN (SELECT paper_id FROM i) AND dst IN (SELECT paper_id FROM i)), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), b AS (SELECT id, 1.0 / (SELECT count(*) FROM v) AS v FROM v), " + _walks("e", "b", 0.85, 90) + ", f AS (SELECT journal, sum(r) * 100 AS f FROM r JOIN i ON paper_id = id GROUP BY 1), n AS (SELECT journal, count(*) AS n FROM i GROUP BY 1) SELECT journal, round(f, 6) AS eigenfactor, round(f / (0.01 * n), 6)::DOUBLE AS article_influence FROM f JOIN n USING (journal)")


@R.add("m5_journal_rank")
def m5(v):
    j = v.papers.select("paper_id", "journal")
    x = v.cites.join(j.select(C("paper_id").alias("src"), C("journal").alias("js")), "src").join(j.select(C("paper_id").alias("dst"), C("journal").alias("jd")), "dst").filter("js <> jd")
    e = x.groupBy(C("js").alias("src"), C("jd").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    return rounded(G.pagerank(e, 0.9, tol=1e-10, weighted=True).select(C("id").alias("journal"), (C("rank") * 1000).alias("sjr")))


R.ORACLES["m5_journal_rank"] = _recursive_over("cites papers", "WITH e AS (SELECT x.journal AS src, y.journal AS dst, count(*)::DOUBLE AS w FROM cites JOIN papers x ON x.paper_id = src JOIN papers y ON y.paper_id = dst WHERE x.journal <> y.journal GROUP BY ALL), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), b AS (SELECT id, 1.0 / (SELECT count(*) FROM v) AS v FROM v), " + _walks("e", "b", 0.9, 260) + " SELECT id AS journal, round(r * 1000, 6) AS sjr FROM r")


@R.add("k6_turning_points", S, WHOLE + COUNTED + ", " + PASSED.format("") + " SELECT id, round(coalesce(b, 0), 6) AS betweenness FROM v LEFT JOIN b USING (id) ORDER BY coalesce(b, 0) DESC, id LIMIT 10")
def k6(v):
    e = coauthors_once(v)
    return rounded(G.betweenness(e, G.vertices(e)).orderBy(F.desc("betweenness"), "id").limit(10))
