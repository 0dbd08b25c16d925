"""Queries N1-N20, J1-J4, J11, J14, K1, K2, W10, W20."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.operators import networks as N
from corvella.plans.q_aggregates import rounded
from corvella.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES


@R.add("n1_bib_coupling", "refs", "SELECT x.paper_id AS a, y.paper_id AS b, count(*) AS weight FROM refs x JOIN refs y ON x.ref = y.ref AND x.paper_id < y.paper_id GROUP BY ALL HAVING count(*) >= 2")
def n1(v):
    return N.bibliographic_coupling(v.references, 2)


@R.add("n2_co_citation", "refs", "SELECT x.ref AS a, y.ref AS b, count(*) AS weight FROM refs x JOIN refs y ON x.paper_id = y.paper_id AND x.ref < y.ref GROUP BY ALL")
def n2(v):
    return N.co_citation(v.references)


@R.add("n3_co_citation_sources", "cites papers", "WITH c AS (SELECT DISTINCT src, journal AS node FROM cites JOIN papers ON dst = paper_id) SELECT x.node AS a, y.node AS b, count(*) AS weight FROM c x JOIN c y ON x.src = y.src AND x.node < y.node GROUP BY ALL")
def n3(v):
    return N.co_citation_of(v.cites, v.papers, "journal")


@R.add("u2_user_node", "cites papers", "WITH c AS (SELECT DISTINCT src, concat(source, year % 3) AS node FROM cites JOIN papers ON dst = paper_id) SELECT x.node AS a, y.node AS b, count(*) AS weight FROM c x JOIN c y ON x.src = y.src AND x.node < y.node GROUP BY ALL")
def u2(v):
    return N.co_citation_of(v.cites, v.papers, "journal", node=F.concat("source", (F.col("year") % 3).cast("string")))


@R.add("n3_co_citation_authors", "cites authorship", "WITH c AS (SELECT DISTINCT src, author AS node FROM cites JOIN authorship ON dst = paper_id) SELECT x.node AS a, y.node AS b, count(*) AS weight FROM c x JOIN c y ON x.src = y.src AND x.node < y.node GROUP BY ALL")
def n3a(v):
    return N.co_citation_of(v.cites, v.authorship, "author")


@R.add("n4_co_authorship", "coauthors", "SELECT * FROM coauthors")
def n4(v):
    return N.co_authorship(v.authorship)


@R.add("n4_author_nodes", "authorship papers", "SELECT author, count(*) AS papers, sum(citations_count)::BIGINT AS citations FROM authorship JOIN papers USING (paper_id) GROUP BY 1")
def n4n(v):
    return N.author_nodes(v.authorship, v.papers)


@R.add("n5_collaboration_graph", "authorship papers", "SELECT x.author AS a, y.author AS b, count(*) AS weight, count(DISTINCT year) AS n_years, min(year) AS first_year, max(year) AS last_year, arg_min(paper_id, (year, paper_id)) AS first_paper, list_sort(list(DISTINCT year)) AS years FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author JOIN papers ON papers.paper_id = x.paper_id GROUP BY ALL".replace("arg_min(paper_id", "arg_min(x.paper_id").replace("(year, paper_id)", "(year, x.paper_id)"))
def n5(v):
    return N.collaboration_graph(v.authorship, v.papers)


@R.add("n6_term_co_occurrence", "keywords", "WITH t AS (SELECT keyword FROM keywords GROUP BY 1 ORDER BY count(*) DESC, keyword LIMIT 15), k AS (SELECT * FROM keywords WHERE keyword IN (SELECT keyword FROM t)) SELECT x.keyword AS a, y.keyword AS b, count(*) AS weight FROM k x JOIN k y ON x.paper_id = y.paper_id AND x.keyword < y.keyword GROUP BY ALL HAVING count(*) >= 2")
def n6(v):
    return N.term_co_occurrence(v.keywords.withColumnRenamed("keyword", "term"), 15, 2)


MATRIX = "WITH m AS (SELECT x.keyword AS i, y.keyword AS j, count(*) AS value FROM keywords x JOIN keywords y ON x.paper_id = y.paper_id GROUP BY ALL) "


@R.add("n7_co_word_matrix", "keywords", MATRIX + "SELECT * FROM m")
def n7(v):
    return N.co_occurrence_matrix(v.keywords, "paper_id", "keyword")


@R.add("n7_co_journal_matrix", "cites papers", "WITH c AS (SELECT DISTINCT src, journal FROM cites JOIN papers ON dst = paper_id) SELECT x.journal AS i, y.journal AS j, count(*) AS value FROM c x JOIN c y ON x.src = y.src GROUP BY ALL")
def n7j(v):
    c = v.cites.join(v.papers.withColumnRenamed("paper_id", "dst"), "dst").select("src", "journal")
    return N.co_occurrence_matrix(c, "src", "journal")


for _m, _e in (("association", "value / sqrt(di.value * dj.value)"), ("jaccard", "value / (di.value + dj.value - m.value)"), ("inclusion", "value / least(di.value, dj.value)")):
    R.add(f"n8_normalise_{_m}", "keywords", MATRIX + f", d AS (SELECT i, value FROM m WHERE i = j) SELECT m.i, m.j, round(CASE WHEN m.i = m.j THEN 1.0 ELSE m.{_e} END, 6)::DOUBLE AS value FROM m JOIN d di ON m.i = di.i JOIN d dj ON m.j = dj.i")(lambda v, m=_m: rounded(N.normalise(N.co_occurrence_matrix(v.keywords, "paper_id", "keyword"), m)))


@R.add("n9_prune", "keywords", MATRIX + "SELECT * FROM m WHERE i = j OR value >= 0.9 * (SELECT max(value) FROM m WHERE i <> j)")
def n9(v):
    return N.prune(N.co_occurrence_matrix(v.keywords, "paper_id", "keyword"), 0.9, absolute=False)


@R.add("n10_domain_map", "fields papers", "WITH n AS (SELECT field AS topic, floor((year - (SELECT min(year) FROM papers)) / 2)::INT AS bin, count(*) AS n FROM fields JOIN papers USING (paper_id) GROUP BY ALL) SELECT topic, bin, n, CASE WHEN lead(bin) OVER w = bin + 1 THEN least(n, lead(n) OVER w) END AS to_next FROM n WINDOW w AS (PARTITION BY topic ORDER BY bin)")
def n10(v):
    return N.domain_map(v.fields.join(v.papers, "paper_id").select(F.col("field").alias("topic"), "year"), 2)


PROJECTED = "WITH k AS (SELECT paper_id, count(*) AS k FROM authorship GROUP BY 1) SELECT x.author AS a, y.author AS b, {w} AS weight FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author JOIN k ON k.paper_id = x.paper_id GROUP BY ALL"
for _h, _w in (("count", "count(*)::DOUBLE"), ("newman", "round(sum(1.0 / (k - 1)), 6)::DOUBLE"), ("ratio", "round(count(*) / (SELECT count(DISTINCT paper_id) FROM authorship), 6)::DOUBLE")):
    R.add(f"n13_projection_{_h}", "authorship", PROJECTED.replace("{w}", _w))(lambda v, h=_h: rounded(N.projection(v.authorship, "paper_id", "author", h)))


@R.add("n14_generic_projection", "authorship", "WITH d AS (SELECT author, count(*) AS d FROM authorship GROUP BY 1) SELECT x.author AS a, y.author AS b, round(count(*) / any_value(p.d + q.d - 0) * 2, 6) AS weight FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author JOIN d p ON p.author = x.author JOIN d q ON q.author = y.author GROUP BY ALL")
def n14(v):
    dice = lambda shared, na, nb: shared / (na + nb) * 2
    return rounded(N.generic_projection(v.authorship, "paper_id", "author", dice, counts=True))


@R.add("n15_bipartite_stats", "authorship", "SELECT count(DISTINCT paper_id) AS n_left, count(DISTINCT author) AS n_right, count(*) AS edges, round(count(*) / (count(DISTINCT paper_id) * count(DISTINCT author)), 6) AS density FROM authorship")
def n15(v):
    return rounded(N.bipartite_stats(v.authorship, "paper_id", "author"))


@R.add("n15_bipartite_clustering", "coauthors", "WITH d AS (SELECT author, count(*) AS d FROM authorship GROUP BY 1), p AS (SELECT a, b, weight / (x.d + y.d - weight) AS c FROM coauthors JOIN d x ON a = x.author JOIN d y ON b = y.author) SELECT author, round(coalesce(avg(c), 0), 6) AS clustering FROM d LEFT JOIN (SELECT a AS author, c FROM p UNION ALL SELECT b, c FROM p) USING (author) GROUP BY 1")
def n15c(v):
    return rounded(N.bipartite_clustering(v.authorship, "paper_id", "author"))


def author_paper_edges(v):
    """Papers and their authors as one graph; authors' ids are negative, so that none is a paper's."""
    return v.authorship.select(F.col("paper_id").alias("src"), (-1 - F.col("author")).alias("dst"))


@R.add("n15_two_colouring", "", "WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n, min(o_orderkey) OVER (PARTITION BY o_custkey) AS least FROM orders), z AS (SELECT o_custkey, k AS k0 FROM n WHERE o_orderkey = least) SELECT o_orderkey AS id, least AS component, CASE WHEN o_custkey % 2 = 0 AND n % 2 = 1 AND n > 1 THEN NULL ELSE (abs(k - k0) % 2)::INT END AS side FROM n JOIN z USING (o_custkey) WHERE n > 1")
def n15t(v):
    """Each customer's orders as a chain, or as a ring where the key is even: odd rings have no colouring."""
    from corvella.plans.q_graph import rings

    return N.two_colouring(rings(v))


@R.add("n15_is_bipartite", "authorship", "SELECT true AS bipartite, count(DISTINCT paper_id) AS zeros, count(DISTINCT author) AS ones FROM authorship")
def n15b(v):
    got = N.is_bipartite(author_paper_edges(v))
    # authors' ids are the smaller ones, so in every component they are side 0
    return got.select("bipartite", F.col("ones").alias("zeros"), F.col("zeros").alias("ones"))


@R.add("n15_redundancy", "coauthors", "WITH p AS (SELECT x.paper_id, avg((weight > 1)::INT) AS r FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author JOIN coauthors ON a = x.author AND b = y.author GROUP BY 1) SELECT DISTINCT paper_id, round(r, 6) AS redundancy FROM authorship LEFT JOIN p USING (paper_id)")
def n15r(v):
    return rounded(N.redundancy(v.authorship, "author", "paper_id"))


TEMPORAL = "WITH t AS (SELECT x.author AS a, y.author AS b, count(DISTINCT year) AS weight, list_sort(list(DISTINCT year)) AS years, min(year) AS first_year, max(year) AS last_year FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author JOIN papers ON papers.paper_id = x.paper_id GROUP BY ALL), n AS (SELECT author, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS n_years FROM authorship JOIN papers USING (paper_id) GROUP BY 1) "


def members(v):
    return v.authorship.join(v.papers.select("paper_id", "year"), "paper_id")


def temporal(v):
    return N.temporal_network(members(v), "paper_id", "author")


@R.add("n16_temporal_edges", "authorship papers", TEMPORAL + "SELECT * FROM t")
def n16(v):
    return temporal(v)


@R.add("n16_temporal_nodes", "authorship papers", TEMPORAL + "SELECT * FROM n")
def n16n(v):
    return N.temporal_nodes(members(v), "author")


@R.add("n17_evolution", "authorship papers", TEMPORAL + ", s AS (SELECT unnest(range(1995, 2002))::INT AS year), p AS (SELECT s.year, a, b, len(list_filter(years, lambda y: y <= s.year)) AS w FROM t JOIN s ON first_year <= s.year), e AS (SELECT year, count(*) AS edges, sum(w)::BIGINT AS weight FROM p GROUP BY 1), v AS (SELECT year, count(DISTINCT x) AS nodes FROM (SELECT year, a AS x FROM p UNION ALL SELECT year, b FROM p) GROUP BY 1) SELECT year, edges, weight, nodes FROM e JOIN v USING (year)")
def n17(v):
    return N.evolution(temporal(v), 1995, 2001)


@R.add("n18_temporal_degree", "authorship papers", TEMPORAL + ", y AS (SELECT unnest(years) AS year, a, b FROM t) SELECT year, node, count(*) AS degree FROM (SELECT year, a AS node FROM y UNION ALL SELECT year, b FROM y) GROUP BY ALL")
def n18(v):
    return N.temporal_degree(temporal(v))


@R.add("n19_emerging_pairs", "authorship papers", TEMPORAL + "SELECT a, b, first_year, weight FROM t WHERE first_year >= 1997")
def n19(v):
    return N.emerging_pairs(temporal(v), 1997)


@R.add("n20_scientogram", "keywords", MATRIX + ", d AS (SELECT i, value FROM m WHERE i = j), z AS (SELECT m.i, m.j, CASE WHEN m.i = m.j THEN 1.0 ELSE m.value / sqrt(di.value * dj.value) END AS value FROM m JOIN d di ON m.i = di.i JOIN d dj ON m.j = dj.i) SELECT i, j, round(value, 6) AS value FROM z WHERE i = j OR value >= 0.165")
def n20(v):
    return rounded(N.scientogram(v.keywords, "paper_id", "keyword", "association", 0.165))


@R.add("w10_growth_curve", "authorship papers", TEMPORAL + ", g AS (SELECT first_year AS year, count(*) AS new_nodes FROM n GROUP BY 1), h AS (SELECT first_year AS year, count(*) AS new_edges FROM t GROUP BY 1), j AS (SELECT coalesce(g.year, h.year) AS year, coalesce(new_nodes, 0) AS new_nodes, coalesce(new_edges, 0) AS new_edges FROM g FULL JOIN h ON g.year = h.year), c AS (SELECT *, sum(new_nodes) OVER (ORDER BY year)::BIGINT AS nodes, sum(new_edges) OVER (ORDER BY year)::BIGINT AS edges FROM j) SELECT *, round(CASE WHEN nodes > 1 THEN 2 * edges / (nodes * (nodes - 1)) ELSE 0 END, 6) AS density, round(CASE WHEN nodes > 0 THEN 2 * edges / nodes ELSE 0 END, 6) AS mean_degree FROM c")
def w10(v):
    return rounded(N.growth_curve(N.temporal_nodes(members(v), "author"), temporal(v)))


@R.add("w20_fading_nodes", "papers authorship", TEMPORAL + "SELECT author, first_year, last_year FROM n WHERE last_year BETWEEN 1999 AND 2001")
def w20(v):
    return N.temporal_nodes(members(v), "author").filter("last_year BETWEEN 1999 AND 2001").select("author", "first_year", "last_year")


@R.add("j1_citation_edges", "cites", "SELECT src, dst FROM cites WHERE src <> dst")
def j1(v):
    alias = v.papers.select("paper_id", F.concat(F.lit("10.1/"), "paper_id").alias("alias"))
    refs = v.cites.select(F.col("src").alias("paper_id"), F.concat(F.lit("10.1/"), "dst").alias("ref"))
    return N.resolve_references(refs, alias)


@R.add("j2_alias_edges", "cites", "SELECT DISTINCT src, dst FROM cites WHERE src <> dst")
def j2(v):
    ids = v.papers.select("paper_id", F.col("paper_id").cast("string").alias("alias"))
    aliases = ids.union(v.papers.select("paper_id", F.concat(F.lit("10.1/"), "paper_id").alias("alias"))).union(v.papers.select("paper_id", F.concat(F.lit("W"), "paper_id").alias("alias")))
    ref = F.when(F.col("dst") % 3 == 0, F.col("dst").cast("string")).when(F.col("dst") % 3 == 1, F.concat(F.lit("10.1/"), "dst")).otherwise(F.concat(F.lit("W"), "dst"))
    return N.resolve_references(v.cites.select(F.col("src").alias("paper_id"), ref.alias("ref")), aliases)


@R.add("j3_heterogeneous_edges", "authorship cites", "SELECT 'p' || paper_id AS src, 'a' || author AS dst, 'authorship' AS type FROM authorship UNION ALL SELECT DISTINCT 'p' || greatest(src, dst), 'p' || least(src, dst), 'citation' FROM cites")
def j3(v):
    return N.heterogeneous_edges(v.authorship, v.cites)


@R.add("j4_co_citation_lookup", "cites papers", "WITH c AS (SELECT DISTINCT src, year AS node FROM cites JOIN papers ON dst = paper_id) SELECT x.node AS a, y.node AS b, count(*) AS weight FROM c x JOIN c y ON x.src = y.src AND x.node < y.node GROUP BY ALL HAVING count(*) >= 5")
def j4(v):
    return N.co_citation_of(v.cites, v.papers, "year", min_weight=5)


@R.add("j11_snapshot", "authorship papers", TEMPORAL + "SELECT a, b, len(list_filter(years, lambda y: y <= 1997)) AS weight, list_filter(years, lambda y: y <= 1997) AS years FROM t WHERE first_year <= 1997")
def j11(v):
    return N.snapshot(temporal(v), 1997)


@R.add("j14_inter_institutional", "coauthors", "SELECT a, b, x.s_nationkey AS ia, y.s_nationkey AS ib, weight FROM coauthors JOIN supplier x ON a = x.s_suppkey JOIN supplier y ON b = y.s_suppkey WHERE x.s_nationkey <> y.s_nationkey")
def j14(v):
    return N.inter_institutional(v.coauthors, v.table("supplier").select(F.col("s_suppkey").alias("author"), F.col("s_nationkey").alias("institution")))


@R.add("k1_top_cited", "cites", "SELECT dst AS paper_id, count(*) AS citations FROM cites GROUP BY 1 ORDER BY citations DESC, paper_id LIMIT 50")
def k1(v):
    return v.cites.groupBy(F.col("dst").alias("paper_id")).agg(F.count(F.lit(1)).alias("citations")).orderBy(F.desc("citations"), "paper_id").limit(50)


@R.add("k1_top_citing", "cites", "SELECT src AS paper_id, count(*) AS refs FROM cites GROUP BY 1 ORDER BY refs DESC, paper_id LIMIT 50")
def k1c(v):
    return v.cites.groupBy(F.col("src").alias("paper_id")).agg(F.count(F.lit(1)).alias("refs")).orderBy(F.desc("refs"), "paper_id").limit(50)


@R.add("k2_top_collaborators", "coauthors", "SELECT CASE WHEN a = 7 THEN b ELSE a END AS neighbour, weight FROM coauthors WHERE a = 7 OR b = 7 ORDER BY weight DESC, neighbour LIMIT 20")
def k2(v):
    return N.top_neighbours(v.coauthors, 7, 20)
