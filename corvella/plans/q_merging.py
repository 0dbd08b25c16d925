"""Queries F1-F8, J5-J13, D1-D9."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.functions import scalars as S
from corvella.operators import merging as M
from corvella.plans.q_aggregates import rounded
from corvella.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
C = F.col


@R.add("f1_list_papers", "papers", "SELECT * FROM papers WHERE contains(lower(journal), 'urgent') OR contains(lower(source), 'urgent') ORDER BY year DESC, paper_id LIMIT 50 OFFSET 100")
def f1(v):
    return M.list_papers(v.papers, ["journal", "source"], "URGENT", 50, 100)


@R.add("f2_search_advanced", "papers authorship", "SELECT * FROM papers WHERE year BETWEEN 1996 AND 1998 AND lower(source) = 'f' AND paper_id IN (SELECT paper_id FROM authorship WHERE author < 5)")
def f2(v):
    return M.search_advanced(v.papers, v.authorship, (1996, 1998), "F", C("author") < 5)


@R.add("f3_paged", "papers", "WITH f AS (SELECT paper_id, year FROM papers WHERE source = 'O' AND year = 1997) SELECT *, (SELECT count(*) FROM f) AS total, ceil((SELECT count(*) FROM f) / 20)::BIGINT AS pages FROM f ORDER BY paper_id LIMIT 20 OFFSET 40")
def f3(v):
    return M.paged(v.papers.filter("source = 'O' AND year = 1997").select("paper_id", "year"), [C("paper_id")], 3, 20)


@R.add("f4_suggest", "", "SELECT DISTINCT p_name FROM part WHERE len(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda w: starts_with(w, 'ri'))) > 0 ORDER BY p_name LIMIT 25")
def f4(v):
    return M.suggest(v.table("part"), "p_name", "some ri", 25)


@R.add("f5_bm25", "", r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d), q AS (SELECT unnest(['the', 'and']) AS term), f AS (SELECT doc_id, len(t) AS l, term, len(list_filter(t, lambda w: w = term)) AS tf FROM d, q), g AS (SELECT * FROM f WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM g GROUP BY 1)
 SELECT doc_id, round(sum(ln(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * l / al))), 6) AS score FROM g JOIN df USING (term), s GROUP BY 1 HAVING count(*) = 2 ORDER BY score DESC, doc_id LIMIT 100""")
def f5(v):
    t = v.table("documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))
    return rounded(M.bm25(t, ["the", "and"], 100))


@R.add("f6_year_filter", "papers", "SELECT paper_id, CASE WHEN paper_id % 9 <> 0 THEN year END AS year FROM papers WHERE paper_id % 9 = 0 OR year BETWEEN 1996 AND 1997")
def f6(v):
    return M.in_range_or_unknown(v.papers.select("paper_id", F.when(C("paper_id") % 9 != 0, C("year")).alias("year")), 1996, 1997)


@R.add("f7_orphans", "papers cites", "SELECT * FROM papers WHERE paper_id NOT IN (SELECT src FROM cites) AND paper_id NOT IN (SELECT dst FROM cites)")
def f7(v):
    return M.orphans(v.papers, v.cites)


@R.add("f8_by_ids", "papers", "SELECT pos::INT AS pos, papers.* FROM (VALUES (0, 30), (1, 4), (2, 999999999), (3, 17)) t(pos, i) JOIN papers ON i = paper_id")
def f8(v):
    return M.by_ids(v.papers, "paper_id", [30, 4, 999999999, 17])


@R.add("j5_similar_papers", "papers keywords authorship", "WITH b AS (SELECT * FROM papers WHERE paper_id = (SELECT min(paper_id) FROM authorship)), s AS (SELECT paper_id, 2.0 AS s FROM keywords WHERE keyword IN (SELECT keyword FROM keywords WHERE paper_id = (SELECT paper_id FROM b)) UNION ALL SELECT paper_id, 1.0 FROM authorship WHERE author IN (SELECT author FROM authorship WHERE paper_id = (SELECT paper_id FROM b))), t AS (SELECT paper_id, sum(s) AS s FROM s GROUP BY 1) SELECT p.paper_id, round(s + CASE WHEN p.journal = b.journal THEN 1 ELSE 0 END + greatest(0, .5 - .05 * abs(p.year - b.year)), 6)::DOUBLE AS score FROM papers p JOIN t USING (paper_id), b WHERE p.paper_id <> b.paper_id ORDER BY score DESC, paper_id LIMIT 40")
def j5(v):
    base = v.papers.join(v.authorship.agg(F.min("paper_id").alias("m")), C("paper_id") == C("m")).drop("m")
    return rounded(M.similar_papers(base, [(v.keywords, "keyword", 2), (v.authorship, "author", 1)], v.papers, 40))


TITLES = r"WITH b AS (SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS t FROM benchmark), d AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS t FROM documents), s AS (SELECT b.id AS w, d.id AS k, len(list_intersect(b.t, d.t)) AS n, len(b.t) AS bn, len(d.t) AS dn FROM b, d WHERE len(list_intersect(b.t, d.t)) > 0), r AS (SELECT w, k, n / (bn + dn - n) * 0.8 AS score, row_number() OVER (PARTITION BY w ORDER BY n / (bn + dn - n) DESC, k) AS r FROM s WHERE n / (bn + dn - n) * 0.8 >= 0.3) "


@R.add("j6_resolve_titles", "", TITLES + "SELECT w AS id, k AS match, round(score, 6) AS score FROM r WHERE r = 1")
def j6(v):
    t = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("tokens")
    none = F.lit(None).cast("int").alias("year")
    return rounded(M.resolve_titles(v.table("benchmark").select(C("item_id").alias("id"), t, none), v.table("documents").select(C("doc_id").alias("id"), t, none)))


@R.add("j7_enrich", "", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'source' ELSE c_name END AS name, greatest(c_nationkey, 10) AS n, CASE WHEN lower(c_mktsegment) = 'building' THEN [c_mktsegment, 'x'] ELSE [c_mktsegment, 'building', 'x'] END AS tags FROM customer")
def j7(v):
    c = v.table("customer")
    left = c.select(C("c_custkey").alias("id"), F.when(C("c_custkey") % 3 == 0, " ").otherwise(C("c_name")).alias("name"), C("c_nationkey").alias("n"), F.array("c_mktsegment").alias("tags"))
    src = c.select(C("c_custkey").alias("id"), F.lit("source").alias("name"), F.lit(10).alias("n"), F.array(F.lit("building"), F.lit("x")).alias("tags"))
    return M.enrich(left, src, "id", ["name"], ["n"], ["tags"])


@R.add("j7_discrepancies", "", "SELECT c_custkey AS id, 'seg' AS field, c_mktsegment AS kept, 'BUILDING' AS other FROM customer WHERE c_mktsegment <> 'BUILDING'")
def j7d(v):
    c = v.table("customer")
    return M.discrepancies(c.select(C("c_custkey").alias("id"), C("c_mktsegment").alias("seg")), c.select(C("c_custkey").alias("id"), F.lit("BUILDING").alias("seg")), "id", ["seg"])


@R.add("j8_union_citations", "refs", "WITH l AS (SELECT '10.1/A' || ref AS doi, 1 AS source_rank FROM refs UNION ALL SELECT '10.1/a' || ref, 0 FROM refs WHERE ref % 2 = 0) SELECT lower(doi) AS key, CASE WHEN min(source_rank) = 0 THEN min(doi) FILTER (source_rank = 0) ELSE min(doi) END AS doi, count(DISTINCT source_rank) AS sources FROM l GROUP BY 1")
def j8(v):
    one = v.references.select(F.concat(F.lit("10.1/A"), "ref").alias("doi"), F.lit(1).alias("source_rank"))
    return M.union_citations(one.union(v.references.filter("ref % 2 = 0").select(F.concat(F.lit("10.1/a"), "ref"), F.lit(0))))


@R.add("j9_best_location", "", "SELECT doi, version, pdf_url, url FROM (SELECT l_orderkey AS doi, CASE l_returnflag WHEN 'A' THEN 'publishedVersion' WHEN 'N' THEN 'acceptedVersion' ELSE 'submittedVersion' END AS version, CASE WHEN l_linestatus = 'F' THEN 'p' END AS pdf_url, l_linenumber AS url, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linestatus, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def j9(v):
    ver = F.when(C("l_returnflag") == "A", "publishedVersion").when(C("l_returnflag") == "N", "acceptedVersion").otherwise("submittedVersion")
    return M.best_location(v.table("lineitem").select(C("l_orderkey").alias("doi"), ver.alias("version"), F.when(C("l_linestatus") == "F", "p").alias("pdf_url"), C("l_linenumber").alias("url")))


SNAP = "WITH a AS (SELECT paper_id, journal, citations_count FROM papers WHERE paper_id % 5 <> 0), b AS (SELECT paper_id, CASE WHEN paper_id % 7 = 0 THEN 'moved' ELSE journal END AS journal, citations_count FROM papers WHERE paper_id % 6 <> 0) "


@R.add("j10_compare_snapshots", "papers", SNAP + "SELECT coalesce(a.paper_id, b.paper_id) AS paper_id, CASE WHEN a.paper_id IS NULL THEN 'added' WHEN b.paper_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.paper_id = b.paper_id WHERE a.paper_id IS NULL OR b.paper_id IS NULL OR a.journal <> b.journal")
def j10(v):
    b = v.papers.filter("paper_id % 6 <> 0").withColumn("journal", F.when(C("paper_id") % 7 == 0, "moved").otherwise(C("journal")))
    return M.compare_snapshots(v.papers.filter("paper_id % 5 <> 0"), b, "paper_id", ["journal", "citations_count"])


@R.add("j12_restore", "papers", "SELECT paper_id, paper_id % 6 <> 0 AS present FROM papers WHERE paper_id % 5 <> 0")
def j12(v):
    return M.restore(v.papers.filter("paper_id % 5 <> 0"), v.papers.filter("paper_id % 6 <> 0"), "paper_id")


@R.add("j13_citing_papers", "refs", "SELECT paper_id, ref FROM refs WHERE ref = (SELECT min(ref) FROM refs)")
def j13(v):
    focal = v.references.agg(F.min("ref").alias("f")).select(S.doi(F.concat(F.lit("https://doi.org/10.1/"), "f")).alias("key"))
    return v.references.withColumn("key", S.doi(F.concat(F.lit("DOI:10.1/"), "ref"))).join(F.broadcast(focal), "key").select("paper_id", "ref")  # one row


@R.add("d1_union_sources", "", "SELECT 'c' AS source, count(*) AS n, count(bal) AS with_balance FROM (SELECT c_acctbal AS bal FROM customer) UNION ALL SELECT 'n', count(*), 0 FROM nation")
def d1(v):
    u = M.union_sources({"c": v.table("customer").select(C("c_name").alias("name"), C("c_acctbal").alias("bal")), "n": v.table("nation").select(C("n_name").alias("name"))})
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("bal").alias("with_balance"))


def records(v):
    """Customers twice over: with a DOI shared by three, without one every fifth, a title shared by two."""
    k = C("c_custkey")
    return v.table("customer").select(k.alias("seq"), F.when(k % 5 != 0, F.concat(F.lit("10.1/"), F.floor(k / 3).cast("long"))).alias("doi"), F.concat(F.lit("T "), F.floor(k / 2).cast("long")).alias("title"), C("c_nationkey").cast("int").alias("citations_count"), F.when(k % 2 == 0, C("c_mktsegment")).alias("venue"))


REC = "WITH r AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 5 <> 0 THEN '10.1/' || (c_custkey // 3) END AS doi, 'T ' || (c_custkey // 2) AS title, c_nationkey AS citations_count, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS venue FROM customer), t AS (SELECT title, arg_min(doi, seq) AS bt FROM r WHERE doi IS NOT NULL GROUP BY 1), g AS (SELECT r.*, coalesce('d:' || coalesce(doi, bt), 't:' || title) AS gid FROM r LEFT JOIN t USING (title)) "


@R.add("d2_merge_records", "", REC + "SELECT min(seq) AS seq, max(citations_count) AS citations_count, count(*) AS merged, arg_min(doi, seq) FILTER (doi IS NOT NULL) AS doi, arg_min(title, seq) AS title, arg_min(venue, seq) FILTER (venue IS NOT NULL) AS venue FROM g GROUP BY gid")
def d2(v):
    return M.merge_records(records(v))


@R.add("d3_new_records", "", REC + ", x AS (SELECT doi AS k FROM r WHERE seq < 300 AND doi IS NOT NULL UNION SELECT lower(title) FROM r WHERE seq < 300), n AS (SELECT seq, coalesce(doi, lower(title)) AS k FROM r WHERE seq >= 300) SELECT min(seq) AS seq FROM n WHERE k NOT IN (SELECT k FROM x) GROUP BY k")
def d3(v):
    r = records(v)
    return M.new_records(r.filter("seq >= 300"), r.filter("seq < 300")).select("seq")


@R.add("d4_auto_dedup", "", "WITH RECURSIVE r AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 < 2 THEN c_custkey // 3 END AS doi, c_custkey // 2 AS title FROM customer), e AS (SELECT x.seq AS a, y.seq AS b FROM r x JOIN r y ON x.doi = y.doi OR x.title = y.title), w AS (SELECT seq, seq AS m FROM r UNION SELECT w.seq, e.b FROM w JOIN e ON w.m = e.a), k AS (SELECT seq, min(m) AS keeper FROM w GROUP BY 1) SELECT seq, keeper, count(*) OVER (PARTITION BY keeper) AS group_size FROM k")
def d4(v):
    return M.auto_dedup(records(v).withColumn("doi", F.when(C("seq") % 4 < 2, C("doi"))))


@R.add("d5_compare_projects", "", "WITH a AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_quantity > 45), b AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_quantity > 45) SELECT CASE WHEN a.l_partkey IS NULL THEN 'only_b' WHEN b.l_partkey IS NULL THEN 'only_a' ELSE 'shared' END AS part, count(*) AS n FROM a FULL JOIN b ON a.l_partkey = b.l_partkey GROUP BY 1")
def d5(v):
    x = v.table("lineitem").filter("l_quantity > 45").join(v.table("orders"), C("l_orderkey") == C("o_orderkey"))
    return M.compare_projects(x.filter("o_orderstatus = 'F'"), x.filter("o_orderstatus = 'O'"), "l_partkey")


@R.add("d6_compare_frontiers", "", "WITH b AS (SELECT p_brand || '-' || p_size AS keyword, count(*) AS df FROM part WHERE p_partkey % 2 = 1 GROUP BY 1), a AS (SELECT p_brand || '-' || p_size AS keyword, count(*) AS df FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT keyword, round(1 - least(1, coalesce(a.df, 0) / 100 / (b.df / 40)), 6) AS novelty, round(b.df / 40, 6) AS importance FROM b LEFT JOIN a USING (keyword) WHERE b.df >= 2 AND coalesce(a.df, 0) <= 1")
def d6(v):
    p = v.table("part").withColumn("keyword", F.concat_ws("-", "p_brand", "p_size"))
    df = lambda x: x.groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))
    return rounded(M.compare_frontiers(df(p.filter("p_partkey % 2 = 0")), df(p.filter("p_partkey % 2 = 1")), 100, 40))


@R.add("d7_collapse_similar", "", "WITH RECURSIVE k AS (SELECT DISTINCT p_size AS id, p_brand AS k FROM part), n AS (SELECT id, count(*) AS n FROM k GROUP BY 1), e AS (SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.k = y.k AND x.id <> y.id JOIN n p ON p.id = x.id JOIN n q ON q.id = y.id GROUP BY x.id, y.id HAVING count(*) / (any_value(p.n) + any_value(q.n) - count(*)) >= .5), r AS (SELECT id, id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(c) AS c FROM r GROUP BY 1), s AS (SELECT p_size AS id, avg(p_retailprice) AS score FROM part GROUP BY 1) SELECT arg_max(id, (score, -id)) AS id, count(*) AS members FROM c JOIN s USING (id) GROUP BY c")
def d7(v):
    k = v.table("part").groupBy(C("p_size").alias("id")).agg(F.collect_set("p_brand").alias("keywords"), F.avg("p_retailprice").alias("score"))
    return M.collapse_similar(k)


@R.add("d8_common_references", "cites", "SELECT dst FROM cites WHERE src = (SELECT max(src) FROM cites) INTERSECT SELECT dst FROM cites WHERE src = (SELECT max(src) FROM cites)")
def d8(v):
    top = v.cites.agg(F.max("src").alias("m"))
    one = v.cites.join(F.broadcast(top), C("src") == C("m")).select("dst")  # one row
    return one.intersect(one)


@R.add("d9_upsert", "", "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'added' ELSE 'kept' END AS state FROM customer")
def d9(v):
    c = v.table("customer").select(C("c_custkey").alias("id"), C("c_name").alias("name"))
    return M.upsert(c.filter("id % 4 <> 0"), c, "id")
