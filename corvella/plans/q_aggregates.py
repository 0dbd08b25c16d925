"""Queries A1-A27."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.operators import aggregates as A
from corvella.plans.q_indices import BASE, author_papers
from corvella.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES


def rounded(df, digits: int = 6):
    """All double columns rounded, for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@R.add("a1_summary_stats", "papers", """SELECT count(*) AS papers, min(year) AS year_min, max(year) AS year_max, round(avg(citations_count), 6) AS mean, median(citations_count)::DOUBLE AS median, round(stddev_pop(citations_count), 6) AS std,
 min(citations_count) AS min, max(citations_count) AS max, quantile_cont(citations_count, .25)::DOUBLE AS q1, quantile_cont(citations_count, .75)::DOUBLE AS q3, (quantile_cont(citations_count, .75) - quantile_cont(citations_count, .25))::DOUBLE AS iqr, sum(citations_count)::BIGINT AS total FROM papers""")
def a1(v):
    return rounded(A.summary_stats(v.papers))


@R.add("a2_per_year", "papers", "SELECT year, count(*) AS publications, sum(citations_count)::BIGINT AS citations FROM papers WHERE year IS NOT NULL GROUP BY 1")
def a2(v):
    return A.per_year(v.papers)


@R.add("a3_author_metrics", "papers authorship", BASE + """SELECT author, sum(c)::BIGINT AS total_citations, count(*) AS papers, round(avg(c), 6) AS mean_citations, min(year) AS first_year, max(year) AS last_year, coalesce(max(rank) FILTER (c >= rank), 0)::INT AS h_index,
 coalesce(max(rank) FILTER (run >= rank * rank), 0)::INT AS g_index, count(*) FILTER (c >= 10) AS i10_index, round(coalesce(max(rank) FILTER (c >= rank), 0) / greatest(max(year) - min(year) + 1, 1), 6) AS h_per_year FROM r GROUP BY 1""")
def a3(v):
    return rounded(A.author_metrics(author_papers(v)))


@R.add("a4_journal_metrics", "papers", """WITH d AS (SELECT *, max(year) OVER (PARTITION BY journal) AS last FROM papers), r AS (SELECT journal, citations_count AS c, row_number() OVER (PARTITION BY journal ORDER BY citations_count DESC, paper_id) AS k FROM d WHERE year > last - 5),
 h AS (SELECT journal, coalesce(max(k) FILTER (c >= k), 0)::INT AS h5 FROM r GROUP BY 1), a AS (SELECT journal, 2002 - year AS age, sum(citations_count) AS c FROM papers GROUP BY ALL),
 u AS (SELECT journal, age, sum(c) OVER (PARTITION BY journal ORDER BY age) AS run, sum(c) OVER (PARTITION BY journal) AS total FROM a), m AS (SELECT journal, min(age) AS half_life FROM u WHERE total > 0 AND run >= total / 2 GROUP BY 1)
 SELECT journal, count(*) AS papers, sum(citations_count)::BIGINT AS total_citations, round(avg(citations_count), 6) AS mean_citations, any_value(h5) AS h5, any_value(half_life)::INT AS half_life FROM papers LEFT JOIN h USING (journal) LEFT JOIN m USING (journal) GROUP BY 1""")
def a4(v):
    return rounded(A.journal_metrics(v.papers, 2002))


@R.add("a5_collaboration_index", "authorship", "SELECT round(avg(n), 6) AS collaboration_index FROM (SELECT count(*) AS n FROM authorship GROUP BY paper_id)")
def a5(v):
    return rounded(A.collaboration_index(v.authorship))


@R.add("a6_summary_rollup", "papers", "SELECT journal, year, count(*) AS papers, sum(citations_count)::BIGINT AS citations, CASE grouping(journal, year) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level FROM papers GROUP BY ROLLUP (journal, year)")
def a6(v):
    return A.summary_rollup(v.papers)


@R.add("a7_emerging_authors", "papers", "SELECT o_custkey AS author, min(year) AS first_year, count(*) AS papers, sum(citations_count)::BIGINT AS citations, round(avg(citations_count), 6) AS mean_citations FROM orders JOIN papers ON o_orderkey = paper_id GROUP BY 1 HAVING min(year) >= 1996")
def a7(v):
    """Customers as corresponding authors: suppliers all begin in the first year."""
    who = v.table("orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_custkey").alias("author"))
    return rounded(A.emerging_authors(who.join(v.papers, "paper_id").withColumn("citations", F.col("citations_count")), 1996))


@R.add("a8_year_field", "papers fields", "SELECT year, field, count(*) AS papers, grouping(year, field)::BIGINT AS level FROM papers JOIN fields USING (paper_id) GROUP BY CUBE (year, field)")
def a8(v):
    return A.year_field_counts(v.papers, v.fields)


@R.add("a9_geographic_distribution", "authorship", "SELECT n_name AS country, count(DISTINCT paper_id) AS papers FROM authorship JOIN supplier ON author = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def a9(v):
    who = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("author"), F.col("n_name").alias("country"))
    return v.authorship.join(who, "author").select("country", "paper_id").distinct().groupBy("country").agg(F.count(F.lit(1)).alias("papers"))


@R.add("a10_top_authors", "papers authorship", "SELECT author, count(*) AS papers, sum(citations_count)::BIGINT AS citations FROM authorship JOIN papers USING (paper_id) GROUP BY 1 ORDER BY citations DESC, author LIMIT 25")
def a10(v):
    return A.top_keys(author_papers(v), "author", 25, "citations")


@R.add("a10_top_journals", "papers", "SELECT journal, count(*) AS papers, sum(citations_count)::BIGINT AS citations FROM papers GROUP BY 1 ORDER BY papers DESC, journal LIMIT 3")
def a10j(v):
    return A.top_keys(v.papers.withColumn("citations", F.col("citations_count")), "journal", 3, "papers")


PROJECT = """WITH r AS (SELECT source, citations_count AS c, row_number() OVER (PARTITION BY source ORDER BY citations_count DESC, paper_id) AS k FROM papers), h AS (SELECT source, coalesce(max(k) FILTER (c >= k), 0)::INT AS h_index FROM r GROUP BY 1),
 m AS (SELECT source, count(*) AS papers, sum(citations_count)::BIGINT AS citations, (max(year) - min(year) + 1)::INT AS span, any_value(h_index) AS h_index, round(count(*) / (max(year) - min(year) + 1), 3) AS productivity FROM papers JOIN h USING (source) GROUP BY 1) """


@R.add("a11_project_metrics", "papers", PROJECT + "SELECT * FROM m")
def a11(v):
    return A.project_metrics(v.papers, "source")


@R.add("a11_compare_metrics", "papers", PROJECT + "SELECT metric, max(value) FILTER (source = 'F') AS \"F\", max(value) FILTER (source = 'O') AS \"O\" FROM (UNPIVOT (SELECT source, papers::DOUBLE AS papers, citations::DOUBLE AS citations, span::DOUBLE AS span, h_index::DOUBLE AS h_index, productivity::DOUBLE AS productivity FROM m) ON papers, citations, span, h_index, productivity INTO NAME metric VALUE value) GROUP BY 1")
def a11c(v):
    return A.side_by_side(A.project_metrics(v.papers, "source"), "source", ["F", "O"])


@R.add("a13_stage_progress", "", "WITH s AS (SELECT * FROM (VALUES ('click'), ('view'), ('none')) t(stage)), c AS (SELECT stage, count(event_id) AS records FROM s LEFT JOIN events ON event_type = stage GROUP BY 1) SELECT coalesce(stage, 'total') AS stage, sum(records)::BIGINT AS records FROM c GROUP BY ROLLUP (stage)")
def a13(v):
    return A.stage_progress(v.table("events").select(F.col("event_type").alias("stage")), ["click", "view", "none"])


JUDGED = "WITH j AS (SELECT l_partkey AS study_id, l_shipmode AS domain, judgement FROM (SELECT l_partkey, l_linestatus AS l_shipmode, CASE WHEN max(l_discount) < 0.07 THEN 'low' WHEN min(l_tax) > 0 THEN 'some concerns' WHEN count(*) > 16 THEN 'very high' ELSE 'high' END AS judgement FROM lineitem GROUP BY ALL)) "


def judgements(v):
    g = v.table("lineitem").groupBy(F.col("l_partkey").alias("study_id"), F.col("l_linestatus").alias("domain"))
    j = F.when(F.max("l_discount") < 0.07, "low").when(F.min("l_tax") > 0, "some concerns").when(F.count(F.lit(1)) > 16, "very high").otherwise("high")
    return g.agg(j.alias("judgement"))


@R.add("a14_judgement_shares", "", JUDGED + "SELECT domain, judgement, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY domain), 6) AS share FROM j GROUP BY domain, judgement")
def a14(v):
    return rounded(A.judgement_shares(judgements(v)))


@R.add("a15_overall_risk", "", JUDGED + """, s AS (SELECT study_id, CASE judgement WHEN 'low' THEN 0 WHEN 'some concerns' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS s FROM j)
 SELECT study_id, CASE WHEN max(s) = 0 THEN 'low' WHEN max(s) < 2 THEN 'some concerns' WHEN min(s) >= 2 AND max(s) = 3 THEN 'very high' ELSE 'high' END AS rob2, CASE max(s) WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' WHEN 2 THEN 'serious' ELSE 'critical' END AS worst FROM s GROUP BY 1""")
def a15(v):
    return A.overall_risk(judgements(v))


@R.add("a15_star_quality", "", "SELECT l_orderkey AS study_id, sum(least(l_linenumber, CASE WHEN l_linenumber = 2 THEN 2 ELSE 1 END))::BIGINT AS total, CASE WHEN sum(least(l_linenumber, CASE WHEN l_linenumber = 2 THEN 2 ELSE 1 END)) >= 7 THEN 'high' WHEN sum(least(l_linenumber, CASE WHEN l_linenumber = 2 THEN 2 ELSE 1 END)) >= 5 THEN 'moderate' ELSE 'low' END AS overall FROM lineitem GROUP BY 1")
def a15s(v):
    item = F.when(F.col("l_linenumber") == 2, "comparability").otherwise(F.col("l_linenumber").cast("string"))
    return A.star_quality(v.table("lineitem").select(F.col("l_orderkey").alias("study_id"), item.alias("item"), F.col("l_linenumber").alias("stars")))


@R.add("a17_bias_distribution", "", JUDGED + "SELECT judgement, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM j GROUP BY judgement")
def a17b(v):
    return rounded(A.bias_distribution(judgements(v)))


@R.add("a17_narrative_themes", "effects", "SELECT study_id AS theme, count(*) AS studies, round(avg(m1 - m2), 6) AS mean_effect, CASE WHEN avg(m1 - m2) > 0 THEN 'positive' WHEN avg(m1 - m2) < 0 THEN 'negative' ELSE 'none' END AS direction FROM effects GROUP BY 1 ORDER BY studies DESC, theme LIMIT 5")
def a17(v):
    return rounded(A.narrative_themes(v.effects.select(F.col("study_id").alias("theme"), (F.col("m1") - F.col("m2")).alias("effect")), 5))


@R.add("a17_theme_studies", "effects", "WITH t AS (SELECT study_id, count(*) AS n FROM effects GROUP BY 1 ORDER BY n DESC, study_id LIMIT 5) SELECT study_id AS theme, meta_id AS study, round(m1 - m2, 6) AS effect FROM effects WHERE study_id IN (SELECT study_id FROM t)")
def a17s(v):
    return rounded(A.theme_studies(v.effects.select(F.col("study_id").alias("theme"), F.col("meta_id").alias("study"), (F.col("m1") - F.col("m2")).alias("effect")), 5))


@R.add("a17_study_table", "effects", "SELECT meta_id AS study, max(year)::INT AS year, count(m1 - m2) AS outcomes, round(avg(m1 - m2), 6) AS mean_effect, CASE WHEN avg(m1 - m2) > 0 THEN 'positive' WHEN avg(m1 - m2) < 0 THEN 'negative' ELSE 'none' END AS direction FROM effects GROUP BY 1")
def a17t(v):
    x = v.effects.select(F.col("meta_id").alias("study"), "year", (F.col("m1") - F.col("m2")).alias("effect"))
    return rounded(A.study_table(x.groupBy("study").agg(F.max("year").alias("year")), x))


CASES = "WITH q AS (SELECT l_orderkey AS id, (sum(l_quantity) > 100)::INT AS big, (avg(l_discount) > 0.05)::INT AS cheap, (max(l_tax) > 0.06)::INT AS taxed, (count(*) > 3)::INT AS many FROM lineitem GROUP BY 1) "


def cases(v):
    return v.table("lineitem").groupBy("l_orderkey").agg(
        (F.sum("l_quantity") > 100).cast("int").alias("big"), (F.avg("l_discount") > 0.05).cast("int").alias("cheap"), (F.max("l_tax") > 0.06).cast("int").alias("taxed"), (F.count(F.lit(1)) > 3).cast("int").alias("many")
    )


@R.add("a18_qca_truth_table", "", CASES + "SELECT cheap, taxed, many, big, count(*) AS cases FROM q GROUP BY ALL")
def a18(v):
    return A.qca_truth_table(cases(v), "big", ["cheap", "taxed", "many"])


@R.add("a18_qca_conditions", "", CASES + " SELECT condition, round(sum(x * big) / sum(big), 6) AS necessity, round(sum(x * big) / sum(x), 6) AS sufficiency FROM (UNPIVOT q ON cheap, taxed, many INTO NAME condition VALUE x) GROUP BY 1")
def a18c(v):
    return rounded(A.qca_conditions(cases(v), "big", ["cheap", "taxed", "many"]))


@R.add("a19_fsqca", "", """WITH f AS (SELECT o_orderkey, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS y, (o_orderkey % 100) / 100.0 AS a, (o_custkey % 10) / 10.0 AS b FROM orders),
 m AS (SELECT concat_ws('*', CASE WHEN a > .5 THEN 'A' ELSE 'a' END, CASE WHEN b > .5 THEN 'B' ELSE 'b' END) AS configuration, least(CASE WHEN a > .5 THEN a ELSE 1 - a END, CASE WHEN b > .5 THEN b ELSE 1 - b END)::DOUBLE AS x, y FROM f)
 SELECT configuration, count(*) AS cases, round(sum(least(x, y)) / sum(x), 6) AS consistency, round(sum(least(x, y)) / sum(y), 6) AS coverage FROM m GROUP BY 1""")
def a19(v):
    o = v.table("orders")
    top = o.agg(F.max("o_totalprice").alias("top"))
    f = o.join(F.broadcast(top)).select((F.col("o_totalprice") / F.col("top")).alias("y"), (F.col("o_orderkey") % 100 / 100.0).alias("a"), (F.col("o_custkey") % 10 / 10.0).alias("b"))
    return rounded(A.fsqca(f, "y", ["a", "b"]))


@R.add("a20_prisma_flow", "", "SELECT count(*) AS identified, count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (n = 1) AS screened, count(*) FILTER (n = 1 AND x) AS excluded, count(*) FILTER (n = 1 AND NOT x) AS sought, count(*) FILTER (n = 1 AND NOT x AND i) AS included, [] ::VARCHAR[] AS warnings FROM (SELECT row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n, n_chars < 500 AS x, lang = 'en' AS i FROM documents)")
def a20(v):
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("text").orderBy("doc_id"))
    d = v.table("documents").select((n > 1).alias("duplicate"), (F.col("n_chars") < 500).alias("excluded"), (F.col("lang") == "en").alias("included"))
    return A.prisma_flow(d)


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


@R.add("a21_table_counts", "", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def a21(v):
    return A.table_counts({t: v.table(t) for t in TABLES})


@R.add("a22_citation_histogram", "papers", "WITH s AS (SELECT min(citations_count)::DOUBLE lo, max(citations_count)::DOUBLE hi, least(50, greatest(10, floor(sqrt(count(*)))))::INT bins FROM papers) SELECT least(floor((citations_count - lo) / ((hi - lo) / bins)), bins - 1)::INT AS bin, count(*) AS n FROM papers, s GROUP BY 1")
def a22(v):
    return A.histogram(v.papers, "citations_count")


EDGES = "WITH e AS (SELECT x.l_suppkey AS src, y.l_suppkey AS dst, x.l_quantity AS weight FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey) "


def multi_edges(v):
    x = v.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("src"), F.col("l_quantity").alias("weight"))
    y = v.table("lineitem").select(F.col("l_orderkey").alias("o2"), F.col("l_suppkey").alias("dst"))
    return x.join(y, (x.o == y.o2) & (x.src < y.dst)).select("src", "dst", "weight")


@R.add("a23_fold_parallel_edges", "", EDGES + "SELECT src, dst, sum(weight) AS weight, count(*) AS parallel FROM e GROUP BY ALL")
def a23(v):
    return A.fold_parallel_edges(multi_edges(v))


@R.add("u1_user_edge_fold", "", EDGES + "SELECT src, dst, round(sqrt(sum(weight * weight)), 6) AS weight, count(*) AS parallel FROM e GROUP BY ALL")
def u1(v):
    return rounded(A.fold_parallel_edges(multi_edges(v), fold=lambda w: F.sqrt(F.sum(w * w))))


@R.add("a24_cohen_kappa", "", "WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels), s AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, (sum(a) * sum(b) + sum(1 - a) * sum(1 - b)) / (count(*) * count(*)) AS pe FROM p) SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM s")
def a24(v):
    return rounded(A.cohen_kappa(v.table("labels").select(F.col("quality").alias("rater_1"), (1 - F.col("toxic")).alias("rater_2"))))


def decisions(v):
    one = v.table("labels").select(F.col("doc_id").alias("record_id"), F.lit("r1").alias("reviewer"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"))
    two = v.table("labels").select(F.col("doc_id").alias("record_id"), F.lit("r2").alias("reviewer"), F.when(F.col("toxic") == 0, "include").otherwise("exclude").alias("decision"))
    return one.union(two)


DECIDED = "WITH d AS (SELECT doc_id AS record_id, 'r1' AS reviewer, CASE WHEN quality = 1 THEN 'include' ELSE 'exclude' END AS decision FROM labels UNION ALL SELECT doc_id, 'r2', CASE WHEN toxic = 0 THEN 'include' ELSE 'exclude' END FROM labels) "


@R.add("a24_fleiss_kappa", "", DECIDED + ", c AS (SELECT record_id, decision, count(*) AS k FROM d GROUP BY ALL), r AS (SELECT record_id, sum(k) AS m, sum(k * k) AS sq FROM c GROUP BY 1 HAVING sum(k) > 1), s AS (SELECT (SELECT count(*) FROM r) AS n, (SELECT avg((sq - m) / (m * (m - 1))) FROM r) AS po, (SELECT sum(t * t) / (sum(t) * sum(t)) FROM (SELECT sum(k) AS t FROM c GROUP BY decision)) AS pe) SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM s")
def a24f(v):
    return rounded(A.fleiss_kappa(decisions(v)))


@R.add("a25_conflicts", "", DECIDED + "SELECT record_id, count(DISTINCT reviewer) AS reviewers, count(DISTINCT decision) AS decisions FROM d GROUP BY 1 HAVING count(DISTINCT reviewer) >= 2 AND count(DISTINCT decision) >= 2")
def a25(v):
    return A.conflicts(decisions(v))


@R.add("a25_resolved", "", DECIDED + ", r AS (SELECT doc_id AS record_id, 'include' AS decision FROM labels WHERE doc_id % 2 = 0) SELECT record_id, coalesce(any_value(r.decision), CASE WHEN count(DISTINCT d.decision) = 1 THEN min(d.decision) END, 'conflict') AS decision FROM d LEFT JOIN r USING (record_id) GROUP BY 1")
def a25r(v):
    res = v.table("labels").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("record_id"), F.lit("include").alias("decision"), F.lit(1).alias("ts"))
    return A.resolved(decisions(v), res)


@R.add("a26_bland_altman", "", "SELECT count(*) AS n, round(avg(d), 6) AS bias, round(stddev_samp(d), 6) AS sd, round(avg(d) - 1.96 * stddev_samp(d), 6) AS lower, round(avg(d) + 1.96 * stddev_samp(d), 6) AS upper FROM (SELECT l_quantity - l_tax * 500 AS d FROM lineitem)")
def a26(v):
    return rounded(A.bland_altman(v.table("lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_tax") * 500).alias("y"))))


@R.add("a26_volcano", "", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN l_discount < 0.05 AND l_quantity / 10 - 2 >= 1 THEN 'up' WHEN l_discount < 0.05 AND l_quantity / 10 - 2 <= -1 THEN 'down' ELSE 'ns' END AS class FROM lineitem) GROUP BY 1")
def a26v(v):
    t = v.table("lineitem").select((F.col("l_quantity") / 10 - 2).alias("change"), F.col("l_discount").alias("p"))
    return A.volcano_classes(t).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@R.add("a26_qq", "", "SELECT o_orderpriority AS family, o_orderkey AS id, o_totalprice AS p, row_number() OVER w::INT AS i, round((row_number() OVER w - 0.5) / count(*) OVER (PARTITION BY o_orderpriority), 6) AS expected FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)")
def a26q(v):
    t = v.table("orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"))
    return rounded(A.qq_points(t, ["family"]))


@R.add("a26_manhattan", "", "WITH s AS (SELECT p_brand AS chromosome, max(p_partkey) AS span FROM part GROUP BY 1) SELECT chromosome, span, coalesce(sum(span) OVER (ORDER BY chromosome ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM s")
def a26m(v):
    return A.manhattan_offsets(v.table("part").select(F.col("p_brand").alias("chromosome"), F.col("p_partkey").alias("position")))


@R.add("a27_validate_forms", "", """SELECT c_custkey AS study_id, list_sort(list_filter([CASE WHEN c_acctbal < 0 THEN 'balance: required' END, CASE WHEN NOT c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'segment: not an option' END], lambda x: x IS NOT NULL)) AS errors FROM customer""")
def a27(v):
    c = v.table("customer")
    rules = v.spark.createDataFrame([("balance", "number", True, []), ("segment", "select", True, ["BUILDING", "MACHINERY"])], "field string, kind string, required boolean, options array<string>")
    values = c.select(F.col("c_custkey").alias("study_id"), F.lit("balance").alias("field"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).alias("value")).union(c.select("c_custkey", F.lit("segment"), "c_mktsegment"))
    return A.validate_forms(values, rules)
