"""Queries W11-W19, K3-K7 without graphs, M1-M3, M6-M8."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.operators import windows as W
from corvella.plans.q_aggregates import rounded
from corvella.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
C = F.col


@R.add("w11_cumulative", "papers", "SELECT year, count(*) AS n, (sum(count(*)) OVER (ORDER BY year))::BIGINT AS cumulative FROM papers GROUP BY year")
def w11(v):
    return W.cumulative_by(v.papers, "year")


@R.add("w12_bradford", "authorship", "WITH c AS (SELECT author, count(*) AS n FROM authorship GROUP BY 1), r AS (SELECT author, n, row_number() OVER w::INT AS rank, (sum(n) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS cumulative, sum(n) OVER () AS total FROM c WINDOW w AS (ORDER BY n DESC, author)) SELECT author, n, rank, cumulative, CASE WHEN cumulative / total <= 1.0/3 THEN 1 WHEN cumulative / total <= 2.0/3 THEN 2 ELSE 3 END AS zone FROM r")
def w12(v):
    return W.bradford(v.authorship, "author")


@R.add("w13_lotka", "authorship", "WITH n AS (SELECT papers, count(*) AS authors FROM (SELECT count(*) AS papers FROM authorship GROUP BY author) GROUP BY 1) SELECT round(regr_slope(log10(authors), log10(papers)), 6) AS slope, count(*) AS points FROM n")
def w13(v):
    return rounded(W.lotka(v.authorship, "author"))


@R.add("w14_zipf", "", r"WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), r AS (SELECT term, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, term) AS rank FROM t GROUP BY 1) SELECT round(regr_slope(log10(n), log10(rank)), 6) AS slope, count(*) AS terms FROM r")
def w14(v):
    t = v.table("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    return rounded(W.zipf(t, "term"))


@R.add("w15_growth_fit", "papers", "WITH c AS (SELECT year, sum(count(*)) OVER (ORDER BY year) AS c FROM papers GROUP BY year) SELECT round(regr_slope(ln(c), year), 6) AS rate, round(regr_intercept(ln(c), year), 4) AS intercept, round(ln(2) / regr_slope(ln(c), year), 6) AS doubling FROM c")
def w15(v):
    return rounded(W.exponential_growth(v.papers, "year").withColumn("intercept", F.round("intercept", 4)))


SUBJECT = "WITH s AS (SELECT abs(date_diff('day', o_orderdate, l_shipdate)) + 1 AS time, (l_returnflag = 'R')::INT AS event, l_linestatus AS arm FROM lineitem JOIN orders ON l_orderkey = o_orderkey) "


def subjects(v):
    x = v.table("lineitem").join(v.table("orders"), C("l_orderkey") == C("o_orderkey"))
    return x.select((F.abs(F.datediff("l_shipdate", "o_orderdate")) + 1).alias("time"), (C("l_returnflag") == "R").cast("int").alias("event"), C("l_linestatus").alias("arm"))


@R.add("w16_kaplan_meier", "", SUBJECT + ", t AS (SELECT arm, time, sum(event) AS d, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY arm ORDER BY time DESC) AS at_risk FROM t), e AS (SELECT * FROM r WHERE d > 0 AND d < at_risk), k AS (SELECT arm, time, at_risk, d, exp(sum(ln(1 - d / at_risk)) OVER w) AS s, sum(d / (at_risk * (at_risk - d))) OVER w AS var FROM e WINDOW w AS (PARTITION BY arm ORDER BY time)) SELECT arm, time, at_risk::BIGINT AS at_risk, d::BIGINT AS events, round(s, 6) AS survival, round(s * exp(-1.96 * sqrt(var)), 6) AS lower, round(least(1, s * exp(1.96 * sqrt(var))), 6) AS upper FROM k")
def w16(v):
    return rounded(W.kaplan_meier(subjects(v), ["arm"]).filter("survival > 0"))


@R.add("w16_log_rank", "", SUBJECT + ", t AS (SELECT time, sum(event) AS d, count(*) AS n, sum(event) FILTER (arm = 'F') AS d1, count(*) FILTER (arm = 'F') AS n1 FROM s GROUP BY 1), r AS (SELECT d, coalesce(d1, 0) AS d1, sum(n) OVER w AS r, sum(n1) OVER w AS r1 FROM t WINDOW w AS (ORDER BY time DESC)), g AS (SELECT sum(d1 - d * r1 / r) AS oe, sum(CASE WHEN r > 1 THEN d * r1 / r * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS v FROM r WHERE d > 0) SELECT round(oe, 5) AS oe, round(v, 5) AS v, round(oe * oe / v, 5) AS chi2 FROM g")
def w16l(v):
    return rounded(W.log_rank(subjects(v), "arm", "F"), 5)


@R.add("w17_percentile", "papers", "SELECT paper_id, journal, citations_count, round(cume_dist() OVER (PARTITION BY journal ORDER BY citations_count) * 100, 6) AS percentile FROM papers")
def w17(v):
    return rounded(W.percentile_of(v.papers.select("paper_id", "journal", "citations_count"), ["journal"], "citations_count"))


@R.add("w18_quartiles", "authorship papers", "WITH m AS (SELECT year, author, count(*) AS n FROM authorship JOIN papers USING (paper_id) GROUP BY ALL) SELECT year, author, n, row_number() OVER w::INT AS position, ceil(4 * row_number() OVER w / count(*) OVER (PARTITION BY year))::INT AS quartile FROM m WINDOW w AS (PARTITION BY year ORDER BY n DESC, author)")
def w18(v):
    m = v.authorship.join(v.papers, "paper_id").groupBy("year", "author").agg(F.count(F.lit(1)).alias("n"))
    return W.quartiles(m, ["year"], "n", "author")


@R.add("w19_timeline", "papers", "SELECT paper_id, journal, year, row_number() OVER w::INT AS pos, lag(year) OVER w AS previous_year FROM papers WINDOW w AS (PARTITION BY journal ORDER BY year NULLS LAST, paper_id)")
def w19(v):
    return W.timeline(v.papers.select("paper_id", "journal", "year"), ["journal"], "paper_id")


@R.add("k3_top_nodes", "coauthors", "SELECT author, sum(weight)::BIGINT AS value FROM (SELECT a AS author, weight FROM coauthors UNION ALL SELECT b, weight FROM coauthors) GROUP BY 1 ORDER BY value DESC, author LIMIT 10")
def k3(v):
    w = v.coauthors
    return w.select(C("a").alias("author"), "weight").union(w.select("b", "weight")).groupBy("author").agg(F.sum("weight").alias("value")).orderBy(F.desc("value"), "author").limit(10)


@R.add("k4_trending", "papers", "SELECT paper_id, year, round(citations_count / greatest(t - year + 1, 1), 6) AS velocity FROM papers, (SELECT max(year) AS t FROM papers) WHERE year >= t - 730 / 365.0 ORDER BY citations_count / greatest(t - year + 1, 1) DESC, paper_id LIMIT 30")
def k4(v):
    return rounded(W.trending(v.papers, 30, 730))


@R.add("k7_top_per_group", "papers", "SELECT * FROM (SELECT paper_id, journal, citations_count, row_number() OVER (PARTITION BY journal ORDER BY citations_count DESC, paper_id)::INT AS rank FROM papers) WHERE rank <= 5")
def k7(v):
    return W.top_per_group(v.papers.select("paper_id", "journal", "citations_count"), "journal", "citations_count", "paper_id", 5)


DATED = "WITH x AS (SELECT q.journal, p.year AS cy, q.year AS dy FROM cites JOIN papers p ON src = p.paper_id JOIN papers q ON dst = q.paper_id) "
for _n, _lo, _hi, _kw in (("m1_impact_factor", 1, 2, {"back": 2}), ("m1_five_year_impact_factor", 1, 5, {"back": 5}), ("m2_immediacy_index", 0, 0, {"immediate": True})):
    R.add(_n, "cites papers", DATED + f", g AS (SELECT journal, cy AS year, count(*) AS citations FROM x WHERE cy - dy BETWEEN {_lo} AND {_hi} GROUP BY ALL), i AS (SELECT journal, (year + k)::INT AS year, count(*) AS items FROM papers, (SELECT unnest(range({_lo}, {_hi + 1})) AS k) GROUP BY ALL) SELECT journal, year, items, coalesce(citations, 0) AS citations, round(coalesce(citations, 0) / items, 6) AS value FROM i LEFT JOIN g USING (journal, year)")(lambda v, kw=_kw: rounded(W.impact_factors(v.cites, v.papers, **kw)))


@R.add("m3_cite_score", "cites papers", DATED + ", y AS (SELECT unnest(range(1990, 2010))::INT AS year), g AS (SELECT journal, year, count(*) AS citations FROM x, y WHERE cy BETWEEN year - 3 AND year AND dy BETWEEN year - 3 AND year GROUP BY ALL), i AS (SELECT journal, y.year, count(*) AS items FROM papers p, y WHERE p.year BETWEEN y.year - 3 AND y.year GROUP BY ALL) SELECT journal, year, items, coalesce(citations, 0) AS citations, round(coalesce(citations, 0) / items, 6) AS value FROM i LEFT JOIN g USING (journal, year)")
def m3(v):
    return rounded(W.cite_scores(v.cites, v.papers))


@R.add("m6_snip", "cites papers", "WITH o AS (SELECT * FROM papers WHERE year BETWEEN 1997 AND 1999), c AS (SELECT DISTINCT o.journal, src, p.citations_count AS c FROM cites JOIN o ON dst = o.paper_id JOIN papers p ON src = p.paper_id WHERE p.year BETWEEN 1997 AND 2000), m AS (SELECT journal, median(c) AS median FROM c GROUP BY 1), a AS (SELECT journal, avg(citations_count) AS mean FROM o GROUP BY 1) SELECT journal, round(mean, 6) AS mean, round(median, 6) AS median, round(mean / median, 6) AS snip FROM a JOIN m USING (journal)")
def m6(v):
    return rounded(W.snip(v.cites, v.papers, 2000))


JH = "WITH r AS (SELECT journal, citations_count AS c, row_number() OVER w AS k, sum(citations_count) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM papers WINDOW w AS (PARTITION BY journal ORDER BY citations_count DESC, paper_id)), a AS (SELECT journal, coalesce(max(k) FILTER (c >= k), 0)::INT AS h_index, coalesce(max(k) FILTER (s >= k * k), 0)::INT AS g_index FROM r GROUP BY 1), f AS (SELECT journal, citations_count AS c, row_number() OVER (PARTITION BY journal ORDER BY citations_count DESC, paper_id) AS k FROM papers WHERE year BETWEEN 1997 AND 2001), h AS (SELECT journal, coalesce(max(k) FILTER (c >= k), 0)::INT AS h5_index FROM f GROUP BY 1), m AS (SELECT journal, floor(median(c) FILTER (k <= h5_index))::INT AS h5_median FROM f JOIN h USING (journal) GROUP BY 1) "


@R.add("m7_journal_h", "papers", JH + "SELECT * FROM a JOIN h USING (journal) JOIN m USING (journal)")
def m7(v):
    return W.journal_h(v.papers, 2001)


@R.add("m8_journal_profile", "papers cites", JH + ", x AS (SELECT q.journal, p.year AS cy, q.year AS dy FROM cites JOIN papers p ON src = p.paper_id JOIN papers q ON dst = q.paper_id), g AS (SELECT journal, count(*) AS n FROM x WHERE cy = 2000 AND cy - dy BETWEEN 1 AND 2 GROUP BY 1), i AS (SELECT journal, count(*) AS items FROM papers WHERE year BETWEEN 1998 AND 1999 GROUP BY 1) SELECT a.*, h5_index, h5_median, round(n / items, 6) AS impact_factor FROM a JOIN h USING (journal) JOIN m USING (journal) JOIN g USING (journal) JOIN i USING (journal)")
def m8(v):
    f = W.impact_factors(v.cites, v.papers, 2).filter("year = 2000").select("journal", C("value").alias("impact_factor"))
    return rounded(W.journal_h(v.papers, 2001).join(f, "journal"))
