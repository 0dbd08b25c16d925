"""Queries W1-W9: indices per author."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.operators import indices
from corvella.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
NOW = 2002
VIEWS = "papers authorship"
BASE = """WITH n AS (SELECT paper_id, count(*) AS n_authors FROM authorship GROUP BY 1),
b AS (SELECT author, paper_id, citations_count AS c, year, n_authors, greatest({now} - year + 1, 1) AS age FROM authorship JOIN papers USING (paper_id) JOIN n USING (paper_id)),
r AS (SELECT *, row_number() OVER w AS rank, sum(c) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM b WINDOW w AS (PARTITION BY author ORDER BY c DESC, paper_id)),
h AS (SELECT author, coalesce(max(rank) FILTER (c >= rank), 0) AS h FROM r GROUP BY 1) """.replace("{now}", str(NOW))


def author_papers(v):
    n = v.authorship.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_authors"))
    return v.authorship.join(v.papers, "paper_id").join(n, "paper_id").select("author", "paper_id", F.col("citations_count").alias("citations"), "year", "n_authors")


@R.add("w1_h_index", VIEWS, BASE + "SELECT author, coalesce(max(rank) FILTER (c >= rank), 0)::INT AS h_index, coalesce(max(rank) FILTER (run >= rank * rank), 0)::INT AS g_index, count(*) FILTER (c >= 10) AS i10_index FROM r GROUP BY 1")
def w1(v):
    return indices.h_index(author_papers(v), ["author"], tie=("paper_id",))


@R.add("w2_h_core", VIEWS, BASE + "SELECT author, paper_id, rank::INT AS rank, c AS citations FROM r JOIN h USING (author) WHERE rank <= h")
def w2(v):
    return indices.h_core(author_papers(v), ["author"], ("paper_id",)).select("author", "paper_id", "rank", F.col("value").alias("citations"))


@R.add("w2_e_index", VIEWS, BASE + "SELECT author, round(sqrt(coalesce(sum(c - h) FILTER (rank <= h), 0)), 6) AS e_index, max(h)::INT AS h_core_size FROM r JOIN h USING (author) GROUP BY 1")
def w2e(v):
    return indices.e_index(author_papers(v), ["author"], ("paper_id",)).withColumn("e_index", F.round("e_index", 6))


@R.add("w3_contemporary_h", VIEWS, BASE + ", k AS (SELECT author, c / pow(age, 0.5) AS s, row_number() OVER (PARTITION BY author ORDER BY c / pow(age, 0.5) DESC, paper_id) AS k FROM b) SELECT author, coalesce(max(k) FILTER (s >= k), 0)::INT AS contemporary_h FROM k GROUP BY 1")
def w3(v):
    return indices.contemporary_h(author_papers(v), ["author"], NOW, tie=("paper_id",))


@R.add("w4_age_weighted_rate", VIEWS, BASE + "SELECT author, round(avg(c / age), 6) AS awcr_mean, round(sum(c / age), 6) AS awcr_sum FROM b GROUP BY 1")
def w4(v):
    return indices.age_weighted_rates(author_papers(v), ["author"], NOW).select("author", F.round("awcr_mean", 6).alias("awcr_mean"), F.round("awcr_sum", 6).alias("awcr_sum"))


@R.add("w5_multi_authored_h", VIEWS, BASE + ", k AS (SELECT author, row_number() OVER w AS k, sum(c / n_authors) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM b WINDOW w AS (PARTITION BY author ORDER BY c / n_authors DESC, paper_id)) SELECT author, coalesce(max(k) FILTER (s >= k), 0)::INT AS multi_authored_h FROM k GROUP BY 1")
def w5(v):
    return indices.multi_authored_h(author_papers(v), ["author"], tie=("paper_id",))


@R.add("w6_individual_h", VIEWS, BASE + "SELECT author, round(CASE WHEN coalesce(sum(n_authors) FILTER (rank <= h), 0) > 0 THEN max(h) * max(h) / sum(n_authors) FILTER (rank <= h) ELSE max(h) END, 6) AS individual_h FROM r JOIN h USING (author) GROUP BY 1")
def w6(v):
    return indices.individual_h(author_papers(v), ["author"], ("paper_id",)).select("author", F.round("individual_h", 6).alias("individual_h"))


@R.add("w7_ar_index", VIEWS, BASE + "SELECT author, round(sqrt(coalesce(sum(c / pow(age, 0.5)) FILTER (rank <= h), 0)), 6) AS ar_index FROM r JOIN h USING (author) GROUP BY 1")
def w7(v):
    return indices.ar_index(author_papers(v), ["author"], NOW, 0.5, ("paper_id",)).select("author", F.round("ar_index", 6).alias("ar_index"))


ALL = BASE + """SELECT author, max(h)::INT AS h_index, coalesce(max(rank) FILTER (run >= rank * rank), 0)::INT AS g_index, count(*) FILTER (c >= 10) AS i10_index,
 round(sqrt(coalesce(sum(c - h) FILTER (rank <= h), 0)), 6) AS e_index, count(*) FILTER (c >= 2 * h) AS q2_index, max(c) AS w_index, round(sqrt(sum(c)), 6) AS h_max_index,
 round(max(h) / greatest(2002 - min(year) + 1, 1), 6) AS normalized_h, sum(c)::BIGINT AS total_citations, count(*) AS papers, min(year) AS first_year, max(year) AS last_year
 FROM r JOIN h USING (author) GROUP BY 1"""


@R.add("w9_compute_all", VIEWS, ALL)
def w9(v):
    d = indices.compute_all(author_papers(v), ["author"], NOW, ("paper_id",))
    return d.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


W8 = BASE + "SELECT author, round(max(h) / greatest(2002 - min(year) + 1, 1), 6) AS normalized_h, count(*) FILTER (c >= 2 * h) AS q2_index, max(c) AS w_index, round(sqrt(sum(c)), 6) AS h_max_index FROM r JOIN h USING (author) GROUP BY 1"


@R.add("w8_other_indices", VIEWS, W8)
def w8(v):
    return w9(v).select("author", "normalized_h", "q2_index", "w_index", "h_max_index")
