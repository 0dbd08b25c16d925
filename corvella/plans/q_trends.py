"""Queries B1-B28 and the retrieval rows of T."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.operators import trends as X
from corvella.plans.q_aggregates import rounded
from corvella.plans.q_indices import author_papers
from corvella.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
C = F.col
SER = "WITH e AS (SELECT entity, min(year) AS a, max(year) AS b FROM paper_year_counts GROUP BY 1), f AS (SELECT d.entity, d.year::INT AS year, coalesce(count, 0) AS count FROM (SELECT entity, unnest(range(a, b + 1)) AS year FROM e) d LEFT JOIN paper_year_counts p ON p.entity = d.entity AND p.year = d.year) "


def series(v):
    return X.fill_years(v.paper_year_counts, "entity")


R.add("b1_two_state_bursts")(lambda v: rounded(X.two_state_bursts(series(v), "entity")))
R.add("b2_multi_level_bursts")(lambda v: rounded(X.multi_level_bursts(series(v), "entity")))
R.add("a12_aggregate_bursts")(lambda v: rounded(X.aggregate_bursts(X.multi_level_bursts(series(v), "entity"), "entity")))


@R.add("b3_corpus_bursts")
def b3(v):
    n = v.papers.groupBy("year").agg(F.count(F.lit(1)).alias("count")).withColumn("entity", F.lit("corpus"))
    return rounded(X.two_state_bursts(X.fill_years(n, "entity", 2002), "entity", s=1.2))


R.add("b4_keyword_bursts")(lambda v: rounded(X.multi_level_bursts(X.fill_years(v.keywords.join(v.papers, "paper_id").groupBy(C("keyword").alias("entity"), "year").agg(F.count(F.lit(1)).alias("count")), "entity"), "entity", s=1.2, threshold=1.2)))


@R.add("b6_yearly_series", "paper_year_counts", SER + "SELECT * FROM f")
def b6(v):
    return series(v)


@R.add("b7_linear_forecast", "paper_year_counts", SER + ", g AS (SELECT entity, coalesce(regr_slope(count, year), 0) AS s, avg(count) AS my, avg(year) AS mx, max(year) AS last, var_pop(count) AS vy, var_pop(year) AS vx FROM f GROUP BY 1), y AS (SELECT entity, (last + k)::INT AS year, my + s * (last + k - mx) AS y, 1.2816 * sqrt(greatest(vy - s * s * vx, 0)) AS w FROM g, (SELECT unnest([1, 2, 3]) AS k)) SELECT entity, year, round(greatest(y, 0), 6) AS forecast, round(greatest(y - w, 0), 6) AS lower, round(greatest(y + w, 0), 6) AS upper FROM y")
def b7(v):
    return rounded(X.linear_forecast(series(v), "entity", 3))


R.add("b8_holt_forecast")(lambda v: rounded(X.holt_forecast(X.fill_years(v.keywords.join(v.papers, "paper_id").groupBy(C("keyword").alias("entity"), "year").agg(F.count(F.lit(1)).alias("count")), "entity"), "entity", 3)))
R.add("b9_arima_forecast")(lambda v: rounded(X.arima_forecast(X.fill_years(v.keywords.join(v.papers, "paper_id").groupBy(C("keyword").alias("entity"), "year").agg(F.count(F.lit(1)).alias("count")), "entity"), "entity", 3)))


@R.add("b10_forecast_quality", "paper_year_counts", SER + ", g AS (SELECT entity, count(*) AS n, sum(year)::BIGINT AS sx, sum(count)::BIGINT AS sy, (count(*) * sum(year * year) - sum(year) * sum(year))::BIGINT AS dx, (count(*) * sum(count * count) - sum(count) * sum(count))::BIGINT AS dy, (count(*) * sum(year * count) - sum(year) * sum(count))::BIGINT AS dxy FROM f GROUP BY 1), r AS (SELECT f.entity, n, dx, dy, dxy, abs(greatest(dx, 1) * (n * count - sy) - dxy * (n * year - sx))::BIGINT AS r FROM f JOIN g ON f.entity = g.entity) SELECT entity, round(sum(r)::DOUBLE / (any_value(n) * any_value(n) * any_value(greatest(dx, 1))), 6) AS mae, round(any_value(CASE WHEN dx > 0 AND dy > 0 THEN dxy::DOUBLE * dxy / (dx::DOUBLE * dy) ELSE 0 END), 6) AS r2 FROM r GROUP BY 1")
def b10(v):
    return rounded(X.forecast_quality(series(v), "entity"))


GROWTHS = SER + ", g AS (SELECT entity, coalesce(regr_slope(count, year), 0) AS s, avg(count) AS my, avg(year) AS mx, max(year) AS last, arg_max(count, year) AS now, sum(count) AS total FROM f GROUP BY 1), y AS (SELECT entity, avg(greatest(my + s * (last + k - mx), 0)) AS mean FROM g, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1), t AS (SELECT entity, round((mean - now) / greatest(now, 1), 9) AS growth FROM (SELECT * FROM g ORDER BY total DESC, entity LIMIT 60) JOIN y USING (entity)) SELECT entity, round(growth, 6) AS growth FROM t "


@R.add("b11_emerging", "paper_year_counts", GROWTHS + "ORDER BY t.growth DESC, entity LIMIT 20")
def b11(v):
    return rounded(X.emerging(series(v), X.linear_forecast(series(v), "entity", 3), "entity", 20))


@R.add("b11_fading", "paper_year_counts", GROWTHS + "ORDER BY t.growth, entity LIMIT 20")
def b11f(v):
    return rounded(X.fading(series(v), X.linear_forecast(series(v), "entity", 3), "entity", 20))


@R.add("b12_novelty", "", "WITH s AS (SELECT x.vec_id AS q, y.vec_id AS k, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS s FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, k) AS r FROM s), n AS (SELECT q AS query_id, least(1, greatest(0, 1 - avg(s))) AS n FROM r WHERE r <= 5 GROUP BY 1) SELECT query_id, round(n, 6) AS novelty, round(cume_dist() OVER (ORDER BY n) * 100, 4) AS percentile FROM n")
def b12(v):
    e = v.table("embeddings")
    n = X.novelty(X.nearest(e, e, 5))
    return n.select("query_id", F.round("novelty", 6).alias("novelty"), F.round("percentile", 4).alias("percentile"))


DIS = "WITH c AS (SELECT dst AS f, src AS c FROM cites), r AS (SELECT src AS f, dst AS r FROM cites), s AS (SELECT c.f, c.c, r.r FROM c JOIN cites e ON e.src = c.c JOIN r ON r.f = c.f AND r.r = e.dst), g AS (SELECT f, count(DISTINCT c) AS i, count(DISTINCT r) AS k FROM s GROUP BY 1), n AS (SELECT coalesce(x.f, y.f) AS f, x.n AS citers, y.n AS refs FROM (SELECT f, count(*) AS n FROM c GROUP BY 1) x FULL JOIN (SELECT f, count(*) AS n FROM r GROUP BY 1) y ON x.f = y.f) "


@R.add("b13_disruption", "cites", DIS + "SELECT n.f AS focal, CASE WHEN citers IS NOT NULL AND refs IS NOT NULL THEN round((citers - coalesce(i, 0) - coalesce(i, 0)) / (citers + coalesce(k, 0)), 6) END AS disruption, CASE WHEN refs IS NULL THEN 'no references' WHEN citers IS NULL THEN 'no citers' END AS reason FROM n LEFT JOIN g ON n.f = g.f")
def b13(v):
    return rounded(X.disruption(v.cites))


@R.add("b14_atypicality", "keywords", "WITH n AS (SELECT count(DISTINCT paper_id) AS n FROM keywords), d AS (SELECT keyword, count(*) AS c FROM keywords GROUP BY 1), p AS (SELECT x.keyword AS a, y.keyword AS b, count(*) AS w FROM keywords x JOIN keywords y ON x.paper_id = y.paper_id AND x.keyword < y.keyword GROUP BY ALL), z AS (SELECT a, b, (w - da.c * db.c / n) / sqrt(greatest(da.c * db.c / n, 0.5)) AS z FROM p JOIN d da ON da.keyword = a JOIN d db ON db.keyword = b, n), m AS (SELECT x.paper_id, avg(z) AS z FROM keywords x JOIN keywords y ON x.paper_id = y.paper_id AND x.keyword < y.keyword JOIN z ON a = x.keyword AND b = y.keyword GROUP BY 1) SELECT k.paper_id, round(CASE WHEN z IS NULL THEN 0.5 ELSE 0.5 * (1 + (exp(-z) - 1) / (exp(-z) + 1)) END, 6)::DOUBLE AS atypicality FROM (SELECT DISTINCT paper_id FROM keywords) k LEFT JOIN m USING (paper_id)")
def b14(v):
    return rounded(X.atypicality(v.keywords, "paper_id", "keyword"))


@R.add("b15_topic_scores", "cites fields", DIS + "SELECT field, round(avg((citers - 2 * coalesce(i, 0)) / (citers + coalesce(k, 0))), 6) AS disruption, count(*) AS papers FROM n LEFT JOIN g ON n.f = g.f JOIN fields ON n.f = paper_id WHERE citers IS NOT NULL AND refs IS NOT NULL GROUP BY 1")
def b15(v):
    d = X.disruption(v.cites).filter("disruption IS NOT NULL")
    return rounded(d.join(v.fields.withColumnRenamed("paper_id", "focal"), "focal").groupBy("field").agg(F.avg("disruption").alias("disruption"), F.count(F.lit(1)).alias("papers")))


@R.add("b18_velocity", "paper_year_counts", SER + ", l AS (SELECT entity, count - 2 * lag(count) OVER w + lag(count, 2) OVER w AS d FROM f WINDOW w AS (PARTITION BY entity ORDER BY year)) SELECT entity, round(avg(d), 6) AS acceleration FROM l WHERE d IS NOT NULL GROUP BY 1")
def b18(v):
    return rounded(X.velocity(series(v), "entity"))


USERS = "WITH h AS (SELECT DISTINCT user_id, event_id % (SELECT count(*) FROM embeddings) AS vec_id FROM events WHERE event_type = 'purchase')"


def history(v):
    n = v.table("embeddings").agg(F.count(F.lit(1)).alias("n"))
    return v.table("events").filter("event_type = 'purchase'").join(F.broadcast(n)).select("user_id", (C("event_id") % C("n")).alias("vec_id")).distinct()  # one row


# a small negative mean rounds to -0.0, as in SQL
R.add("b20_user_profiles")(lambda v: X.user_profile(history(v), v.table("embeddings")).select("user_id", F.transform("embedding", lambda x: F.signum(x) * F.round(F.abs(x), 6)).alias("embedding")))
PROFILES = USERS + ", x AS (SELECT user_id, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM h JOIN embeddings USING (vec_id)), m AS (SELECT user_id, i, avg(x) AS x FROM x GROUP BY ALL), p AS (SELECT user_id, list(x ORDER BY i) AS e FROM m GROUP BY 1) "

R.ORACLES["b20_user_profiles"] = PROFILES + "SELECT user_id, list_transform(e, lambda x: round(x, 6)) AS embedding FROM p"


@R.add("b20_for_users", "", PROFILES + ", s AS (SELECT user_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 9) AS score FROM p, embeddings WHERE (user_id, vec_id) NOT IN (SELECT (user_id, vec_id) FROM h)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT user_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5")
def b20u(v):
    """Five new items for every user."""
    return X.recommend_for_users(history(v), v.table("embeddings"), 5).select("user_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@R.add("b20_for_topic", "", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q.e), 9) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 40), b AS (SELECT vec_id, round(score + CASE WHEN label = 3 THEN .1 ELSE 0 END, 9) AS score FROM s) SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY b.score DESC, vec_id)::INT AS rank FROM b QUALIFY rank <= 20")
def b20t(v):
    e = v.table("embeddings")
    q = e.join(F.broadcast(e.agg(F.min("vec_id").alias("m"))), C("vec_id") == C("m")).select("vec_id", "embedding")  # one row
    items = e.select("vec_id", F.array(C("label").cast("string")).alias("keywords"))
    return X.recommend_for_topic(items, e, q, "3", 20).select("vec_id", F.round("score", 6).alias("score"), "rank")


@R.add("t9_candidate_recall", "", "SELECT count(*) AS queries, true AS enough FROM embeddings")
def t9r(v):
    """Recall at 5 of the search among candidates, for every vector, against the exact search."""
    from corvella.operators import similarity

    e = v.table("embeddings")
    r = similarity.recall(similarity.nearest(e, e, 5), X.nearest(e, e, 5))
    return r.select("queries", (C("recall") >= 0.9).alias("enough"))


@R.add("b20_similar_items", "", "WITH s AS (SELECT x.vec_id AS query_id, y.vec_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS score FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 3")
def b20(v):
    e = v.table("embeddings")
    return X.nearest(e, e, 3).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@R.add("b21_bridge", "", "WITH a AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), b AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings)), s AS (SELECT vec_id, greatest(list_cosine_similarity(embedding::DOUBLE[], a.e), 1e-6) AS x, greatest(list_cosine_similarity(embedding::DOUBLE[], b.e), 1e-6) AS y FROM embeddings, a, b) SELECT vec_id, round(round(2 * x * y / (x + y), 9), 6) AS score FROM s ORDER BY round(2 * x * y / (x + y), 9) DESC, vec_id LIMIT 15")
def b21(v):
    e = v.table("embeddings")
    pick = lambda f: e.join(F.broadcast(e.agg(f("vec_id").alias("m"))), C("vec_id") == C("m"))  # noqa: E731  one row
    return rounded(X.bridge(e, pick(F.min), pick(F.max), 15))


@R.add("b22_ndcg", "", "WITH s AS (SELECT x.vec_id AS q, y.label = x.label AS same, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS s, y.vec_id AS k FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, k) AS rank FROM s), f AS (SELECT q, min(rank) FILTER (same AND rank <= 10) AS first FROM r GROUP BY 1 HAVING bool_or(same)) SELECT round(avg(coalesce(1 / log2(first + 1), 0)), 6) AS ndcg, round(avg((first IS NOT NULL)::INT), 6) AS hit_rate FROM f")
def b22(v):
    e = v.table("embeddings")
    same = e.select(C("vec_id").alias("query_id"), "label").join(e.select("vec_id", C("label").alias("l2")), C("label") == C("l2")).filter("query_id <> vec_id").select("query_id", "vec_id")
    return rounded(X.ndcg(X.nearest(e, e, 10), same, 10))


@R.add("b23_collaborators", "coauthors keywords", "WITH ak AS (SELECT author, keyword, count(*) AS c FROM authorship JOIN keywords USING (paper_id) GROUP BY ALL), z AS (SELECT author, count(*) AS k, sqrt(sum(c * c)) AS n FROM ak GROUP BY 1), b AS (SELECT x.author, sum(x.c * y.c) AS dot, count(*) AS shared FROM ak x JOIN ak y ON x.keyword = y.keyword AND y.author = 7 GROUP BY 1), w AS (SELECT a, b, weight FROM coauthors UNION ALL SELECT b, a, weight FROM coauthors), d AS (SELECT b AS author, weight AS joint FROM w WHERE a = 7), v AS (SELECT w.b AS author, count(*) AS common FROM w JOIN d ON w.a = d.author GROUP BY 1), p AS (SELECT author, count(*) AS papers FROM authorship GROUP BY 1), x AS (SELECT z.author, coalesce(dot, 0) / (z.n * (SELECT n FROM z WHERE author = 7)) AS cos, coalesce(shared, 0) / (z.k + (SELECT k FROM z WHERE author = 7) - coalesce(shared, 0)) AS jac, coalesce(common, 0) AS common, coalesce(joint, 0) AS joint, papers FROM z LEFT JOIN b USING (author) LEFT JOIN v USING (author) LEFT JOIN d USING (author) JOIN p USING (author) WHERE z.author <> 7), s AS (SELECT author, .4 * (.5 * cos + CASE WHEN cos > 0 THEN .5 * (1 - jac) ELSE 0 END) + CASE WHEN common > 0 THEN .25 / (1 + common) ELSE 0 END + .15 * least(1, joint / 5) + .2 * papers / (SELECT max(papers) FROM p) AS score FROM x) SELECT author, round(score, 6) AS score FROM s ORDER BY s.score DESC, author LIMIT 10")
def b23(v):
    """Nearly all authors have written together here, so those who have stay in."""
    return rounded(X.recommend_collaborators(v.authorship, v.keywords, v.coauthors, 7, 10, exclude_existing=False))


@R.add("b24_institutions", "authorship papers", "WITH m AS (SELECT s_nationkey AS institution, citations_count AS c FROM authorship JOIN papers USING (paper_id) JOIN supplier ON author = s_suppkey) SELECT institution, round(.5 * least(1, sum(c) / 50) + .5 * least(1, avg(c) / 10), 6) AS score FROM m GROUP BY 1")
def b24(v):
    a = author_papers(v).join(v.table("supplier").select(C("s_suppkey").alias("author"), C("s_nationkey").alias("institution")), "author")
    return rounded(X.recommend_institutions(a))


@R.add("b24_bridge_authors", "authorship fields", "WITH m AS (SELECT author, paper_id, substr(field, 1, 5) AS f FROM authorship JOIN fields USING (paper_id)), g AS (SELECT author, count(DISTINCT paper_id) FILTER (f = 'STAND') / count(DISTINCT paper_id) AS a, count(DISTINCT paper_id) FILTER (f = 'PROMO') / count(DISTINCT paper_id) AS b FROM m GROUP BY 1) SELECT author, round(a, 6) AS a, round(b, 6) AS b, round(2 * a * b / (a + b), 6) AS affinity FROM g WHERE a > 0 AND b > 0 ORDER BY 2 * a * b / (a + b) DESC, author LIMIT 25")
def b24b(v):
    m = v.authorship.join(v.fields, "paper_id").select("author", "paper_id", F.substring("field", 1, 5).alias("field"))
    return rounded(X.bridge_authors(m, "STAND", "PROMO", 25))


@R.add("b24_strength", "coauthors keywords papers", "WITH k AS (SELECT author, keyword, count(*) AS c FROM authorship JOIN keywords USING (paper_id) GROUP BY ALL), z AS (SELECT author, count(*) AS k, sqrt(sum(c * c)) AS n FROM k GROUP BY 1), y AS (SELECT x.author AS a, y.author AS b, max(year) AS last_year FROM authorship x JOIN authorship y ON x.paper_id = y.paper_id AND x.author < y.author JOIN papers ON papers.paper_id = x.paper_id GROUP BY ALL), d AS (SELECT y.a, y.b, sum(p.c * q.c) AS dot, count(*) AS shared FROM y JOIN k p ON p.author = a JOIN k q ON q.author = b AND q.keyword = p.keyword GROUP BY ALL) SELECT y.a, y.b, round(.4 * coalesce(shared, 0) / (p.k + q.k - coalesce(shared, 0)) + .3 * coalesce(dot, 0) / (p.n * q.n) + .3 * exp(-(1999 - last_year) / 5), 6) AS strength FROM y LEFT JOIN d ON d.a = y.a AND d.b = y.b JOIN z p ON p.author = y.a JOIN z q ON q.author = y.b")
def b24s(v):
    from corvella.plans.q_networks import temporal

    k = v.authorship.join(v.keywords, "paper_id").groupBy("author", "keyword").agg(F.count(F.lit(1)).alias("c"))
    return rounded(X.collaboration_strength(temporal(v).select("a", "b", "last_year"), k, 1999))


@R.add("b25_research_gaps", "keywords", "WITH n AS (SELECT count(DISTINCT paper_id) AS n FROM keywords), d AS (SELECT keyword, count(*) AS c FROM keywords GROUP BY 1), p AS (SELECT x.keyword AS a, y.keyword AS b, count(*) AS w FROM keywords x JOIN keywords y ON x.paper_id = y.paper_id AND x.keyword < y.keyword GROUP BY ALL), e AS (SELECT a, b, w, da.c * db.c / n AS e FROM p JOIN d da ON da.keyword = a JOIN d db ON db.keyword = b, n) SELECT a, b, round((e - w) / e * (1 + ln(1 + e)), 6) AS score FROM e WHERE w < e ORDER BY (e - w) / e * (1 + ln(1 + e)) DESC, a, b LIMIT 40")
def b25(v):
    return rounded(X.research_gaps(v.keywords, "paper_id", "keyword", 40))


@R.add("b26_gap_sentences", "", r"WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) AS s FROM documents) SELECT doc_id, count(*) AS sentences FROM s WHERE trim(s) <> '' AND regexp_matches(lower(s), 'is of the|und der') GROUP BY 1")
def b26(v):
    return X.gap_sentences(v.table("documents"), ["is of the", "und der"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))


@R.add("b27_sub_area_gaps", "", "WITH k AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS i FROM lineitem), n AS (SELECT count(DISTINCT g) AS n FROM k), d AS (SELECT i, count(*) AS c FROM k GROUP BY 1 ORDER BY c DESC, i LIMIT 30), p AS (SELECT x.i AS a, y.i AS b, x.c AS ca, y.c AS cb FROM d x JOIN d y ON x.i < y.i), s AS (SELECT x.i AS a, y.i AS b, count(*) AS w FROM k x JOIN k y ON x.g = y.g AND x.i < y.i WHERE x.i IN (SELECT i FROM d) AND y.i IN (SELECT i FROM d) GROUP BY ALL) SELECT a, b, coalesce(w, 0) AS observed, round(ca * cb / n, 6) AS expected FROM p LEFT JOIN s USING (a, b), n WHERE coalesce(w, 0) <= .5 * ca * cb / n")
def b27(v):
    return rounded(X.sub_area_gaps(v.table("lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey"))


R.add("b27_directions_from_gaps")(lambda v: rounded(X.directions_from_gaps(X.sub_area_gaps(v.table("lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey"))))
R.ORACLES["b27_directions_from_gaps"] = "SELECT a, b, round(greatest(0, 1 - observed / greatest(expected, 1e-9)), 6) AS novelty, round(expected / (expected + 1), 6) AS feasibility, round(6 + 18 * greatest(0, 1 - observed / greatest(expected, 1e-9)), 6) AS months, round(.5 * greatest(0, 1 - observed / greatest(expected, 1e-9)) + .5 * expected / (expected + 1), 6) AS score FROM (" + R.ORACLES["b27_sub_area_gaps"].replace("round(ca * cb / n, 6)", "ca * cb / n") + ")"


@R.add("b27_directions_from_trends", "paper_year_counts", GROWTHS.replace("SELECT entity, round(growth, 6) AS growth FROM t ", ", q AS (SELECT * FROM t ORDER BY growth DESC, entity LIMIT 20), z AS (SELECT entity, least(1, greatest(0, growth)) AS g FROM q) SELECT entity, round(g, 6) AS novelty, round(.5 + .5 * g, 6) AS feasibility, round(6 + 18 * g, 6) AS months, round(.5 * g + .5 * (.5 + .5 * g), 6) AS score FROM z"))
def b27t(v):
    return rounded(X.directions_from_trends(series(v), X.linear_forecast(series(v), "entity", 3), "entity", 20))


@R.add("b28_composite_score", "", "SELECT l_orderkey, l_linenumber, round(exp((ln(greatest(l_discount, 1e-6)) + ln(greatest(l_tax, 1e-6)) + ln(l_quantity / 50)) / 3), 6) AS score FROM lineitem")
def b28(v):
    return rounded(v.table("lineitem").select("l_orderkey", "l_linenumber", X.composite_score(C("l_discount"), C("l_tax"), C("l_quantity") / 50).alias("score")))


@R.add("t9_vector_search", "", "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(round(list_cosine_similarity(embedding::DOUBLE[], q.e), 9), 6) AS score FROM embeddings, q WHERE label % 2 = 0 ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q.e), 9) DESC, vec_id LIMIT 25")
def t9(v):
    e = v.table("embeddings")
    q = e.join(F.broadcast(e.agg(F.min("vec_id").alias("m"))), C("vec_id") == C("m"))  # one row
    return rounded(X.nearest(e.filter("label % 2 = 0"), q, 25, keep_self=True).select("vec_id", "score"))


@R.add("t11_mmr")
def t11(v):
    e = v.table("embeddings")
    n = X.nearest(e, e, 20).join(e.select("vec_id", "embedding"), "vec_id")
    return X.mmr(n.select("query_id", "vec_id", "score", "embedding"), 0.7, 5)


@R.add("t12_confidence", "", "WITH s AS (SELECT x.vec_id AS query_id, y.vec_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS score FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, round(least(1, avg(least(1, greatest(0, score))) + least(.2, .05 * count(*))), 6) AS confidence FROM r WHERE rank <= 3 GROUP BY 1")
def t12(v):
    e = v.table("embeddings")
    return rounded(X.confidence(X.nearest(e, e, 3)))


R.add("t13_summaries")(lambda v: X.extractive_summary(v.table("documents"), 100))
R.add("t13_sentence_scores")(lambda v: rounded(X.sentence_scores(v.table("documents"))))


@R.add("t15_top_terms", "", r"WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term)::INT AS rank FROM t GROUP BY lang, term) SELECT * FROM c WHERE rank <= 10")
def t15(v):
    t = v.table("documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term"))
    return X.top_terms(t, "lang", "term", 10)
