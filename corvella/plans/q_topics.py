"""Queries of T1-T18, K5, and of fronts and frontiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.operators import graph as G
from corvella.operators import frontiers as FR
from corvella.operators import themes as TH
from corvella.operators import topics as T
from corvella.operators import trends as X
from corvella.plans.q_aggregates import rounded
from corvella.plans.q_graph import coauthors
from corvella.plans.registry import Registry
from corvella.plans.storage import materialise

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
C = F.col


def tokens(v):
    return v.table("documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("tokens"))


def doc_years(v):
    return v.table("documents").select("doc_id", (1990 + C("doc_id") % 10).cast("int").alias("year"))


R.add("t1_lda_topics")(lambda v: rounded(T.lda(tokens(v), 5)[1], 4))
R.add("t2_nmf_topics")(lambda v: rounded(T.nmf(tokens(v), 5)[1], 4))
R.add("t3_coherence")(lambda v: rounded(T.coherence(T.lda(tokens(v), 5)[1], tokens(v)), 4))
R.add("t4_topic_years")(lambda v: rounded(T.topic_years(T.lda(tokens(v), 5)[0], doc_years(v), 2), 4))
R.add("t4_trending_topics")(lambda v: rounded(T.trending_topics(T.topic_years(T.lda(tokens(v), 5)[0], doc_years(v), 1), 1999), 4))
R.add("t5_clusters")(lambda v: T.clusters(T.tf_idf(tokens(v)), 4).select("doc_id", "cluster"))
R.add("t6_top_down_clusters")(lambda v: T.clusters(T.vector_features(v.table("embeddings")), 4, top_down=True).select("vec_id", "cluster"))
R.add("t7_dbscan")(lambda v: T.dbscan(v.table("embeddings"), eps=1.2, least=5))
R.add("t8_silhouettes")(lambda v: rounded(T.silhouettes(T.vector_features(v.table("embeddings")), [2, 4, 6]), 4))
R.add("t8_optimal_k")(lambda v: T.optimal_k(T.silhouettes(T.vector_features(v.table("embeddings")), [2, 3, 4, 5, 6])))


@R.add("t7_eps_pairs", "", "SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) <= 1.2")
def t7p(v):
    return T.within(v.table("embeddings"), 1.2)


R.add("t14_themes")(lambda v: TH.themes(v.table("documents").select(C("doc_id").alias("id"), "text")))
R.add("t16_study_themes")(lambda v: TH.study_themes(v.table("documents").select(C("doc_id").alias("study_id"), "text", "source"), ["text", "source"]))


@R.add("t18_key_quotes", "", r"WITH s AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x) <> '')) AS sentence, generate_subscripts(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x) <> ''), 1) - 1 AS pos FROM documents), c AS (SELECT doc_id, pos, w, count(*) AS c FROM (SELECT doc_id, pos, unnest(regexp_extract_all(lower(sentence), '[a-z]{3,}')) AS w FROM s) GROUP BY ALL), n AS (SELECT doc_id, pos, sqrt(sum(c * c)) AS norm FROM c GROUP BY ALL), x AS (SELECT doc_id, pos, w, c / norm AS x FROM c JOIN n USING (doc_id, pos)), m AS (SELECT doc_id, w, sum(x) AS total FROM x GROUP BY ALL), z AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1), sc AS (SELECT x.doc_id, pos, round(sum(x * total) / any_value(k), 9) AS score FROM x JOIN m ON m.doc_id = x.doc_id AND m.w = x.w JOIN z ON z.doc_id = x.doc_id GROUP BY ALL), f AS (SELECT doc_id, min(pos) AS pos FROM s GROUP BY doc_id, lower(substr(sentence, 1, 80))), r AS (SELECT sc.doc_id, sc.pos, score, row_number() OVER (PARTITION BY sc.doc_id ORDER BY score DESC, sc.pos) AS rank FROM sc JOIN f ON f.doc_id = sc.doc_id AND f.pos = sc.pos), t AS (SELECT * FROM r WHERE rank <= 3) SELECT doc_id, rank::INT AS rank, pos::INT AS pos, round(score / max(score) OVER (PARTITION BY doc_id), 6) AS relevance FROM t")
def t18(v):
    return rounded(TH.key_quotes(v.table("documents")))


@R.add("t10_chunk_table", "", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents), s AS (SELECT doc_id, words, unnest(range(0, (ceil(greatest(len(words) - 512, 0) / 448.0) * 448)::BIGINT + 1, 448)) AS i FROM w WHERE len(words) > 0) SELECT doc_id || '#' || (i / 448)::INT AS chunk_id, doc_id, (i / 448)::INT AS pos, array_to_string(words[i + 1 : i + 512], ' ') AS chunk FROM s")
def t10(v):
    new = T.chunk_table(v.table("documents"))
    return T.replace_chunks(T.chunk_table(v.table("documents"), 64, 8), new)


@R.add("t17_framework_fit", "", "WITH f AS (SELECT r_name AS framework, unnest(list_distinct(regexp_extract_all(lower(r_name), '[a-z]+'))) AS t FROM region), s AS (SELECT n_nationkey AS study_id, unnest(list_distinct(regexp_extract_all(lower(n_name || ' ' || r_name), '[a-z]+'))) AS t FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT DISTINCT study_id, framework FROM s JOIN f USING (t)")
def t17(v):
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)).alias("tokens")
    n = v.table("nation").join(v.table("region"), C("n_regionkey") == C("r_regionkey"))
    return T.framework_fit(n.select(C("n_nationkey").alias("study_id"), words(F.concat_ws(" ", "n_name", "r_name"))), v.table("region").select(C("r_name").alias("framework"), words(C("r_name"))))


@R.add("k5_landmarks")
def k5(v):
    e = materialise(coauthors(v), "author-pairs")
    papers = v.authorship.join(v.papers, "paper_id").groupBy("author", "year").agg(F.count(F.lit(1)).alias("count"))
    bursts = X.multi_level_bursts(X.fill_years(papers, "author"), "author", s=1.2, threshold=1.2).groupBy(C("author").alias("id")).agg(F.max("strength").alias("burst"))
    return rounded(T.landmark_scores(G.betweenness(e, G.vertices(e)), G.degrees(e).select("id", "degree"), bursts, 10))


def vec_years(v):
    return v.table("embeddings").select("vec_id", (1990 + C("vec_id") % 10).cast("int").alias("year"))


def yearly_regions(v):
    """Centroids of each label and year, as regions."""
    x = v.table("embeddings").join(vec_years(v), "vec_id").select("year", C("label").alias("region"), C("embedding").cast("array<double>").alias("v"))
    return FR._mean_vectors(x, ["year", "region"])


# Years that fill up faster and faster, as in a growing field: a year's share of documents is the difference of two cubes.
R.add("b5_topic_bursts")(lambda v: rounded(FR.topic_bursts(T.lda(tokens(v), 5)[0], v.table("documents").select("doc_id", (1990 + F.floor(F.cbrt(C("doc_id") % 1000))).cast("int").alias("year")))))
R.add("b16_sparse_regions")(lambda v: rounded(FR.sparse_regions(v.table("embeddings"), vec_years(v)).drop("centroid"), 4))
R.add("b17_boundary_topics")(lambda v: rounded(FR.boundary_topics(T.lda(tokens(v), 20)[0], doc_years(v)), 4))
CENTRES = "WITH m AS (SELECT 1990 + vec_id % 10 AS year, label AS region, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), a AS (SELECT year, region, i, avg(x) AS x FROM m GROUP BY ALL), c AS (SELECT year, region, list(x ORDER BY i) AS c FROM a GROUP BY ALL)"


@R.add("b19_matched_regions", "", CENTRES + ", b AS (SELECT x.year, x.region, max(list_cosine_similarity(x.c, y.c)) AS best FROM c x JOIN c y ON y.year = x.year - 1 GROUP BY ALL) SELECT c.year::INT AS year, c.region, round(greatest(coalesce(best, 0), 0), 6) AS best, greatest(coalesce(best, 0), 0) >= 0.7 AS matched FROM c LEFT JOIN b USING (year, region)")
def b19(v):
    return rounded(FR.match_regions(yearly_regions(v)))


@R.add("b19_fading_regions", "", CENTRES + ", p AS (SELECT x.year AS from_year, x.region, x.c, x.year + k AS year FROM c x, (SELECT unnest([1, 2, 3]) AS k) WHERE x.year + k <= (SELECT max(year) FROM c)) SELECT p.year::INT AS year, p.from_year::INT AS from_year, p.region FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.year = p.year AND list_cosine_similarity(c.c, p.c) >= 0.7)")
def b19f(v):
    return FR.fading_regions(yearly_regions(v))


R.add("n11_structural_variation")(lambda v: rounded(FR.structural_variation(v.references, v.papers.select("paper_id", "year"), passes=2, levels=2), 4))


@R.add("n12_research_fronts")
def n12(v):
    terms = v.keywords.select("paper_id", C("keyword").alias("term"))
    yearly = terms.join(v.papers, "paper_id").groupBy("term", "year").agg(F.count(F.lit(1)).alias("count"))
    bursts = X.multi_level_bursts(X.fill_years(yearly, "term"), "term", s=1.2, threshold=1.2).groupBy("term").agg(F.max("strength").alias("burst"))
    return rounded(FR.research_fronts(v.references, terms, bursts), 4)
