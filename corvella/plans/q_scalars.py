"""Queries P1-P27: scalar functions over the documents, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.functions import scalars as S
from corvella.plans.q_aggregates import rounded
from corvella.plans.registry import Registry

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
C = F.col


def orders(v):
    return v.table("orders")


@R.add("p1_doi", "", "SELECT o_orderkey AS id, '10.1/x' || o_orderkey AS doi FROM orders")
def p1(v):
    prefix = F.element_at(F.array(*map(F.lit, ["https://doi.org/", "http://doi.org/", "doi.org/", "DOI:", " doi: ", ""])), (C("o_orderkey") % 6 + 1).cast("int"))
    return orders(v).select(C("o_orderkey").alias("id"), S.doi(F.concat(prefix, F.lit("10.1/X"), C("o_orderkey"))).alias("doi"))


@R.add("p2_identifier", "", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'i' || o_orderkey ELSE o_orderpriority END AS ident FROM orders")
def p2(v):
    k = C("o_orderkey")
    return orders(v).select(k.alias("id"), S.first_filled(F.when(k % 3 == 0, F.concat(F.lit("d"), k)).otherwise(" "), F.when(k % 3 == 1, F.concat(F.lit("i"), k)), C("o_orderpriority")).alias("ident"))


@R.add("p3_normal_id", "", "SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS id FROM documents")
def p3(v):
    return v.table("documents").select("doc_id", S.normal_id(C("text")).alias("id"))


@R.add("p4_authors", "", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN [n_name, 'X Y'] ELSE ['A', n_name] END AS authors FROM nation")
def p4(v):
    k = C("n_nationkey")
    return v.table("nation").select(k.alias("id"), S.authors(F.when(k % 2 == 0, F.concat("n_name", F.lit(" and X Y"))).otherwise(F.concat(F.lit("A, "), "n_name"))).alias("authors"))


@R.add("p5_keywords", "", "SELECT p_partkey AS id, [p_brand, p_type] AS keywords FROM part")
def p5(v):
    return v.table("part").select(C("p_partkey").alias("id"), S.keyword_list(F.concat("p_brand", F.lit("|; "), "p_type", F.lit(" ,"))).alias("keywords"))


@R.add("p6_citation_count", "", "SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey * 2 END)::INT AS n FROM orders")
def p6(v):
    k = C("o_orderkey")
    return orders(v).select(k.alias("id"), S.citation_count(F.when(k % 2 == 0, k.cast("string")).otherwise("n/a"), F.array(k.cast("int"), k.cast("int"))).alias("n"))


@R.add("p7_cited_dois", "refs", "SELECT paper_id, list_sort(list(DISTINCT '10.1/' || ref)) AS dois FROM refs GROUP BY 1")
def p7(v):
    g = v.references.groupBy("paper_id").agg(F.collect_list(F.concat(F.lit("https://doi.org/10.1/"), C("ref"))).alias("r"))
    return g.select("paper_id", F.sort_array(S.cited_dois(F.concat("r", F.array(F.lit(""), F.lit(None).cast("string"))))).alias("dois"))


@R.add("p8_year", "", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE year(o_orderdate)::INT END AS year FROM orders")
def p8(v):
    t = F.when(C("o_orderkey") % 5 == 0, "0999-01-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders(v).select(C("o_orderkey").alias("id"), S.year_of(t).alias("year"))


@R.add("p9_countries", "", "SELECT s_suppkey AS id, [n_name] AS countries FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def p9(v):
    x = v.table("supplier").join(v.table("nation"), C("s_nationkey") == C("n_nationkey"))
    a = F.concat(F.lit("Dept, "), "s_name", F.lit(", "), "n_name")
    return x.select(C("s_suppkey").alias("id"), S.countries(F.array(a, F.concat(F.lit("Lab, "), "n_name"))).alias("countries"))


@R.add("p10_citekey", "", "SELECT o_orderkey AS id, 'smith' || CASE WHEN o_orderkey % 4 = 0 THEN 'nd' ELSE year(o_orderdate)::VARCHAR END || 'deep' AS citekey FROM orders")
def p10(v):
    y = F.when(C("o_orderkey") % 4 != 0, F.year("o_orderdate"))
    return orders(v).select(C("o_orderkey").alias("id"), S.citekey(F.lit("Ann Smith"), y, F.lit("On a Deep Graph")).alias("citekey"))


@R.add("p11_clean_text", "", r"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' $x$ \emph{a} {b}', '\$[^$]*\$', ' ', 'g'), '\\[A-Za-z]+(\{[^}]*\})?', ' ', 'g'), '[{}]', ' ', 'g'), '\s+', ' ', 'g'))) AS cleaned FROM documents")
def p11(v):
    return v.table("documents").select("doc_id", S.clean_text(F.concat("text", F.lit(r" $x$ \emph{a} {b}")), lower=True).alias("cleaned"))


R.add("p11_nfkc")(lambda v: v.table("documents").select("doc_id", S.clean_text(C("text"), normalise=True).alias("cleaned")))
STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


@R.add("p12_tokens", "", rf"SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP})) AS tokens FROM documents")
def p12(v):
    return v.table("documents").select("doc_id", S.tokens(C("text")).alias("tokens"))


@R.add("p13_title_key", "", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM documents")
def p13(v):
    return v.table("documents").select("doc_id", S.title_key(C("text"), strict=True).alias("key"))


@R.add("p14_abstract", "", "SELECT o_orderkey AS id, 'the ' || o_orderstatus || ' of the ' || o_orderpriority AS abstract FROM orders")
def p14(v):
    index = F.map_from_arrays(F.array(F.lit("the"), F.concat(F.lit(""), "o_orderstatus"), F.lit("of"), C("o_orderpriority")), F.array(F.array(F.lit(0), F.lit(3)), F.array(F.lit(1)), F.array(F.lit(2)), F.array(F.lit(4))))
    return orders(v).select(C("o_orderkey").alias("id"), S.abstract_of(index).alias("abstract"))


@R.add("p15_topics", "", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN [p_type] WHEN p_size % 3 = 1 THEN [p_brand] ELSE ['graph', 'mining'] END AS topics FROM part")
def p15(v):
    none = F.array().cast("array<string>")
    return v.table("part").select(C("p_partkey").alias("id"), S.topics(F.when(C("p_size") % 3 == 0, F.array("p_type")).otherwise(none), F.when(C("p_size") % 3 == 1, F.array("p_brand")).otherwise(none), F.lit("The graph of mining ab")).alias("topics"))


@R.add("p16_safe_cell", "", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '''=1+' || o_orderkey WHEN 1 THEN 'a b' ELSE '''-' || o_orderkey END AS cell FROM orders")
def p16(v):
    k = C("o_orderkey")
    return orders(v).select(k.alias("id"), S.safe_cell(F.when(k % 3 == 0, F.concat(F.lit("=1+"), k)).when(k % 3 == 1, "a\nb").otherwise(F.concat(F.lit("-"), k))).alias("cell"))


@R.add("p17_institute", "", "SELECT n_nationkey AS id, n_name AS institute FROM nation")
def p17(v):
    return v.table("nation").select(C("n_nationkey").alias("id"), S.institute(F.when(C("n_nationkey") % 2 == 0, F.concat(F.lit("A B ("), "n_name", F.lit(")"))).otherwise(F.concat(F.lit("A B, "), "n_name"))).alias("institute"))


@R.add("p18_word_chunks", "", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents), s AS (SELECT doc_id, words, unnest(range(0, (ceil(greatest(len(words) - 64, 0) / 48.0) * 48)::BIGINT + 1, 48)) AS i FROM w WHERE len(words) > 0)
 SELECT doc_id, (i / 48)::INT AS pos, array_to_string(words[i + 1 : i + 64], ' ') AS chunk FROM s""")
def p18(v):
    return v.table("documents").select("doc_id", F.posexplode(S.word_chunks(C("text"), 64, 16)).alias("pos", "chunk"))


R.add("p19_snippet")(lambda v: v.table("documents").select("doc_id", S.snippet("the", C("text")).alias("snippet")))


@R.add("p20_jaccard", "", "WITH k AS (SELECT l_orderkey, list(DISTINCT l_partkey % 50) AS a, list(DISTINCT l_suppkey % 50) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey AS id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM k")
def p20(v):
    k = v.table("lineitem").groupBy("l_orderkey").agg(F.collect_set(C("l_partkey") % 50).alias("a"), F.collect_set(C("l_suppkey") % 50).alias("b"))
    return rounded(k.select(C("l_orderkey").alias("id"), S.jaccard(C("a"), C("b")).alias("similarity")))


@R.add("p21_cosine", "", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS similarity FROM embeddings, q")
def p21(v):
    e = v.table("embeddings")
    q = e.filter("vec_id = 0").select(C("embedding").alias("q"))
    return rounded(e.join(F.broadcast(q)).select("vec_id", S.cosine(C("embedding"), C("q")).alias("similarity")))  # one query vector


R.add("p22_hash_vector")(lambda v: v.table("nation").select("n_nationkey", F.transform(S.hash_vector(C("n_name"), 16), lambda x: F.round(x, 6)).alias("vector")))


@R.add("p23_rescale", "papers", "SELECT paper_id, round(1 + (citations_count - lo) / (hi - lo)::DOUBLE * 9, 6) AS linear, round((ln(citations_count + s) - ln(lo + s)) / (ln(hi + s) - ln(lo + s)), 6) AS logged FROM papers, (SELECT min(citations_count) AS lo, max(citations_count) AS hi, CASE WHEN min(citations_count) <= 0 THEN 1 - min(citations_count) ELSE 0 END AS s FROM papers)")
def p23(v):
    c = C("citations_count").cast("double")
    s = v.papers.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    x = v.papers.join(F.broadcast(s))  # one row
    return rounded(x.select("paper_id", S.rescaled(c, C("lo"), C("hi"), 1.0, 10.0).alias("linear"), S.rescaled(c, C("lo"), C("hi"), 0.0, 1.0, log=True).alias("logged")))


@R.add("p24_bands", "", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 < 0 THEN 'poor' WHEN l_discount * 10 <= .2 THEN 'slight' WHEN l_discount * 10 <= .4 THEN 'fair' WHEN l_discount * 10 <= .6 THEN 'moderate' WHEN l_discount * 10 <= .8 THEN 'substantial' ELSE 'almost perfect' END AS kappa, CASE WHEN l_quantity * 2 < 25 THEN 'low' WHEN l_quantity * 2 < 50 THEN 'moderate' WHEN l_quantity * 2 < 75 THEN 'substantial' ELSE 'considerable' END AS i2 FROM lineitem")
def p24(v):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", S.kappa_band(C("l_discount") * 10).alias("kappa"), S.i2_band(C("l_quantity") * 2).alias("i2"))


@R.add("p25_calibrate", "", "SELECT o_orderkey AS id, round(CASE WHEN o_totalprice >= 300000 THEN 1.0 WHEN o_totalprice <= 50000 THEN 0.0 ELSE 1 / (1 + exp(-5.0 / 250000 * (o_totalprice - 150000))) END, 6)::DOUBLE AS member FROM orders")
def p25(v):
    return rounded(orders(v).select(C("o_orderkey").alias("id"), S.calibrate(C("o_totalprice"), 300000.0, 150000.0, 50000.0).alias("member")))


@R.add("p26_dense_series", "paper_year_counts", "WITH e AS (SELECT entity, min(year) AS a, max(year) AS b FROM paper_year_counts GROUP BY 1), d AS (SELECT entity, unnest(range(a, b + 1)) AS year FROM e) SELECT entity, list(coalesce(count, 0) ORDER BY d.year) AS series FROM d LEFT JOIN paper_year_counts USING (entity, year) GROUP BY 1")
def p26(v):
    m = v.paper_year_counts.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("year", "count"))).alias("m"), F.min("year").alias("a"), F.max("year").alias("b"))
    return m.select("entity", S.dense_series(C("m"), C("a"), C("b")).alias("series"))


@R.add("p27_bucket_year", "papers", "SELECT year - year % 3 AS bucket, count(*) AS papers FROM papers GROUP BY 1")
def p27(v):
    return v.papers.groupBy(S.bucket_year(C("year"), 3).alias("bucket")).agg(F.count(F.lit(1)).alias("papers"))
