"""Queries S1-S22 and R1-R7: round trips through files and streams over the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corvella.plans.q_aggregates import rounded
from corvella.plans.q_networks import temporal
from corvella.plans.registry import Registry
from corvella.plans.storage import fresh_path
from corvella.sources import records as S
from corvella.streaming import events as E

R = Registry()
QUERIES, ORACLES = R.QUERIES, R.ORACLES
C = F.col


def papers(v):
    """The paper view in PAPER columns: a title, authors and keywords made of the order's parts."""
    names = v.authorship.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.concat(F.lit("Author "), "author"))).alias("authors"))
    keys = v.keywords.groupBy("paper_id").agg(F.sort_array(F.collect_list("keyword")).alias("keywords"))
    p = v.papers.join(names, "paper_id", "left").join(keys, "paper_id", "left").withColumn("title", F.concat(F.lit("Study "), "paper_id")).withColumn("doi", F.concat(F.lit("10.1/"), "paper_id"))
    return S.conform(p.withColumn("paper_id", C("paper_id").cast("string")))


FULL = "WITH a AS (SELECT paper_id, list_sort(list('Author ' || author)) AS authors FROM authorship GROUP BY 1), k AS (SELECT paper_id, list_sort(list(keyword)) AS keywords FROM keywords GROUP BY 1), p AS (SELECT papers.paper_id::VARCHAR AS paper_id, 'Study ' || papers.paper_id AS title, '10.1/' || papers.paper_id AS doi, journal, year, citations_count, coalesce(authors, []) AS authors, coalesce(keywords, []) AS keywords FROM papers LEFT JOIN a USING (paper_id) LEFT JOIN k USING (paper_id)) "
NEEDS = "papers authorship keywords"
SHOWN = ["paper_id", "title", "doi", "journal", "year", "citations_count", "authors", "keywords"]


def _trip(v, fmt):
    path = fresh_path(v.spark, f"papers-{fmt}")
    S.save(papers(v), path, fmt)
    return S.load(v.spark, path, fmt).select(*SHOWN)


for _i, _f in ((1, "parquet"), (2, "csv"), (3, "json")):
    R.add(f"s{_i}_{_f}_round_trip", NEEDS, FULL + "SELECT * FROM p")(lambda v, f=_f: _trip(v, f))


@R.add("s4_conform", NEEDS, FULL + "SELECT * FROM p")
def s4(v):
    return papers(v).select(*SHOWN)


@R.add("s5_crossref", "papers", "SELECT '10.1/' || paper_id AS paper_id, 'T ' || paper_id AS title, year, citations_count, ['A B'] AS authors, ['10.1/z'] AS \"references\", journal FROM papers")
def s5(v):
    w = F.struct(F.concat(F.lit("https://doi.org/10.1/"), "paper_id").alias("DOI"), F.array(F.concat(F.lit("T "), "paper_id")).alias("title"), F.array(F.struct(F.lit("A").alias("given"), F.lit("B").alias("family"))).alias("author"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"), F.array(F.struct(F.lit("10.1/Z").alias("DOI"))).alias("reference"), C("citations_count").alias("is-referenced-by-count"), F.array("journal").alias("container-title"))
    return S.from_crossref(v.papers.select(F.to_json(w).alias("value"))).select("paper_id", "title", "year", "citations_count", "authors", "references", "journal")


@R.add("s6_openalex", "papers", "SELECT 'W' || paper_id AS paper_id, 'T' AS title, year, 'the graph of the' AS abstract, ['R1'] AS \"references\" FROM papers WHERE paper_id % 5 <> 0")
def s6(v):
    index = F.map_from_arrays(F.array(F.lit("the"), F.lit("graph"), F.lit("of")), F.array(F.array(F.lit(0), F.lit(3)), F.array(F.lit(1)), F.array(F.lit(2))))
    w = F.struct(F.concat(F.lit("https://openalex.org/W"), "paper_id").alias("id"), F.when(C("paper_id") % 5 != 0, "T").alias("display_name"), C("year").alias("publication_year"), index.alias("abstract_inverted_index"), F.array(F.lit("https://openalex.org/R1")).alias("referenced_works"))
    return S.from_openalex(v.papers.select(F.to_json(w).alias("value"))).select("paper_id", "title", "year", "abstract", "references")


@R.add("s7_semantic_scholar", "papers", "SELECT paper_id::VARCHAR AS paper_id, journal, ['DOI:10.1/q', 'p9'] AS \"references\", year FROM papers")
def s7(v):
    ids = F.create_map(F.lit("DOI"), F.lit("10.1/q"))
    w = F.struct(C("paper_id").cast("string").alias("paperId"), F.lit("T").alias("title"), "year", F.struct(C("journal").alias("name")).alias("journal"), F.array(F.struct(F.lit("p1").alias("paperId"), ids.alias("externalIds")), F.struct(F.lit("p9").alias("paperId"), F.lit(None).cast("map<string,string>").alias("externalIds"))).alias("references"))
    return S.from_semantic_scholar(v.papers.select(F.to_json(w).alias("value"))).select("paper_id", "journal", "references", "year")


def _xml(v, label, record):
    """The papers, one XML record a line, as a dump in the shared folder."""
    path = fresh_path(v.spark, label)
    v.papers.select(F.expr(record)).write.text(path)
    return v.spark.read.text(path)


@R.add("s8_pubmed", "papers", "SELECT paper_id::VARCHAR AS paper_id, 'T ' || paper_id AS title, year, journal, ['Bee, Ann', 'The Group'] AS authors, 'AIM: x ' || year AS abstract, '10.1/' || paper_id AS doi, ['M1', 'k'] AS keywords FROM papers")
def s8(v):
    record = (
        "concat('<PubmedArticle><MedlineCitation><PMID>', paper_id, '</PMID><Article><Journal><Title>', journal, '</Title><JournalIssue><PubDate><Year>', year, '</Year></PubDate></JournalIssue></Journal><ArticleTitle>T ', paper_id, '</ArticleTitle>"
        "<ELocationID EIdType=\"pii\">p</ELocationID><ELocationID EIdType=\"doi\">10.1/', paper_id, '</ELocationID><Abstract><AbstractText Label=\"AIM\">x</AbstractText><AbstractText>', year, '</AbstractText></Abstract>"
        "<AuthorList><Author><LastName>Bee</LastName><ForeName>Ann</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList></Article>"
        "<MeshHeadingList><MeshHeading><DescriptorName>M1</DescriptorName></MeshHeading></MeshHeadingList><KeywordList><Keyword>k</Keyword></KeywordList></MedlineCitation></PubmedArticle>')"
    )
    return S.from_pubmed(v.spark, _xml(v, "pubmed", record)).select("paper_id", "title", "year", "journal", "authors", "abstract", "doi", "keywords")


@R.add("s9_arxiv", "papers", "SELECT paper_id::VARCHAR AS paper_id, 'T ' || paper_id AS title, year, ['A B'] AS authors, '10.1/' || paper_id AS doi, ['cs.DL', 'cs.IR'] AS keywords FROM papers")
def s9(v):
    record = (
        "concat('<entry><id>', paper_id, '</id><title>T   ', paper_id, '</title><summary>s</summary><published>', year, '-02-03T00:00:00Z</published><author><name>A B</name></author>"
        "<link href=\"https://doi.org/10.1/', paper_id, '\" title=\"doi\"/><link href=\"http://x/pdf\" title=\"pdf\"/><category term=\"cs.DL\"/><category term=\"cs.IR\"/></entry>')"
    )
    return S.from_atom(v.spark, _xml(v, "arxiv", record)).select("paper_id", "title", "year", "authors", "doi", "keywords")


@R.add("s9_dblp", "papers", "SELECT paper_id::VARCHAR AS paper_id, 'T ' || paper_id AS title, year, journal, ['A', 'B'] AS authors, '10.1/' || paper_id AS doi FROM papers")
def s9d(v):
    record = (
        "concat('<hit id=\"', paper_id, '\"><info><authors><author>A</author><author>B</author></authors><title>T ', paper_id, '.</title><venue>', journal, '</venue><year>', year, '</year><ee>https://doi.org/10.1/', paper_id, '</ee></info></hit>')"
    )
    return S.from_dblp(v.spark, _xml(v, "dblp", record)).select("paper_id", "title", "year", "journal", "authors", "doi")


@R.add("s10_springer", "papers", "SELECT paper_id::VARCHAR AS paper_id, year, ' text' AS abstract, '1-9' AS pages, ['A'] AS authors FROM papers")
def s10(v):
    w = F.struct(C("paper_id").cast("string").alias("identifier"), F.concat("year", F.lit("-01-01")).alias("publicationDate"), F.lit("Abstract text").alias("abstract"), F.lit("1").alias("startingPage"), F.lit("9").alias("endingPage"), F.array(F.struct(F.lit("A").alias("creator"))).alias("creators"))
    return S.from_dump(v.papers.select(F.to_json(w).alias("value")), "springer").select("paper_id", "year", "abstract", "pages", "authors")


@R.add("s10_base", "papers", "SELECT paper_id::VARCHAR AS paper_id, year, journal AS title FROM papers")
def s10b(v):
    w = F.struct(C("paper_id").cast("string").alias("dcdocid"), F.array("journal").alias("dctitle"), F.concat(F.lit("c"), "year").alias("dcyear"))
    return S.from_dump(v.papers.select(F.to_json(w).alias("value")), "base").select("paper_id", "year", "title")


@R.add("s10_core", "papers", "SELECT paper_id::VARCHAR AS paper_id, year, ['A B'] AS authors, 'u' || paper_id AS pdf_url, '10.1/' || paper_id AS doi, citations_count FROM papers")
def s10c(v):
    dated = F.when(C("paper_id") % 2 == 0, C("year"))  # the other half only has a date
    w = F.struct(C("paper_id").cast("string").alias("id"), dated.alias("yearPublished"), F.concat("year", F.lit("-05-06")).alias("publishedDate"), F.array(F.struct(F.lit("A B").alias("name"))).alias("authors"), F.concat(F.lit("u"), "paper_id").alias("downloadUrl"), F.concat(F.lit("https://doi.org/10.1/"), "paper_id").alias("doi"), C("citations_count").alias("citationCount"))
    return S.from_dump(v.papers.select(F.to_json(w).alias("value")), "core").select("paper_id", "year", "authors", "pdf_url", "doi", "citations_count")


@R.add("s10_ieee", "papers", "SELECT paper_id::VARCHAR AS paper_id, year, journal, ['A B', 'C D'] AS authors, '3-7' AS pages, citations_count FROM papers")
def s10i(v):
    names = F.array(F.struct(F.lit("A B").alias("full_name")), F.struct(F.lit("C D").alias("full_name")))
    w = F.struct(C("paper_id").cast("string").alias("article_number"), F.struct(names.alias("authors")).alias("authors"), C("year").alias("publication_year"), C("journal").alias("publication_title"), F.lit("3").alias("start_page"), F.lit("7").alias("end_page"), C("citations_count").alias("citing_paper_count"))
    return S.from_dump(v.papers.select(F.to_json(w).alias("value")), "ieee").select("paper_id", "year", "journal", "authors", "pages", "citations_count")


KINDS = {"doi": r"""(10\.\d{4,9}/[^\s"''<>&]+)""", "arxiv": r"arxiv\.org/abs/(\d{4}\.\d{4,5})", "pmid": r"pubmed/(\d{5,9})", "url": r'href="([^"]+)"'}


@R.add("s12_page_citations", "", " UNION ".join(f"SELECT page_id, '{k}' AS kind, unnest(regexp_extract_all(html, '{p}', 1)) AS value FROM pages" for k, p in KINDS.items()))
def s12(v):
    return S.citations_in_pages(v.table("pages"))


@R.add("s12_text_citations", "papers", "SELECT paper_id AS page_id, unnest(['doi', 'arxiv', 'pmid', 'url']) AS kind, unnest(['10.1234/x' || paper_id, year || '.01234', (10000 + paper_id)::VARCHAR, 'https://pubmed/' || (10000 + paper_id)]) AS value FROM papers")
def s12t(v):
    html = F.expr("concat('see 10.1234/x', paper_id, ' and <b>arxiv.org/abs/', year, '.01234</b> <a href=\"https://pubmed/', 10000 + paper_id, '\">x</a>, again 10.1234/x', paper_id, ' ')")
    return S.citations_in_pages(v.papers.select(C("paper_id").alias("page_id"), html.alias("html")))


@R.add("s13_csv_rows", NEEDS, FULL + "SELECT paper_id, title, year::VARCHAR AS year, array_to_string(authors, '; ') AS authors FROM p")
def s13(v):
    return S.csv_rows(papers(v), ["paper_id", "title", "year", "authors"])


@R.add("s14_export_authors", "papers authorship", "WITH r AS (SELECT author, citations_count AS c, year, row_number() OVER (PARTITION BY author ORDER BY citations_count DESC, paper_id) AS k FROM authorship JOIN papers USING (paper_id)) SELECT author, count(*) AS paper_count, sum(c)::BIGINT AS total_citations, coalesce(max(k) FILTER (c >= k), 0)::INT AS h_index, min(year) AS first_year, max(year) AS last_year FROM r GROUP BY 1")
def s14(v):
    from corvella.operators.indices import h_index
    from corvella.plans.q_indices import author_papers

    a = author_papers(v)
    g = a.groupBy("author").agg(F.count(F.lit(1)).alias("paper_count"), F.sum("citations").alias("total_citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return g.join(h_index(a, ["author"], tie=("paper_id",)).select("author", "h_index"), "author")


@R.add("s15_export_citations", "cites", "SELECT '10.1/' || src AS citing_doi, '10.1/' || dst AS cited_doi FROM cites")
def s15(v):
    return v.cites.select(F.concat(F.lit("10.1/"), "src").alias("citing_doi"), F.concat(F.lit("10.1/"), "dst").alias("cited_doi")).distinct()


R.add("s16_bibtex")(lambda v: S.bibtex_records(papers(v)))


@R.add("s17_ris", NEEDS, FULL + "SELECT paper_id, 'TY  - JOUR\nTI  - ' || title || '\n' || CASE WHEN len(authors) > 0 THEN array_to_string(list_transform(authors, lambda a: 'AU  - ' || a), '\n') || '\n' ELSE '' END || 'PY  - ' || year || '\nJO  - ' || journal || '\nDO  - ' || doi || '\n' || CASE WHEN len(keywords) > 0 THEN array_to_string(list_transform(keywords, lambda a: 'KW  - ' || a), '\n') || '\n' ELSE '' END || 'ER  - ' AS value FROM p")
def s17(v):
    return S.ris_records(papers(v))


def weighted(v):
    return v.coauthors.select(C("a").alias("src"), C("b").alias("dst"), C("weight").cast("double").alias("weight"))


def _text_trip(v, lines, label):
    path = fresh_path(v.spark, label)
    lines.write.text(path)
    return v.spark.read.text(path)


@R.add("s18_edge_list", "coauthors", "SELECT a::VARCHAR AS src, b::VARCHAR AS dst, weight::DOUBLE AS weight FROM coauthors")
def s18(v):
    return S.read_edge_lines(_text_trip(v, S.edge_lines(weighted(v)), "edges"))


@R.add("s18_adjacency", "coauthors", "SELECT a::VARCHAR AS src, b::VARCHAR AS dst FROM coauthors")
def s18a(v):
    return S.read_adjacency_lines(_text_trip(v, S.adjacency_lines(weighted(v)), "adjacency"))


@R.add("s19_json_links", "coauthors", "SELECT a AS src, b AS dst, weight::DOUBLE AS weight FROM coauthors")
def s19(v):
    return S.read_json_links(_text_trip(v, S.json_links(weighted(v)), "links"))


def _xml_graph(v, root):
    """The co-author graph as XML with ``root`` around it; every part file is a document of its own."""
    e = weighted(v)
    edges = e.select(F.format_string('<edge source="%s" target="%s" weight="%s"></edge>', C("src").cast("string"), C("dst").cast("string"), C("weight").cast("string")).alias("value"))
    ids = e.select(C("src").alias("id")).union(e.select("dst")).distinct()
    nodes = ids.select(F.format_string('<node id="%s" label="Author %s"></node>', C("id").cast("string"), C("id").cast("string")).alias("value"))

    def whole(frames):
        yield pd.DataFrame({"value": [f"<{root}><graph>"]})
        yield from frames
        yield pd.DataFrame({"value": [f"</graph></{root}>"]})

    path = fresh_path(v.spark, root)
    nodes.union(edges).mapInPandas(whole, "value string").write.text(path)
    return path


@R.add("s19_cytoscape", "coauthors", "SELECT a AS src, b AS dst, weight::DOUBLE AS weight FROM coauthors")
def s19c(v):
    return S.read_cytoscape_edges(_text_trip(v, S.cytoscape_elements(weighted(v)), "cytoscape"))


@R.add("s20_gexf", "coauthors", "SELECT a::VARCHAR AS src, b::VARCHAR AS dst, weight::DOUBLE AS weight FROM coauthors")
def s20g(v):
    return S.graph_xml(v.spark, _xml_graph(v, "gexf"))[1]


@R.add("s20_gexf_nodes", "coauthors", "SELECT DISTINCT id::VARCHAR AS id, 'Author ' || id AS label FROM (SELECT a AS id FROM coauthors UNION SELECT b FROM coauthors)")
def s20n(v):
    return S.graph_xml(v.spark, _xml_graph(v, "gexf"))[0]


@R.add("s20_graphml", "coauthors", "SELECT a::VARCHAR AS src, b::VARCHAR AS dst, weight::DOUBLE AS weight FROM coauthors")
def s20(v):
    return S.graph_xml(v.spark, _xml_graph(v, "graphml"))[1]


R.add("s22_csl")(lambda v: S.csl_records(papers(v)))


def stream(v):
    return E.event_stream(v.spark, f"{v.dir}/events.parque[t]")  # a pattern, so that a single file may stand for the folder


@R.add("r1_first_arrivals", "", "SELECT user_id, 1::BIGINT AS arrivals FROM events GROUP BY 1")
def r1(v):
    got = E.run(E.first_arrivals(stream(v).select("ts", "user_id"), ["user_id"], "60 days"), "append", "first-arrivals")
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("arrivals"))  # which row of a batch comes first is not fixed, how many do is


@R.add("r2_tumbling_counts", "", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def r2(v):
    got = E.run(E.windowed_counts(stream(v), "1 hour"), "complete", "tumbling")
    return got.select(C("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R.add("r2_sliding_counts", "", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL")
def r2s(v):
    got = E.run(E.windowed_counts(stream(v), "1 hour", "15 minutes"), "complete", "sliding")
    return got.select(C("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R.add("r3_sessions", "", "WITH g AS (SELECT user_id, ts, event_id, event_type, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE)::INT AS gap FROM events), s AS (SELECT *, sum(coalesce(gap, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS events, arg_max(event_type, (ts, event_id)) AS last_type FROM s GROUP BY user_id, s")
def r3(v):
    got = E.run(E.sessions(stream(v)), "complete", "sessions")
    return got.withColumn("start", C("start").cast("timestamp_ntz")).withColumn("end", C("end").cast("timestamp_ntz"))


@R.add("r4_routed", "", "SELECT CASE event_type WHEN 'click' THEN 'ui.click' WHEN 'purchase' THEN 'shop.buy' ELSE 'other' END AS topic, 'task-' || user_id AS room, count(*) AS n FROM events GROUP BY ALL")
def r4(v):
    r = E.routed(stream(v), {"click": "ui.click", "purchase": "shop.buy"}).groupBy("topic", "room").agg(F.count(F.lit(1)).alias("n"))
    return E.run(r, "complete", "routed")


@R.add("r5_latest_state", "", "SELECT user_id, count(*) AS events, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def r5(v):
    return E.run(E.latest_state(stream(v)), "complete", "latest-state")


def decisions(v):
    """Reviewers' decisions as a table: two raters of title and abstract, the second also of full texts."""
    x = v.table("labels").select(C("doc_id").alias("record"), "quality", "toxic")
    say = lambda reviewer, stage, ok, seq: x.select("record", F.lit(reviewer).alias("reviewer"), F.lit(stage).alias("stage"), F.when(ok, "include").otherwise("exclude").alias("decision"), F.lit("out of scope").alias("reason"), F.lit(seq).alias("seq"))
    return say("a", "title_abstract", C("quality") == 1, 1).union(say("b", "title_abstract", C("toxic") == 0, 2)).union(say("b", "full_text", C("quality") == 1, 3))


@R.add("r5_screening", "", "SELECT doc_id AS record, CASE WHEN toxic = 1 OR toxic IS NULL THEN 'excluded' WHEN quality = 1 THEN 'included' ELSE 'excluded' END AS stage, coalesce(quality = 1, false) <> coalesce(toxic = 0, false) AS conflict FROM labels")
def r5s(v):
    return E.screening(decisions(v))


@R.add("r5_screening_stream", "", "WITH d AS (SELECT doc_id, coalesce(quality = 1, false) AS q, coalesce(toxic = 0, false) AS t FROM labels) SELECT doc_id AS record, CASE WHEN t AND q THEN 'included' ELSE 'excluded' END AS stage, q <> t AS conflict, 1 + (q <> t)::INT + t::INT AS moves FROM d")
def r5t(v):
    """The decisions as a stream of one batch per decision round, and where it leaves each record."""
    moves = E.run(E.screening_transitions(E.replay(decisions(v), "seq", 3)), "append", "screening")
    last = F.max_by(F.struct("stage", "conflict"), F.struct("seq", "conflict"))
    return moves.groupBy("record").agg(last.alias("last"), F.count(F.lit(1)).cast("int").alias("moves")).select("record", "last.stage", "last.conflict", "moves")


@R.add("r6_fresh_values", "", "WITH RECURSIVE e AS (SELECT user_id, event_type, ts FROM events WHERE ts IS NOT NULL), f AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY ALL UNION ALL SELECT f.user_id, f.event_type, min(e.ts) AS ts FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.ts > f.ts + INTERVAL 1 DAY GROUP BY ALL) SELECT user_id, event_type, ts FROM f")
def r6(v):
    got = E.run(E.fresh_values(stream(v), ["user_id", "event_type"], "1 day"), "append", "fresh-values")
    return got.withColumn("ts", C("ts").cast("timestamp_ntz"))


DAYS = "WITH RECURSIVE d AS (SELECT event_type AS key, date_trunc('day', ts) AS day, count(*)::DOUBLE AS c, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts)) AS k FROM events GROUP BY event_type, date_trunc('day', ts)), w AS (SELECT key, k, 20 - c * ln(20) AS idle, ln(30) + 40 - c * ln(40) AS burst FROM d WHERE k = 1 UNION ALL SELECT d.key, d.k, least(idle, burst) + 20 - c * ln(20), least(idle + ln(30), burst) + 40 - c * ln(40) FROM w JOIN d ON d.key = w.key AND d.k = w.k + 1) "


@R.add("r7_online_bursts", "", DAYS + "SELECT key, k::BIGINT AS days, round(idle, 4) AS idle, round(burst, 4) AS burst FROM w WHERE k = (SELECT max(k) FROM d WHERE d.key = w.key)")
def r7(v):
    """Daily counts of the whole stream, sent in as one batch of days."""
    days = E.run(stream(v).groupBy(C("event_type").alias("key"), F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("count")), "complete", "daily")
    got = E.run(E.online_burst_cost(E.replay(days), base=20.0), "update", "online-bursts")
    return got.groupBy("key").agg(F.max("days").alias("days"), F.round(F.max_by("idle", "days"), 4).alias("idle"), F.round(F.max_by("burst", "days"), 4).alias("burst"))


@R.add("u5_chunk_generator", "", r"SELECT doc_id, ceil(greatest(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) - 128, 0) / 96.0)::BIGINT + 1 AS chunks FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > 0")
def u5(v):
    from corvella.functions.scalars import word_chunks

    return v.table("documents").select("doc_id", F.explode(word_chunks(C("text"), 128, 32)).alias("chunk")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
