"""Record sources and sinks: papers as Parquet, CSV and JSON, provider dumps, and export formats.

Every source ends in the PAPER columns; a missing column becomes NULL, a missing list an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.functions import scalars as S

_TEXT = ("paper_id", "title", "abstract", "doi", "url", "source", "pdf_url", "issn", "isbn", "publisher", "journal", "volume", "issue", "pages", "language", "paper_type", "raw")
_LISTS = ("authors", "references", "keywords", "fields_of_study")
PAPER = T.StructType(
    [*(T.StructField(c, T.StringType()) for c in _TEXT), *(T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS), T.StructField("year", T.IntegerType()), T.StructField("citations_count", T.IntegerType()), T.StructField("citations_by_year", T.MapType(T.IntegerType(), T.DoubleType()))]
)


def conform(df: DataFrame, extras: tuple[str, ...] = ()) -> DataFrame:
    """Any frame in the PAPER columns (S4): missing become NULL or empty, NaN becomes NULL, others are dropped."""
    have = dict(df.dtypes)
    out = []
    for f in PAPER:
        if f.name not in have:
            out.append((F.array().cast(f.dataType) if f.name in _LISTS else F.lit(None).cast(f.dataType)).alias(f.name))
            continue
        c = F.col(f.name)
        if have[f.name] in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        if f.name in _LISTS:
            c = F.coalesce(S.keyword_list(c) if have[f.name] == "string" else c.cast(f.dataType), F.array().cast(f.dataType))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out, *extras)


def save(papers: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write papers (S1-S3). Arrays stay arrays in Parquet and JSON; CSV joins them by '; '."""
    if fmt != "parquet":  # text formats have only text keys
        papers = papers.withColumn("citations_by_year", F.transform_keys("citations_by_year", lambda k, _: k.cast("string")))
    if fmt == "csv":
        flat = [F.concat_ws("; ", c).alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in papers.dtypes]
        papers.select(*flat).write.option("header", True).option("escape", '"').csv(path)
    else:
        getattr(papers.write, fmt)(path)


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read what ``save`` wrote, with a fixed schema."""
    if fmt == "csv":
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in PAPER])
        rows = spark.read.option("header", True).option("escape", '"').schema(text).csv(path)
        split = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), "; "), lambda x: x != "")
        return rows.select(*[split(f.name).alias(f.name) if f.name in _LISTS else _int_keys(F.from_json(f.name, _BY_NAME)).alias(f.name) if f.name == "citations_by_year" else F.col(f.name).cast(f.dataType).alias(f.name) for f in PAPER])
    if fmt == "json":
        named = T.StructType([T.StructField(f.name, _BY_NAME if f.name == "citations_by_year" else f.dataType) for f in PAPER])
        return spark.read.schema(named).json(path).withColumn("citations_by_year", _int_keys(F.col("citations_by_year")))
    return spark.read.schema(PAPER).parquet(path)


_BY_NAME = T.MapType(T.StringType(), T.DoubleType())


def _int_keys(c: Column) -> Column:
    return F.transform_keys(c, lambda k, _: k.cast("int"))


def _mapped(raw: DataFrame, fields: dict[str, Column]) -> DataFrame:
    return conform(raw.select(*[c.alias(k) for k, c in fields.items()]))


CROSSREF = "DOI string, title array<string>, author array<struct<given:string,family:string>>, issued struct<`date-parts`:array<array<int>>>, abstract string, reference array<struct<DOI:string,unstructured:string>>, subject array<string>, `is-referenced-by-count` int, `container-title` array<string>, publisher string, volume string, issue string, page string, type string, language string, URL string"


def from_crossref(lines: DataFrame) -> DataFrame:
    """Crossref work JSON lines (column value) as papers."""
    w = lines.select(F.from_json("value", CROSSREF).alias("w")).select("w.*")
    name = lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))
    return _mapped(w, {
        "paper_id": S.doi(F.col("DOI")), "title": F.get("title", F.lit(0)), "authors": F.transform("author", name), "year": F.get(F.get(F.col("issued.date-parts"), F.lit(0)), F.lit(0)), "doi": S.doi(F.col("DOI")),
        "abstract": F.trim(F.regexp_replace("abstract", "<[^>]*>", " ")), "references": F.filter(F.transform("reference", lambda r: F.coalesce(S.doi(r["DOI"]), r["unstructured"])), lambda x: x.isNotNull()),
        "fields_of_study": F.col("subject"), "citations_count": F.col("is-referenced-by-count"), "journal": F.get("container-title", F.lit(0)), "publisher": F.col("publisher"), "volume": F.col("volume"), "issue": F.col("issue"),
        "pages": F.col("page"), "paper_type": F.col("type"), "language": F.col("language"), "url": F.col("URL"), "source": F.lit("crossref"),
    })


OPENALEX = "id string, display_name string, publication_year int, doi string, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, cited_by_count int, referenced_works array<string>, keywords array<struct<display_name:string>>, concepts array<struct<display_name:string,level:int>>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>, type string, language string"


def from_openalex(lines: DataFrame) -> DataFrame:
    """OpenAlex work JSON lines as papers (S6); works without a title are dropped."""
    w = lines.select(F.from_json("value", OPENALEX).alias("w")).select("w.*").filter("display_name IS NOT NULL")
    short = lambda c: F.regexp_replace(c, "^https://openalex.org/", "")
    return _mapped(w, {
        "paper_id": short(F.col("id")), "title": F.col("display_name"), "year": F.col("publication_year"), "doi": S.doi(F.col("doi")), "abstract": S.abstract_of(F.col("abstract_inverted_index")),
        "authors": F.transform("authorships", lambda a: a["author"]["display_name"]), "citations_count": F.col("cited_by_count"), "references": F.transform("referenced_works", short),
        "keywords": F.array_distinct(F.concat(F.transform("keywords", lambda k: k["display_name"]), F.transform("concepts", lambda k: k["display_name"]))), "fields_of_study": F.transform(F.filter("concepts", lambda c: c["level"] == 0), lambda c: c["display_name"]),
        "pages": F.concat_ws("-", F.col("biblio.first_page"), F.col("biblio.last_page")), "volume": F.col("biblio.volume"), "issue": F.col("biblio.issue"), "paper_type": F.col("type"), "language": F.col("language"), "source": F.lit("openalex"),
    })


SEMANTIC = "paperId string, title string, year int, abstract string, externalIds map<string,string>, authors array<struct<name:string>>, citationCount int, journal struct<name:string,volume:string,pages:string>, publicationTypes array<string>, references array<struct<paperId:string,externalIds:map<string,string>>>, fieldsOfStudy array<string>"


def from_semantic_scholar(lines: DataFrame) -> DataFrame:
    """Semantic Scholar paper JSON lines as papers (S7); papers without a title are dropped."""
    w = lines.select(F.from_json("value", SEMANTIC).alias("w")).select("w.*").filter("title IS NOT NULL")
    ref = lambda r: F.coalesce(F.concat(F.lit("DOI:"), r["externalIds"]["DOI"]), r["paperId"])
    return _mapped(w, {
        "paper_id": F.col("paperId"), "title": F.col("title"), "year": F.col("year"), "abstract": F.col("abstract"), "doi": S.doi(F.col("externalIds")["DOI"]), "authors": F.transform("authors", lambda a: a["name"]),
        "citations_count": F.col("citationCount"), "journal": F.col("journal.name"), "volume": F.col("journal.volume"), "pages": F.col("journal.pages"), "paper_type": F.get("publicationTypes", F.lit(0)),
        "references": F.filter(F.transform("references", ref), lambda x: x.isNotNull()), "fields_of_study": F.col("fieldsOfStudy"), "source": F.lit("semantic_scholar"),
    })


#: Declarative field maps of plain JSON dumps (S10, S11): target -> SQL expression over the parsed record.
FIELD_MAPS = {
    "core": ("id string, title string, yearPublished int, publishedDate string, abstract string, authors array<struct<name:string>>, downloadUrl string, doi string, citationCount int", {
        "paper_id": "id", "title": "title", "year": "coalesce(yearPublished, try_cast(substr(publishedDate, 1, 4) AS INT))", "abstract": "abstract", "authors": "transform(authors, a -> a.name)", "pdf_url": "downloadUrl", "doi": "doi", "citations_count": "citationCount"}),
    "base": ("dcdocid string, dctitle array<string>, dccreator array<string>, dcyear string, dcdoi array<string>, dcsubject array<string>, dcpublisher array<string>, dclink string", {
        "paper_id": "dcdocid", "title": "get(dctitle, 0)", "authors": "dccreator", "year": "try_cast(regexp_extract(dcyear, '(19|20)[0-9]{2}', 0) AS INT)", "doi": "get(dcdoi, 0)", "keywords": "dcsubject", "publisher": "get(dcpublisher, 0)", "url": "dclink"}),
    "springer": ("identifier string, title string, creators array<struct<creator:string>>, publicationDate string, doi string, abstract string, publicationName string, startingPage string, endingPage string, volume string, number string", {
        "paper_id": "identifier", "title": "title", "authors": "transform(creators, c -> c.creator)", "year": "try_cast(substr(publicationDate, 1, 4) AS INT)", "doi": "doi", "abstract": "regexp_replace(abstract, '^Abstract', '')", "journal": "publicationName", "pages": "concat_ws('-', startingPage, endingPage)", "volume": "volume", "issue": "number"}),
    "ieee": ("article_number string, title string, authors struct<authors:array<struct<full_name:string>>>, publication_year int, doi string, abstract string, publication_title string, start_page string, end_page string, citing_paper_count int", {
        "paper_id": "article_number", "title": "title", "authors": "transform(authors.authors, a -> a.full_name)", "year": "publication_year", "doi": "doi", "abstract": "abstract", "journal": "publication_title", "pages": "concat_ws('-', start_page, end_page)", "citations_count": "citing_paper_count"}),
}


def from_dump(lines: DataFrame, provider: str) -> DataFrame:
    """JSON lines of a provider with a field map as papers."""
    schema, fields = FIELD_MAPS[provider]
    w = lines.select(F.from_json("value", schema).alias("w")).select("w.*")
    return conform(w.select(*[F.expr(e).alias(k) for k, e in fields.items()], F.lit(provider).alias("source"))).withColumn("doi", S.doi(F.col("doi")))


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _xml(spark: SparkSession, source: str | DataFrame, tag: str, schema: str) -> DataFrame:
    """Records of XML files with a root element around them, or of a frame with one record a line (``value``)."""
    if isinstance(source, str):
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(source)
    return source.select(F.from_xml("value", schema).alias("x")).select("x.*")


def from_atom(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """arXiv Atom entries as papers (S9): DOI from its element or from a doi.org link, the first PDF link, categories as keywords."""
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>, link array<struct<_href:string,_title:string,_type:string>>, category array<struct<_term:string>>, `arxiv:doi` string, doi string"
    e = _xml(spark, source, "entry", schema)
    href = lambda hit: F.get(F.transform(F.filter("link", hit), lambda x: x["_href"]), F.lit(0))
    by_link = href(lambda x: x["_href"].contains("doi.org/"))
    pdf = href(lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf"))
    return conform(
        e.select(
            F.col("id").alias("paper_id"), _flat(F.col("title")).alias("title"), _flat(F.col("summary")).alias("abstract"), S.year_of(F.col("published")).alias("year"),
            F.transform("author", lambda a: a["name"]).alias("authors"), S.doi(F.coalesce(F.col("`arxiv:doi`"), F.col("doi"), by_link)).alias("doi"), pdf.alias("pdf_url"),
            F.transform("category", lambda c: c["_term"]).alias("keywords"), F.lit("arxiv").alias("source"),
        )
    )


def from_dblp(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """DBLP search hits as papers (S9): the title's last full stop is cut, the DOI taken from ``ee`` where it is absent."""
    schema = "_id string, info struct<authors:struct<author:array<string>>,title:string,venue:string,year:int,doi:string,ee:string,url:string>"
    i = _xml(spark, source, "hit", schema).select(F.col("_id").alias("paper_id"), "info.*")
    in_ee = F.when(F.col("ee").contains("doi.org/"), F.col("ee"))
    return conform(
        i.select("paper_id", F.regexp_replace(_flat(F.col("title")), r"\.$", "").alias("title"), F.col("authors.author").alias("authors"), "year", F.col("venue").alias("journal"), S.doi(F.coalesce("doi", in_ee)).alias("doi"), "url", F.lit("dblp").alias("source"))
    )


def from_pubmed(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """PubmedArticle records as papers (S8): labelled abstract parts joined, MeSH and author keywords, DOI from its location id."""
    article = (
        "ArticleTitle:string,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,CollectiveName:string>>>,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:int>>>,"
        "ArticleDate:struct<Year:int>,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,ELocationID:array<struct<_EIdType:string,_VALUE:string>>,PublicationTypeList:struct<PublicationType:array<string>>"
    )
    schema = f"MedlineCitation struct<PMID:string,Article:struct<{article}>,MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:string>>>,KeywordList:struct<Keyword:array<string>>>"
    m = _xml(spark, source, "PubmedArticle", schema).select("MedlineCitation.*")
    name = lambda a: F.coalesce(F.concat_ws(", ", F.array_compact(F.array(a["LastName"], F.when(a["LastName"].isNotNull(), a["ForeName"])))), F.lit(""))
    full = lambda a: F.when(a["LastName"].isNull(), a["CollectiveName"]).otherwise(name(a))
    a = F.col("Article")
    part = lambda t: F.when(t["_Label"].isNotNull(), F.concat(t["_Label"], F.lit(": "), t["_VALUE"])).otherwise(t["_VALUE"])
    none = F.array().cast("array<string>")
    mesh = F.coalesce(F.transform(F.col("MeshHeadingList.MeshHeading"), lambda h: h["DescriptorName"]), none)
    doi = F.get(F.transform(F.filter(a["ELocationID"], lambda x: x["_EIdType"] == "doi"), lambda x: x["_VALUE"]), F.lit(0))
    return conform(
        m.select(
            F.col("PMID").alias("paper_id"), a["ArticleTitle"].alias("title"), F.transform(a["AuthorList"]["Author"], full).alias("authors"),
            F.array_join(F.transform(a["Abstract"]["AbstractText"], part), " ").alias("abstract"), F.coalesce(a["ArticleDate"]["Year"], a["Journal"]["JournalIssue"]["PubDate"]["Year"]).alias("year"),
            a["Journal"]["Title"].alias("journal"), S.doi(doi).alias("doi"), F.concat(mesh, F.coalesce(F.col("KeywordList.Keyword"), none)).alias("keywords"), F.lit("pubmed").alias("source"),
        )
    )


def graph_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a GraphML or GEXF file."""
    v = spark.read.format("xml").option("rowTag", "node").schema("_id string, _label string").load(path).select(F.col("_id").alias("id"), F.col("_label").alias("label"))
    e = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, _weight double").load(path)
    return v, e.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce("_weight", F.lit(1.0)).alias("weight"))


def citations_in_pages(pages: DataFrame) -> DataFrame:
    """Distinct identifiers in page HTML (S12): DOIs, arXiv ids, PMIDs and links."""
    kinds = {"doi": r"(10\.\d{4,9}/[^\s\"'<>&]+)", "arxiv": r"arxiv\.org/abs/(\d{4}\.\d{4,5})", "pmid": r"pubmed/(\d{5,9})", "url": r"href=\"([^\"]+)\""}
    found = F.explode(F.concat(*[F.transform(F.regexp_extract_all("html", F.lit(p), F.lit(1)), _named(k)) for k, p in kinds.items()]))
    return pages.select("page_id", found.alias("x")).select("page_id", "x.kind", "x.value").distinct()


def _named(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def csv_rows(papers: DataFrame, columns: list[str]) -> DataFrame:
    """Spreadsheet-safe text columns, lists joined by '; ' (S13)."""
    types = dict(papers.dtypes)
    return papers.select(*[S.safe_cell(F.concat_ws("; ", c) if types[c].startswith("array") else F.col(c).cast("string")).alias(c) for c in columns])


def ris_records(papers: DataFrame) -> DataFrame:
    """One RIS record per paper."""
    line = lambda tag, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{tag}  - "), c))
    kind = F.when(F.col("paper_type").contains("conference"), "CONF").when(F.col("paper_type").contains("book"), "BOOK").otherwise("JOUR")
    many = lambda tag, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{tag}  - "), x))
    parts = F.concat(F.array(line("TY", kind), line("TI", F.col("title"))), many("AU", "authors"), F.array(line("PY", F.col("year").cast("string")), line("JO", F.col("journal")), line("DO", F.col("doi"))), many("KW", "keywords"), F.array(F.lit("ER  - ")))
    return papers.select("paper_id", F.concat_ws("\n", parts).alias("value"))


def bibtex_records(papers: DataFrame) -> DataFrame:
    """One BibTeX entry per paper with a unique key."""
    from pyspark.sql.window import Window

    esc = lambda c: F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")
    key = S.citekey(F.coalesce(F.get("authors", F.lit(0)), F.lit("anon")), F.col("year"), F.coalesce("title", F.lit("")))
    n = F.row_number().over(Window.partitionBy("key").orderBy("paper_id"))
    x = papers.withColumn("key", key).withColumn("n", n).withColumn("key", F.when(F.col("n") == 1, F.col("key")).otherwise(F.concat("key", F.lit("_"), "n")))
    field = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    body = F.concat_ws(",\n", field("title", esc(F.col("title"))), field("author", F.concat_ws(" and ", "authors")), field("year", F.col("year").cast("string")), field("journal", esc(F.col("journal"))), field("doi", F.col("doi")), field("pages", F.regexp_replace("pages", "-+", "--")))
    kind = F.when(F.col("paper_type").contains("conference"), "inproceedings").otherwise("article")
    return x.select("paper_id", F.concat(F.lit("@"), kind, F.lit("{"), F.col("key"), F.lit(",\n"), body, F.lit("\n}")).alias("value"))


def csl_records(papers: DataFrame) -> DataFrame:
    """CSL-JSON object per paper."""
    a = F.transform("authors", lambda n: F.struct(n.alias("literal")))
    return papers.select("paper_id", F.to_json(F.struct(F.col("paper_id").alias("id"), F.lit("article-journal").alias("type"), "title", a.alias("author"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"), F.col("journal").alias("container-title"), F.col("doi").alias("DOI"))).alias("value"))


def edge_lines(edges: DataFrame, sep: str = " ") -> DataFrame:
    """Edge-list text lines."""
    return edges.select(F.concat_ws(sep, "src", "dst", "weight").alias("value"))


def read_edge_lines(lines: DataFrame, sep: str = r"\s+") -> DataFrame:
    p = F.split(F.trim("value"), sep)
    return lines.filter("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(p[0].alias("src"), p[1].alias("dst"), F.coalesce(F.get(p, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("weight"))


def adjacency_lines(edges: DataFrame) -> DataFrame:
    """``u n1 n2 ...`` lines."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("n")).select(F.concat_ws(" ", F.col("src").cast("string"), F.transform("n", lambda x: x.cast("string"))).alias("value"))


def read_adjacency_lines(lines: DataFrame) -> DataFrame:
    """Edges src, dst. A line is split once, and neither it nor its parts are carried along with every neighbour."""
    p = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    return p.select(F.col("p")[0].alias("src"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("n")).select("src", F.explode("n").alias("dst"))


def json_links(edges: DataFrame) -> DataFrame:
    """One JSON link per row, as in node-link and D3 documents."""
    return edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")).alias("value"))


def read_json_links(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", "source long, target long, weight double").alias("x")).select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"), "x.weight")


def cytoscape_elements(edges: DataFrame) -> DataFrame:
    """One Cytoscape element a line, nodes and edges, as in the ``elements`` list of a document."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    nodes = ids.select(F.to_json(F.struct(F.lit("nodes").alias("group"), F.struct(F.col("id").cast("string").alias("id")).alias("data"))).alias("value"))
    data = F.struct(F.concat_ws("-", "src", "dst").alias("id"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "weight")
    return nodes.union(edges.select(F.to_json(F.struct(F.lit("edges").alias("group"), data.alias("data"))).alias("value")))


def read_cytoscape_edges(lines: DataFrame) -> DataFrame:
    """Edges of Cytoscape element lines (S19); ids that are numbers become numbers."""
    x = lines.select(F.from_json("value", "group string, data struct<source:string,target:string,weight:double>").alias("x")).filter("x.group = 'edges'")
    return x.select(F.col("x.data.source").try_cast("long").alias("src"), F.col("x.data.target").try_cast("long").alias("dst"), F.coalesce("x.data.weight", F.lit(1.0)).alias("weight"))
