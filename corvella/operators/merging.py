"""Search predicates, joins between sources, merging and de-duplication of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.functions import scalars as S
from corvella.plans.components import components
from corvella.plans.storage import materialise


def _is(value):
    return lambda x: x == value


def _absent_from(array: Column):
    return lambda v: ~F.exists(array, lambda u: F.lower(u) == F.lower(v))


def list_papers(papers: DataFrame, columns: list[str], query: str, limit: int, offset: int = 0) -> DataFrame:
    """Substring match in any column, newest first, one page (F1). Filters run before paging."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c).cast("string")), F.lit(query.lower())) for c in columns])
    return papers.filter(hit).orderBy(F.desc("year"), "paper_id").offset(offset).limit(limit)


def search_advanced(papers: DataFrame, authorship: DataFrame, years: tuple[int, int] | None = None, source: str | None = None, authors: Column | None = None) -> DataFrame:
    """AND of the given conditions; authors through a semi join (F2)."""
    out = papers
    if years:
        out = out.filter(F.col("year").between(*years))
    if source:
        out = out.filter(F.lower("source") == source.lower())
    return out if authors is None else out.join(authorship.filter(authors), "paper_id", "left_semi")


def paged(rows: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """A page with the total and the number of pages."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    part = rows.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    return part.join(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / per_page))  # one row


def suggest(titles: DataFrame, column: str, prefix: str, n: int) -> DataFrame:
    """Distinct values with a word that begins with the query's last token."""
    last = prefix.lower().split()[-1]
    hit = F.exists(F.split(F.lower(column), r"\s+"), lambda w: w.startswith(last))
    return titles.filter(hit).select(column).distinct().orderBy(column).limit(n)


def by_ids(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows for ``ids`` in their order (F8)."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, {key} {rows.schema[key].dataType.simpleString()}")
    return rows.join(F.broadcast(wanted), key).orderBy("pos")  # the caller's own list


def in_range_or_unknown(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows without a year pass."""
    return rows.filter(F.col("year").isNull() | F.col("year").between(lo, hi))


def orphans(papers: DataFrame, cites: DataFrame) -> DataFrame:
    """Papers without any edge (F7): two anti joins."""
    return papers.join(cites, papers.paper_id == cites.src, "left_anti").join(cites, F.col("paper_id") == cites.dst, "left_anti")


def bm25(docs: DataFrame, query: list[str], limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over (doc_id, tokens); every query token must occur (F5). Only query tokens are exploded."""
    terms = sorted(set(query))
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avg_len"))
    tf = docs.select("doc_id", F.size("tokens").alias("len"), F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.size(F.filter("tokens", _is(t))).alias("tf")) for t in terms])).alias("x")).select("doc_id", "len", "x.*").filter("tf > 0")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = tf.join(F.broadcast(df), "term").join(F.broadcast(n))  # a row per query token, and one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return x.groupBy("doc_id").agg(F.sum(s).alias("score"), F.count(F.lit(1)).alias("hits")).filter(F.col("hits") == len(terms)).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(limit)


def similar_papers(base: DataFrame, items: list[tuple[DataFrame, str, float]], papers: DataFrame, limit: int) -> DataFrame:
    """Papers scored against one base paper by shared items, journal and year gap (J5). ``base`` is one row of papers."""
    b = base.select(F.col("paper_id").alias("b_id"), F.col("journal").alias("b_journal"), F.col("year").alias("b_year"))
    parts = []
    for rows, item, weight in items:
        own = rows.join(F.broadcast(b), F.col("paper_id") == F.col("b_id")).select(item)  # one paper's items
        parts.append(rows.join(own, item, "left_semi").select("paper_id", F.lit(float(weight)).alias("s")))
    shared = reduce(DataFrame.union, parts).groupBy("paper_id").agg(F.sum("s").alias("s"))
    x = papers.join(shared, "paper_id").join(F.broadcast(b)).filter("paper_id <> b_id")
    score = F.col("s") + F.when(F.col("journal") == F.col("b_journal"), 1.0).otherwise(0.0) + F.greatest(F.lit(0.0), 0.5 - 0.05 * F.abs(F.col("year") - F.col("b_year")))
    return x.select("paper_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "paper_id").limit(limit)


def resolve_titles(wanted: DataFrame, known: DataFrame, least: float = 0.3) -> DataFrame:
    """Best known title of each wanted one by token Jaccard (J6), halved where years differ by more than one and times 0.8 where one is unknown.

    Inputs: id, tokens, year. Only pairs that reach ``least`` before the years count are scored, through a set-similarity join; none is left out.
    """
    from corvella.operators.similarity import similar_to

    pairs = similar_to(wanted, known, least)
    x = pairs.join(wanted.select(F.col("id").alias("a"), F.col("year").alias("wy")), "a").join(known.select(F.col("id").alias("b"), F.col("year").alias("ky")), "b")
    s = F.col("similarity") * F.when(F.col("wy").isNull() | F.col("ky").isNull(), 0.8).when(F.abs(F.col("wy") - F.col("ky")) > 1, 0.5).otherwise(1.0)
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return x.withColumn("score", s).filter(F.col("score") >= least).withColumn("r", F.row_number().over(best)).filter("r = 1").select(F.col("a").alias("id"), F.col("b").alias("match"), "score")


def enrich(left: DataFrame, source: DataFrame, key: str, scalars: list[str], numbers: list[str], lists: list[str]) -> DataFrame:
    """Left values stay, empty ones are filled, counts take the larger, lists unite case-insensitively."""
    s = source.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in [*scalars, *numbers, *lists]])
    x = left.join(s, F.col(key) == F.col("_k"), "left")
    made = [F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.col(f"_{c}")).alias(c) for c in scalars]
    made += [F.greatest(c, f"_{c}").alias(c) for c in numbers]
    for c in lists:
        a, b = F.coalesce(F.col(c), F.array().cast("array<string>")), F.coalesce(F.col(f"_{c}"), F.array().cast("array<string>"))
        made.append(F.concat(a, F.filter(b, _absent_from(a))).alias(c))
    return x.select(key, *made)


def discrepancies(left: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, kept, other) where both have a value and they differ."""
    s = source.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    x = left.join(s, F.col(key) == F.col("_k"))
    packed = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("kept"), F.col(f"_{c}").cast("string").alias("other")) for c in columns]))
    return x.select(key, packed.alias("d")).select(key, "d.*").filter("kept IS NOT NULL AND other IS NOT NULL AND kept <> other")


def union_citations(lists: DataFrame) -> DataFrame:
    """Union of (doi, source_rank): the spelling of the best source per case-insensitive DOI."""
    return lists.groupBy(F.lower("doi").alias("key")).agg(F.min_by("doi", F.struct("source_rank", "doi")).alias("doi"), F.count_distinct("source_rank").alias("sources"))


def best_location(locations: DataFrame) -> DataFrame:
    """Best open-access location per DOI: version rank, then having a PDF."""
    rank = F.when(F.col("version") == "publishedVersion", 0).when(F.col("version") == "acceptedVersion", 1).otherwise(2)
    w = Window.partitionBy("doi").orderBy(rank, F.when(F.col("pdf_url").isNotNull(), 0).otherwise(1), "url")
    return locations.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def compare_snapshots(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """added, removed and changed rows between two snapshots."""
    x = a.select(F.col(key).alias("ka"), F.struct(*columns).alias("before"))
    y = b.select(F.col(key).alias("kb"), F.struct(*columns).alias("after"))
    z = x.join(y, x.ka == y.kb, "full_outer")
    what = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return z.select(F.coalesce("ka", "kb").alias(key), what.alias("change")).filter("change IS NOT NULL")


def restore(members: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Membership to restore, with the ids that no longer exist marked."""
    kept = members.join(present.select(key), key, "left_semi").select(key, F.lit(True).alias("present"))
    return kept.unionByName(members.join(present.select(key), key, "left_anti").select(key, F.lit(False).alias("present")))


def merge_records(records: DataFrame, lists: list[str] = ()) -> DataFrame:
    """First record per DOI wins; records without DOI match on title.

    Records: seq, doi, title, citations_count and more. Empty fields are filled from later records in order
    of seq; the citation count is the largest.
    """
    d = F.when(S.doi(F.col("doi")) != "", S.doi(F.col("doi")))
    r = records.withColumn("_doi", d).withColumn("_title", S.title_key(F.col("title"), strict=True))
    titled = r.filter("_doi IS NOT NULL AND _title <> ''").groupBy("_title").agg(F.min_by("_doi", "seq").alias("_by_title"))
    gid = F.coalesce(F.concat(F.lit("d:"), F.coalesce("_doi", "_by_title")), F.when(F.col("_title") != "", F.concat(F.lit("t:"), "_title")), F.concat(F.lit("s:"), "seq"))
    keyed = r.join(titled, "_title", "left").withColumn("_gid", gid)
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.col("seq")))
    plain = [c for c in records.columns if c not in ("seq", "citations_count", *lists)]
    aggs = [F.min("seq").alias("seq"), F.max("citations_count").alias("citations_count"), F.count(F.lit(1)).alias("merged"), *[first(c).alias(c) for c in plain], *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in lists]]
    return keyed.groupBy("_gid").agg(*aggs).drop("_gid")


def new_records(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming records that are neither empty nor known by DOI or title (D3), one per DOI or title."""
    key = F.coalesce(F.when(S.doi(F.col("doi")) != "", S.doi(F.col("doi"))), F.when(S.title_key(F.col("title")) != "", S.title_key(F.col("title"))))
    x = incoming.withColumn("_k", key).filter("_k IS NOT NULL")
    known = existing.select(F.explode(F.array(S.doi(F.col("doi")), S.title_key(F.col("title")))).alias("_k")).filter("_k <> ''")
    once = Window.partitionBy("_k").orderBy("seq")
    return x.join(known, "_k", "left_anti").withColumn("_r", F.row_number().over(once)).filter("_r = 1").drop("_k", "_r")


def auto_dedup(records: DataFrame) -> DataFrame:
    """Keeper and group size by connected DOI and title matches (D4); the keeper is the smallest seq."""
    keys = records.select("seq", F.explode(F.array(F.concat(F.lit("d:"), S.doi(F.col("doi"))), F.concat(F.lit("t:"), S.title_key(F.col("title"))))).alias("k")).filter("length(k) > 2")
    lead = keys.groupBy("k").agg(F.min("seq").alias("lead"))
    edges = keys.join(lead, "k").select(F.col("lead").alias("src"), F.col("seq").alias("dst"))
    c = components(edges)
    x = materialise(records.select("seq").join(c, records.seq == c.id, "left").select("seq", F.coalesce("component", "seq").alias("keeper")), "keepers")
    return x.join(x.groupBy("keeper").agg(F.count(F.lit(1)).alias("group_size")), "keeper").select("seq", "keeper", "group_size")


def compare_projects(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """Counts of shared, only-a and only-b items."""
    x, y = a.select(item).distinct().withColumn("in_a", F.lit(1)), b.select(item).distinct().withColumn("in_b", F.lit(1))
    part = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").otherwise("shared")
    return x.join(y, item, "full_outer").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


def compare_frontiers(a: DataFrame, b: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """Keywords frequent in b and rare in a (D6). Inputs: keyword, df; corpus sizes."""
    x = b.join(a.withColumnRenamed("df", "df_a"), "keyword", "left").na.fill(0, ["df_a"])
    ra, rb = F.col("df_a") / n_a, F.col("df") / n_b
    keep = (F.col("df") >= F.greatest(F.lit(2.0), F.lit(0.05 * n_b))) & (F.col("df_a") <= F.greatest(F.lit(1.0), F.lit(0.005 * n_a)))
    return x.filter(keep).select("keyword", (1 - F.least(F.lit(1.0), ra / rb)).alias("novelty"), rb.alias("importance"))


def collapse_similar(items: DataFrame, least: float = 0.5) -> DataFrame:
    """Items (id, keywords, score) whose keyword sets overlap by ``least`` collapse to the best scored.

    The classes are connected components, which does not depend on the order of the input.
    """
    from corvella.operators.similarity import similar_sets

    c = components(similar_sets(items.select("id", F.col("keywords").alias("tokens")), least), "a", "b")
    y = items.join(c.withColumnRenamed("id", "v"), items.id == F.col("v"), "left").withColumn("cls", F.coalesce("component", "id"))
    return y.groupBy("cls").agg(F.max_by("id", F.struct("score", F.negative("id"))).alias("id"), F.count(F.lit(1)).alias("members")).select("id", "members")


def common_neighbours(edges: DataFrame, a, b, side: str = "dst") -> DataFrame:
    """Shared references (dst) or shared citers (src) of two papers."""
    other = "src" if side == "dst" else "dst"
    return edges.filter(F.col(other) == F.lit(a)).select(side).intersect(edges.filter(F.col(other) == F.lit(b)).select(side))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows and the incoming ones whose key is new; known keys keep the existing row."""
    fresh = incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.withColumn("state", F.lit("kept")).unionByName(fresh.withColumn("state", F.lit("added")))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources in one frame, missing columns null, with the name of each."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(name)) for name, df in sources.items()])
