"""Themes of texts by co-occurring terms, themes of studies, and key sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.operators.trends import sentences
from corvella.plans.storage import materialise


def words(text: Column) -> Column:
    """Lower-case letter runs of three or more."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))


def _clusters(seeds: list[str], together: dict[tuple[str, str], int], most: int) -> list[list[str]]:
    """Seeds in order: each joins the theme it meets most often (at least twice with some member), or starts one."""
    out: list[list[str]] = []
    for s in seeds:
        met = [max(together.get((min(s, t), max(s, t)), 0) for t in c) for c in out]
        best = max(range(len(out)), key=lambda i: (met[i], -i), default=None)
        if best is not None and met[best] >= 2:
            out[best].append(s)
        elif len(out) < most:
            out.append([s])
    return out


def themes(texts: DataFrame, most: int = 10, quotes: int = 5, quote_chars: int = 200) -> DataFrame:
    """(theme, terms, support, quotes) of (id, text) (T14). Terms and their pairs are counted by Spark; only the 3 * ``most``
    commonest terms, as seeds, and their pair counts come to the driver to be grouped."""
    rows = materialise(texts.select("id", "text", F.array_distinct(words(F.col("text"))).alias("terms")), "theme-terms")
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    seeds = [r.term for r in df.orderBy(F.desc("n"), "term").limit(3 * most).collect()]
    mine = rows.select("id", F.array_sort(F.array_intersect("terms", F.array(*map(F.lit, seeds)) if seeds else F.array().cast("array<string>"))).alias("s"))
    pairs = mine.select(F.posexplode("s").alias("i", "a"), "s").select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).groupBy("a", "b").count()
    together = {(r.a, r.b): r["count"] for r in pairs.collect()}  # at most (3 * most) ** 2 / 2 rows
    made = [(c[0], c) for c in _clusters(seeds, together, most)]
    table = texts.sparkSession.createDataFrame(made, "theme string, terms array<string>")
    hits = rows.join(F.broadcast(table.select("theme", F.col("terms").alias("codes"))), F.arrays_overlap("terms", "codes"))  # at most ``most`` themes
    first = Window.partitionBy("theme").orderBy("id")
    top = hits.select("theme", "id", F.substring(F.trim("text"), 1, quote_chars).alias("quote")).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= quotes)
    said = top.groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "quote"))), lambda x: x["quote"]).alias("quotes"))
    n = hits.groupBy("theme").agg(F.count(F.lit(1)).alias("support"))
    return table.join(n, "theme").join(said, "theme").select("theme", "terms", "support", "quotes")


def study_themes(studies: DataFrame, fields: list[str], most: int = 10) -> DataFrame:
    """(theme, sub_theme, support) edges of themes that two studies or more hold, from all finding ``fields`` of (study_id, ...)."""
    t = themes(studies.select(F.col("study_id").alias("id"), F.concat_ws(" ", *fields).alias("text")), most).filter("support >= 2")
    return t.select("theme", F.explode_outer(F.slice("terms", 2, F.size("terms"))).alias("sub_theme"), "support")


def key_quotes(docs: DataFrame, n: int = 3, same_chars: int = 80) -> DataFrame:
    """(doc_id, rank, pos, relevance): the sentences most like all sentences of their text.

    Sentences are unit vectors of word counts; the mean similarity to all of them is the product with the
    mean vector. Of sentences that start alike, the first is kept; relevance is relative to the best.
    """
    s = sentences(docs)
    c = s.select("doc_id", "pos", F.explode(words(F.col("sentence"))).alias("w")).groupBy("doc_id", "pos", "w").agg(F.count(F.lit(1)).alias("c"))
    norm = c.groupBy("doc_id", "pos").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    x = c.join(norm, ["doc_id", "pos"]).select("doc_id", "pos", "w", (F.col("c") / F.col("norm")).alias("x"))
    mean = x.groupBy("doc_id", "w").agg(F.sum("x").alias("total"))
    size = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))
    score = x.join(mean, ["doc_id", "w"]).groupBy("doc_id", "pos").agg(F.sum(F.col("x") * F.col("total")).alias("s")).join(size, "doc_id").select("doc_id", "pos", F.round(F.col("s") / F.col("sentences"), 9).alias("score"))
    alike = s.groupBy("doc_id", F.lower(F.substring("sentence", 1, same_chars)).alias("start")).agg(F.min("pos").alias("pos"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    top = score.join(alike.select("doc_id", "pos"), ["doc_id", "pos"], "left_semi").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    most = F.max("score").over(Window.partitionBy("doc_id"))
    return top.select("doc_id", "rank", "pos", F.when(most > 0, F.col("score") / most).otherwise(0.0).alias("relevance"))
