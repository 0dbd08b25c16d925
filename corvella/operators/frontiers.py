"""Research fronts and frontiers: sparse regions of vectors, rising topics, coupled groups of papers, and their change over years."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.operators import graph as G
from corvella.operators.networks import pair_counts
from corvella.operators.topics import vector_features
from corvella.operators.trends import multi_level_bursts, nearest
from corvella.plans.components import components
from corvella.plans.storage import materialise

SAME_REGION = 0.7


def topic_series(topics: DataFrame, years: DataFrame) -> DataFrame:
    """(topic, year, count): summed topic weights per year, years without papers as 0."""
    x = topics.join(years, "doc_id").select("year", F.posexplode("topics").alias("topic", "w"))
    n = x.groupBy("topic", "year").agg(F.sum("w").alias("w"))
    span = years.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    grid = n.select("topic").distinct().join(F.broadcast(span))  # a row per year
    return grid.join(n, ["topic", "year"], "left").select("topic", "year", F.coalesce("w", F.lit(0.0)).alias("count"))


def topic_bursts(topics: DataFrame, years: DataFrame, s: float = 2.0, threshold: float = 1.2) -> DataFrame:
    """Bursts of topic weight."""
    return multi_level_bursts(topic_series(topics, years), "topic", s=s, threshold=threshold)


def _mean_vectors(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., centroid): unit-scaled mean of ``v``."""
    m = rows.select(*by, F.posexplode("v").alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    c = m.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return c.select(*by, F.transform("c", lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sparse_regions(vectors: DataFrame, years: DataFrame, quantile: float = 0.2, dense: int = 8, regions: int = 8, k: int = 5, lookback: int = 3, seed: int = 42) -> DataFrame:
    """Regions at the border of what is known (B16): region, papers, novelty, growth, neighbours, centroid.

    A paper's sparseness is its mean cosine distance to the ``k`` nearest; the sparsest ``quantile`` are grouped, the rest gives
    ``dense`` centroids. Novelty is a group's sparseness over twice the median, growth the share of its last years.
    """
    near = nearest(vectors, vectors, k)
    far = materialise(near.groupBy(F.col("query_id").alias("vec_id")).agg((1 - F.avg("score")).alias("far")), "sparseness")
    cut, median = far.agg(F.percentile("far", F.lit(1 - quantile)), F.percentile("far", F.lit(0.5))).first()
    x = vector_features(vectors).join(far, "vec_id").select("vec_id", "features", "far")
    border = x.filter(F.col("far") >= (cut or 0.0))
    n = border.count()
    if n < 2:
        return vectors.sparkSession.createDataFrame([], "region int, papers long, novelty double, growth double, neighbours array<int>, centroid array<double>")
    groups = BisectingKMeans(k=max(2, min(regions, n)), seed=seed, distanceMeasure="cosine", featuresCol="features", predictionCol="region").fit(border).transform(border)
    groups = materialise(groups.select("vec_id", "region", "far", vector_to_array("features").alias("v")), "border-groups")
    inner = x.filter(F.col("far") < cut)
    inner = x if inner.count() < dense else inner
    known = KMeans(k=dense, seed=seed, featuresCol="features").fit(inner).clusterCenters()  # ``dense`` vectors
    known = vectors.sparkSession.createDataFrame([(i, [float(z) for z in c]) for i, c in enumerate(known)], "known int, v array<double>")
    centre = _mean_vectors(groups, ["region"])
    closest = centre.join(F.broadcast(known)).groupBy("region").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-dot(F.col("centroid"), F.col("v"))).alias("d"), "known"))), 1, 5), lambda s: s["known"]).alias("neighbours"))  # regions x dense
    y = groups.join(years, "vec_id", "left")
    last = y.groupBy("region").agg(F.max("year").alias("last"))
    recent = F.avg(F.when(F.col("year").isNotNull(), (F.col("year") > F.col("last") - lookback).cast("double")))
    g = y.join(last, "region").groupBy("region").agg(F.count(F.lit(1)).alias("papers"), F.avg("far").alias("far"), F.coalesce(recent, F.lit(0.0)).alias("growth"))
    novelty = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("far") / (2 * median))) if median > 0 else F.lit(0.5)
    return g.join(closest, "region").join(centre, "region").select("region", "papers", novelty.alias("novelty"), "growth", "neighbours", "centroid")


def growth_rate(counts: DataFrame, key: str, lookback: int = 3) -> DataFrame:
    """(key, growth): mean yearly growth over the last ``lookback`` years that have papers. Input: key, year, n."""
    recent = Window.partitionBy(key).orderBy(F.desc("year"))
    x = counts.withColumn("age", F.row_number().over(recent)).filter(F.col("age") <= lookback)
    was = F.lag("n").over(Window.partitionBy(key).orderBy("year"))
    rate = (F.col("n") - F.greatest(was, F.lit(1))) / F.greatest(was, F.lit(1))
    return x.withColumn("rate", F.when(was.isNotNull(), rate)).groupBy(key).agg(F.coalesce(F.avg("rate"), F.lit(0.0)).alias("growth"))


def boundary_topics(topics: DataFrame, years: DataFrame, least: float = 0.02, most: float = 0.15, lookback: int = 3) -> DataFrame:
    """Topics that are dominant in few papers and grow (B17): topic, papers, prevalence, growth, novelty. topics: doc_id, topics."""
    top = F.array_position("topics", F.array_max("topics")).cast("int") - 1
    d = topics.select("doc_id", top.alias("topic"))
    n = d.agg(F.count(F.lit(1)).alias("n"))
    size = d.groupBy("topic").agg(F.count(F.lit(1)).alias("papers")).join(F.broadcast(n)).withColumn("prevalence", F.col("papers") / F.col("n"))  # one row
    rate = growth_rate(d.join(years, "doc_id").groupBy("topic", "year").agg(F.count(F.lit(1)).alias("n")), "topic", lookback)
    x = size.filter(F.col("prevalence").between(least, most)).join(rate, "topic", "left").na.fill(0.0, ["growth"])
    novelty = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * (1 - F.col("prevalence") / most) + 0.5 * F.least(F.col("growth"), F.lit(1.0))))
    return x.select("topic", "papers", "prevalence", "growth", novelty.alias("novelty"))


def match_regions(regions: DataFrame, lookback: int = 1, same: float = SAME_REGION) -> DataFrame:
    """(year, region, best): largest cosine with a region of the ``lookback`` years before, 0 without one.

    Input: year, region, centroid (unit length); a year holds a few regions.
    """
    before = regions.select(F.col("year").alias("y"), F.col("centroid").alias("c"))
    shifted = before.select(F.explode(F.sequence(F.col("y") + 1, F.col("y") + lookback)).alias("year"), "c")
    best = regions.join(shifted, "year").groupBy("year", "region").agg(F.max(dot(F.col("centroid"), F.col("c"))).alias("best"))
    x = regions.select("year", "region").join(best, ["year", "region"], "left").select("year", "region", F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)).alias("best"))
    return x.withColumn("matched", F.col("best") >= same)


def fading_regions(regions: DataFrame, lookback: int = 3, same: float = SAME_REGION) -> DataFrame:
    """(year, from_year, region): regions of the ``lookback`` years before that have no match in the year."""
    prior = regions.select(F.col("year").alias("from_year"), "region", "centroid")
    last = regions.agg(F.max("year").alias("last"))
    asked = prior.join(F.broadcast(last)).select("from_year", "region", "centroid", F.explode(F.sequence(F.col("from_year") + 1, F.least(F.col("from_year") + lookback, F.greatest(F.col("last"), F.col("from_year") + 1)))).alias("year"), "last").filter("year <= last")  # one row
    hit = asked.join(regions.select("year", F.col("centroid").alias("c")), "year").filter(dot(F.col("centroid"), F.col("c")) >= same).select("year", "from_year", "region").distinct()
    return asked.select("year", "from_year", "region").join(hit, ["year", "from_year", "region"], "left_anti")


def coupling(references: DataFrame) -> DataFrame:
    """(src, dst, weight): papers by the references they share."""
    return pair_counts(references, "ref", "paper_id").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def structural_variation(references: DataFrame, years: DataFrame, width: int = 3, passes: int | None = None, levels: int | None = None) -> DataFrame:
    """(bin, papers, communities, modularity, change) of the coupling graph of each bin of years (N11), all bins in one run.

    A bin is split by moves towards higher modularity where its graph is connected, else by components; communities are
    scored without weights. ``passes`` and ``levels`` bound the moves (``graph.louvain_many``); without them they go on to the end.
    """
    b = (F.floor(F.col("year") / width) * width).cast("int")
    rows = references.join(years.select("paper_id", b.alias("bin")), "paper_id").select(F.struct("bin", "ref").alias("of"), F.struct("bin", "paper_id").alias("paper"))
    pairs = materialise(pair_counts(rows, "of", "paper"), "bin-coupling")
    c = materialise(components(pairs, "a", "b").select(F.col("id.bin").alias("part"), F.col("id.paper_id").alias("id"), F.col("component.paper_id").alias("label")), "bin-components")
    flat = pairs.select(F.col("a.bin").alias("part"), F.col("a.paper_id").alias("src"), F.col("b.paper_id").alias("dst"), F.lit(1).alias("weight"))
    whole = c.groupBy("part").agg(F.count_distinct("label").alias("n")).filter("n = 1").select("part")
    labels = G.louvain_many(flat.join(whole, "part", "left_semi"), passes=passes, levels=levels).unionByName(c.join(whole, "part", "left_anti"))
    q = G.modularities(flat, labels).join(c.groupBy("part").agg(F.count(F.lit(1)).alias("papers")), "part")
    t = q.select(F.col("part").alias("bin"), "papers", "communities", "modularity")
    return t.withColumn("change", F.col("modularity") - F.lag("modularity").over(Window.orderBy("bin")))  # one row per bin


def research_fronts(references: DataFrame, terms: DataFrame, bursts: DataFrame, k: int = 10, method: str = "spectral", top_terms: int = 5, least: int = 2) -> DataFrame:
    """(front, papers, burst, terms): groups of coupled papers with summed burst scores and commonest terms.

    method: ``spectral`` (``k`` groups by power iteration) or ``communities`` (G9). terms: paper_id, term; bursts: term, burst. Fronts of fewer than ``least`` papers are none.
    """
    e = materialise(coupling(references), "front-edges")
    label = G.spectral_groups(e, k) if method == "spectral" else G.louvain(e)
    label = materialise(label.select(F.col("id").alias("paper_id"), F.col("label").alias("front")), "fronts")
    size = label.groupBy("front").agg(F.count(F.lit(1)).alias("papers")).filter(F.col("papers") >= least)
    n = label.join(terms, "paper_id").groupBy("front", "term").agg(F.count(F.lit(1)).alias("n"))
    heat = n.join(bursts, "term").groupBy("front").agg(F.sum(F.col("n") * F.col("burst")).alias("burst"))
    best = Window.partitionBy("front").orderBy(F.desc("n"), "term")
    top = n.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top_terms).groupBy("front").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))
    return size.join(heat, "front", "left").na.fill(0.0, ["burst"]).join(top, "front", "left")
