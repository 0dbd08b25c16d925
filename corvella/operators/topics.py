"""Topics, clusters, chunk tables and theme synthesis on Spark ML and long frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.functions import scalars as S
from corvella.operators.graph import both_ways
from corvella.plans.components import components
from corvella.plans.storage import materialise


BUCKETS = 1 << 18


def term_buckets(docs: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(docs with tokens as hash buckets, (bucket, term): the commonest term of each). No term is dropped; the space is bounded."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("string")
    terms = docs.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    names = terms.groupBy(at("term").alias("bucket")).agg(F.max_by("term", F.struct("n", "term")).alias("term"))
    return docs.withColumn("tokens", F.transform("tokens", at)), names


def lda(docs: DataFrame, k: int, words: int = 10, seed: int = 1, rounds: int = 20, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, topics array), (topic, term, weight) of (doc_id, tokens).

    Terms of two documents or more and of at most 95 % of them; of all where that leaves none.
    """
    hashed, names = term_buckets(docs, buckets)
    fit = lambda least, most: CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=buckets, minDF=least, maxDF=most).fit(hashed)
    vocabulary = fit(2.0, 0.95)
    if not vocabulary.vocabulary:
        vocabulary = fit(1.0, 1.0)
    counts = vocabulary.transform(hashed)
    model = LDA(k=k, seed=seed, maxIter=rounds, featuresCol="features").fit(counts)
    buckets_of = docs.sparkSession.createDataFrame(list(enumerate(vocabulary.vocabulary)), "i int, bucket string")  # at most ``buckets`` rows
    top = model.describeTopics(words).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "x"))
    tops = top.select("topic", "rank", F.col("x.termIndices").alias("i"), F.col("x.termWeights").alias("weight")).join(buckets_of, "i").join(names, "bucket")
    return model.transform(counts).select("doc_id", vector_to_array("topicDistribution").alias("topics")), tops.select("topic", "term", "weight")


def non_negative_factors(cells: DataFrame, k: int, tol: float = 1e-4, most: int = 400, seed: int = 1) -> tuple[DataFrame, DataFrame, float]:
    """(row, x array), (col, x array), relative residual: ``cells`` (row, col, w > 0; all others are 0) as rows times columns of ``k`` non-negative factors.

    Multiplicative updates: the zeros count, through the k x k products of each factor with itself; only these and the
    residual reach the driver. Ends when a round lowers the residual by less than ``tol`` of it, an error past ``most`` rounds. Ids may be of any type.
    """
    v = materialise(cells.groupBy("row", "col").agg(F.sum("w").cast("double").alias("w")).filter("w > 0"), "nmf-cells")
    whole = v.agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0
    start = lambda c: F.array(*[(F.pmod(F.xxhash64(F.lit(seed * 1000 + i), F.col(c)), F.lit(1 << 20)) + 1) / float(1 << 20) for i in range(k)])
    rows = materialise(v.select("row").distinct().select("row", start("row").alias("x")), "nmf-rows")
    cols = materialise(v.select("col").distinct().select("col", start("col").alias("x")), "nmf-cols")

    def gram(side: DataFrame) -> list[list[float]]:
        got = side.agg(*[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        return [[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]

    def updated(side: DataFrame, key: str, other: DataFrame, by: str, g: list[list[float]], label: str) -> DataFrame:
        toward = v.join(other.withColumnRenamed("x", "o"), by).groupBy(key).agg(F.array(*[F.sum(F.col("w") * F.col("o")[i]) for i in range(k)]).alias("n"))
        under = [sum((F.col("x")[j] * g[j][i] for j in range(k)), F.lit(1e-12)) for i in range(k)]
        return materialise(side.join(toward, key).select(key, F.array(*[F.col("x")[i] * F.col("n")[i] / under[i] for i in range(k)]).alias("x")), label)

    was = None
    for _ in range(most):
        g_rows = gram(rows)
        cols = updated(cols, "col", rows, "row", g_rows, "nmf-cols")
        g_cols = gram(cols)
        rows = updated(rows, "row", cols, "col", g_cols, "nmf-rows")
        g_rows = gram(rows)
        fit = v.join(rows.withColumnRenamed("x", "r"), "row").join(cols.withColumnRenamed("x", "c"), "col").agg(F.sum(F.col("w") * sum((F.col("r")[i] * F.col("c")[i] for i in range(k)), F.lit(0.0)))).first()[0] or 0.0
        residual = max(whole - 2 * fit + sum(g_rows[i][j] * g_cols[i][j] for i in range(k) for j in range(k)), 0.0) ** 0.5
        if was is None or was - residual >= tol * max(was, 1e-300):
            was = residual
            continue
        return rows, cols, residual / whole**0.5 if whole else 0.0
    raise RuntimeError("factors did not settle")


def nmf(docs: DataFrame, k: int, words: int = 10, seed: int = 1, tol: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, topics), (topic, term, weight) by non-negative factors of tf-idf weights (T2). A topic's words' weights sum to one."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    tf = docs.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("c"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df, "term").join(F.broadcast(n)).select(F.col("doc_id").alias("row"), F.col("term").alias("col"), (F.col("c") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))  # one row
    rows, cols, _ = non_negative_factors(w, k, tol, seed=seed)
    long = cols.select(F.col("col").alias("term"), F.posexplode("x").alias("topic", "weight"))
    best = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    top = long.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= words)
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("topic"))
    return rows.select(F.col("row").alias("doc_id"), F.col("x").alias("topics")), top.select("topic", "term", share.alias("weight"))


def topic_years(topics: DataFrame, years: DataFrame, width: int) -> DataFrame:
    """Mean weight of each topic per year bin (T4)."""
    x = topics.join(years, "doc_id").select(S.bucket_year(F.col("year"), width).alias("bin"), F.posexplode("topics").alias("topic", "w"))
    return x.groupBy("bin", "topic").agg(F.avg("w").alias("weight"), F.count(F.lit(1)).alias("docs"))


def trending_topics(by_year: DataFrame, last: int, window: int = 3) -> DataFrame:
    """(topic, recent, prior, growth): mean weight in the last ``window`` years against the ``window`` before (T4). Input: bin, topic, weight."""
    age = F.lit(last) - F.col("bin")
    g = by_year.groupBy("topic").agg(F.avg(F.when((age >= 0) & (age < window), F.col("weight"))).alias("recent"), F.avg(F.when((age >= window) & (age < 2 * window), F.col("weight"))).alias("prior"))
    return g.select("topic", "recent", "prior", F.when(F.col("prior") > 0, (F.col("recent") - F.col("prior")) / F.col("prior")).alias("growth"))


def coherence(tops: DataFrame, docs: DataFrame) -> DataFrame:
    """(topic, coherence) (T3): words are vectors of normalised pointwise mutual information with the topic's words over
    documents; the mean cosine of words adjacent by weight. Input: topic, term, weight."""
    by = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    t = tops.select("topic", "term", F.row_number().over(by).alias("i"))
    d = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term")).join(F.broadcast(t.select("term").distinct()), "term", "left_semi")  # a few words per topic
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    x = d.select("doc_id", F.col("term").alias("a")).join(d.select("doc_id", F.col("term").alias("b")), "doc_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    df = x.filter("a = b").select(F.col("a").alias("term"), F.col("w").alias("c"))
    left, right = t.select("topic", "i", F.col("term").alias("a")), t.select("topic", F.col("i").alias("j"), F.col("term").alias("b"))
    y = left.join(right, "topic").join(x, ["a", "b"], "left").na.fill(0, ["w"]).join(df.select(F.col("term").alias("a"), F.col("c").alias("ca")), "a").join(df.select(F.col("term").alias("b"), F.col("c").alias("cb")), "b").join(F.broadcast(n))  # one row
    p = F.col("w") / F.col("n")
    npmi = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("w") == 0, -1.0).when(p < 1, F.ln(p * F.col("n") * F.col("n") / (F.col("ca") * F.col("cb"))) / -F.ln(p)).otherwise(1.0)
    v = y.select("topic", "i", "j", npmi.alias("x"))
    nxt = v.select("topic", (F.col("i") - 1).alias("i"), "j", F.col("x").alias("z"))
    cos = v.join(nxt, ["topic", "i", "j"]).groupBy("topic", "i").agg((F.sum(F.col("x") * F.col("z")) / F.sqrt(F.sum(F.col("x") ** 2) * F.sum(F.col("z") ** 2))).alias("cos"))
    return cos.groupBy("topic").agg(F.avg("cos").alias("coherence"))


def tf_idf(docs: DataFrame, features: int = 2048) -> DataFrame:
    """(doc_id, features): (1 + ln tf) * idf of hashed terms of (doc_id, tokens) (T5)."""
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features).transform(docs)
    damped = tf.select("doc_id", array_to_vector(F.transform(vector_to_array("tf"), lambda x: F.when(x > 0, 1 + F.ln(x)).otherwise(0.0))).alias("tf"))
    return IDF(inputCol="tf", outputCol="features").fit(damped).transform(damped).select("doc_id", "features")


def clusters(vectors: DataFrame, k: int, seed: int = 1, top_down: bool = False) -> DataFrame:
    """(…, cluster) by k-means (T5) or bisecting k-means, which stands for hierarchical clustering."""
    kind = BisectingKMeans if top_down else KMeans
    return kind(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors).transform(vectors)


def vector_features(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def silhouettes(vectors: DataFrame, ks: list[int], seed: int = 1) -> DataFrame:
    """Silhouette and within-cluster cost per number of clusters."""
    score, out = ClusteringEvaluator(featuresCol="features", predictionCol="cluster"), []
    for k in ks:
        m = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
        out.append((k, float(score.evaluate(m.transform(vectors))), float(m.summary.trainingCost)))
    return vectors.sparkSession.createDataFrame(out, "k int, silhouette double, cost double")


def optimal_k(scores: DataFrame) -> DataFrame:
    """(k, reason): the best silhouette, or the elbow of the cost (largest second difference) where none is positive."""
    by = Window.orderBy("k")  # one row per number of clusters tried
    bend = F.lag("cost").over(by) - 2 * F.col("cost") + F.lead("cost").over(by)
    x = scores.withColumn("bend", bend)
    best = F.max_by("k", F.struct("silhouette", -F.col("k")))
    elbow = F.max_by(F.when(F.col("bend").isNotNull(), F.col("k")), F.struct(F.coalesce("bend", F.lit(float("-inf"))), -F.col("k")))
    ok = F.max("silhouette") > 0
    return x.agg(F.when(ok, best).otherwise(F.coalesce(elbow, best)).alias("k"), F.when(ok, "silhouette").otherwise("elbow").alias("reason"))


def within(vectors: DataFrame, eps: float, block: int = 2048) -> DataFrame:
    """(a, b) with a < b: all pairs of vectors at most ``eps`` apart (T7), block against block, none left out."""
    vectors = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL")  # a null id would turn a batch of ids into floats
    blocks = max(1, -(-vectors.count() // block))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), own.alias("own"))
    # a block meets itself and every other once: the cell (smaller, larger) holds both
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, "own").alias("p"), F.greatest(o, "own").alias("q")))
    dealt = x.select("vec_id", "v", "own", F.explode(cells).alias("c")).select("c.p", "c.q", "own", "vec_id", "v")

    def near(f: pd.DataFrame) -> pd.DataFrame:
        p, q = f["p"].iloc[0], f["q"].iloc[0]
        one, two = f[f["own"] == p], f[f["own"] == q]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        u, w = (np.stack(s["v"].to_numpy()) for s in (one, two))
        d = (u**2).sum(axis=1)[:, None] + (w**2).sum(axis=1)[None, :] - 2 * u @ w.T
        i, j = np.nonzero(d <= eps * eps + 1e-9)
        exact = np.sqrt(((u[i] - w[j]) ** 2).sum(axis=1)) <= eps  # the product form only proposes
        a, b = one["vec_id"].to_numpy()[i[exact]], two["vec_id"].to_numpy()[j[exact]]
        keep = (a < b) if p == q else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return dealt.groupBy("p", "q").applyInPandas(near, "a long, b long")


def dbscan(vectors: DataFrame, eps: float = 0.5, least: int = 5) -> DataFrame:
    """(id, cluster) of (vec_id, embedding) by density (T7); noise is -1, borders go to the smallest cluster."""
    near = materialise(within(vectors, eps), "eps-pairs")
    points = vectors.select(F.col("vec_id").alias("id"))
    e = both_ways(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    core = e.groupBy("src").agg((F.count(F.lit(1)) + 1).alias("n")).filter(F.col("n") >= least).select(F.col("src").alias("id"))
    inner = e.join(core.select(F.col("id").alias("src")), "src", "left_semi").join(core.select(F.col("id").alias("dst")), "dst", "left_semi")
    c = components(inner.union(core.select("id", F.col("id").alias("dst"))))
    border = e.join(c, e.dst == c.id).groupBy(F.col("src").alias("id")).agg(F.min("component").alias("border"))
    x = points.select("id").join(c, "id", "left").join(border, "id", "left")
    return x.select("id", F.coalesce("component", "border", F.lit(-1)).alias("cluster"))


def chunk_table(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(chunk_id, doc_id, pos, chunk) with an id that re-indexing repeats."""
    x = docs.select("doc_id", F.posexplode(S.word_chunks(F.col("text"), size, overlap)).alias("pos", "chunk"))
    return x.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("chunk_id"), "doc_id", "pos", "chunk")


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by document: chunks of re-indexed documents replace the old ones."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def framework_fit(studies: DataFrame, columns: DataFrame) -> DataFrame:
    """(study_id, framework) where tokens overlap, null framework where none does."""
    s = studies.select("study_id", F.explode(F.array_distinct("tokens")).alias("t"))
    c = columns.select("framework", F.explode(F.array_distinct("tokens")).alias("t"))
    hit = s.join(F.broadcast(c), "t").select("study_id", "framework").distinct()  # a framework has a few dozen words
    return studies.select("study_id").join(hit, "study_id", "left")


def landmark_scores(betweenness: DataFrame, degree: DataFrame, bursts: DataFrame, n: int) -> DataFrame:
    """(0.6 of relative betweenness + 0.4 of relative degree) * (1 + relative burst strength) (K5). bursts: id, burst."""
    x = betweenness.join(degree, "id").join(bursts, "id", "left").na.fill(0, ["burst"])
    top = x.agg(F.max("betweenness").alias("tb"), F.max("degree").alias("td"), F.max("burst").alias("ts"))
    part = lambda c, t: F.col(c) / F.greatest(F.col(t), F.lit(1e-12))
    y = x.join(F.broadcast(top))  # one row
    return y.select("id", ((0.6 * part("betweenness", "tb") + 0.4 * part("degree", "td")) * (1 + part("burst", "ts"))).alias("score")).orderBy(F.desc("score"), "id").limit(n)
