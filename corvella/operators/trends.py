"""Bursts, forecasts, novelty, recommendation and gaps over long yearly series and element frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.functions import scalars as S
from corvella.operators import similarity
from corvella.plans.ordered import cume_dist
from corvella.plans.storage import materialise


def fill_years(counts: DataFrame, key: str, last: int | None = None) -> DataFrame:
    """Dense yearly series from each key's first year to its last, or to ``last`` (B6): key, year, count."""
    span = counts.groupBy(key).agg(F.min("year").alias("a"), F.max("year").alias("b"))
    end = F.col("b") if last is None else F.greatest(F.col("b"), F.lit(last))
    years = span.select(key, F.explode(F.sequence("a", end)).alias("year"))
    return years.join(counts, [key, "year"], "left").select(key, "year", F.coalesce("count", F.lit(0)).alias("count"))


def _runs(series: DataFrame, key: str, find, out: str) -> DataFrame:
    """Runs of years found in all series at once: ``find`` takes counts (series by years) of series of one length and gives
    (series, first, last, values) of the runs. A batch holds one row per series, whatever the number of keys."""
    kind = series.schema[key].dataType.simpleString()
    columns = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for _, same in f.groupby(f["years"].str.len()):
                years = np.stack(same["years"].to_numpy())
                at, first, last, values = find(np.stack(same["counts"].to_numpy()).astype(float))
                made = {key: same[key].to_numpy()[at], "start": years[at, first], "end": years[at, last]}
                yield pd.DataFrame(made | dict(zip(columns, values, strict=True)))

    rows = series.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("year").cast("int").alias("year"), F.col("count").cast("double").alias("count")))).alias("at"))
    rows = rows.select(key, F.col("at.year").alias("years"), F.col("at.count").alias("counts"))
    return rows.mapInPandas(run, f"{key} {kind}, start int, end int, {out}")


def _true_runs(high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values in each row."""
    edge = np.zeros((len(high), 1), bool)
    at, first = np.nonzero(high & ~np.hstack([edge, high[:, :-1]]))
    return at, first, np.nonzero(high & ~np.hstack([high[:, 1:], edge]))[1]


def two_state_bursts(series: DataFrame, key: str, s: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """Kleinberg's two-state automaton per key (B1): burst periods with their gain in log-likelihood.

    Poisson costs; entering a burst costs gamma * ln n, leaving is free. Series of one length go through the automaton together.
    """

    def find(counts: np.ndarray):
        n = counts.shape[1]
        base = counts.mean(axis=1)
        some = np.flatnonzero((base > 0) & (n >= 2))
        c, rates = counts[some], np.stack([base[some], base[some] * s])
        cost = rates[:, :, None] - c[None, :, :] * np.log(rates)[:, :, None]
        up = gamma * math.log(n)
        low, high = cost[0, :, 0], cost[1, :, 0] + up
        back = np.zeros((n, 2, len(c)), bool)
        for t in range(1, n):
            back[t] = high < low, ~(low + up < high)
            low, high = np.where(back[t, 0], high, low) + cost[0, :, t], np.where(back[t, 1], high, low + up) + cost[1, :, t]
        state = np.zeros(c.shape, bool)
        state[:, n - 1] = high < low
        for t in range(n - 1, 0, -1):
            state[:, t - 1] = np.where(state[:, t], back[t, 1], back[t, 0])
        at, first, last = _true_runs(state)
        gain = [float((cost[0, i, a : b + 1] - cost[1, i, a : b + 1]).sum()) for i, a, b in zip(at, first, last, strict=True)]
        return some[at], first, last, [np.array(gain, float)]

    return _runs(series, key, find, "strength double")


def multi_level_bursts(series: DataFrame, key: str, s: float = 2.0, gamma: float = 1.0, threshold: float = 2.0) -> DataFrame:
    """Kleinberg's automaton with levels base * s ** i (B2), in state 0 at first; runs of at least log_s(threshold). Series of
    one length and number of levels go through it together."""
    least = max(1, math.ceil(math.log(threshold, s)))

    def level(c: np.ndarray, base: np.ndarray, top: int):
        n, i = c.shape[1], np.arange(top + 1)
        rates = base[:, None] * s**i
        cost = rates[:, :, None] - c[:, None, :] * np.log(rates)[:, :, None]
        move = gamma * math.log(n) * np.maximum(i[None, :] - i[:, None], 0)
        total = np.where(i == 0, cost[:, :, 0], np.inf)
        back = np.zeros((n, len(c), top + 1), int)
        for t in range(1, n):
            step = total[:, :, None] + move
            back[t] = step.argmin(axis=1)
            total = step.min(axis=1) + cost[:, :, t]
        state = np.zeros(c.shape, int)
        state[:, n - 1] = total.argmin(axis=1)
        for t in range(n - 1, 0, -1):
            state[:, t - 1] = back[t, np.arange(len(c)), state[:, t]]
        at, first, last = _true_runs(state >= least)
        levels = [state[k, a : b + 1] for k, a, b in zip(at, first, last, strict=True)]
        return at, first, last, np.array([float(s ** x.max()) for x in levels], float), np.array([float((s**x).sum()) for x in levels], float)

    def find(counts: np.ndarray):
        base, most = counts.mean(axis=1), counts.max(axis=1)
        some = np.flatnonzero((base > 0) & (most > base) & (counts.shape[1] >= 2))
        tops = np.array([min(12, max(1, math.ceil(math.log(m / b, s)))) for m, b in zip(most[some], base[some], strict=True)], int)
        found = [(np.zeros(0, int),) * 3 + (np.zeros(0),) * 2]
        for top in np.unique(tops):
            these = some[tops == top]
            at, *rest = level(counts[these], base[these], int(top))
            found.append((these[at], *rest))
        at, first, last, strength, total = (np.concatenate(x) for x in zip(*found, strict=True))
        return at, first, last, [strength, total]

    return _runs(series, key, find, "strength double, total double")


def aggregate_bursts(bursts: DataFrame, key: str) -> DataFrame:
    """Count, largest strength and span of each key's bursts."""
    return bursts.groupBy(key).agg(F.count(F.lit(1)).alias("bursts"), F.max("strength").alias("strength"), F.sum("total").alias("score"), F.min("start").alias("first"), F.max("end").alias("last"))


def linear_forecast(series: DataFrame, key: str, horizon: int, z: float = 1.2816) -> DataFrame:
    """Least squares on the year for all series at once (B7): forecast, 80 % limits, floor 0."""
    g = series.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.regr_slope(F.col("count"), F.col("year")), F.lit(0.0)).alias("slope"), F.avg("count").alias("my"), F.avg("year").alias("mx"), F.max("year").alias("last"),
        F.var_pop("count").alias("vy"), F.var_pop("year").alias("vx"),
    )
    sd = F.sqrt(F.greatest(F.col("vy") - F.col("slope") ** 2 * F.col("vx"), F.lit(0.0)))
    x = g.select(key, "slope", sd.alias("sd"), "my", "mx", F.explode(F.sequence(F.col("last") + 1, F.col("last") + horizon)).alias("year"))
    y = F.col("my") + F.col("slope") * (F.col("year") - F.col("mx"))
    floor = lambda c: F.greatest(c, F.lit(0.0))
    return x.select(key, "year", floor(y).alias("forecast"), floor(y - z * F.col("sd")).alias("lower"), floor(y + z * F.col("sd")).alias("upper"))


def holt_forecast(series: DataFrame, key: str, horizon: int) -> DataFrame:
    """Holt's additive trend with smoothing constants from a grid per series (B8); short series fall back to their mean."""
    a, b = (g.ravel() for g in np.meshgrid(np.linspace(0.05, 0.95, 19), np.linspace(0.05, 0.95, 19), indexing="ij"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("year", kind="stable")
        y, last = f["count"].to_numpy(float), int(f["year"].max())
        at_end, slope = y.mean(), 0.0
        if len(y) >= 3:
            level, trend, sse = np.full(a.shape, y[0]), np.full(a.shape, y[1] - y[0]), np.zeros(a.shape)
            for v in y[1:]:  # the whole grid at once
                guess = level + trend
                sse += (v - guess) ** 2
                new = a * v + (1 - a) * guess
                trend = b * (new - level) + (1 - b) * trend
                level = new
            best = sse.argmin()
            at_end, slope = level[best], trend[best]
        return pd.DataFrame({key: f[key].iloc[0], "year": [last + k for k in range(1, horizon + 1)], "forecast": [max(at_end + k * slope, 0.0) for k in range(1, horizon + 1)]})

    return series.groupBy(key).applyInPandas(run, f"{key} {series.schema[key].dataType.simpleString()}, year int, forecast double")


def arima_forecast(series: DataFrame, key: str, horizon: int, least: int = 6) -> DataFrame:
    """ARIMA(1,1,1) by conditional sums of squares on a grid that is refined once (B9); shorter series repeat their last value."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("year", kind="stable")
        y, last = f["count"].to_numpy(float), int(f["year"].max())
        d = np.diff(y)

        def css(phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            e, s = np.zeros(phi.shape), np.zeros(phi.shape)
            for t in range(1, len(d)):  # the whole grid at once
                e = d[t] - phi * d[t - 1] - theta * e
                s = s + e * e
            return s, e

        phi = theta = e = 0.0
        if len(y) >= least:
            step = 0.1
            for _ in range(2):
                p, q = (g.ravel() for g in np.meshgrid(phi + step * np.arange(-9, 10), theta + step * np.arange(-9, 10), indexing="ij"))
                inside = (np.abs(p) < 1) & (np.abs(q) < 1)
                p, q = p[inside], q[inside]
                cost, last_e = css(p, q)
                best = cost.argmin()
                phi, theta, e = p[best], q[best], last_e[best]
                step /= 10
        level, diff, out = y[-1], d[-1] if len(d) else 0.0, []
        for k in range(horizon):
            diff = phi * diff + (theta * e if k == 0 else 0.0)
            level += diff
            out.append(max(level, 0.0))
        return pd.DataFrame({key: f[key].iloc[0], "year": [last + k for k in range(1, horizon + 1)], "forecast": out})

    return series.groupBy(key).applyInPandas(run, f"{key} {series.schema[key].dataType.simpleString()}, year int, forecast double")


def forecast_quality(series: DataFrame, key: str) -> DataFrame:
    """Mean absolute error and R2 of the linear fit per series (B10), from whole-number sums: no order of adding changes them."""
    x, y = F.col("year").cast("long"), F.col("count").cast("long")
    g = series.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    n, dx, dy, dxy = F.col("n"), F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy"), F.expr("n * sxy - sx * sy")
    g = g.select(key, n, "sx", "sy", dx.alias("dx"), dy.alias("dy"), dxy.alias("dxy"))
    over = F.greatest(F.col("dx"), F.lit(1))  # a series of one year has slope 0
    off = F.abs(over * (n * y - F.col("sy")) - F.col("dxy") * (n * x - F.col("sx")))
    r2 = F.when((F.col("dx") > 0) & (F.col("dy") > 0), F.col("dxy").cast("double") * F.col("dxy") / (F.col("dx").cast("double") * F.col("dy"))).otherwise(0.0)
    z = series.join(g, key).groupBy(key).agg(F.sum(off).alias("off"), F.first(n).alias("n"), F.first(over).alias("over"), F.first(r2).alias("r2"))
    return z.select(key, (F.col("off").cast("double") / (F.col("n") * F.col("n") * F.col("over"))).alias("mae"), "r2")


def _growths(series: DataFrame, forecasts: DataFrame, key: str, most: int) -> DataFrame:
    """(key, growth) of the ``most`` largest series: (mean forecast - last) / max(last, 1)."""
    t = series.groupBy(key).agg(F.sum("count").alias("total"), F.max_by("count", "year").alias("last")).orderBy(F.desc("total"), key).limit(most)
    m = forecasts.groupBy(key).agg(F.avg("forecast").alias("mean"))
    return t.join(m, key).select(key, F.round((F.col("mean") - F.col("last")) / F.greatest(F.col("last"), F.lit(1)), 9).alias("growth"))


def emerging(series: DataFrame, forecasts: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` highest growths of the 3n largest series."""
    return _growths(series, forecasts, key, 3 * n).orderBy(F.desc("growth"), key).limit(n)


def fading(series: DataFrame, forecasts: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` lowest growths of the 3n largest series."""
    return _growths(series, forecasts, key, 3 * n).orderBy("growth", key).limit(n)


def disruption(cites: DataFrame) -> DataFrame:
    """Disruption of every paper with references and citers (B13): (j - i) / (i + j + k).

    i: citers that also cite one of the paper's references, j: those that do not, k: the paper's references cited by its citers.
    """
    e = cites.select("src", "dst").distinct()
    citers = e.select(F.col("dst").alias("focal"), F.col("src").alias("citer"))
    refs = e.select(F.col("src").alias("focal"), F.col("dst").alias("ref"))
    shared = citers.join(e.select(F.col("src").alias("citer"), F.col("dst").alias("ref")), "citer").join(refs, ["focal", "ref"]).select("focal", "citer", "ref")
    s = shared.groupBy("focal").agg(F.count_distinct("citer").alias("i"), F.count_distinct("ref").alias("k"))
    n = citers.groupBy("focal").agg(F.count(F.lit(1)).alias("citers")).join(refs.groupBy("focal").agg(F.count(F.lit(1)).alias("refs")), "focal", "full_outer")
    x = n.join(s, "focal", "left").na.fill(0, ["i", "k"])
    j = F.col("citers") - F.col("i")
    value = F.when(F.col("citers").isNotNull() & F.col("refs").isNotNull(), (j - F.col("i")) / (F.col("i") + j + F.col("k")))
    why = F.when(F.col("refs").isNull(), "no references").when(F.col("citers").isNull(), "no citers")
    return x.select("focal", value.alias("disruption"), why.alias("reason"))


def atypicality(elements: DataFrame, group: str, item: str) -> DataFrame:
    """Mean z of a group's element pairs against independence, mapped to 0..1 (B14); no pairs is 0.5."""
    from corvella.operators.networks import pair_counts

    m = elements.select(group, item).distinct()
    n = m.agg(F.count_distinct(group).alias("n"))
    df = m.groupBy(item).agg(F.count(F.lit(1)).alias("c"))
    p = pair_counts(m, group, item)
    p = p.join(df.select(F.col(item).alias("a"), F.col("c").alias("ca")), "a").join(df.select(F.col(item).alias("b"), F.col("c").alias("cb")), "b").join(F.broadcast(n))  # one row
    e = F.col("ca") * F.col("cb") / F.col("n")
    p = p.select("a", "b", ((F.col("weight") - e) / F.sqrt(F.greatest(e, F.lit(0.5)))).alias("z"))
    x, y = m.select(F.col(group).alias("g"), F.col(item).alias("a")), m.select(F.col(group).alias("g2"), F.col(item).alias("b"))
    mine = x.join(y, (x.g == y.g2) & (x.a < y.b)).join(p, ["a", "b"]).groupBy("g").agg(F.avg("z").alias("z"))
    return m.select(F.col(group).alias("g")).distinct().join(mine, "g", "left").select(F.col("g").alias(group), F.when(F.col("z").isNull(), 0.5).otherwise(0.5 * (1 + F.tanh(-F.col("z") / 2))).alias("atypicality"))


def velocity(series: DataFrame, key: str) -> DataFrame:
    """Mean second difference of series of three years or more."""
    w = Window.partitionBy(key).orderBy("year")
    d = F.col("count") - 2 * F.lag("count").over(w) + F.lag("count", 2).over(w)
    return series.withColumn("d2", d).filter("d2 IS NOT NULL").groupBy(key).agg(F.avg("d2").alias("acceleration"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, keep_self: bool = False, block: int = 32_768) -> DataFrame:
    """Exact cosine top-k of each query against all vectors (T9, B12), block against block.

    A task holds one block of queries and one of vectors, and returns the block's best only; a window over
    those picks the ``k`` of each query. Vectors are unit-scaled first, zero vectors score 0; rows with a null id or vector take no part.
    Every row is copied eight times at least and once per ``block`` rows of the other side; comparing all with all stays
    quadratic. ``similarity.nearest`` compares candidates only.
    """
    x, q = similarity.sound(vectors), similarity.sound(queries)
    count = lambda df: max(1, -(-(n := df.count()) // block), min(8, n // 256))
    nq, nv = count(q), count(x)
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select(own(nq).alias("qb"), every(nv).alias("vb"), "vec_id", "v")
    x = x.select(every(nq).alias("qb"), own(nv).alias("vb"), "vec_id", "v")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return similarity.best_of_cells(q, x, ["qb", "vb"], [], k, keep_self).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def novelty(near: DataFrame, k: int = 5) -> DataFrame:
    """1 - mean cosine of the k nearest, and its percentile."""
    g = near.filter(F.col("rank") <= k).groupBy("query_id").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.avg("score"))).alias("novelty"))
    return cume_dist(g, "novelty", "percentile").withColumn("percentile", F.col("percentile") * 100)


def bridge(vectors: DataFrame, a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Vectors near both of two topics: harmonic mean of similarities (B21). ``a``, ``b``: one row with embedding."""
    x = vectors.join(F.broadcast(a.select(F.col("embedding").alias("va")))).join(F.broadcast(b.select(F.col("embedding").alias("vb"))))  # one row each
    sa, sb = F.greatest(S.cosine(F.col("embedding"), F.col("va")), F.lit(1e-6)), F.greatest(S.cosine(F.col("embedding"), F.col("vb")), F.lit(1e-6))
    return x.select("vec_id", F.round(2 * sa * sb / (sa + sb), 9).alias("score")).orderBy(F.desc("score"), "vec_id").limit(n)


def ndcg(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Mean hit rate and 1 / log2(rank + 1) of the first relevant hit (B22). ranked: query_id, vec_id, rank."""
    hit = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    x = relevant.select("query_id").distinct().join(hit, "query_id", "left")
    return x.agg(F.avg(F.coalesce(1 / F.log2(F.col("first") + 1), F.lit(0.0))).alias("ndcg"), F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"))


def recommend_collaborators(authorship: DataFrame, keywords: DataFrame, coauthors: DataFrame, author, n: int, exclude_existing: bool = True) -> DataFrame:
    """Authors who share keywords or co-authors with ``author`` (B23), without those who share a paper unless ``exclude_existing`` is off.

    0.4 * (0.5 cosine + 0.5 (1 - jaccard) where cosine > 0) + 0.25 / (1 + shared co-authors) where any
    + 0.15 * min(1, joint papers / 5) + 0.2 * papers / most. ``coauthors``: a, b, weight.
    """
    ak = authorship.join(keywords, "paper_id").groupBy("author", "keyword").agg(F.count(F.lit(1)).alias("c"))
    size = ak.groupBy("author").agg(F.count(F.lit(1)).alias("k"), F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("norm"))
    me = ak.filter(F.col("author") == F.lit(author)).select("keyword", F.col("c").alias("mc"))
    mine = size.filter(F.col("author") == F.lit(author)).select(F.col("k").alias("mk"), F.col("norm").alias("mn"))
    both = ak.join(me, "keyword").groupBy("author").agg(F.sum(F.col("c") * F.col("mc")).alias("dot"), F.count(F.lit(1)).alias("shared"))
    pairs = coauthors.select("a", "b", "weight").union(coauthors.select("b", "a", "weight"))
    direct = pairs.filter(F.col("a") == F.lit(author)).select(F.col("b").alias("author"), F.col("weight").alias("joint"))
    via = pairs.join(direct.select(F.col("author").alias("a")), "a").groupBy(F.col("b").alias("author")).agg(F.count(F.lit(1)).alias("common"))
    papers = authorship.groupBy("author").agg(F.count(F.lit(1)).alias("papers"))
    top = papers.agg(F.max("papers").alias("top"))
    x = size.join(both, "author", "left").join(via, "author", "left").join(papers, "author").na.fill(0, ["dot", "shared", "common"])
    x = x.filter(F.col("author") != F.lit(author)).join(direct, "author", "left").na.fill(0, ["joint"])
    x = (x.filter("joint = 0") if exclude_existing else x).join(F.broadcast(mine)).join(F.broadcast(top))  # one row each
    cos = F.col("dot") / (F.col("norm") * F.col("mn"))
    jac = F.col("shared") / (F.col("k") + F.col("mk") - F.col("shared"))
    s = 0.4 * (0.5 * cos + F.when(cos > 0, 0.5 * (1 - jac)).otherwise(0.0)) + F.when(F.col("common") > 0, 0.25 / (1 + F.col("common"))).otherwise(0.0) + 0.15 * F.least(F.lit(1.0), F.col("joint") / 5) + 0.2 * F.col("papers") / F.col("top")
    return x.select("author", s.alias("score")).orderBy(F.desc("score"), "author").limit(n)


def recommend_institutions(members: DataFrame) -> DataFrame:
    """0.5 min(1, total / 50) + 0.5 min(1, mean / 10) of citations per institution (B24). Input: institution, citations."""
    g = members.groupBy("institution").agg(F.sum("citations").alias("total"), F.avg("citations").alias("mean"))
    return g.select("institution", (0.5 * F.least(F.lit(1.0), F.col("total") / 50) + 0.5 * F.least(F.lit(1.0), F.col("mean") / 10)).alias("score"))


def research_gaps(elements: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """Pairs that co-occur less than independence expects (B25): deficit * (1 + ln(1 + expected))."""
    from corvella.operators.networks import pair_counts

    m = elements.select(group, item).distinct()
    total = m.agg(F.count_distinct(group).alias("n"))
    df = m.groupBy(item).agg(F.count(F.lit(1)).alias("c"))
    p = pair_counts(m, group, item).join(df.select(F.col(item).alias("a"), F.col("c").alias("ca")), "a").join(df.select(F.col(item).alias("b"), F.col("c").alias("cb")), "b").join(F.broadcast(total))  # one row
    e = F.col("ca") * F.col("cb") / F.col("n")
    return p.filter(F.col("weight") < e).select("a", "b", ((e - F.col("weight")) / e * (1 + F.ln(1 + e))).alias("score")).orderBy(F.desc("score"), "a", "b").limit(n)


def sub_area_gaps(elements: DataFrame, group: str, item: str, top: int = 30) -> DataFrame:
    """Pairs of the ``top`` items, never co-occurring ones included, seen at most half as often as expected."""
    from corvella.operators.networks import pair_counts

    m = elements.select(group, item).distinct()
    n = m.agg(F.count_distinct(group).alias("n"))
    df = m.groupBy(item).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), item).limit(top)
    x, y = df.select(F.col(item).alias("a"), F.col("c").alias("ca")), df.select(F.col(item).alias("b"), F.col("c").alias("cb"))
    all_pairs = x.join(F.broadcast(y), F.col("a") < F.col("b"))  # ``top`` rows a side
    seen = pair_counts(m.join(F.broadcast(df.select(item)), item, "left_semi"), group, item)
    z = all_pairs.join(seen, ["a", "b"], "left").na.fill(0, ["weight"]).join(F.broadcast(n))  # one row
    e = F.col("ca") * F.col("cb") / F.col("n")
    return z.filter(F.col("weight") <= 0.5 * e).select("a", "b", F.col("weight").alias("observed"), e.alias("expected"))


def composite_score(*parts: Column) -> Column:
    """Geometric mean of scores, each at least 1e-6."""
    total = F.lit(0.0)
    for p in parts:
        total = total + F.ln(F.greatest(p, F.lit(1e-6)))
    return F.exp(total / len(parts))


def user_profile(history: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean vector of each user's items (B20): user_id, embedding."""
    x = history.join(vectors, "vec_id").select("user_id", F.posexplode("embedding").alias("i", "x"))
    m = x.groupBy("user_id", "i").agg(F.avg("x").alias("x"))
    return m.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


def recommend_for_users(history: DataFrame, vectors: DataFrame, k: int, find=nearest) -> DataFrame:
    """(user_id, vec_id, score, rank): the ``k`` items nearest to the mean of each user's own, those left out.

    ``find`` searches: the exact ``nearest``, or ``similarity.nearest``. As many more are asked for as the longest history has items.
    """
    long = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    profile = user_profile(history, vectors)
    found = find(vectors, profile.select(F.col("user_id").alias("vec_id"), "embedding"), k + long, keep_self=True)
    new = found.select(F.col("query_id").alias("user_id"), "vec_id", "score").join(history.select("user_id", "vec_id"), ["user_id", "vec_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "vec_id")
    return new.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recommend_for_topic(items: DataFrame, vectors: DataFrame, query: DataFrame, topic: str, k: int, boost: float = 0.1) -> DataFrame:
    """(vec_id, score, rank): of the 2k items nearest to ``query`` (one row: vec_id, embedding), those with ``topic`` among their keywords gain ``boost``.

    ``items``: vec_id, keywords. Sorted again after the boost, which the published method leaves out.
    """
    found = nearest(vectors, query, 2 * k, keep_self=True)
    x = found.join(items, "vec_id", "left").withColumn("score", F.col("score") + F.when(F.array_contains("keywords", topic), boost).otherwise(0.0))
    top = x.select("vec_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))  # k rows


def bridge_authors(members: DataFrame, field_a, field_b, n: int) -> DataFrame:
    """Authors at home in both of two fields, by the harmonic mean of their shares of papers in each (B24). Input: author, paper_id, field."""
    m = members.select("author", "paper_id", "field").distinct()
    share = lambda f: F.count_distinct(F.when(F.col("field") == F.lit(f), F.col("paper_id"))) / F.count_distinct("paper_id")
    g = m.groupBy("author").agg(share(field_a).alias("a"), share(field_b).alias("b")).filter("a > 0 AND b > 0")
    return g.select("author", "a", "b", (2 * F.col("a") * F.col("b") / (F.col("a") + F.col("b"))).alias("affinity")).orderBy(F.desc("affinity"), "author").limit(n)


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with two sparse vectors (w1, c1 and w2, c2; w ascending), which become their product ``dot`` and the number of ``shared`` places."""

    def flat(batch: pa.RecordBatch, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, c = batch.column(f"w{t}"), batch.column(f"c{t}")
        size = np.asarray(pc.fill_null(pc.list_value_length(w), 0))
        return np.repeat(np.arange(len(size)), size), pc.list_flatten(w).to_numpy(zero_copy_only=False), pc.list_flatten(c).to_numpy(zero_copy_only=False)

    for batch in batches:
        (r1, w1, c1), (r2, w2, c2) = flat(batch, 1), flat(batch, 2)
        places, at = np.unique(np.concatenate([w1, w2]), return_inverse=True)
        one, two = r1 * len(places) + at[: len(w1)], r2 * len(places) + at[len(w1) :]  # ascending: rows, then places
        spot = np.minimum(np.searchsorted(two, one), max(len(two) - 1, 0))
        met = np.flatnonzero(two[spot] == one) if len(two) else np.zeros(0, dtype=np.int64)
        dot, shared = np.zeros(batch.num_rows, dtype=np.int64), np.bincount(r1[met], minlength=batch.num_rows)
        np.add.at(dot, r1[met], c1[met] * c2[spot[met]])
        kept = [n for n in batch.schema.names if n[0] not in "wc"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(dot), pa.array(shared.astype(np.int64))], names=[*kept, "dot", "shared"])


def collaboration_strength(coauthors: DataFrame, keywords: DataFrame, current_year: int) -> DataFrame:
    """(a, b, strength): 0.4 Jaccard and 0.3 cosine of the authors' keywords, 0.3 e^(-age / 5) of their last joint paper.

    Inputs: a, b, last_year of author pairs; author, keyword, c (papers of the author with the keyword; one row for both). A pair meets each
    author's keywords as one vector, so it is one row throughout, however many keywords two authors share.
    """
    named = materialise(keywords.select("keyword").filter("keyword IS NOT NULL").distinct().withColumn("_no", F.monotonically_increasing_id()), "keyword-numbers")
    vectors = keywords.join(named, "keyword", "left").groupBy("author").agg(
        F.count(F.lit(1)).alias("k"), F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("_no").isNotNull(), F.struct("_no", F.coalesce(F.col("c").cast("long"), F.lit(0)).alias("c"))))).alias("v"),
    )
    vectors = materialise(vectors.select("author", "k", "n", F.col("v").getField("_no").alias("w"), F.col("v").getField("c").alias("c")), "keyword-vectors")
    of = lambda c, t: vectors.select(F.col("author").alias(c), *[F.col(x).alias(f"{x}{t}") for x in ("k", "n", "w", "c")])
    x = coauthors.select("a", "b", "last_year").join(of("a", 1), "a", "left").join(of("b", 2), "b", "left")
    types = {f.name: f.dataType.simpleString() for f in x.schema}
    plain = ["a", "b", "last_year", "k1", "n1", "k2", "n2"]
    z = x.select(*plain, "w1", "c1", "w2", "c2").mapInArrow(_dots, ", ".join(f"{c} {types[c]}" for c in plain) + ", dot long, shared long")
    jac = F.coalesce(F.col("shared") / (F.col("k1") + F.col("k2") - F.col("shared")), F.lit(0.0))
    cos = F.coalesce(F.col("dot") / (F.col("n1") * F.col("n2")), F.lit(0.0))
    return z.select("a", "b", (0.4 * jac + 0.3 * cos + 0.3 * F.exp(-(F.lit(current_year) - F.col("last_year")) / 5.0)).alias("strength"))


def directions_from_gaps(gaps: DataFrame) -> DataFrame:
    """(a, b, novelty, feasibility, months, score) of gaps (a, b, observed, expected) (B27): novelty is the missing share, feasibility grows with what is there to build on."""
    novelty = 1 - F.col("observed") / F.greatest(F.col("expected"), F.lit(1e-9))
    return _directions(gaps.withColumn("novelty", F.greatest(F.lit(0.0), novelty)).withColumn("feasibility", F.col("expected") / (F.col("expected") + 1)), ["a", "b"])


def directions_from_frontier(regions: DataFrame) -> DataFrame:
    """(region, novelty, feasibility, months, score) of regions (region, novelty, growth) (B27): feasibility is 0.5 + 0.5 growth, within 0..1."""
    return _directions(regions.withColumn("feasibility", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.5 * F.col("growth")))), ["region"])


def directions_from_trends(series: DataFrame, forecasts: DataFrame, key: str, n: int) -> DataFrame:
    """(key, novelty, feasibility, months, score) of the fastest growing series (B27): growth is squeezed into 0..1 for both."""
    g = emerging(series, forecasts, key, n)
    squeezed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("growth")))
    return _directions(g.withColumn("novelty", squeezed).withColumn("feasibility", 0.5 + 0.5 * squeezed), [key])


def _directions(rows: DataFrame, keys: list[str], weight: float = 0.5) -> DataFrame:
    return rows.select(*keys, "novelty", "feasibility", (6 + 18 * F.col("novelty")).alias("months"), (weight * F.col("novelty") + (1 - weight) * F.col("feasibility")).alias("score"))


def mmr(candidates: DataFrame, weight: float = 0.7, k: int = 10) -> DataFrame:
    """Greedy maximal marginal relevance per query (T11): query_id, vec_id, score, embedding, a bounded candidate list each."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "vec_id"], ascending=[False, True], kind="stable")
        v = np.stack(f["embedding"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        sim, s = v @ v.T, f["score"].to_numpy(float)
        taken, left = [0], list(range(1, len(f)))
        while left and len(taken) < k:
            value = [weight * s[i] - (1 - weight) * sim[i, taken].max() for i in left]
            taken.append(left.pop(int(np.argmax(value))))
        return pd.DataFrame({"query_id": f["query_id"].iloc[0], "rank": range(1, len(taken) + 1), "vec_id": f["vec_id"].iloc[taken].to_numpy()})

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, rank int, vec_id long")


def confidence(chunks: DataFrame) -> DataFrame:
    """mean clipped score + min(0.2, 0.05 n), at most 1."""
    g = chunks.groupBy("query_id").agg(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))).alias("m"), F.count(F.lit(1)).alias("n"))
    return g.select("query_id", F.least(F.lit(1.0), F.col("m") + F.least(F.lit(0.2), 0.05 * F.col("n"))).alias("confidence"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence) of every text."""
    return docs.select("doc_id", F.posexplode(F.filter(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), r"\n"), lambda s: F.trim(s) != "")).alias("pos", "sentence"))


def sentence_scores(docs: DataFrame) -> DataFrame:
    """Sum of the document's word counts over the root of the sentence's length plus one."""
    words = sentences(docs).select("doc_id", "pos", F.explode(S.tokens(F.col("sentence"))).alias("w"))
    n = words.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("c"))
    return words.join(n, ["doc_id", "w"]).groupBy("doc_id", "pos").agg((F.sum("c") / (F.sqrt(F.count(F.lit(1))) + 1)).alias("score"))


def extractive_summary(docs: DataFrame, max_words: int = 100, top: int = 5) -> DataFrame:
    """(doc_id, summary): the ``top`` best scored sentences of each text in its own order, up to ``max_words`` words in all.

    The first sentence chosen is kept whole. Texts without words have no row.
    """
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    chosen = sentence_scores(docs).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top)
    x = sentences(docs).join(chosen.select("doc_id", "pos"), ["doc_id", "pos"]).withColumn("n", F.size(F.split(F.trim("sentence"), r"\s+")))
    upto = F.sum("n").over(Window.partitionBy("doc_id").orderBy("pos"))
    kept = x.withColumn("upto", upto).filter((F.col("upto") <= max_words) | (F.col("upto") == F.col("n")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.trim("sentence").alias("s")))), lambda z: z["s"]), " ").alias("summary"))


def top_terms(rows: DataFrame, group: str, term: str, n: int) -> DataFrame:
    """Most common terms of each group, ties by term."""
    w = Window.partitionBy(group).orderBy(F.desc("n"), term)
    return rows.groupBy(group, term).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def gap_sentences(docs: DataFrame, markers: list[str]) -> DataFrame:
    """Sentences with a gap marker."""
    return sentences(docs).filter(F.lower("sentence").rlike("|".join(markers)))
