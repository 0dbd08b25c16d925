"""Similarity joins without squares of common tokens, and approximate neighbours by random projections.

Sets: tokens are ordered from the rarest to the commonest, and two sets of the asked overlap must share one of
their first few (the prefix), so only those are joined, behind bounds on sizes and positions; what is left is counted exactly. Equal sets
are one, so a set that a third of the rows have does not meet itself.

Vectors: the signs of projections on random directions are a bucket's name; queries also look into the buckets behind the directions that
they are nearest to. Candidates are scored exactly. More tables or probes find more, and ``recall`` measures how many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.operators.graph import wedges
from corvella.plans.storage import materialise

TABLES, PROBES, BUCKET_ROWS = 16, 6, 64
TASK_ROWS, HOT_ROWS = 65_536, 16_384


def _prefixed(sets: DataFrame, order: DataFrame, least: float) -> DataFrame:
    """(id, n, t, pos) of the prefix of each set (id, tokens): rarest tokens first."""
    each = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).join(order, "t")
    ranked = each.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("o"))
    length = F.col("n") - F.ceil(least * F.col("n") - 1e-9).cast("int") + 1
    return ranked.select("id", "n", F.posexplode(F.slice("o", 1, length)).alias("pos", "x")).select("id", "n", F.col("x.t").alias("t"), "pos")


def _may(nx: Column, ny: Column, px: Column, py: Column, least: float) -> Column:
    """Can sets of these sizes that share the tokens at these positions reach the overlap?"""
    needed = F.ceil(least / (1 + least) * (nx + ny) - 1e-9)
    # a pair that does has a first shared token, and from there on both still hold as many
    return (F.least(nx, ny) >= least * F.greatest(nx, ny) - 1e-9) & (F.least(nx - px, ny - py) >= needed)


def _jaccard(pairs: DataFrame, one: DataFrame, two: DataFrame, least: float) -> DataFrame:
    x = pairs.join(one.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(two.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    x = x.select("a", "b", shared.alias("shared"), (shared / (F.size("ta") + F.size("tb") - shared)).alias("similarity"))
    return x.filter(F.col("similarity") >= least)


def _sets(rows: DataFrame) -> DataFrame:
    """(id, tokens): distinct tokens, without null ones; rows without any are left out, as no set is similar to an empty one."""
    t = F.array_sort(F.array_distinct(F.filter("tokens", lambda x: x.isNotNull())))
    return rows.select("id", t.alias("tokens")).filter(F.size("tokens") > 0)


def similar_sets(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, shared, similarity), a < b: all pairs of rows (id, tokens array) of different sets with a Jaccard similarity of ``least`` or more,
    and each row of a repeated set with the smallest id of that set (similarity 1). Ids must be distinct."""
    sets = materialise(_sets(rows), "token-sets")
    lead = sets.groupBy("tokens").agg(F.min("id").alias("lead"))
    same = sets.join(lead, "tokens").filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"), F.size("tokens").alias("shared"), F.lit(1.0).alias("similarity"))
    once = materialise(lead.select(F.col("lead").alias("id"), "tokens"), "token-sets")
    order = once.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    links = _prefixed(once, order, least).select("t", F.struct("id", "n", "pos").alias("end"))
    met = wedges(links, "t", "end").filter(_may(F.col("a.n"), F.col("b.n"), F.col("a.pos"), F.col("b.pos"), least))
    pairs = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    return _jaccard(pairs, once, once, least).unionByName(same)


def similar_to(wanted: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(a, b, shared, similarity): pairs of a wanted and a known row (id, tokens array) with a Jaccard similarity of ``least`` or more."""
    w, k = materialise(_sets(wanted), "wanted-sets"), materialise(_sets(known), "known-sets")
    order = w.union(k).select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    x = _prefixed(w, order, least).select("t", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    y = _prefixed(k, order, least).select("t", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    pairs = x.join(y, "t").filter(_may(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"), least)).select("a", "b").distinct()
    return _jaccard(pairs, w, k, least)


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that have both; components keep their single precision."""
    kept = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    return vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), kept.alias("v"))


def _directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(count, dim))


def buckets(vectors: DataFrame, bits: int, tables: int, probes: int, seed: int = 11) -> DataFrame:
    """(vec_id, v, keys): names of each vector's buckets, ``probes`` more per table behind the nearest directions."""

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = f["v"].map(len).to_numpy()
            for dim in np.unique(size):
                part = f[size == dim]
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                side = (x @ _directions(int(dim), bits * tables, seed).T).reshape(len(x), tables, bits)
                name = ((side > 0) << np.arange(bits)).sum(axis=2) if bits else np.zeros((len(x), tables), np.int64)
                near = np.argsort(np.abs(side), axis=2, kind="stable")[:, :, :probes]
                names = np.concatenate([name[:, :, None], name[:, :, None] ^ (1 << near)], axis=2) if bits else name[:, :, None]
                keys = names + (np.arange(tables) << 40)[None, :, None] + (int(dim) << 48)
                yield pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "keys": list(keys.reshape(len(x), -1))})

    return vectors.mapInPandas(named, f"vec_id long, v {vectors.schema['v'].dataType.simpleString()}, keys array<long>")


def top_by_cosine(q: np.ndarray, x: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int, keep_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of q, rows of x, scores): for each row of ``q`` the ``k`` rows of ``x`` of largest cosine (9 decimals), ties to the smaller id.

    Single precision proposes, behind a bound on its error and the k-th score so far; what it proposes is scored in double precision.
    """
    u, w = (g / np.where((n := np.linalg.norm(g, axis=1, keepdims=True)) > 0, n, 1.0) for g in (q, x))
    if not (np.isfinite(u).all() and np.isfinite(w).all()):
        return _top_plainly(u, w, qid, xid, k, keep_self)
    u4, w4 = u.astype(np.float32), w.astype(np.float32)
    slack = np.float32((u.shape[1] + 8) * 2.0**-22)
    order = np.argsort(xid, kind="stable")
    low, high = (np.searchsorted(xid[order], qid, side) for side in ("left", "right"))
    columns = max(4096, k)
    found = []
    for i in range(0, len(u), 512):
        rows = min(512, len(u) - i)
        own = np.repeat(np.arange(rows), (high - low)[i : i + rows])
        mine = np.concatenate([order[a:b] for a, b in zip(low[i : i + rows], high[i : i + rows], strict=True)])
        r, c, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        cut = np.full(rows, -np.inf, np.float32)
        for j in range(0, len(w), columns):
            s = u4[i : i + rows] @ w4[j : j + columns].T
            if not keep_self:
                here = (mine >= j) & (mine < j + columns)
                s[own[here], mine[here] - j] = -np.inf
            if j == 0 and s.shape[1] > k:
                cut = np.partition(s, -k, axis=1)[:, -k] - 2 * slack
            r2, c2 = np.nonzero((s >= cut[:, None]) & (s > -np.inf))
            c2 = c2 + j
            exact = [np.einsum("ij,ij->i", u[i + r2[a : a + 65536]], w[c2[a : a + 65536]]) for a in range(0, len(r2), 65536)]
            r, c, score = np.concatenate([r, r2]), np.concatenate([c, c2]), np.concatenate([score, *[np.round(e, 9) for e in exact]])
            by = np.lexsort((xid[c], -score, r))
            place = np.arange(len(by)) - np.searchsorted(r[by], r[by])
            by, place = by[place < k], place[place < k]
            r, c, score = r[by], c[by], score[by]
            cut = np.full(rows, -np.inf, np.float32)
            cut[r[place == k - 1]] = score[place == k - 1] - slack
        found.append((r + i, c, score))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _top_plainly(u: np.ndarray, w: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int, keep_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``top_by_cosine``, for unit rows that may hold components that are no numbers; such scores come last."""
    found = []
    for i in range(len(u)):
        score = np.round(w @ u[i], 9)
        ok = np.arange(len(w)) if keep_self else np.flatnonzero(xid != qid[i])
        top = ok[np.lexsort((xid[ok], -score[ok]))[:k]]
        found.append((np.full(len(top), i), top, score[top]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def best_of_cells(queries: DataFrame, vectors: DataFrame, task: list[str], cell: list[str], k: int, keep_self: bool) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` best by cosine within each cell; both frames hold ``task``, ``cell``, vec_id and v.

    Rows of one ``task`` are handled together, cell by cell, so it must be bounded.
    """
    dealt = queries.select(*task, *cell, F.lit(0).alias("side"), "vec_id", "v").union(vectors.select(*task, *cell, F.lit(1).alias("side"), "vec_id", "v"))

    def best(f: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for _, g in f.groupby(cell, sort=False) if cell else [(None, f)]:
            asked, known = g[g["side"] == 0], g[g["side"] == 1]
            if len(asked) and len(known):
                qid, xid = asked["vec_id"].to_numpy(), known["vec_id"].to_numpy()
                q, x = (np.stack(s["v"].to_numpy()).astype(np.float64) for s in (asked, known))
                r, c, score = top_by_cosine(q, x, qid, xid, k, keep_self)
                out.append((qid[r], xid[c], score))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(o) for o in zip(*out, strict=True)), strict=True)))

    return dealt.groupBy(*task).applyInPandas(best, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, keep_self: bool = False, tables: int = TABLES, probes: int = PROBES, bits: int | None = None, seed: int = 11) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` best by cosine among each query's candidates; a zero vector scores 0.

    Rows with a null id or vector take no part; vectors meet those of their own dimension. ``bits`` is set from the number of vectors,
    for buckets of about ``BUCKET_ROWS``. A vector travels once per bucket, never once per pair: buckets keep their ``k`` best of each query, and
    large ones are met block against block. Compare ``recall`` before relying on it; ``trends.nearest`` is exact.
    """
    known, asked = materialise(sound(vectors), "lsh-vectors"), materialise(sound(queries), "lsh-queries")
    n = max(known.count(), 1)
    if bits is None:
        bits = min(36, max(0, int(math.log2(n / BUCKET_ROWS) + 0.5)))
    probes = min(probes, bits)
    placed, looked = materialise(buckets(known, bits, tables, 0, seed), "lsh-placed"), materialise(buckets(asked, bits, tables, probes, seed), "lsh-looked")
    keys = lambda df, name: df.select(F.explode("keys").alias("key")).groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HOT_ROWS).cast("int").alias(name)).filter(F.col(name) > 1)
    hot = materialise(keys(looked, "qn").join(keys(placed, "vn"), "key", "full_outer"), "lsh-hot")

    def dealt(df: DataFrame, own: str, n: str, other: str, m: str) -> DataFrame:
        x = df.select("vec_id", "v", F.explode("keys").alias("key")).join(F.broadcast(hot), "key", "left")  # hot buckets only
        x = x.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.coalesce(n, F.lit(1))).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(m, F.lit(1)) - 1)))
        return x.withColumn("task", F.pmod(F.xxhash64("key", "qb", "vb"), F.lit(tasks)))

    tasks = max(1, -(-tables * (n + (1 + probes) * asked.count()) // TASK_ROWS))
    found = best_of_cells(dealt(looked, "qb", "qn", "vb", "vn"), dealt(placed, "vb", "vn", "qb", "qn"), ["task"], ["key", "qb", "vb"], k, keep_self)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of ``exact`` (query_id, vec_id) that is in ``found``."""
    e = exact.select("query_id", "vec_id")
    hit = e.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))
