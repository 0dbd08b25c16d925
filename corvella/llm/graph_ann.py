"""Approximate nearest neighbours by largest inner product, on robust-pruned directed graphs, one per shard.

Equal vectors are one node (with the smallest ids that carry it: enough for any answer of ``k``), and
nodes are dealt to shards of about ``SHARD_NODES`` by a hash. A shard's graph grows in batches that
double: greedy searches on the graph so far propose neighbours, relaxed distance pruning keeps those
that no kept neighbour is much closer to, and reverse edges are pruned the same way. Inner products
become distances by one more coordinate that gives all nodes of a shard the same norm. A query is
answered by beam search in every shard, scored again in double precision on the original vectors,
and the shards' best are merged. A shard's graph is a file in the shared folder; queries travel in blocks, sorted
by shard, so a task loads a graph once for all its blocks and holds one graph and one block. Every shard is asked
by every query, so work grows with queries times shards (and the logarithm of a shard).

Defined results: vectors that are null, zero, or hold nulls or non-finite components take no part,
nor do rows without vec_id; vectors are compared with those of their own length only; rows that repeat
id and vector count once; ties go to the smaller vec_id; no vectors or no queries, no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.llm.files import Sink, Source
from corvella.plans.storage import fresh_path, materialise

K = 20
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
WIDTH = 4
SLACK = 1.2
SHARD_NODES = 8192
BLOCK_QUERIES = 512
BATCH = 512


class Graph:
    """Nodes with up to ``DEGREE`` out-edges; -1 pads. ``points`` are float32 and of equal norm."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, entry: int):
        self.points, self.edges, self.entry = points, edges, entry
        self.squares = (points**2).sum(axis=1)

    def search(self, queries: np.ndarray, beam: int, among: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(node, squared distance less the query's own) of the ``beam`` best found, all queries in step; -1 pads."""
        n = len(self.points) if among is None else among
        b = len(queries)
        row = np.arange(b)
        ids = np.full((b, beam), -1, dtype=np.int32)
        dist = np.full((b, beam), np.inf, dtype=np.float32)
        done = np.zeros((b, beam), dtype=bool)
        seen = np.zeros((b, n + 1), dtype=bool)
        seen[:, n] = True  # where padding points
        ids[:, 0] = self.entry
        dist[:, 0] = self.squares[self.entry] - 2 * (queries @ self.points[self.entry])
        seen[:, self.entry] = True
        active = row
        while len(active):
            open_dist = np.where(done[active], np.inf, dist[active])
            pick = np.argpartition(open_dist, WIDTH - 1, axis=1)[:, :WIDTH]
            ok = np.isfinite(np.take_along_axis(open_dist, pick, axis=1))
            active, pick, ok = (x[ok.any(axis=1)] for x in (active, pick, ok))
            if not len(active):
                break
            done[active[:, None], pick] = True
            chosen = np.where(ok, ids[active[:, None], pick], -1)
            near = np.where(chosen[:, :, None] >= 0, self.edges[chosen], -1).reshape(len(active), -1)
            near = np.where(near < 0, n, near)
            near = np.sort(near, axis=1)
            fresh = ~seen[active[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[active[:, None], near] = True
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            node = near[r, c]
            d = np.full(near.shape, np.inf, dtype=np.float32)
            d[r, c] = self.squares[node] - 2 * np.einsum("ij,ij->i", queries[active[r]], self.points[node])
            all_d = np.concatenate([dist[active], d], axis=1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(np.concatenate([ids[active], near.astype(np.int32)], axis=1), best, axis=1)
            done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1), best, axis=1)
            dist[active] = np.take_along_axis(all_d, best, axis=1)
        ids[~np.isfinite(dist)] = -1
        return ids, dist

    def prune(self, at: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Edges for the nodes ``at`` out of ``candidates`` (-1 pads): nearest first, dropping what a kept one covers."""
        candidates = np.sort(np.where(candidates == at[:, None], -1, candidates), axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        c = self.points[candidates]
        own = self.points[at]
        to_own = np.maximum(self.squares[candidates] + self.squares[at][:, None] - 2 * np.einsum("bcd,bd->bc", c, own), 0)
        between = np.maximum(self.squares[candidates][:, :, None] + self.squares[candidates][:, None, :] - 2 * (c @ c.transpose(0, 2, 1)), 0)
        left = np.where(candidates < 0, np.inf, to_own)
        out = np.full((len(at), DEGREE), -1, dtype=np.int32)
        row = np.arange(len(at))
        for k in range(DEGREE):
            pick = left.argmin(axis=1)
            ok = np.isfinite(left[row, pick])
            if not ok.any():
                break
            out[ok, k] = candidates[row, pick][ok]
            covered = SLACK**2 * between[row, pick] <= to_own
            left[covered] = np.inf
            left[row, pick] = np.inf
        return out


def build(points: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """(order of nodes, edges, entry): nodes are renumbered and inserted by falling norm, ties at random.

    The last coordinate is what a node lacks to the largest norm; early nodes become the hubs that
    queries by inner product need.
    """
    n = len(points)
    order = np.lexsort((np.random.default_rng(seed).random(n), points[:, -1]))
    points = points[order]
    edges = np.full((n, DEGREE), -1, dtype=np.int32)
    graph = Graph(points, edges, 0)
    have, size = 1, 1
    while have < n:
        new = np.arange(have, min(n, have + size))
        found, _ = graph.search(points[new], BUILD_BEAM, among=have)
        if len(new) > 1:  # nodes of one batch see each other through their order
            peers = np.stack([np.roll(new, s) for s in (1, -1)], axis=1)
            found = np.concatenate([found, peers.astype(np.int32)], axis=1)
        edges[new] = graph.prune(new, found)
        source, k = np.nonzero(edges[new] >= 0)
        target = edges[new][source, k]
        _add_reverse(graph, target, new[source])
        have += len(new)
        size = min(BATCH, 2 * size)
    return order, edges, 0


def _add_reverse(graph: Graph, target: np.ndarray, source: np.ndarray) -> None:
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    lo = 0
    while place.max(initial=-1) >= lo:  # a much chosen node takes its new edges in several turns
        now = (place >= lo) & (place < lo + DEGREE)
        who, more, slot = np.searchsorted(nodes, target[now]), source[now], place[now] - lo
        extra = np.full((len(nodes), DEGREE), -1, dtype=np.int32)
        extra[who, slot] = more
        busy = np.flatnonzero((extra >= 0).any(axis=1))
        held = graph.edges[nodes[busy]]
        both = np.concatenate([held, extra[busy]], axis=1)
        fits = (both >= 0).sum(axis=1) <= DEGREE
        packed = np.sort(both[fits], axis=1)[:, ::-1][:, :DEGREE]
        graph.edges[nodes[busy[fits]]] = packed
        for part in np.array_split(busy[~fits], max(1, -(-int((~fits).sum()) // BATCH))):
            if len(part):
                graph.edges[nodes[part]] = graph.prune(nodes[part], np.concatenate([graph.edges[nodes[part]], extra[part]], axis=1))
        lo += DEGREE


def level(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate, so that all have the largest norm among them."""
    squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
    extra = np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))
    return np.column_stack([vectors, extra]).astype(np.float32)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))


INDEX = "dim int, shard int, nodes long, file string, n_bytes long"
NEAR = "query_id long, query_key long, vec_id long, score double"


@dataclass
class Shard:
    """What a query needs of one shard."""

    vectors: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    graph: Graph

    def __post_init__(self) -> None:
        self.first = np.cumsum(self.counts) - self.counts

    @staticmethod
    def save(folder: str, vectors: np.ndarray, edges: np.ndarray, ids: list[np.ndarray]) -> tuple[str, int]:
        out = Sink(folder, ".graph")
        flat = np.concatenate(ids)
        out.write(np.array([len(vectors), vectors.shape[1], len(flat)], dtype=np.int64).tobytes())
        for part in (vectors, edges, np.array([len(x) for x in ids], dtype=np.int64), flat):
            out.write(part.tobytes())
        out.close()
        return out.name, out.position

    @staticmethod
    def load(name: str) -> Shard:
        source = Source(name)
        raw = source.read(0, source.size)
        source.close()
        n, dim, m = np.frombuffer(raw, np.int64, 3).tolist()
        at, parts = 24, []
        for kind, size in ((np.float64, n * dim), (np.int32, n * DEGREE), (np.int64, n), (np.int64, m)):
            parts.append(np.frombuffer(raw, kind, size, at))
            at += parts[-1].nbytes
        vectors = parts[0].reshape(n, dim)
        return Shard(vectors, parts[2], parts[3], Graph(level(vectors), parts[1].reshape(n, DEGREE), 0))


def build_index(embeddings: DataFrame, k: int = K, shard_nodes: int = SHARD_NODES) -> tuple[DataFrame, int]:
    """(index with one row per shard and its file, number of shards). Every usable vector is in it."""
    vectors = usable(embeddings)
    few = Window.partitionBy("vector").orderBy("vec_id")  # limited before its shuffle, so a common vector stays small
    nodes = vectors.withColumn("nth", F.dense_rank().over(few)).filter(F.col("nth") <= k + 1).groupBy("vector").agg(F.collect_set("vec_id").alias("ids"))
    nodes = materialise(nodes, "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_nodes))
    dealt = nodes.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), "vector", "ids")
    folder = fresh_path(embeddings.sparkSession, "ann-graphs")

    def one(f: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(f["vector"].to_numpy()).astype(np.float64)
        order, edges, _ = build(level(vectors))
        ids = [np.sort(np.asarray(x, dtype=np.int64)) for x in f["ids"]]
        name, size = Shard.save(folder, vectors[order], edges, [ids[i] for i in order])
        return pd.DataFrame([{"dim": f["dim"].iloc[0], "shard": f["shard"].iloc[0], "nodes": len(vectors), "file": name, "n_bytes": size}])

    return materialise(dealt.groupBy("dim", "shard").applyInPandas(one, INDEX), "ann-index"), shards


def search(queries: DataFrame, index: DataFrame, shards: int, k: int = K, beam: int = SEARCH_BEAM) -> DataFrame:
    """The ``k`` nearest of each row of ``queries`` (vec_id, embedding), itself excluded: query_id, rank, vec_id, score."""
    asked = materialise(usable(queries).distinct(), "ann-queries")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    keyed = asked.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int").alias("block"), "vec_id", F.xxhash64("vector").alias("query_key"), "vector")

    def bundle(f: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(f["vector"].to_numpy()).astype(np.float64)
        return pd.DataFrame([{"dim": f["dim"].iloc[0], "block": f["block"].iloc[0], "q_ids": f["vec_id"].to_numpy(np.int64).tobytes(), "q_keys": f["query_key"].to_numpy(np.int64).tobytes(), "q": q.tobytes()}])

    bundles = keyed.groupBy("dim", "block").applyInPandas(bundle, "dim int, block int, q_ids binary, q_keys binary, q binary")
    everywhere = bundles.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(index, ["dim", "shard"]).drop("nodes", "n_bytes")

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, shard = None, None
        for f in frames:
            for r in f.to_dict("records"):
                if r["file"] != name:
                    name, shard = r["file"], Shard.load(r["file"])
                yield _search_shard(r, shard, k, beam)

    # a task gets neighbouring (shard, block) pairs: one shard or two, whatever the numbers of shards and blocks
    dealt = everywhere.repartitionByRange("file", "block").sortWithinPartitions("file", "block")
    near = dealt.select("file", "q_ids", "q_keys", "q", "dim").mapInPandas(answer, NEAR)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_shard(r: dict, shard: Shard, k: int, beam: int) -> pd.DataFrame:
    n, dim = shard.vectors.shape
    q = np.frombuffer(r["q"], np.float64).reshape(-1, dim)
    q_ids, q_keys = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_keys"], np.int64)
    if n <= beam:
        found = np.broadcast_to(np.arange(n), (len(q), n))
    else:
        found, _ = shard.graph.search(np.column_stack([q, np.zeros(len(q))]).astype(np.float32), beam)
    who, scores, owner = [], [], []
    for i in range(len(q)):
        nodes = found[i][found[i] >= 0]
        c = shard.counts[nodes]
        member = np.repeat(shard.first[nodes], c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        ids, s = shard.ids[member], np.repeat(np.einsum("ij,j->i", shard.vectors[nodes], q[i]), c)
        other = ids != q_ids[i]
        ids, s = ids[other], s[other]
        top = np.lexsort((ids, -s))[:k]
        who.append(ids[top])
        scores.append(s[top])
        owner.append(np.full(len(top), i))
    at = np.concatenate(owner)
    return pd.DataFrame({"query_id": q_ids[at], "query_key": q_keys[at], "vec_id": np.concatenate(who), "score": np.concatenate(scores)})
