"""Sums over the edges of many rows at once, dense parts of the graph as blocks of a matrix.

A step of all sources over all edges, sum by (source, dst) of front(source, src) * edge(src, dst), makes a row per front row and edge where it is
a join. Here vertices are numbered; where a square of ``BLOCK`` by ``BLOCK`` vertices holds at least ``DENSE`` edges, its edges are one row,
and so are the front's values over a block of sources and of vertices; a task multiplies two such blocks and gives one row per
value of the product. Edges of other squares are joined as rows, so sparse graphs lose nothing. A block holds BLOCK ** 2 values
at most, whatever the size of the graph. ``Costs`` does the same for the least sums of weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.plans.ordered import running_totals
from corvella.plans.storage import materialise, shuffled

BLOCK = 512
DENSE = 8192
PRODUCT = "s long, v long, x double"
NEARER = "s long, v long, dist double, parent long"


def numbered(ids: DataFrame) -> DataFrame:
    """(id, v) of distinct ``ids`` (id), numbered from 0 in their order, so that neighbours in that order share blocks."""
    return materialise(running_totals(ids.select("id"), ["id"], {"v": F.lit(1)}).withColumn("v", F.col("v").cast("long") - 1), "block-numbers")


def _cell(row: str, col: str, size: int) -> Column:
    return (F.pmod(F.col(row), F.lit(size)) * size + F.pmod(F.col(col), F.lit(size))).cast("int")


def _multiply(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, j = batch.column("sb").to_pylist(), batch.column("j").to_pylist()
            for k in range(batch.num_rows):
                at, x, edge = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("at", "x", "edges"))
                front, square = np.zeros(size * size), np.zeros(size * size)
                np.add.at(front, at, x)
                square[edge] = 1.0
                rows = np.unique(at // size).astype(np.int64)
                made = front.reshape(size, size)[rows] @ square.reshape(size, size)
                r, c = np.nonzero(made)
                yield pa.RecordBatch.from_arrays([pa.array(s[k] * size + rows[r]), pa.array(j[k] * size + c), pa.array(made[r, c])], names=["s", "v", "x"])

    return run


class Blocks:
    """Distinct edges (u, v), by number, ready for ``through``."""

    carried: tuple[str, ...] = ()

    def __init__(self, edges: DataFrame, size: int | None = None, dense: int | None = None):
        self.size, least = size or BLOCK, dense or DENSE
        of = lambda c: F.floor(F.col(c) / self.size)
        placed = edges.select("u", "v", *self.carried, of("u").alias("i"), of("v").alias("j"))
        squares = placed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
        full = materialise(squares.filter(F.col("n") >= least).select("i", "j"), "block-squares")
        self.blocks = self.rows = None
        if not full.isEmpty():
            self.blocks = materialise(placed.join(full, ["i", "j"]).groupBy("i", "j").agg(F.collect_list(_cell("u", "v", self.size)).alias("edges"), *[F.collect_list(c).alias(c) for c in self.carried]), "block-edges")
        rest = materialise(placed.join(full, ["i", "j"], "left_anti").select("u", "v", *self.carried), "block-rest")
        if self.blocks is None or not rest.isEmpty():
            self.rows = rest

    def through(self, front: DataFrame) -> DataFrame:
        """(s, v, x): sums over the edges (u, v) of the ``front`` (s, v, x), whose values are above 0 and whose (s, v) are distinct."""
        parts = []
        if self.rows is not None:
            parts.append(front.select("s", F.col("v").alias("u"), "x").join(self.rows, "u").select("s", "v", "x"))
        if self.blocks is not None:
            of = lambda c: F.floor(F.col(c) / self.size)
            held = front.groupBy(of("s").alias("sb"), of("v").alias("i")).agg(F.collect_list(_cell("s", "v", self.size)).alias("at"), F.collect_list(F.col("x").cast("double")).alias("x"))
            both = held.join(self.blocks, "i").select("sb", "j", "at", "x", "edges")
            parts.append(both.mapInArrow(_multiply(self.size), PRODUCT))
        made = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
        return made.groupBy("s", "v").agg(F.sum("x").alias("x"))


def _matrix(batch: pa.RecordBatch, at: str, x: str, k: int, size: int) -> np.ndarray:
    """Row ``k``'s values as a square, infinity where there are none."""
    m = np.full(size * size, np.inf)
    if batch.column(at)[k].is_valid:
        m[batch.column(at)[k].values.to_numpy(zero_copy_only=False)] = batch.column(x)[k].values.to_numpy(zero_copy_only=False)
    return m.reshape(size, size)


def _least(front: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least sums of a front row's value and an edge, and the first column of the front that gives them."""
    least, by = np.full(front.shape, np.inf), np.zeros(front.shape, dtype=np.int32)
    there = np.isfinite(front)
    for u in np.flatnonzero(there.any(0) & np.isfinite(square).any(1)):
        r = np.flatnonzero(there[:, u])
        if 2 * len(r) > len(front):
            made = front[:, u, None] + square[u]
            nearer = made < least
            np.copyto(least, made, where=nearer)
            by[nearer] = u
        else:
            made = front[r, u, None] + square[u]
            nearer = made < least[r]
            least[r] = np.where(nearer, made, least[r])
            by[r] = np.where(nearer, u, by[r])
    return least, by


def _relax(size: int, ties: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sb, i, j = (batch.column(c).to_pylist() for c in ("sb", "i", "j"))
            for k in range(batch.num_rows):
                front, square, known = _matrix(batch, "at", "x", k, size), _matrix(batch, "edges", "w", k, size), _matrix(batch, "known_at", "known_x", k, size)
                rows = np.flatnonzero(np.isfinite(front).any(1))
                front, known = front[rows], known[rows]
                found = []
                if ties:
                    for u in np.flatnonzero(np.isfinite(front).any(0) & np.isfinite(square).any(1)):
                        r, c = np.nonzero((front[:, u, None] + square[u] == known) & np.isfinite(known))
                        found.append((r, c, known[r, c], np.full(len(r), u)))
                else:
                    least, by = _least(front, square)
                    r, c = np.nonzero((least <= known) & np.isfinite(least))
                    found.append((r, c, least[r, c], by[r, c]))
                for r, c, dist, u in found:
                    yield pa.RecordBatch.from_arrays([pa.array(sb[k] * size + rows[r]), pa.array(j[k] * size + c), pa.array(dist), pa.array(i[k] * size + u.astype(np.int64))], names=["s", "v", "dist", "parent"])

    return run


class Costs(Blocks):
    """Distinct edges (u, v, w), by number, with weights above 0, ready for least sums."""

    carried = ("w",)

    def _held(self, rows: DataFrame, col: str, at: str, x: str) -> DataFrame:
        of = lambda c: F.floor(F.col(c) / self.size)
        return rows.groupBy(of("s").alias("sb"), of("v").alias(col)).agg(F.collect_list(_cell("s", "v", self.size)).alias(at), F.collect_list("dist").alias(x))

    def _over(self, front: DataFrame, known: DataFrame, ties: bool) -> DataFrame:
        both = self._held(front, "i", "at", "x").join(shuffled(self.blocks), "i").join(shuffled(self._held(known, "j", "known_at", "known_x")), ["sb", "j"], "left")
        return both.select("sb", "i", "j", "at", "x", "edges", "w", "known_at", "known_x").mapInArrow(_relax(self.size, ties), NEARER)

    def _by_rows(self, front: DataFrame) -> DataFrame:
        return front.select("s", F.col("v").alias("u"), "dist").join(self.rows, "u").select("s", "v", (F.col("dist") + F.col("w")).alias("dist"), F.col("u").alias("parent"))

    def nearer(self, front: DataFrame, known: DataFrame) -> DataFrame:
        """(s, v, dist, parent): least sums of a distance of ``front`` (s, v, dist) and an edge, by the smallest of equal parents; what is further
        than ``known`` (s, v, dist) says may be left out."""
        parts = [self._by_rows(front)] if self.rows is not None else []
        if self.blocks is not None:
            parts.append(self._over(front, known, False))
        made = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
        return made.groupBy("s", "v").agg(F.min(F.struct("dist", "parent")).alias("m")).select("s", "v", "m.dist", "m.parent")

    def ties(self, known: DataFrame) -> DataFrame:
        """(s, v, parent): every last step that gives just the distance of ``known`` (s, v, dist)."""
        parts = []
        if self.rows is not None:
            parts.append(self._by_rows(known).join(shuffled(known), ["s", "v", "dist"]).select("s", "v", "parent"))
        if self.blocks is not None:
            parts.append(self._over(known, known, True).select("s", "v", "parent"))
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])
