"""Breadth-first search from many sources at once, its state held as blocks of the matrix of sources and vertices.

A row holds all values of ``size`` sources by ``size`` vertices, packed: distances, numbers of shortest paths, and what measures add to
them. A round multiplies blocks of the front by dense squares of the edges where they are merged into the state, so no product is shuffled
and no pair becomes a row; edges of sparse squares are joined as rows, for the vertices only that have such edges. A task holds the blocks of one
place at a time, whatever the size of the graph. Measures read the blocks; pairs are unfolded only for a caller who asks for them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from corvella.operators.blocks import Blocks, _cell, numbered
from corvella.plans.storage import materialise

STATE = "sb long, vb long, dist binary, paths binary, delta binary, fresh long"
STEPS = "sb long, vb long, kind int, one binary, two binary, three binary, at array<int>, x array<double>"
JOINED = 65536  # a square whose edges would make so many rows when joined is dense


def least_dense(sources: int, size: int) -> int:
    """Edges from which on a square is multiplied, not joined, for a search from so many sources."""
    return max(1, JOINED // max(1, min(size, sources)))


def packed(values: np.ndarray) -> bytes:
    """The values other than 0 of a block, in the narrowest type that keeps them, behind a map of their places."""
    flat = values.ravel()
    there = flat != 0
    v = flat[there]
    whole = not v.size or (v.min() >= 0 and (v == np.floor(v)).all())
    kind = next((t for t in ("u1", "u2", "u4") if whole and (not v.size or v.max() <= np.iinfo(t).max)), "f8")
    where, body = zlib.compress(np.packbits(there).tobytes(), 1), v.astype(kind).tobytes()
    return kind.encode() + len(where).to_bytes(4, "little") + where + (body if kind == "f8" else zlib.compress(body, 1))


def unpacked(data: bytes | None, rows: int, size: int) -> np.ndarray:
    out = np.zeros(rows * size)
    if data is not None:
        kind, end = data[:2].decode(), 6 + int.from_bytes(data[2:6], "little")
        there = np.unpackbits(np.frombuffer(zlib.decompress(data[6:end]), np.uint8), count=rows * size).view(bool)
        out[there] = np.frombuffer(data[end:] if kind == "f8" else zlib.decompress(data[end:]), kind)
    return out.reshape(rows, size)


def _records(names: list[str], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=schema.field(n).type) for i, n in enumerate(names)], schema=schema)


STATE_ARROW = pa.schema([("sb", pa.int64()), ("vb", pa.int64()), ("dist", pa.binary()), ("paths", pa.binary()), ("delta", pa.binary()), ("fresh", pa.int64())])


def _merge(size: int, sources: int, finish: Callable, counted: bool):
    """Blocks of one place after another, state first: sums of its products and rows, then ``finish(dist, paths, delta, sums)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state, sums = None, (None, None, None), None

        def ended() -> pa.RecordBatch:
            rows = min(size, sources - place[0] * size)
            dist, paths, delta = (unpacked(b, rows, size) for b in state)
            dist, paths, delta, fresh = finish(dist, paths, delta, sums)
            made = [None if m is None else packed(m) for m in (dist, paths, delta)]
            return _records(STATE_ARROW.names, [(*place, *made, int(fresh))], STATE_ARROW)

        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k] for c in batch.schema.names}
                now = r["sb"].as_py(), r["vb"].as_py()
                if now != place:
                    if place is not None:
                        yield ended()
                    place, state = now, (None, None, None)
                    rows = min(size, sources - now[0] * size)
                    sums = np.zeros((rows, size), dtype=np.float64 if counted else np.float32)
                kind = r["kind"].as_py()
                if kind == 0:
                    state = tuple(r[c].as_py() for c in ("one", "two", "three"))
                elif kind == 1:
                    front = unpacked(r["one"].as_py(), rows, size)
                    used, by = np.flatnonzero(front.any(1)), np.flatnonzero(front.any(0))
                    square = np.unpackbits(np.frombuffer(r["two"].as_py(), np.uint8), count=size * size).reshape(size, size)
                    sums[used] += front[np.ix_(used, by)].astype(sums.dtype) @ square[by].astype(sums.dtype)
                else:
                    np.add.at(sums.reshape(-1), r["at"].values.to_numpy(), r["x"].values.to_numpy().astype(sums.dtype))
        if place is not None:
            yield ended()

    return run


def _squares(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                square = np.zeros(size * size, dtype=np.uint8)
                square[batch.column("edges")[k].values.to_numpy()] = 1
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(k, 1), batch.column("j").slice(k, 1), pa.array([np.packbits(square).tobytes()], pa.binary())], names=["i", "j", "edges"])

    return run


def _started(size: int, sources: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sb, vb = batch.column("sb")[k].as_py(), batch.column("vb")[k].as_py()
                m = np.zeros((min(size, sources - sb * size), size))
                m.reshape(-1)[batch.column("at")[k].values.to_numpy()] = 1
                own = packed(m)
                yield _records(STATE_ARROW.names, [(sb, vb, own, own, None, int(m.sum()))], STATE_ARROW)

    return run


def _fronts(size: int, sources: int, front: Callable):
    """(sb, i, front): blocks of ``front(dist, paths, delta)``; with ``ends``, its values at these columns only, as rows (s, u, x)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sb = batch.column("sb")[k].as_py()
                m = front(*(unpacked(batch.column(c)[k].as_py(), min(size, sources - sb * size), size) for c in ("dist", "paths", "delta")))
                if m.any():
                    yield pa.RecordBatch.from_arrays([batch.column("sb").slice(k, 1), batch.column("i").slice(k, 1), pa.array([packed(m)], pa.binary())], names=["sb", "i", "front"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sb, i = batch.column("sb")[k].as_py(), batch.column("i")[k].as_py()
                m = front(*(unpacked(batch.column(c)[k].as_py(), min(size, sources - sb * size), size) for c in ("dist", "paths", "delta")))
                at = batch.column("ends")[k].values.to_numpy()
                r, c = np.nonzero(m[:, at])
                yield pa.RecordBatch.from_arrays([pa.array(sb * size + r), pa.array(i * size + at[c].astype(np.int64)), pa.array(m[:, at][r, c])], names=["s", "u", "x"])

    return blocks, rows


def block_names(numbers: DataFrame, number: str, size: int, block: str, name: str) -> DataFrame:
    """(block, name): the ids of each block of ``numbers`` (id, number), in the order of their numbers."""
    held = F.array_sort(F.collect_list(F.struct(F.col(number), F.col("id"))))
    return numbers.groupBy(F.floor(F.col(number) / size).alias(block)).agg(F.transform(held, lambda x: x["id"]).alias(name))


class Search:
    """State over ``sources`` (id) and the vertices ``known`` (id, v), whose edges are ``edges``; ``counted``: with numbers of shortest paths."""

    def __init__(self, known: DataFrame, edges: Blocks, sources: DataFrame, counted: bool = True):
        self.known, self.edges, self.size, self.counted = known, edges, edges.size, counted
        self.starts = numbered(sources).withColumnRenamed("v", "s")
        self.sources = self.starts.count()
        self.parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.squares = self.ends = None
        of = lambda c: F.floor(F.col(c) / self.size)
        if edges.blocks is not None:
            self.squares = materialise(edges.blocks.select("i", "j", "edges").mapInArrow(_squares(self.size), "i long, j long, edges binary"), "hop-squares")
        if edges.rows is not None:
            at = F.pmod("u", F.lit(self.size)).cast("int")
            self.ends = materialise(edges.rows.select("u").distinct().groupBy(of("u").alias("i")).agg(F.collect_list(at).alias("ends")), "hop-ends")
        own = self.starts.join(known, "id").groupBy(of("s").alias("sb"), of("v").alias("vb")).agg(F.collect_list(_cell("s", "v", self.size)).alias("at"))
        self.cells = materialise(own.mapInArrow(_started(self.size, self.sources), STATE), "hop-cells")

    def step(self, cells: DataFrame, front: Callable, finish: Callable, among: str = "true") -> DataFrame:
        """``cells`` after one step along all edges of the values that ``front`` takes from those ``among`` them."""
        blocks, rows = _fronts(self.size, self.sources, front)
        state = cells.select("sb", "vb", F.lit(0).alias("kind"), F.col("dist").alias("one"), F.col("paths").alias("two"), F.col("delta").alias("three"))
        parts, now = [state], cells.filter(among).select("sb", F.col("vb").alias("i"), "dist", "paths", "delta")
        if self.squares is not None:
            made = now.mapInArrow(blocks, "sb long, i long, front binary").join(self.squares, "i")
            parts.append(made.select("sb", F.col("j").alias("vb"), F.lit(1).alias("kind"), F.col("front").alias("one"), F.col("edges").alias("two")))
        if self.ends is not None:
            of = lambda c: F.floor(F.col(c) / self.size)
            made = now.join(self.ends, "i").mapInArrow(rows, "s long, u long, x double").join(self.edges.rows, "u").groupBy("s", "v").agg(F.sum("x").alias("x"))
            parts.append(made.groupBy(of("s").alias("sb"), of("v").alias("vb")).agg(F.collect_list(_cell("s", "v", self.size)).alias("at"), F.collect_list("x").alias("x")).withColumn("kind", F.lit(2)))
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p, allowMissingColumns=True)
        for c, t in (("at", "array<int>"), ("x", "array<double>")):
            if c not in both.columns:
                both = both.withColumn(c, F.lit(None).cast(t))
        # a fixed number of partitions: bytes are few beside the work on them
        dealt = both.repartition(self.parts, "sb", "vb").sortWithinPartitions("sb", "vb", "kind")
        return materialise(dealt.mapInArrow(_merge(self.size, self.sources, finish, self.counted), STATE), "hop-cells")

    def spread(self, most: int, radius: int | None = None) -> Search:
        """Distances of all vertices in reach, plus 1 (0: not in reach); an error if some are more than ``most`` hops away, none beyond ``radius``."""
        for d in range(1, (most + 1 if radius is None else radius) + 1):
            last, counted = float(d), self.counted

            def front(dist, paths, delta, last=last, counted=counted):
                return np.where(dist == last, paths if counted else 1.0, 0.0)

            def finish(dist, paths, delta, sums, last=last, counted=counted):
                new = (sums > 0) & (dist == 0)
                dist[new] = last + 1
                if counted:
                    paths[new] = sums[new]
                return dist, paths if counted else None, None, new.sum()

            cells = self.step(self.cells, front, finish, "fresh > 0")
            if cells.filter("fresh > 0").isEmpty():
                return self
            if radius is None and d > most:
                raise RuntimeError(f"vertices are more than {most} hops away")
            self.cells = cells
        return self

    def _read(self, cells: DataFrame, each: Callable, schema: str) -> DataFrame:
        return cells.mapInArrow(_reading(self.size, self.sources, each, [c.split()[0] for c in schema.split(", ")]), schema)

    def counts(self) -> DataFrame:
        """(source, dist, many): how many vertices are at each distance of each source."""

        def each(sb, vb, dist, paths, delta, size):
            for d in np.unique(dist[dist > 0]):
                n = (dist == d).sum(1)
                r = np.flatnonzero(n)
                yield [pa.array(sb * size + r), pa.array(np.full(len(r), d - 1, dtype=np.int32)), pa.array(n[r])]

        x = self._read(self.cells, each, "s long, dist int, many long").groupBy("s", "dist").agg(F.sum("many").alias("many"))
        return x.join(self.starts, "s").select(F.col("id").alias("source"), "dist", "many")

    def deepest(self) -> int:
        return self.counts().agg(F.max("dist")).first()[0] or 0

    def rows(self) -> DataFrame:
        """(source, id, dist, paths) of all pairs in reach; ids are put in block by block, not by a join of the pairs."""
        t = self.known.schema["id"].dataType
        size, sources, counted = self.size, self.sources, self.counted

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    n = min(size, sources - batch.column("sb")[k].as_py() * size)
                    dist = unpacked(batch.column("dist")[k].as_py(), n, size)
                    r, c = np.nonzero(dist)
                    paths = pa.array(unpacked(batch.column("paths")[k].as_py(), n, size)[r, c]) if counted else pa.nulls(len(r), pa.float64())
                    yield pa.RecordBatch.from_arrays([batch.column("sids")[k].values.take(pa.array(r)), batch.column("vids")[k].values.take(pa.array(c)), pa.array((dist[r, c] - 1).astype(np.int32)), paths], names=["source", "id", "dist", "paths"])

        named = self.cells.select("sb", "vb", "dist", "paths").join(block_names(self.starts, "s", self.size, "sb", "sids"), "sb").join(block_names(self.known, "v", self.size, "vb", "vids"), "vb")
        schema = StructType([StructField("source", t), StructField("id", t), StructField("dist", IntegerType()), StructField("paths", DoubleType())])
        found = named.mapInArrow(run, schema)
        return found if counted else found.drop("paths")

    def passed(self) -> DataFrame:
        """(id, x): Brandes' sums of all sources at each vertex that has any, without the sources' own; backwards, a level at a time."""
        cells = self.cells
        for level in range(self.deepest(), 1, -1):

            def front(dist, paths, delta, at=level + 1.0):
                there = dist == at
                return np.divide(1 + delta, paths, out=np.zeros_like(paths), where=there)

            def finish(dist, paths, delta, sums, at=float(level)):
                return dist, paths, np.where(dist == at, paths * sums, delta), 0

            cells = self.step(cells, front, finish)

        def each(sb, vb, dist, paths, delta, size):
            x = delta.sum(0)
            c = np.flatnonzero(x)
            yield [pa.array(vb * size + c), pa.array(x[c])]

        sums = self._read(cells, each, "v long, x double").groupBy("v").agg(F.sum("x").alias("x"))
        return sums.join(self.known, "v").select("id", "x")

    def walks(self, hops: int, alpha: float) -> DataFrame:
        """(src, dst, score) of pairs src < dst: the sum of ``alpha`` ** k times the walks of k steps, up to ``hops``; sources must be all vertices."""
        cells, each_k, size, sources = self.cells, [], self.size, self.sources
        for k in range(1, hops + 1):
            cells = self.step(cells, lambda dist, paths, delta: paths, lambda dist, paths, delta, sums: (None, sums, None, 0))
            each_k.append(cells.select("sb", "vb", F.lit(k).alias("k"), "paths").filter("sb <= vb"))
        both = reduce(DataFrame.union, each_k).repartition(self.parts, "sb", "vb").sortWithinPartitions("sb", "vb", "k")

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, score = None, None

            def ended() -> pa.RecordBatch:
                if place[0] == place[1]:
                    score[np.tril_indices(len(score), 0, size)] = 0.0
                return pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]]), pa.array([packed(score)], pa.binary())], names=["sb", "vb", "score"])

            for batch in batches:
                for k in range(batch.num_rows):
                    now = batch.column("sb")[k].as_py(), batch.column("vb")[k].as_py()
                    n = min(size, sources - now[0] * size)
                    if now != place:
                        if place is not None:
                            yield ended()
                        place, score = now, np.zeros((n, size))
                    score += unpacked(batch.column("paths")[k].as_py(), n, size) * alpha ** batch.column("k")[k].as_py()
            if place is not None:
                yield ended()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    score = unpacked(batch.column("score")[k].as_py(), min(size, sources - batch.column("sb")[k].as_py() * size), size)
                    r, c = np.nonzero(score)
                    yield pa.RecordBatch.from_arrays([batch.column("sids")[k].values.take(pa.array(r)), batch.column("vids")[k].values.take(pa.array(c)), pa.array(score[r, c])], names=["src", "dst", "score"])

        t = self.known.schema["id"].dataType
        scores = both.mapInArrow(summed, "sb long, vb long, score binary")
        named = scores.join(block_names(self.starts, "s", self.size, "sb", "sids"), "sb").join(block_names(self.known, "v", self.size, "vb", "vids"), "vb")
        return named.mapInArrow(run, StructType([StructField("src", t), StructField("dst", t), StructField("score", DoubleType())]))

    def by_label(self, labels: DataFrame) -> DataFrame:
        """(id, to, s, many): sum and number of the distances above 0 from each vertex to the sources of each label."""
        size, sources = self.size, self.sources
        codes = numbered(labels.select(F.col("label").alias("id")).filter("id IS NOT NULL").distinct())
        of = self.starts.join(labels.select("id", "label"), "id").join(codes.select(F.col("id").alias("label"), F.col("v").alias("code")), "label")
        at = of.groupBy(F.floor(F.col("s") / size).alias("sb")).agg(F.collect_list(F.pmod("s", F.lit(size)).cast("int")).alias("at"), F.collect_list("code").alias("codes"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    n, vb = min(size, sources - batch.column("sb")[k].as_py() * size), batch.column("vb")[k].as_py()
                    dist = np.maximum(unpacked(batch.column("dist")[k].as_py(), n, size) - 1, 0)
                    r, code = batch.column("at")[k].values.to_numpy(), batch.column("codes")[k].values.to_numpy()
                    for x in np.unique(code):
                        d = dist[r[code == x]]
                        many = (d > 0).sum(0)
                        c = np.flatnonzero(many)
                        yield pa.RecordBatch.from_arrays([pa.array(vb * size + c), pa.array(np.full(len(c), x)), pa.array(d.sum(0)[c].astype(np.int64)), pa.array(many[c])], names=["v", "code", "s", "many"])

        x = self.cells.select("sb", "vb", "dist").join(at, "sb").mapInArrow(run, "v long, code long, s long, many long").groupBy("v", "code").agg(F.sum("s").alias("s"), F.sum("many").alias("many"))
        return x.join(self.known, "v").join(codes.select(F.col("id").alias("to"), F.col("v").alias("code")), "code").select("id", "to", "s", "many")


def _reading(size: int, sources: int, each: Callable, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sb, vb = batch.column("sb")[k].as_py(), batch.column("vb")[k].as_py()
                state = (unpacked(batch.column(c)[k].as_py(), min(size, sources - sb * size), size) for c in ("dist", "paths", "delta"))
                for columns in each(sb, vb, *state, size):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
