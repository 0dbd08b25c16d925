"""Best-fit packing by length patterns and non-negative least squares.

The plan depends on the histogram of piece lengths alone (at most ``capacity`` counts):
every multiset of up to three lengths that fills a sequence is a pattern; repeat counts are fitted to
the histogram by projected accelerated gradient on the non-negative least squares problem, rounded
(up from a fraction that is chosen to give the fewest sequences, as far as the histogram allows);
what is left is packed best fit, longest first, with equal sequences handled together. The plan is a table of patterns and
repeat counts, so its size is bounded by ``capacity``, however many documents there are.
Every piece then finds its place from its rank among the pieces of its length. Ranks come from
counts by (length, chunk), so that no length meets in one task.

Defined results: null text is empty, and an empty text is one piece that holds only the end id; no
documents, no pieces; repeated rows and ids are documents of their own; a very long text is encoded by one task and cut into
pieces of ``capacity`` ids, the first of which may be shorter; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvella.llm.unit_encoder import encoder
from corvella.plans.storage import materialise

END_ID = 2
CAPACITY = 1024
RANK_CHUNK_ROWS = 20_000
#: Fractions from which a fitted repeat count is rounded up; the plan with the fewest sequences is used.
ROUND_UP = (0.9, 0.75, 0.5, 0.25, 0.1, 0.03)


def _fill_patterns(capacity: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c >= 0 and a + b + c = capacity; 0 stands for no piece."""
    a = np.arange(1, capacity + 1)
    grid = []
    for c in range(capacity // 3 + 1):
        b = np.arange(c, (capacity - c) // 2 + 1)
        first = capacity - c - b
        keep = first >= b
        grid.append(np.column_stack([first[keep], b[keep], np.full(int(keep.sum()), c)]))
    out = np.concatenate(grid)
    return out[(out[:, 0] <= a[-1])]


def _fit(patterns: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative repeat counts x with sum of x over the patterns' lengths close to ``counts``."""
    n = len(counts)
    flat = patterns.ravel()

    def lengths(x: np.ndarray) -> np.ndarray:
        y = np.bincount(flat, weights=np.repeat(x, 3), minlength=n)
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[patterns].sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(lengths(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = z = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(z - back(lengths(z) - counts) / norm, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_patterns(counts: np.ndarray, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, repeats)] that use up ``counts`` (index = length) exactly."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    used: dict[tuple[int, ...], int] = defaultdict(int)
    if left[1:].sum() == 0:
        return []
    if left[capacity]:
        used[(capacity,)] = int(left[capacity])
        left[capacity] = 0
    patterns = _fill_patterns(capacity)
    patterns = patterns[(left[patterns] > 0).all(axis=1, where=patterns > 0)]
    x = _fit(patterns, left.astype(float), rounds) if len(patterns) else np.zeros(0)
    plans = [_rounded(patterns, x, least, left.copy(), dict(used)) for least in ROUND_UP]
    return sorted(min(plans, key=lambda plan: sum(plan.values())).items())


def _rounded(patterns: np.ndarray, x: np.ndarray, least: float, left: np.ndarray, used: dict) -> dict:
    """Repeats rounded down, one more for each fraction of at least ``least``, the residue best fit."""
    used = defaultdict(int, used)
    whole = np.floor(x + 1e-9)
    for i in np.flatnonzero(whole).tolist():
        _take(tuple(v for v in patterns[i].tolist() if v), int(whole[i]), left, used)
    rest = np.where(x > 0, x - whole, -1)
    order = np.argsort(-rest, kind="stable")
    for i in order[: int((rest >= least).sum())].tolist():
        _take(tuple(v for v in patterns[i].tolist() if v), 1, left, used)
    for lengths, k in _best_fit(left, len(left) - 1):
        used[lengths] += k
    return used


def _take(lengths: tuple[int, ...], k: int, left: np.ndarray, used: dict) -> None:
    need = {v: lengths.count(v) for v in lengths}
    k = min(k, *(int(left[v]) // m for v, m in need.items()))
    if k > 0:
        used[lengths] += k
        for v, m in need.items():
            left[v] -= k * m


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing. Sequences of equal content are one entry with a count."""
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms = np.zeros(capacity + 1, dtype=bool)
    for v in range(capacity, 0, -1):
        k = int(left[v])
        while k:
            fits = np.flatnonzero(rooms[v:])
            if not len(fits):
                per = min(capacity // v, k)
                full = k // per
                made = [((v,) * per, full)] + ([((v,) * (k - full * per), 1)] if k - full * per else [])
                k = 0
                for lengths, m in made:
                    room = capacity - v * len(lengths)
                    by_room[room][lengths] = by_room[room].get(lengths, 0) + m
                    rooms[room] = True
                continue
            room = int(fits[0]) + v
            lengths, m = by_room[room].popitem()
            put = min(m, k)
            if m > put:
                by_room[room][lengths] = m - put
            if not by_room[room]:
                rooms[room] = False
            k -= put
            more = (*lengths, v)
            by_room[room - v][more] = by_room[room - v].get(more, 0) + put
            rooms[room - v] = True
        left[v] = 0
    return [(lengths, m) for group in by_room.values() for lengths, m in group.items()]


class Places:
    """(length, rank) -> (sequence, offset) by binary search in the plan's rank intervals."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], capacity: int):
        taken = [0] * (capacity + 1)
        rows, base = [], 0
        for lengths, k in plan:
            offset = 0
            for v in lengths:
                rows.append((v, taken[v], base, offset))
                taken[v] += k
                offset += v
            base += k
        table = np.array(rows, dtype=np.int64).reshape(-1, 4)
        self.stride = max(taken) + 1
        key = table[:, 0] * self.stride + table[:, 1]
        order = np.argsort(key, kind="stable")
        self.key, self.start, self.base, self.offset = key[order], table[order, 1], table[order, 2], table[order, 3]

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length * self.stride + rank, side="right") - 1
        return self.base[at] + rank - self.start[at], self.offset[at]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only longer documents are cut."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, special_as_text)
        for f in batches:
            owner, piece, start, length, crc = (array("q") for _ in range(5))
            for i, ids in enumerate(encode.batch(f.column("text"))):
                raw = memoryview(ids + end)
                n = len(raw) // 4
                a, b, p = 0, n % capacity or min(n, capacity), 0
                while a < n:
                    owner.append(i)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    a, b, p = b, b + capacity, p + 1
            columns = [pa.array(np.asarray(x, dtype=np.int64)) for x in (piece, start, length, crc)]
            yield pa.RecordBatch.from_arrays([f.column("doc_id").take(pa.array(np.asarray(owner, dtype=np.int64))), columns[0].cast(pa.int32()), *columns[1:]], names=schema.names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns; a stored table, as it is read twice) with sequence_id and offset.

    Ranks within a length come from a hash of the row: chunks of equal length and hash hold about
    ``RANK_CHUNK_ROWS`` pieces, and are numbered from the counts of the chunks before them.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    places = Places(plan_patterns(counts), capacity)
    chunks = 1 + int(counts.max()) // RANK_CHUNK_ROWS
    at, row = F.col("length"), F.col("row")  # the row travels packed, so that no column of its own can clash
    rows = pieces.select("length", F.pmod(F.xxhash64(*pieces.columns), F.lit(chunks)).alias("chunk"), F.struct(*pieces.columns).alias("row"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")).select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "chunk").orderBy("row")
    ranked = rows.withColumn("nth", F.row_number().over(order)).join(bases, ["length", "chunk"]).select(at, (F.col("base") + F.col("nth") - 1).alias("rank"), row)
    made = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(made)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    put = ranked.select("row", place(F.col("length").cast("long"), F.col("rank").cast("long")).alias("put"))
    return put.select(*[F.col("row").getField(c).alias(c) for c in pieces.columns], "put.sequence_id", "put.offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids."""
    return pack(materialise(token_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
