"""Hard negatives by slots between the positives' upper limits.

Each anchor has a few positives, and each positive a window of scores in which its negatives lie; windows of one
anchor overlap. Their upper limits cut the scores into disjoint slots, and a row belongs to the slot of the smallest limit
that is not below its score. Tasks keep the first ``negatives`` rows of each slot among the rows they see (the combiner);
these lists are merged by slot, and since slots are disjoint and ordered, the merged lists of a slot and all
lower ones, read in descending order, begin with the first rows under that limit: every window is answered from the
same lists, cut at its lower limit. An anchor never has more than positives * negatives rows at once.

Rows are written once, as whole numbers, to files of ``BLOCK_ROWS`` rows; anchors, the stated query set, are bundled in
blocks and every block meets every file: once for the positives (rows of one label are multiplied only by anchors of
that label), once for the negatives. A task holds a file and a block. So the work is anchors times rows, as the result asks for.

Defined results: rows with a null id or label, a null vector or a null or non-finite component take no part; rows
of other dimensions than the anchor's are no candidates of it; of rows that repeat an id the one of smallest label, then vector, is
meant; ties go to the smaller id; an anchor without positives, or whose positives score below 0, has no rows; no rows
give none; other columns are ignored. Scores are exact; where they could reach 2**56 the job ends in an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.llm.files import Sink, Source
from corvella.plans.storage import fresh_path, materialise

BLOCK_ROWS = 1 << 14
BLOCK_ANCHORS = 1 << 9
SCALE = 256
MOST_SCORE = 1 << 56
FILES = "dim int, file string, n_rows long"
BUNDLE = "dim int, block int, ids binary, labels binary, limits binary, q binary"
NO_LIMIT = np.iinfo(np.int64).min


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("vector"))
    if kept.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return kept
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")


def _matrices(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, matrix) for each dimension in a column of arrays."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, values[offsets[at][:, None] + np.arange(d)]


def write_rows(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Files of usable rows, components as floor(scale * x), each of one dimension and sorted by label; one row per file."""
    folder = fresh_path(rows.sparkSession, "negatives-rows")

    def save(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[str, int]:
        ids, labels, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, labels))
        most = np.abs(m).max(initial=0)
        m = m[order].astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)
        out = Sink(folder, ".rows")
        out.write(np.array([len(m), m.shape[1], m.dtype.itemsize], dtype=np.int64).tobytes())
        for part in (ids[order], labels[order], m):
            out.write(part.tobytes())
        out.close()
        return out.name, len(m)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        done: list[tuple[int, str, int]] = []
        for b in batches:
            ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
            for d, at, m in _matrices(b.column(2)):
                held.setdefault(d, []).append((ids[at], labels[at], np.floor(scale * m)))
                if sum(len(x[0]) for x in held[d]) >= BLOCK_ROWS:
                    done.append((d, *save(held.pop(d))))
        done += [(d, *save(parts)) for d, parts in held.items()]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.string()), pa.array([x[2] for x in done], pa.int64())], ["dim", "file", "n_rows"])

    return materialise(rows.select("vec_id", "label", "vector").mapInArrow(write, FILES), "negatives-files")


def load_rows(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of one file."""
    source = Source(name)
    raw = source.read(0, source.size)
    source.close()
    n, dim, size = np.frombuffer(raw, np.int64, 3).tolist()
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[size]
    vectors = np.frombuffer(raw, kind, n * dim, 24 + 16 * n).reshape(n, dim)
    return np.frombuffer(raw, np.int64, n, 24), np.frombuffer(raw, np.int64, n, 24 + 8 * n), vectors.astype(np.float64)


def _bundles(anchors: DataFrame, scale: int) -> DataFrame:
    """Blocks of anchors (vec_id, label, vector, limits array<long>), each one row, components as floor(scale * x)."""
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    keyed = anchors.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "label", "vector", "limits")

    def bundle(f: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, f["limits"]))
        limits = np.stack([np.concatenate([np.full(width - len(x), NO_LIMIT), np.sort(np.asarray(x, np.int64))]) for x in f["limits"]])
        q = np.floor(scale * np.stack(f["vector"].to_numpy()).astype(np.float64))
        return pd.DataFrame([{"dim": f["dim"].iloc[0], "block": f["block"].iloc[0], "ids": f["vec_id"].to_numpy(np.int64).tobytes(), "labels": f["label"].to_numpy(np.int64).tobytes(), "limits": limits.astype(np.int64).tobytes(), "q": q.tobytes()}])

    return keyed.groupBy("dim", "block").applyInPandas(bundle, BUNDLE)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * q.shape[1]
    if most >= MOST_SCORE:
        raise ValueError("components are too large for exact scores")
    if most < 1 << 53:
        return (q @ v.T).astype(np.int64)
    return np.einsum("ik,jk->ij", q.astype(np.int64), v.astype(np.int64))


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, ties to smaller ids."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _positives(r: dict, rows: tuple, k: int) -> Iterator[tuple]:
    """(anchor, 0, id, score) of the first ``k`` other rows of the anchor's label in one file."""
    q_ids, q_labels, q, _ = _bundle_of(r)
    ids, labels, v = rows
    for label in np.unique(q_labels).tolist():
        lo, hi = np.searchsorted(labels, [label, label + 1])
        mine = np.flatnonzero(q_labels == label)
        if lo < hi:
            scores = _scores(q[mine], v[lo:hi])
            for i, s in zip(mine, scores, strict=True):
                other = np.flatnonzero(ids[lo:hi] != q_ids[i])
                at = other[_first(ids[lo:hi][other], s[other], k)]
                yield q_ids[i], np.zeros(len(at), np.int32), ids[lo:hi][at], s[at]


def _slots(r: dict, rows: tuple, k: int) -> Iterator[tuple]:
    """(anchor, slot, id, score) of the first ``k`` rows of each slot of each anchor in one file."""
    q_ids, q_labels, q, limits = _bundle_of(r)
    ids, labels, v = rows
    for i, s in enumerate(_scores(q, v)):
        near = np.flatnonzero((labels != q_labels[i]) & (s <= limits[i, -1]) & (s >= 0))  # no window reaches below 0
        slot = np.searchsorted(limits[i], s[near])  # the smallest limit that is not below the score
        for t in np.unique(slot).tolist():
            there = near[slot == t]
            at = there[_first(ids[there], s[there], k)]
            yield q_ids[i], np.full(len(at), t, np.int32), ids[at], s[at]


def _bundle_of(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
    return ids, labels, np.frombuffer(r["q"], np.float64).reshape(len(ids), r["dim"]), np.frombuffer(r["limits"], np.int64).reshape(len(ids), -1)


def _meet(bundles: DataFrame, files: DataFrame, find, k: int) -> DataFrame:
    """The first ``k`` rows per (anchor_id, slot) that ``find`` returns over all files: anchor_id, slot, vec_id, score."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["file"] != name:
                    name, rows = r["file"], load_rows(r["file"])
                found = list(find(r, rows, k))
                anchor = np.concatenate([np.full(len(x[2]), x[0], np.int64) for x in found]) if found else np.zeros(0, np.int64)
                slot, ids, scores = (np.concatenate([x[j] for x in found]) if found else np.zeros(0, np.int64) for j in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(slot.astype(np.int32)), pa.array(ids.astype(np.int64)), pa.array(scores.astype(np.int64))], ["anchor_id", "slot", "vec_id", "score"])

    met = bundles.join(files.select("dim", "file"), "dim")
    dealt = met.repartitionByRange("file", "block").sortWithinPartitions("file", "block")
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    found = dealt.mapInArrow(answer, "anchor_id long, slot int, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)  # limited before its shuffle


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, embedding. An anchor's positives are its first ``positives`` other rows of its label; the negatives of a
    positive are the first ``negatives`` rows of other labels with low * positive <= 100 * score <= high * positive.
    """
    sound = usable(rows)
    files = write_rows(sound, scale)
    anchors = materialise(sound.filter(is_anchor), "anchors")
    found = _meet(_bundles(anchors.withColumn("limits", F.array().cast("array<long>")), scale), files, _positives, positives)
    found = materialise(found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives").filter("positive_score >= 0")
    limit = F.expr(f"(positive_score * {high}) div 100")
    limits = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_set(limit.cast("long"))).alias("limits"))
    slots = _meet(_bundles(anchors.join(limits, "vec_id"), scale), files, _slots, negatives)
    lists = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id"))).alias("found"))  # at most positives * negatives
    top, least = F.col("positive_score") * high, F.col("positive_score") * low
    under = F.slice(F.filter("found", lambda x: -100 * x.m <= top), 1, negatives)
    window = F.filter(under, lambda x: -100 * x.m >= least)
    each = found.join(lists, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("at", "near"))
    return each.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("near.vec_id").alias("negative_id"), "positive_score", (-F.col("near.m")).alias("negative_score"))
