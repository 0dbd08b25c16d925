"""Bounded labelled samples for fitting, and the folds of the labels."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = TypeVar("Model")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


#: A sample for fitting holds about this many bytes of text at most, whatever its rows hold.
FIT_BYTES = 128 << 20
BUCKETS = 1 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, used: Column, rows: int, most_bytes: int = FIT_BYTES) -> DataFrame:
    """(text, y) of labelled documents for which ``used`` (of doc_id) holds, thinned by hashes to about ``rows`` rows and ``most_bytes`` of text.

    The labels are thinned first; the joined sample is counted, and thinned again where ids repeat or texts are very long.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & used).select("doc_id", F.col(label).cast("int").alias("y"))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(BUCKETS)) < int(BUCKETS * rows / n)).orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id", "y").limit(2 * rows)
    text = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = text.join(F.broadcast(known), "doc_id").select("text", "y")  # at most 2 * rows pairs of an id and a label
    found = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    share = min(1.0, 2 * rows / max(found.n, 1), most_bytes / max(found.bytes, 1))
    return sample if share == 1 else sample.filter(F.pmod(F.xxhash64("text"), F.lit(BUCKETS)) < int(BUCKETS * share))


def _distinct(columns: Iterator[tuple[pa.Array, pa.Array]]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct arrays and labels of (lists, labels), in an order fixed by their contents."""
    once = {}
    for lists, labels in columns:
        values, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for a, b, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), labels.to_pylist(), strict=True):
            own = values[a:b].copy()
            once.setdefault((y, b - a, own[:8].tobytes(), hashlib.blake2b(own.tobytes(), digest_size=16).digest()), own)
    order = sorted(once)
    return [once[k] for k in order], np.array([k[0] for k in order], dtype=np.float64)


def fitted(rows: DataFrame, lists: str, fit: Callable[[list[np.ndarray], np.ndarray], Model]) -> Model:
    """What ``fit`` makes of the distinct arrays (column ``lists``) and labels (column y) of a bounded sample. It runs in one task, so that the driver holds the
    model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(*_distinct((b.column(lists), b.column("y")) for b in batches))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.select(lists, "y").repartition(1).mapInArrow(run, "model binary").first()
    return fit([], np.zeros(0)) if made is None else pickle.loads(made.model)
