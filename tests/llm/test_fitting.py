"""Fitting stays off the driver, and does not depend on the order of rows; the coder works in wide steps."""

import os

import numpy as np
from pyspark.sql import functions as F

from corvella.llm import labelled, quality, toxicity


def test_models_are_fitted_in_a_task(spark, monkeypatch):
    rows = spark.createDataFrame([([1, 2, 3], 1), ([1, 2, 3], 1), ([1, 2, 3], 0), ([], 0), ([9], 1)], "t array<int>, y int").repartition(3)
    pid, lists, y = labelled.fitted(rows, "t", lambda lists, y: (os.getpid(), [x.tolist() for x in lists], y.tolist()))
    assert pid != os.getpid()
    assert (lists, y) == ([[], [1, 2, 3], [9], [1, 2, 3]], [0, 0, 1, 1])
    for name in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(rows), name, None)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good plain words").otherwise("bad bad BAD").alias("text"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), ((F.col("id") + 1) % 2).cast("int").alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    for op in (quality, toxicity):
        op.fit_on(docs, labels, F.lit(True))


def test_a_fit_does_not_depend_on_the_order_of_rows(spark):
    rows = [([*range(12), k], k % 2) for k in range(40)]
    one, two = (labelled.fitted(spark.createDataFrame(r, "t array<int>, y int"), "t", lambda lists, y: [x.tolist() for x in lists]) for r in (rows, rows[::-1]))
    assert one == two and len(one) == 40


def test_word_caches_are_small():
    words = quality.TokenBuckets()
    for k in range(150_000):
        words[f"w{k}"]
    slots = toxicity._TermSlots(np.zeros(0, np.uint32))
    for k in range(150_000):
        slots[f"w{k}"]
    assert max(len(words), len(slots)) <= 100_000


def test_coder_takes_few_steps_for_many_ids(monkeypatch):
    """A step costs the same for few lanes as for many, so 200,000 ids are many short blocks, not few long ones."""
    from corvella.llm import range_coder

    steps = []
    monkeypatch.setattr(range_coder.EncoderModel, "update", lambda self, ids, event, whole=range_coder.EncoderModel.update: (steps.append(self.active), whole(self, ids, event)))
    ids = (np.random.default_rng(3).zipf(1.3, 200_000) % 50_000).astype(np.uint32)
    blocks = [ids[lo : lo + range_coder.BLOCK] for lo in range(0, len(ids), range_coder.BLOCK)]
    made = range_coder.encode_blocks(blocks, 1 << 16)
    assert len(steps) <= 1024 and sum(steps) == len(ids)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode_blocks(made, 1 << 16), strict=True))
