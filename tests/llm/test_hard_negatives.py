import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.llm import hard_negatives, queries

DATA = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int, rank int, score double"


def brute(rows, every):
    v = {}
    for i, e, label in rows:
        if i is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        q = [math.floor(256.0 * float(np.float32(x))) for x in e]
        if i not in v or (label, e) < v[i][:2]:
            v[i] = (label, e, q)
    out = set()
    for a, (label, _, q) in v.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, o[2], strict=True)), i, o[0] == label) for i, o in v.items() if i != a and len(o[2]) == len(q))
        for p, pid in [(-m, i) for m, i, same in scored if same][:5]:
            near = [(-m, i) for m, i, same in scored if not same and 30 * p <= -100 * m <= 90 * p][:10]
            out |= {(a, pid, k + 1, i, p, s) for k, (s, i) in enumerate(near)}
    return out


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [3, 1 << 14])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", block)
    r = random.Random(4)
    data = [(i, [r.uniform(-0.2, 1) if i % 3 else r.choice([0.25, 0.5, -0.5]) for _ in range(4)], r.randrange(3)) for i in range(150)]
    data += [(1000 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(60)]  # ties
    data += [(2**60 + 1, [0.5, 0.25, 0.5, 0.5], 0), (2**60 + 3, [0.5, 0.25, 0.5, 0.5], 1), (2**60, [0.75, 0.25, 0.5, 0.5], 0), (-5, [0.9, 0.9, 0.9, 0.9], 2)]
    data += [(None, [1.0] * 4, 0), (2000, None, 0), (2005, [1.0] * 4, None), (2010, [1.0, None, 1.0, 1.0], 1), (2015, [1.0, float("nan"), 1.0, 1.0], 1), (2020, [1.0, float("inf"), 0.0, 0.0], 1), (2025, [0.5] * 3, 1), (2030, [0.25] * 3, 1), (2035, [0.1] * 3, 0), (2040, [], 1)]
    frame = spark.createDataFrame([(i, e, label, 1, 0.0) for i, e, label in data], VEC).repartition(5)
    got = hard_negatives.mine(frame, F.col("vec_id") % 5 == 0)
    assert rows(got) == brute(data, 5)
    twice = frame.union(frame).union(spark.createDataFrame([(15, [0.1] * 4, 0, 1, 0.0)], VEC))
    assert rows(hard_negatives.mine(twice, F.col("vec_id") % 5 == 0)) == brute([*data, (15, [0.1] * 4, 0)], 5)


def test_no_rows_and_large_components(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VEC), F.col("vec_id") % 5 == 0).count() == 0
    one = [(0, [1.0, 1.0], 1, 0, 0.0)]
    assert hard_negatives.mine(spark.createDataFrame(one, VEC), F.col("vec_id") % 5 == 0).count() == 0
    big = [(0, [40000.0, 9.0], 1), (1, [70000.5, -3.0], 1), (2, [30000.25, 1.0], 2), (5, [3e5, 0.5], 2)]
    assert rows(hard_negatives.mine(spark.createDataFrame([(*x, 0, 0.0) for x in big], VEC), F.col("vec_id") % 5 == 0)) == brute(big, 5)


def test_table_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.sql(queries.ORACLES["op12_hard_negatives"])
    assert rows(queries.QUERIES["op12_hard_negatives"](spark, DATA).select(*want.columns)) == set(want.fetchall())
