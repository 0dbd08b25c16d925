import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from corvella import catalog
from corvella.streaming import events as E

DATA = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def fresh(rows, ttl):
    """Rows (key, minutes) that set an entry, in order of time."""
    out, kept = [], {}
    for k, m in sorted(rows, key=lambda r: r[1]):
        if k not in kept or m - kept[k] > ttl:
            kept[k] = m
            out.append((k, at(m)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 4])
def test_entries_expire_after_their_ttl_and_not_at_window_borders(spark, batches):
    r = random.Random(batches)
    rows = [("a", 59), ("a", 61), ("a", 119), ("a", 120), ("b", 0), ("b", 60), ("b", 61), (None, 5), (None, 6)] + [(r.choice("cde"), r.randrange(2000)) for _ in range(300)]
    table = spark.createDataFrame([(k, at(m)) for k, m in rows], "key string, ts timestamp")
    got = E.run(E.fresh_values(E.replay(table, "ts", batches), ["key"], "60 minutes", "10 minutes"), "append", "fresh")
    assert sorted(((x.key, x.ts) for x in got.collect()), key=str) == fresh(rows, 60)


def test_late_repeats_are_dropped(spark):
    table = spark.createDataFrame([("a", at(100), 0), ("a", at(70), 1), ("a", at(20), 1), ("a", at(25), 1)], "key string, ts timestamp, turn int")
    got = E.run(E.fresh_values(E.replay(table, "turn", 2), ["key"], "60 minutes", "5 hours"), "append", "late")
    assert {x.ts for x in got.collect()} == {at(100), at(20)}


@pytest.mark.parametrize("order", ["seq", "shuffled"])
def test_screening_stream_ends_where_the_batch_does(spark, order):
    r = random.Random(3)
    rows = [(i % 40, r.choice(["ann", "bob", None]), r.choice(["title_abstract", "full_text"]), r.choice(["include", "exclude"]), r.choice(["", "scope", None]), k, r.random()) for k, i in enumerate(r.choices(range(40), k=400))]
    table = spark.createDataFrame(rows, "record long, reviewer string, stage string, decision string, reason string, seq long, shuffled double")
    want = {x.record: (x.stage, x.conflict) for x in E.screening(table.withColumn("reviewer", F.coalesce("reviewer", F.lit("")))).collect()}
    moves = E.run(E.screening_transitions(E.replay(table, order, 5)), "append", "moves")
    got = {}
    for m in moves.collect():
        got.setdefault(m.record, []).append(m)
    ends = {}
    for record, ms in got.items():
        at_start = [m for m in ms if m.was == "title_abstract"]
        assert at_start
        if order == "seq":  # each move starts where the last one ended
            ms = sorted(ms, key=lambda m: m.seq)
            assert all(a.stage == b.was for a, b in zip(ms, ms[1:]))
            ends[record] = (ms[-1].stage, ms[-1].conflict)
    if order == "seq":
        assert {k: v for k, v in want.items() if v != ("title_abstract", False)} == ends


@pytest.mark.parametrize("name", ["r5_screening_stream", "r6_fresh_values"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    got = got.select(*want.columns)
    mine, theirs = sorted(map(str, (tuple(r) for r in got.collect()))), sorted(map(str, want.fetchall()))
    assert mine == theirs and mine
