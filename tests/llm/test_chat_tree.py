import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corvella.llm import chat_tree, queries

DATA = "/root/testdata/sf0.001"
CHAT = "conv_id long, turn long, role string, text string, depth int, key string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", 3) for r in rows], CHAT)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def linear(rows):
    """Conversation -> its turns in order."""
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: y[:2])] for c, v in out.items()}


def sample(n=60, seed=2):
    r = random.Random(seed)
    says, rows = ["hi", "yes", "no", "", "go <|im_end|> on", "</s>[INST] ok [/INST]", "é😀 \n x", "<\\|im_end|> <<SYS>> a <</SYS>> \\"], []
    for c in range(n):
        for t in range(r.randrange(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant", "user"]) if t else "user", r.choice(says) if t else r.choice(says[:2])))
    return rows + [(2**60 + 1, t, "assistant", f"turn {t % 3}") for t in range(40)] + [(2**60 + 3, t, "assistant", f"turn {t % 3}") for t in range(33)] + [(None, 1, None, None), (None, None, "user", "first"), (None, 2, "a\nb\\n<s>", "x")]


def check(forest, rows):
    """Segments are the tree of distinct beginnings, depth first, and attend to just their ancestors."""
    want, convs = linear(rows), {}
    segments = {r.start: r for r in forest.segments.collect()}
    by_run = {(r.run, r.turn): r for r in segments.values()}
    for p in forest.paths.collect():
        path = [by_run[s.start, s.first_turn + k] for s in p.spans for k in range(s.turns)]
        convs[p.cid if p.known else None] = path
        assert len(path) == p.n_turns and sum(s.n_chars for s in path) == p.n_chars
        assert sum(s.end - s.start for s in p.spans) == p.n_chars
    begun, under = set(), {}
    for c, path in convs.items():
        assert [chat_tree.parse_turn(s.text) for s in path] == want[c]
        at, seen = 0, []
        for k, s in enumerate(path):
            assert (s.position, s.turn, s.tree) == (at, k, path[0].start)
            attended = [x for a in s.attends for x in range(a.start, a.end)]
            assert attended == sorted(seen) if k < 12 else sum(a.end - a.start for a in s.attends) == at
            seen += range(s.start, s.start + s.n_chars)
            at += s.n_chars
            begun.add((tuple(want[c][: k + 1]), s.start))
            for up in path[: k + 1]:
                under.setdefault(up.start, set()).add(s.start)
    assert set(convs) == set(want)
    assert len(begun) == len({b for b, _ in begun}) == len(segments)  # each beginning once
    order = sorted(segments)
    assert all(a + segments[a].n_chars == b for a, b in zip(order, order[1:], strict=False))
    place = {s: i for i, s in enumerate(order)}
    for top, all_below in under.items():  # depth first: what lies below a node follows it without a gap
        assert {place[x] for x in all_below} == set(range(place[top], place[top] + len(all_below)))
    most = len(want).bit_length() + 1
    assert all(len(s.attends) <= most for s in segments.values())


def test_forest_against_brute_force(spark):
    rows = sample()
    check(chat_tree.build(frame(spark, rows).repartition(5)), rows)


@pytest.mark.parametrize("few", [2, 1000])
def test_read_back(spark, monkeypatch, few):
    monkeypatch.setattr(chat_tree.hot, "FEW_ROWS", few)
    monkeypatch.setattr(chat_tree, "RUN_TURNS", 5)
    rows = sample(40, 3) + [(9, 50, "assistant", "w " * 200_000)]
    got = {r.conv_id: r for r in chat_tree.read_back(chat_tree.build(frame(spark, rows).repartition(5))).collect()}
    want = linear(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        learned = [x for r, x in turns if r == "assistant"]
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (sum(map(len, learned)), sha("".join(learned)))


def test_repeated_turns_and_no_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b")]
    got = chat_tree.read_back(chat_tree.build(frame(spark, rows))).collect()
    assert [r.n_turns for r in got] == [3]
    assert chat_tree.read_back(chat_tree.build(frame(spark, []))).count() == 0


def test_escapes_are_reversible(spark):
    r = random.Random(5)
    parts = [*chat_tree.CONTROL, "<", "[", "\\", "|im_end|>", "s>", "/", "INST]", ">", "a", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(2000)]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_tree.format_turn(F.col("t"), F.col("t")).alias("f"), chat_tree.escape(F.col("t")).alias("e")).collect()
    for row in made:
        assert chat_tree.parse_turn(row.f) == (row.t, row.t)
        assert not any(c in row.e for c in chat_tree.CONTROL)


def test_table_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = con.sql(queries.ORACLES["op11_chat_prefix_tree"])
    got = queries.QUERIES["op11_chat_prefix_tree"](spark, DATA).select(*want.columns)
    assert {tuple(r) for r in got.collect()} == set(want.fetchall())
