import re
import zlib
from collections import Counter

import duckdb

from corvella.llm import queries, spelling

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, word string, n string, key int"


def brute(docs, least_chars=5, least_n=3):
    counts, lower = Counter(), {c: c + 32 for c in range(65, 91)}
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_n}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_variants_against_brute_force(spark):
    long = "Zz" * 300
    texts = [
        (1, "colour Colour COLOUR colour color colors colours aabbb aabb aabbbb abbbb"), (2, "color color color color colour colour " * 3), (None, "aabbb aabbb aabbb aabbbb aabbbb aabbbb abbbb abbbb abbbb"),
        (2, "color color color color colour colour " * 3), (2**60 + 1, "naïveté naivete ÀÉÎõü àéîõü " * 4), (4, None), (5, ""), (6, f"{long} {long} {long} {long[:-1]} {long[:-1]} {long[:-1]} "), (7, "collour caliur colur " * 3),
        (8, "1234 -- !! word, word; word wordy wordy wordy words"),
    ]
    got = spelling.variants(spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts], DOC))
    assert rows(got) == brute(texts)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "Alpha beta-GAMMA  " * 50 + "delta" * 40
    assert [w for p in spelling.pieces(text, 7) for w in spelling.RUN.findall(p)] == spelling.RUN.findall(text.lower())


def test_no_documents(spark):
    assert spelling.variants(spark.createDataFrame([], DOC)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "", "", 0)], DOC)).count() == 0


def test_table_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(queries.ORACLES["op13_spelling_variants"])
    assert rows(queries.QUERIES["op13_spelling_variants"](spark, DATA).select(*want.columns)) == set(want.fetchall())
