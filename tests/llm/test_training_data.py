import base64
import hashlib
import json
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvella.llm import byte_bpe, exact_dedup, graph_ann, html_text, labelled, near_dedup, packing, quality, range_coder, token_files, toxicity, unit_encoder, vocabularies, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, _id long, predicted int"
EDGE = ["", None, "same text here", "same text here", "  \n ", "it's the'll  x\t\n y", "日本語 é😀", "word " * 3000]


def docs_of(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 5, 7) for i, t in zip(ids, texts, strict=True)], DOC)


def test_fingerprints_compose_and_match():
    tool = exact_dedup.Fingerprinter(chunk=16)
    r = random.Random(1)
    for n in (0, 1, 15, 16, 17, 1000):
        b = bytes(r.randrange(256) for _ in range(n))
        h, _ = tool([b])
        want = [0, 0]
        for k in range(2):
            for x in b:
                want[k] = (want[k] * exact_dedup.BASES[k] + x + 1) % exact_dedup.PRIMES[k]
        assert h[0].tolist() == want
        whole, _ = tool([b + b"tail"])
        tail, _ = tool([b"tail"])
        assert exact_dedup.compose((want[0], n), (int(tail[0][0]), 4), 0)[0] == whole[0][0]


@pytest.mark.parametrize("segment", [3, 1 << 18])
def test_exact_duplicates(spark, segment):
    texts = [*EDGE, "abcabcabc", "abcabcabc", "abcabcabd", "same text here"]
    ids = [5, None, 9, 2, 11, 12, 13, 14, 20, 21, 22, 9]
    got = exact_dedup.exact_duplicates(docs_of(spark, texts, ids), segment).collect()
    groups = {}
    for i, t in zip(ids, texts, strict=True):
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(texts)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in got:
        mine = by_sha[r.text_sha256]
        assert r.group_size == len(mine) and r.keep_id == max((x for x in mine if x is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one(docs_of(spark, texts, ids))
    assert kept.count() == len(groups) and kept.columns == docs_of(spark, texts, ids).columns
    assert near_dedup.keep_one(kept).columns == kept.columns


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FP", ["n_bytes"])  # as if all texts of one length had one fingerprint
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs_of(spark, ["aa", "bb", "aa", "bb", "cc"])).collect()}
    assert got == {0: (2, 2), 2: (2, 2), 1: (3, 2), 3: (3, 2), 4: (4, 1)}


BIG = [None, 2**60 + 1, 2**60 + 3, -(2**60) - 1]


def test_large_ids_beside_null_ones(spark):
    """Every operator gives back just the ids it got, in one batch."""
    texts = ["one two three four five six", "alpha beta gamma delta eps zeta", "un deux trois quatre cinq six", "one two three four five six"]
    d = docs_of(spark, texts, BIG).coalesce(1)
    for op in (exact_dedup.exact_duplicates, near_dedup.near_duplicates, lambda x: byte_bpe.digests(x, vocabularies.path("byte_bpe_multi_50k.tiktoken")), lambda x: byte_bpe.encode_table(x, vocabularies.path("byte_bpe_multi_50k.tiktoken"))):
        assert {r.doc_id for r in op(d).collect()} == set(BIG)
    assert {r.keep_id for r in exact_dedup.exact_duplicates(d).collect()} == {2**60 + 1, 2**60 + 3, -(2**60) - 1}
    assert {r.class_id for r in near_dedup.near_duplicates(d).collect()} == {2**60 + 1, 2**60 + 3, -(2**60) - 1}
    unlike = docs_of(spark, [*texts[:3], "four quite other words here now"], BIG).coalesce(1)
    for keep in (exact_dedup.keep_one, near_dedup.keep_one):
        assert {r.doc_id for r in keep(unlike).collect()} == set(BIG)
    pieces = packing.pack_documents(d, vocabularies.path("byte_bpe_50k.json"))
    assert {r.doc_id for r in pieces.collect()} == set(BIG)
    manifest = token_files.write_token_files(d, vocabularies.path("word_bpe_49k.json"), alphabet=49_408)
    assert {r.doc_id for r in token_files.read_token_files(manifest).collect()} == set(BIG)


def test_large_page_ids(spark):
    html = ["<p>same</p>", "<p>same</p>", "<p>other</p>", "<p>same</p>"]
    pages = spark.createDataFrame([(i, "http://x.org/", h) for i, h in zip(BIG, html, strict=True)], "page_id long, url string, html string").coalesce(1)
    assert {r.page_id for r in html_text.extract(pages).collect()} == set(BIG)
    got = {r.page_id: r for r in warc.lookup(warc.page_keys(pages), warc.write_index(warc.write_archives(pages))).collect()}
    assert set(got) == set(BIG)
    first = -(2**60) - 1
    assert {i: r.refers_to for i, r in got.items()} == {first: None, 2**60 + 3: None, None: first, 2**60 + 1: first}
    assert [got[i].record_type for i in (first, 2**60 + 3, 2**60 + 1, None)] == ["response", "response", "revisit", "revisit"]


def test_empty_tables(spark):
    none = docs_of(spark, ["x"]).limit(0)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert packing.pack_documents(none, vocabularies.path("byte_bpe_50k.json")).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(none, vocabularies.path("word_bpe_49k.json"))).count() == 0
    assert byte_bpe.digests(none, vocabularies.path("byte_bpe_multi_50k.tiktoken")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.lookup(warc.page_keys(pages), warc.write_index(warc.write_archives(pages))).count() == 0
    assert html_text.extract(pages).count() == 0


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabularies.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


SPECIAL = ["ab <|endoftext|> cd", "<|startoftext|>x<|endoftext|>", "a <|ENDOFTEXT|>.", "<|endoftext", "x\n<|endoftext|>\ny"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_unit_encoder_is_the_library(name, monkeypatch):
    e, plain = unit_encoder.UnitEncoder(vocabularies.path(name)), library(name)
    r = random.Random(2)
    made = ["".join(r.choice(" \n\t'strevlAZßé日9!.;") for _ in range(r.randrange(60))) for _ in range(500)]
    made += [" ".join(r.choice(["ab", "it's", "Zß", "é\nb", "\n9", "<|endoftext|>", "日本", "x y", "", "end.", "one,", "?,"]) for _ in range(r.randrange(9))) for _ in range(500)]
    texts = [x or "" for x in EDGE] + SPECIAL + made
    for _ in range(2):  # new and known units; the second time the store overflows and starts again
        assert [np.frombuffer(x, "<u4").tolist() for x in e.batch(pa.array(texts))] == [plain(t) for t in texts]
        monkeypatch.setattr(unit_encoder, "STORE_UNITS", 10)
        monkeypatch.setattr(unit_encoder, "CHUNK_BYTES", 500)
    assert np.frombuffer(e(SPECIAL[0]), "<u4").tolist() == plain(SPECIAL[0])


def test_unknown_vocabularies_are_left_to_the_library(tmp_path):
    from tokenizers import Tokenizer

    settings = json.load(open(vocabularies.path("byte_bpe_50k.json")))
    settings["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(settings))
    e, t = unit_encoder.UnitEncoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert e.rule is None
    assert np.frombuffer(e("Some Text\n here"), "<u4").tolist() == t.encode("Some Text\n here", add_special_tokens=False).ids
    plain = unit_encoder.UnitEncoder(vocabularies.path("byte_bpe_50k.json"), special_as_text=True)
    assert 50256 not in np.frombuffer(plain(SPECIAL[0]), "<u4") and 50256 in library("byte_bpe_50k.json")(SPECIAL[0])


def test_packing(spark):
    r = random.Random(3)
    texts = [*EDGE, *SPECIAL, *["alpha beta " * r.randrange(1, 900) for _ in range(150)]]
    vocab = vocabularies.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs_of(spark, texts), vocab).toPandas()
    plain = library("byte_bpe_50k.json")
    for i, t in enumerate(texts):
        ids = np.array([*plain(t), 2], "<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
        assert (mine.length.tolist()[1:] == [1024] * (len(mine) - 1)) if len(ids) > 1024 else len(mine) == 1
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) * 1.1 + 2


def test_pattern_plan_uses_up_the_histogram():
    r = np.random.default_rng(4)
    for n in (0, 1, 5, 4000):
        c = np.bincount(r.integers(1, 129, n), minlength=129)
        used = np.zeros(129, int)
        for lengths, k in packing.plan_patterns(c):
            assert sum(lengths) <= 128
            for v in lengths:
                used[v] += k
        assert (used == c).all()


def test_packing_of_clashing_columns(spark):
    d = spark.createDataFrame([(i, 10 + i % 7, 1, 2, 3, 4, 5) for i in range(50)], "id long, length long, chunk int, nth int, rank int, base int, row int")
    got = packing.pack(d, 64)
    assert got.columns == [*d.columns, "sequence_id", "offset"] and got.drop("sequence_id", "offset").exceptAll(d).isEmpty() and got.count() == 50


def test_range_coder_round_trip():
    r = np.random.default_rng(5)
    blocks = [np.zeros(0, np.uint32), np.array([7], np.uint32), (r.zipf(1.2, range_coder.BLOCK) % 500).astype(np.uint32), r.integers(0, 500, 900).astype(np.uint32), np.tile(r.integers(0, 500, 9), 90).astype(np.uint32)]
    coded = range_coder.encode_blocks(blocks, 500)
    assert all((a == b).all() for a, b in zip(range_coder.decode_blocks(coded, 500), blocks, strict=True))
    assert (range_coder.decode_blocks([coded[2]], 500)[0] == blocks[2]).all()  # alone
    assert len(coded[4]) < len(coded[3]) / 2
    for at in (13, 40, len(coded[3]) // 2):
        broken = coded[3][:at] + bytes([coded[3][at] ^ 1]) + coded[3][at + 1 :]
        with pytest.raises(ValueError):
            range_coder.decode_blocks([coded[2], broken], 500)


def test_token_files(spark):
    texts = [*EDGE, *SPECIAL, "long " * 40_000]  # the last runs over block borders
    ids = [5, None, 9, 2, 11, 12, 13, 14, *range(20, 26)]
    vocab, plain = vocabularies.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    got = token_files.read_token_files(token_files.write_token_files(docs_of(spark, texts, ids), vocab)).collect()
    start = 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        raw = np.array([*plain(t), 2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4


def test_byte_bpe_is_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    texts = [*[x or "" for x in EDGE], *["".join(r.choice(" \n\t'strevlmd  aßñ日9½!?.…é𝒳😀\x85_-") for _ in range(r.randrange(50))) for _ in range(2000)], "a" * 3000, "!" * 500 + "'s"]
    tool = byte_bpe.tokenizer(path)
    for t, got in zip(texts, tool.encode(texts), strict=True):
        assert got.ids.tolist() == e.encode_ordinary(t) and tool.decode(got.ids.tolist()) == t.encode()
        assert tool.decode_span(got, 0, len(got.tokens) // 2) == t[: got.starts[len(got.tokens) // 2] if len(got.tokens) > 1 else 0].encode()
    r = byte_bpe.digests(docs_of(spark, EDGE), path).filter("doc_id = 5").first()
    assert r.ids_sha256 == hashlib.sha256(",".join(map(str, e.encode_ordinary(EDGE[5]))).encode()).hexdigest()


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(7)
    words = [str(i) for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randrange(20, 200))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    hot = base[0]
    for _ in range(60):
        c = list(hot)
        for _ in range(r.randrange(0, 5)):
            c[r.randrange(len(c))] = r.choice(words)
        texts.append(" ".join(c))
    for b in base[1:]:
        c = list(b)
        c[r.randrange(len(c))] = "new"
        texts.append(" ".join(c))
    texts += EDGE + ["a b", "a b", "A  B"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    for small in (2, 4, 40):
        got = near_dedup.near_duplicates(docs_of(spark, texts), small=small).collect()
        assert {r.doc_id: r.class_id for r in got} == {i: top(i) for i in range(len(texts))}
        assert sum(r.kept for r in got) == len({top(i) for i in range(len(texts))})
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(len(texts))]  # null and repeated ids are documents of their own
    d = docs_of(spark, texts, ids)
    got = near_dedup.near_duplicates(d).collect()
    assert len(got) == len(texts) and sum(r.kept for r in got) == len({top(i) for i in range(len(texts))})
    kept = near_dedup.keep_one(d)
    assert kept.columns == d.columns and kept.count() == sum(r.kept for r in got)


@pytest.mark.parametrize("n", [1, 2, 300])
def test_components_fold_chains_and_stars(spark, n):
    from corvella.plans.components import components

    r = random.Random(n)
    names = r.sample(range(10 * n), n)
    chain = [(a, b) for a, b in zip(names, names[1:], strict=False)] or [(names[0], names[0])]
    star = [(10_000, 20_000 + i) for i in range(n)] + [(30_000 + i, 30_000) for i in range(n)]
    got = {x.id: x.component for x in components(spark.createDataFrame(chain + star + [(None, 5), (99_999, 99_999)], "src long, dst long")).collect()}
    want = {v: min(names) for v in names} | {v: 10_000 for e in star[:n] for v in e} | {v: 30_000 for e in star[n:] for v in e} | {99_999: 99_999}
    assert got == want


def test_repeated_passages_are_near_duplicates(spark):
    r = random.Random(8)
    texts, want = [], {}
    for k in range(24):
        body = [f"{k}w{r.randrange(10**6)}" for _ in range(120)]
        line = [f"{k}line{i}" for i in range(12)]
        forms = [body * (1 + k % 3), body] if k < 12 else [body + line * 15, body + line]
        want |= {len(texts) + i: len(texts) for i in range(2)}
        texts += [" ".join(f) for f in forms]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    for i in range(len(texts)):
        for j in range(i):
            assert (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) == (want[i] == want[j])
    got = near_dedup.near_duplicates(docs_of(spark, texts)).collect()
    assert {x.doc_id: x.class_id for x in got} == want


def test_darts_estimate_weighted_similarity():
    doc = np.array([0] * 40 + [1] * 40)
    e = np.concatenate([np.arange(40), np.arange(10, 50)]).astype(np.uint64)
    w = np.concatenate([np.full(40, 2.5), np.full(40, 1.5)])
    est = np.mean([(s := near_dedup.dart_signatures(doc, e + np.uint64(1000 * k), w, 2))[0].tolist() == s[1].tolist() or (s[0] == s[1]).mean() for k in range(20)])
    assert abs(est - 30 * 1.5 / (30 * 2.5 + 10 * 2.5 + 10 * 1.5)) < 0.04


def test_graph_recall(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(20, 16))
    x = centres[r.integers(0, 20, 1500)] + 0.4 * r.normal(size=(1500, 16))
    x[500:700] = x[500]  # one common vector
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (None, [1.0] * 16), (3, [float(v) for v in x[3]])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, shards = graph_ann.build_index(d, shard_nodes=400)
    got = graph_ann.search(d.filter("vec_id % 20 = 0"), index, shards, beam=64).toPandas()
    hit = 0
    for q, f in got.groupby("query_id"):
        s = np.round(x @ x[q], 12)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        f = f.sort_values("rank")
        assert f["rank"].tolist() == list(range(1, 21)) and q not in set(f.vec_id)
        assert np.allclose(f.score, x[f.vec_id] @ x[q])
        hit += len(set(best) & set(f.vec_id))
        if 500 <= q < 700:
            assert set(f.vec_id) == set(best)
    assert got.query_id.nunique() == 75 and hit / (75 * 20) >= 0.9


def test_graph_recall_on_the_embeddings_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in d.collect()}
    ids = np.array(sorted(x))
    grid = np.stack([x[i] for i in ids])
    for shard_nodes in (8192, 300):
        index, shards = graph_ann.build_index(d, shard_nodes=shard_nodes)
        got = graph_ann.search(d.filter("vec_id % 20 = 0"), index, shards).toPandas()
        hit = n = 0
        for q in ids[ids % 20 == 0]:
            s = grid @ x[q]
            s[ids == q] = -np.inf
            best = set(ids[np.lexsort((ids, -s))[:20]])
            hit, n = hit + len(best & set(got[got.query_id == q].vec_id)), n + len(best)
        assert hit / n >= 0.95
    assert graph_ann.search(d.limit(0), index, shards).count() == 0
    index, shards = graph_ann.build_index(d.limit(0))
    assert graph_ann.search(d, index, shards).count() == 0


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "<p>é</p>", "<p>a</p>"]
    rows = [(i * 3 if i != 4 else None, f"http://User@WWW.Example.org:80/x?{i % 2}#f" if i != 3 else None, h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = warc.write_archives(pages)
    assert "org,example,www)/x?0" in {r.urlkey for r in captures.collect()}
    got = {r.page_id: r for r in warc.lookup(warc.page_keys(pages), warc.write_index(captures)).collect()}
    assert len(got) == 6
    assert [(got[i].record_type, got[i].refers_to) for i in (0, 3, 15, 6, 9)] == [("response", None), ("revisit", 0), ("revisit", 0), ("response", None), ("revisit", 6)]
    assert got[None].payload_bytes == 9 and got[3].payload_digest == base64.b32encode(hashlib.sha1(b"<p>a</p>").digest()).decode()


def test_html_text():
    page = '<title>x</title><nav><a href=a>Menu, one.</a></nav><div class="ad">Buy, now.</div><article><h1>Head &amp x</h1><p><b>One, two.<br><p>Three  <i>fo</i>ur.<ul><li>l1<li>l2</ul></article><div id="comments"><p>Nice, post, really, yes.</p></div><footer>Foot, note.</footer><script>"</p>"</script>'
    assert html_text.main_text(page) == "Head & x One, two. Three four. l1 l2"
    assert html_text.main_text("") == "" and html_text.main_text("plain text") == "plain text"


LONG = " ".join(["First sentence of it, with words. Second one, longer than that, goes on."] * 4)
PARA = f"<p>{LONG}</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="site no-sidebar">{PARA}{PARA}</div>', f"{LONG} {LONG}"),
        (f'<article class="post ad-free">{PARA}</article>', LONG),
        (f'<div class="entry has-comments"><h1>Title</h1>{PARA}</div>', f"Title {LONG}"),
        (f'<div id="sidebar-layout">{PARA}</div>', LONG),
        (f"<div><div>{PARA}</div><div><p>See <a href=x>more of this</a></p><p><a href=y>Other story</a></p></div></div>", LONG),
        (f"<div><div>{PARA}{PARA}</div><div><p>Nice one.</p><p>I agree!</p><p>me too</p></div></div>", f"{LONG} {LONG}"),
        (f'<div class="text">{PARA}</div><div class="comment-list">{PARA}</div>', LONG),
        (f'<div class="ad">{PARA}</div><article><p>Short.</p></article>', "Short."),
        (f'<div class="siteHeader navBar"><p>Home, sweet.</p></div><section>{PARA}</section>', LONG),
        ("<p>" + "word, " * 60_000, " ".join(["word,"] * 60_000)),
        (f'<article>{PARA}<section id="social-impact">{PARA}</section>{PARA}</article>', f"{LONG} {LONG} {LONG}"),
        (f'<main>{PARA}<div class="notice-of-meeting">{PARA}</div></main>', f"{LONG} {LONG}"),
        (f'<div><div>{PARA}</div><div class="share-price">{PARA}</div></div>', f"{LONG} {LONG}"),
        (f"<article><p>{LONG} So <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", f"{LONG} So a=2 holds."),
        (f'<article>{PARA}<div class="notice-box">{PARA}</div></article>', LONG),
    ],
)
def test_html_text_is_chosen_by_ratios(page, want):
    assert html_text.main_text(page) == want


class Plain(HTMLParser):
    """Text of the first article element by the standard library's parser, for pages that have one and close what they open."""

    def __init__(self):
        super().__init__()
        self.depth, self.skip, self.parts = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style", "aside", "form", "nav", "footer", "button")
        if tag not in html_text.INLINE:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style", "aside", "form", "nav", "footer", "button")
        if tag not in html_text.INLINE:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.depth > 0 and not self.skip:
            self.parts.append(data)


def test_html_text_of_all_pages_against_a_plain_parser():
    """Every page of sf0.001 whose article holds no named block of its own (those the plain version cannot judge)."""
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).column(0).to_pylist()
    seen = 0
    for page in pages:
        inner = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
        if inner and not re.search(r"(class|id|role|hidden)\b", inner[1]):
            p = Plain()
            p.feed(page)
            assert html_text.main_text(page) == " ".join(" ".join("".join(p.parts).split("\x00")).split())
            seen += 1
    assert seen > 0.5 * len(pages)


def test_classifiers(spark):
    r = random.Random(9)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) for _ in range(120)]
    bad = [" ".join(r.choice(["alpha", "beta"]) + "!!" for _ in range(30)) for _ in range(60)]
    d = docs_of(spark, good + bad + ["", None])
    labels = spark.createDataFrame([(i, int(i < 120), int(i % 3 == 0)) for i in range(180)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    m = quality.fit_on(d, labels, labelled.fold("doc_id", 3) != 1)
    got = {x.doc_id: x.p for x in quality.score(d, m).selectExpr("doc_id", "predicted AS p").collect()}
    assert all(got[i] == (i < 120) for i in range(180)) and len(got) == 182
    assert quality.keep(d, m, 0).columns == d.columns and quality.keep(d, m, 0).filter("doc_id < 180").count() == 60
    insult = [f"the {g} are {w} today {' '.join(chr(97 + r.randrange(26)) * 3 for _ in range(4))}" for g in ("cats", "dogs") for w in ("nice", "scum") for _ in range(60)]
    y = spark.createDataFrame([(i, int("scum" in t)) for i, t in enumerate(insult)], "doc_id long, toxic int")
    d2 = docs_of(spark, [*insult, "", None])
    t = toxicity.fit_on(d2, y, labelled.fold("doc_id", 5) != 0)
    got = {x.doc_id: x.predicted for x in toxicity.score(d2, t).collect()}
    assert all(got[i] == ("scum" in x) for i, x in enumerate(insult)) and len(got) == len(insult) + 2


@pytest.mark.parametrize("want", [[1, 0, 0, 0], [0, 1, 1, 0]])
def test_factorization_machine_learns_pairs(want):
    """The second is an exclusive-or: no term says anything alone."""
    combos = [[1, 3], [1, 4], [2, 3], [2, 4]]
    m = toxicity.fit([np.array(r, np.uint32) for r in combos] * 60, np.array(want * 60, float))
    rows, slots = toxicity._slots(m.terms, [np.array(r, np.uint32) for r in combos])
    p = m.margin(rows, slots, 4)
    assert ((p > 0) == np.array(want, bool)).all()
    flat = toxicity.FactorizationMachine(m.terms, m.bias, m.weights, np.zeros_like(m.vectors)).margin(rows, slots, 4)
    assert sum(want) == 1 or ((flat > 0) != np.array(want, bool)).any()  # without pairs it cannot be told
    for i, (a, b) in enumerate(combos):
        a, b = np.searchsorted(m.terms, [a, b])
        assert np.isclose(p[i], m.bias + m.weights[a] + m.weights[b] + m.vectors[a] @ m.vectors[b])


def test_margin_is_the_sum_over_pairs():
    r = np.random.default_rng(10)
    m = toxicity.FactorizationMachine(np.arange(30, dtype=np.uint32), 0.3, r.normal(size=30), r.normal(size=(30, 4)))
    texts = [r.choice(30, k, replace=False) for k in (0, 1, 2, 9)]
    rows = np.repeat(np.arange(4), [len(t) for t in texts])
    got = m.margin(rows, np.concatenate(texts), 4)
    for t, x in zip(texts, got, strict=True):
        assert np.isclose(x, 0.3 + m.weights[t].sum() + sum(m.vectors[i] @ m.vectors[j] for n, i in enumerate(t) for j in t[:n]))


def test_training_sample_is_bounded(spark):
    d = spark.createDataFrame([(i % 50, "t" * 1000 + str(i)) for i in range(2000)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    all_rows = labelled.training_rows(d, y, "toxic", F.lit(True), 10_000)
    assert all_rows.count() == 2000
    assert 0 < labelled.training_rows(d, y, "toxic", F.lit(True), 10_000, most_bytes=200_000).count() < 400
    assert labelled.training_rows(d, y, "toxic", F.lit(True), 10).count() <= 40


def test_classifiers_held_out(spark):
    """On sf0.1, against the labels that fitting did not see; the fold is computed here again."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    for op, label, modulus, held, least in ((quality, "quality", 3, lambda r: r == 1, 0.97), (toxicity, "toxic", 5, lambda r: r == 0, 0.97)):
        used = labelled.fold("doc_id", modulus)
        m = op.fit_on(docs, labels, used != 1 if modulus == 3 else used != 0)
        rows = op.score(docs.select("doc_id", "text"), m).join(labels, "doc_id").select("doc_id", "score", "predicted", label).collect()
        rows = [r for r in rows if held(zlib.crc32(str(r.doc_id).encode()) % modulus)]
        assert np.mean([r.predicted == r[label] for r in rows]) >= least and all((r.score >= 0.5) == r.predicted and 0 <= r.score <= 1 for r in rows)
        good, bad = ([r.score for r in rows if r[label] == k] for k in (1, 0))
        assert np.mean([x > y for x in good for y in bad]) > 0.93  # rank statistic


def test_classifiers_without_labels_or_rows(spark):
    d = docs_of(spark, ["some text", "", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for op in (quality, toxicity):
        m = op.fit_on(d, none, F.lit(True))
        assert {r.score for r in op.score(d, m).collect()} == {0.5}
        assert op.score(d.limit(0), m).count() == 0 and op.keep(d.limit(0), m, 1).columns == d.columns


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on all that its predecessor kept, with null, empty and repeated rows added."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    first = [r.asDict() for r in table.limit(3).collect()]
    odd = [first[0], first[1] | {"doc_id": None}, first[2] | {"text": None, "doc_id": 10**6}, first[2] | {"text": "", "doc_id": 10**6 + 1}]
    docs = table.union(spark.createDataFrame(odd, table.schema))
    row = lambda r: tuple(r[c] for c in docs.columns)
    seen = docs
    for name, stage in p.STAGES[:-1]:
        before, out = [row(r) for r in seen.collect()], stage(spark, seen, sf)
        assert out.columns == docs.columns, name
        after = [row(r) for r in out.collect()]
        left = list(before)
        for r in after:
            left.remove(r)  # a row that was there, once each
        at = docs.columns.index("text")
        if name == "exact dedup":
            assert sorted(r[at] or "" for r in after) == sorted({r[at] or "" for r in before})
            best = {}
            for r in before:
                best[r[at] or ""] = max(best.get(r[at] or "", -1), -1 if r[0] is None else r[0])
            assert all((-1 if r[0] is None else r[0]) == best[r[at] or ""] for r in after)
        elif name == "MinHash near-dedup":
            sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r[at] or "").lower().split()) else {("none", k)} for k, r in enumerate(before)]
            up = list(range(len(before)))
            for i in range(len(before)):
                for j in range(i):
                    if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        a, b = up[i], up[j]
                        up = [min(a, b) if x in (a, b) else x for x in up]
            assert len(after) == len(set(up)) < len(before)
            assert sorted(up[before.index(r)] for r in after) == sorted(set(up))
        else:
            op = quality if name.startswith("quality") else toxicity
            used = labelled.fold("doc_id", 3) != 1 if op is quality else labelled.fold("doc_id", 5) != 0
            m = op.fit_on(seen, spark.read.parquet(f"{sf}/labels.parquet"), used)
            good = int(op is quality)
            assert sorted(map(repr, after)) == sorted(repr(row(r)) for r in op.score(seen, m).filter(F.col("predicted") == good).select(*docs.columns).collect())
        seen = spark.createDataFrame(after, docs.schema)
    plain = library("byte_bpe_50k.json")
    packed = p.STAGES[-1][1](spark, seen, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    want = {}
    for r in after:
        want[r[0]] = want.get(r[0], 0) + len(plain(r[at])) + 1
    assert {r.doc_id: r.n for r in packed} == want
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
