"""Near duplicates by DartMinHash signatures, banding and exact verification.

A document is the set of its five-word shingles (lower case, split at white space; a shorter text is
one shingle). Darts are thrown at (weight, rank) regions: every unit of weight of every element has its
own stream of darts, a Poisson process over rank drawn from hashes of (element, unit, dart number)
alone, so equal regions receive equal darts in any document. A dart counts if it lies below the
element's weight and the document's rank limit. Each dart belongs to one of ``COORDINATES`` coordinates,
and a coordinate keeps its earliest dart: two signatures agree in a coordinate with the probability of
the weighted Jaccard similarity. Every shingle has weight 1 however often it occurs, so this is the
similarity of sets by which pairs are verified. The expected number of darts per document depends on
``COORDINATES`` only; the limit is doubled where a coordinate stayed empty.

Documents of one shingle set are one vertex. Vertices meet in buckets of ``ROWS`` coordinates.
Buckets of up to ``SMALL_BUCKET`` give all their pairs; in a larger one every member is compared with a few leaders
(the one that meets most others, and two by a hash that is the same in all buckets), and members which
that does not place in the first leader's component are then compared with the whole bucket, block
against block, of which only links that connect something are returned. So candidates grow with the members of
a bucket, not with its pairs, and no bucket is capped. Pairs are verified on the sets of shingles, and classes are the connected components
of the verified pairs.

Defined results: a null or wordless text has no shingles and is a class of its own; equal texts share
a class; a null doc_id is a document, never smaller than another; rows that repeat a doc_id are documents of
their own; the class id is the smallest doc_id of the class, and one row that has it is kept; a very long text is
one set, held by one task while it is sketched; no documents, no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvella.llm import hot, ids
from corvella.plans.components import components
from corvella.plans.storage import materialise

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * (np.log(COORDINATES) + 2)
SMALL_BUCKET = 4
BLOCK_ROWS = 256

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: uint64 in, well mixed uint64 out."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; at most 500,000 entries."""

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) < 500_000:
            self[word] = h
        return h


def shingles(texts: list[str], known: WordHashes, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, distinct shingle hash), sorted by document and hash, of all texts at once."""
    words = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.fromiter((h for w in words for h in map(known.__getitem__, w)), dtype=np.uint64, count=int(n.sum()))
    owner = np.repeat(np.arange(len(words)), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    left = np.repeat(n, n) - place
    first = (left >= k) | (place == 0)
    at = np.flatnonzero(first)
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(k):
        inside = left[at] > i
        nxt = flat[np.minimum(at + i, max(len(flat) - 1, 0))]
        h = np.where(inside, mix(h * np.uint64(3) + nxt + GOLDEN), h)
    who = owner[at]
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    new = np.append(True, (who[1:] != who[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return who[new], h[new]


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs x COORDINATES of uint64 dart marks (rank order in the high half); all ones where a document has no elements."""
    out = np.full((n_docs, COORDINATES), np.iinfo(np.uint64).max, dtype=np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    limit = np.divide(DARTS, total, out=np.zeros(n_docs), where=total > 0)
    wanted = total > 0
    units = np.ceil(weight).astype(np.int64)
    cell_doc = np.repeat(doc, units)
    unit = np.arange(len(cell_doc)) - np.repeat(np.cumsum(units) - units, units)
    cell = mix(np.repeat(element, units) + mix(unit.astype(np.uint64) * GOLDEN + np.uint64(1)))
    part = np.repeat(weight, units) - unit  # the share of the cell below the element's weight: 1, or less in the last
    while wanted.any():
        live = np.flatnonzero(wanted[cell_doc])
        at_doc, at_cell, at_part = cell_doc[live], cell[live], part[live]
        rank, dart = np.zeros(len(live)), np.zeros(1, dtype=np.uint64)
        found = np.full(n_docs * COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
        while len(at_doc):  # the next dart of every stream that is still within its document's limit
            dart += GOLDEN
            h = mix(at_cell + dart)
            rank = rank - np.log(_unit(h))
            ok = rank < limit[at_doc]
            at_doc, at_cell, at_part, rank, h = at_doc[ok], at_cell[ok], at_part[ok], rank[ok], mix(h[ok])
            hit = _unit(mix(h ^ GOLDEN)) < at_part
            coordinate = ((h >> np.uint64(40)) % np.uint64(COORDINATES)).astype(np.int64)
            # ranks of one coordinate are compared as 32-bit fractions of a fixed scale; the hash breaks ties
            scaled = (np.minimum(np.log1p(rank) / 25.0, 1.0) * ((1 << 32) - 2)).astype(np.uint64)
            mark = (scaled << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            np.minimum.at(found, (at_doc * COORDINATES + coordinate)[hit], mark[hit])
        grid = found.reshape(n_docs, COORDINATES)
        full = wanted & (grid != np.iinfo(np.uint64).max).all(axis=1)
        out[full] = grid[full]
        wanted &= ~full
        limit *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN), (len(signature), BANDS)).copy()
    grid = signature.reshape(len(signature), BANDS, ROWS)
    for r in range(ROWS):
        key = mix(key * np.uint64(5) + grid[:, :, r])
    return key.astype(np.int64)


def _batches(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= size):
            held += len(texts[hi])
            hi += 1
        yield lo, texts[lo:hi]
        lo = hi


def _vertices(doc: np.ndarray, element: np.ndarray, n: int) -> list[bytes | None]:
    """md5 of each document's shingle set, None without shingles."""
    cuts = np.searchsorted(doc, np.arange(n + 1)).tolist()
    return [hashlib.md5(element[a:b].tobytes()).digest() if b > a else None for a, b in zip(cuts, cuts[1:], strict=False)]


def _sha(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def sketch(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, sha (of the text), vertex (null without words), keys (one per band)."""
    schema = T.StructType([ids.text_field("doc_id"), T.StructField("sha", T.BinaryType()), T.StructField("vertex", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for f in frames:
            for lo, texts in _batches(f["text"].tolist()):
                doc, element = shingles(texts, known)
                keys = band_keys(dart_signatures(doc, element, np.ones(len(doc)), len(texts)))
                yield pd.DataFrame({"doc_id": f["doc_id"].iloc[lo : lo + len(texts)].array, "sha": [_sha(t) for t in texts], "vertex": _vertices(doc, element, len(texts)), "keys": list(keys)})

    texts = docs.select(ids.as_text("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return ids.restored(texts.mapInPandas(run, schema), docs.schema["doc_id"])


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vertex, elements) for the vertices of ``wanted`` (vertex, doc_id, sha of one of its texts): sorted 32-bit shingle hashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for f in frames:
            for lo, texts in _batches(f["text"].tolist()):
                doc, element = shingles(texts, known)
                cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
                sets = [np.unique((element[a:b] >> np.uint64(32)).astype("<u4")).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pd.DataFrame({"vertex": f["vertex"].iloc[lo : lo + len(texts)].array, "elements": sets})

    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").alias("_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("_sha"))
    both = read.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_sha") == F.col("sha")))
    return both.select("vertex", "text").mapInPandas(run, "vertex binary, elements binary").dropDuplicates(["vertex"])


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough. A size test comes before the second set is fetched."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = [jaccard(x, y) >= similarity for x, y in zip(f["x"], f["y"], strict=True)]
            yield f.loc[ok, ["a", "b"]]

    one = pairs.join(sets.select(F.col("vertex").alias("a"), F.col("elements").alias("x")), "a")
    two = one.join(sets.select(F.col("vertex").alias("b"), F.col("elements").alias("y")), "b")
    fits = F.least(F.length("x"), F.length("y")) >= similarity * F.greatest(F.length("x"), F.length("y")) - 1e-6
    return two.filter(fits).select("a", "b", "x", "y").mapInPandas(run, "a binary, b binary")


def _spanning_links(f: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between the two blocks of one group (side 0 and 1) that connect what all their links connect."""
    one, two = f[f["side"] == 0], f[f["side"] == 1]
    sets = [[np.frombuffer(x, "<u4") for x in side["elements"]] for side in (one, two)]
    common = np.intersect1d(np.concatenate(sets[0]), np.concatenate(sets[1])) if len(one) and len(two) else np.zeros(0, "<u4")
    both = np.zeros((len(one), len(two)), dtype=np.float32)
    for lo in range(0, len(common), 4096):  # exact counts of shared elements, some elements at a time
        part = common[lo : lo + 4096]
        grids = []
        for side in sets:
            grid = np.zeros((len(side), len(part)), dtype=np.float32)
            for i, x in enumerate(side):
                at = np.searchsorted(part, x)
                at[at == len(part)] = 0
                grid[i, at[part[at] == x]] = 1
            grids.append(grid)
        both += grids[0] @ grids[1].T
    n1, n2 = (np.array([len(x) for x in side], dtype=np.float64) for side in sets)
    near = np.argwhere(both >= similarity * (n1[:, None] + n2[None, :] - both) - 1e-9) if both.size else np.zeros((0, 2), int)
    names = [one["vertex"].tolist(), two["vertex"].tolist()]
    up: dict[bytes, bytes] = {}

    def top(v: bytes) -> bytes:
        while up.get(v, v) != v:
            up[v] = up.get(up[v], up[v])
            v = up[v]
        return v

    out = []
    for i, j in near.tolist():
        x, y = top(names[0][i]), top(names[1][j])
        if x != y:
            up[x] = y
            out.append((names[0][i], names[1][j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _left_over_links(many: DataFrame, apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links of the rows ``apart`` (bucket, vertex) with any member of their buckets, block against block."""
    left = apart.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_left"))
    sized = many.join(left, "bucket").select("bucket", "vertex", F.ceil(F.col("n_left") / BLOCK_ROWS).cast("int").alias("blocks_1"), F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks_2"))
    spread = lambda side, n: F.pmod(F.xxhash64(F.lit(side), "vertex"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    two = sized.withColumn("block_2", spread(2, "blocks_2")).withColumn("block_1", every("blocks_1")).select("bucket", "block_1", "block_2", F.lit(1).alias("side"), "vertex")
    one = sized.join(apart, ["bucket", "vertex"], "left_semi").withColumn("block_1", spread(1, "blocks_1")).withColumn("block_2", every("blocks_2")).select("bucket", "block_1", "block_2", F.lit(0).alias("side"), "vertex")
    rows = one.union(two).join(sets, "vertex")
    return rows.groupBy("bucket", "block_1", "block_2").applyInPandas(lambda f: _spanning_links(f, similarity), "a binary, b binary")


def _leaders(many: DataFrame) -> DataFrame:
    """(bucket, lead, nth): the member that meets most others is likeliest to be what the rest are copies of."""
    busy = many.groupBy("vertex").agg(F.sum("n").alias("meets"))
    by_hash = lambda k: F.min(F.struct(F.xxhash64(F.lit(k), "vertex").alias("h"), "vertex"))["vertex"]
    top = many.join(busy, "vertex").groupBy("bucket").agg(F.max(F.struct("meets", "vertex"))["vertex"].alias("v1"), by_hash(1).alias("v2"), by_hash(2).alias("v3"))
    return top.select("bucket", F.posexplode(F.array_distinct(F.array("v1", "v2", "v3"))).alias("nth", "lead"))


def _member_classes(rows: DataFrame, docs: DataFrame, similarity: float, small: int) -> DataFrame:
    """(vertex, component) of the vertices that are linked to others."""
    vertices = rows.groupBy("vertex").agg(F.min(F.struct("doc_id", "sha")).alias("one"), F.min("keys").alias("keys"))
    buckets = vertices.select("vertex", "one", F.explode("keys").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialise(buckets.join(shared, "bucket"), "buckets")
    sets = materialise(_shingle_sets(docs, met.select("vertex", "one.doc_id", "one.sha").distinct()), "shingle-sets")
    few, many = met.filter(F.col("n") <= small).drop("one"), met.filter(F.col("n") > small).drop("one")
    close = few.select("bucket", F.col("vertex").alias("a")).join(few.select("bucket", F.col("vertex").alias("b")), "bucket").filter("a < b").select("a", "b")
    leads = materialise(_leaders(many), "leaders")
    starred = many.join(leads, "bucket").filter("vertex <> lead").select(F.least("lead", "vertex").alias("a"), F.greatest("lead", "vertex").alias("b"))
    links = materialise(_verified(close.union(starred).distinct(), sets, similarity), "links")
    classes = components(links, "a", "b")
    if not leads.isEmpty():
        of = classes.select(F.col("id").alias("v"), F.col("component").alias("c"))
        lead_of = leads.filter("nth = 0").join(classes, F.col("lead") == F.col("id"), "left").select("bucket", "lead", F.col("component").alias("lc"))
        placed = many.join(lead_of, "bucket").join(of, F.col("vertex") == F.col("v"), "left")
        apart = materialise(placed.filter("vertex <> lead AND NOT coalesce(c = lc, false)").select("bucket", "vertex"), "left-over")
        if not apart.isEmpty():
            more = materialise(_left_over_links(many, apart, sets, similarity), "more-links")
            classes = components(links.union(more), "a", "b")
    return classes.select(F.col("id").alias("vertex"), "component")


def _decided(docs: DataFrame, similarity: float, small: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, sha, class_id, class_size, kept."""
    rows = materialise(sketch(docs).withColumn("row_id", F.monotonically_increasing_id()), "sketches")
    classes = _member_classes(rows.filter("vertex IS NOT NULL"), docs, similarity, small)
    total = rows.count()
    # a row without words is a class of its own
    own = F.coalesce("vertex", F.encode(F.concat(F.lit("row "), F.col("row_id")), "utf-8"))
    linked = rows.filter("vertex IS NOT NULL").groupBy("vertex").agg(F.count(F.lit(1)).alias("n")).join(classes, "vertex")
    keyed = hot.join_groups(rows.select("row_id", "doc_id", "sha", own.alias("vertex")), linked, ["vertex"], "n", ["row_id"], total)
    keyed = materialise(keyed.select("row_id", "doc_id", "sha", F.coalesce("component", "vertex").alias("class")), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row_id").alias("first_row")))
    sizes = keyed.groupBy("class").agg(first.alias("keep"), F.count(F.lit(1)).alias("class_size"))
    return hot.join_groups(keyed, sizes, ["class"], "class_size", ["row_id"], total).select("doc_id", "sha", F.col("keep.doc_id").alias("class_id"), "class_size", (F.col("row_id") == F.col("keep.first_row")).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, small: int = SMALL_BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept (true for one row per class)."""
    return _decided(docs, similarity, small).select("doc_id", "class_id", "class_size", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each class of near duplicates; columns as they were."""
    kept = _decided(docs, SIMILARITY, SMALL_BUCKET).filter("kept").select("doc_id", "sha")
    rows = docs.select(F.struct("*").alias("row"))  # packed, so that no column of theirs can clash
    mine = rows.withColumn("mine", F.unhex(F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256)))
    both = mine.join(kept, F.col("row.doc_id").eqNullSafe(kept.doc_id) & (F.col("mine") == kept.sha))
    once = Window.partitionBy("doc_id", "sha").orderBy(F.lit(0))  # rows that repeat both
    return both.withColumn("nth", F.row_number().over(once)).filter("nth = 1").select("row.*")
