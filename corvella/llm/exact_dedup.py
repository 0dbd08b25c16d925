"""Exact de-duplication by composable polynomial fingerprints.

A text is read as the base-256 digits of its UTF-8 bytes, each plus one, and evaluated at a fixed
point modulo two primes. Fingerprints compose: ``fp(a + b) = fp(a) * base ** len(b) + fp(b)``, so
segments of a huge text are hashed as separate rows (on any executor) and folded in order.
Rows with equal fingerprint and byte length are then compared, segment by segment, against the
text of the row that would stay; a row that differs is grouped by its own text instead. So equal
means identical, whatever the fingerprints do.

Defined results: null text counts as empty; all empty texts are equal; a null ``doc_id`` is smaller
than any other; of rows that repeat both ``doc_id`` and text one is kept; no documents, no rows; a very long
text is as many rows as it has segments until it is folded; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvella.llm import hot, ids
from corvella.plans.storage import materialise

# Two primes below 2**31 and an evaluation point for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1566083941)
CHUNK_BYTES = 4096
SEGMENT_CHARS = 1 << 18


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base % prime
    return out


class Fingerprinter:
    """Fingerprints of many byte strings at once; every string is cut into chunks of one size."""

    def __init__(self, chunk: int = CHUNK_BYTES):
        self.chunk = chunk
        # (255 + 1) * 2**31 * 4096 < 2**53: the float dot product below is exact.
        self.digit = [_powers(b, p, chunk)[::-1].astype(np.float64) for b, p in zip(BASES, PRIMES, strict=True)]
        self.step = [pow(b, chunk, p) for b, p in zip(BASES, PRIMES, strict=True)]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        out = np.zeros((len(texts), len(PRIMES)), dtype=np.int64)
        chunks = -(-sizes // self.chunk)
        lo = 0
        while lo < len(texts):  # at most 2048 chunks (64 MB as floats) at a time, or one long text
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + chunks[hi] <= 2048):
                held += int(chunks[hi])
                hi += 1
            if held:
                out[lo:hi] = self._block(texts[lo:hi], sizes[lo:hi], chunks[lo:hi])
            lo = hi
        return out, sizes

    def _block(self, texts: list[bytes], sizes: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        """Texts are aligned to the right, so that only their first chunk is short (zero digits first)."""
        grid = np.zeros(int(chunks.sum()) * self.chunk, dtype=np.uint16)
        ends = np.cumsum(chunks) * self.chunk
        for t, n, e in zip(texts, sizes.tolist(), ends.tolist(), strict=True):
            if n:
                grid[e - n : e] = np.frombuffer(t, dtype=np.uint8)
                grid[e - n : e] += 1
        grid = grid.reshape(-1, self.chunk)
        after = np.concatenate([np.arange(c - 1, -1, -1) for c in chunks.tolist()] or [np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(texts)), chunks)
        out = np.zeros((len(texts), len(PRIMES)), dtype=np.int64)
        for k, p in enumerate(PRIMES):
            parts = np.concatenate([grid[i : i + 512].astype(np.float64) @ self.digit[k] for i in range(0, len(grid), 512)])
            shifts = _powers(self.step[k], p, int(chunks.max()) + 1)
            moved = parts.astype(np.int64) % p * shifts[after] % p
            np.add.at(out[:, k], owner, moved)  # a few million chunks of < 2**31 stay below 2**63
            out[:, k] %= p
        return out


def compose(left: tuple[int, int], right: tuple[int, int], which: int) -> tuple[int, int]:
    """(fingerprint, byte length) of a concatenation from those of its halves, for one prime."""
    p = PRIMES[which]
    return (left[0] * pow(BASES[which], right[1], p) + right[0]) % p, left[1] + right[1]


def _segments(text: Column, size: int) -> Column:
    """The text cut into array<string> of ``size`` code points each; an empty text has one empty segment."""
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / size).cast("int"))
    return F.when(n <= size, F.array(text)).otherwise(F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size))))


def _hash_segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tool = Fingerprinter()
    for f in frames:
        h, n = tool([t.encode("utf-8", "surrogatepass") for t in f["part"]])
        out = f.drop(columns="part")
        for k, p in enumerate(PRIMES):
            out[f"h{k}"] = h[:, k]
            out[f"w{k}"] = [pow(BASES[k], int(x), p) for x in n]
        out["n_bytes"] = n
        yield out


def fingerprints(docs: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_sha256, n_bytes, fp0, fp1.

    Segments of long texts are rows of their own until their fingerprints are folded, in order,
    by a JVM-side aggregate; a short text is one segment.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text.alias("text"))  # numbered before segments become rows
    parts = rows.select("row_id", ids.as_text("doc_id"), F.sha2("text", 256).alias("text_sha256"), F.posexplode(_segments(F.col("text"), segment_chars)).alias("seg", "part"))
    schema = T.StructType(
        [
            T.StructField("row_id", T.LongType()), ids.text_field("doc_id"), T.StructField("text_sha256", T.StringType()), T.StructField("seg", T.IntegerType()),
            *(T.StructField(c, T.LongType()) for c in ("h0", "w0", "h1", "w1", "n_bytes")),
        ]
    )
    hashed = ids.restored(parts.mapInPandas(_hash_segments, schema), docs.schema["doc_id"])
    fold = hashed.groupBy("row_id", "doc_id", "text_sha256").agg(F.sum("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("seg", "h0", "w0", "h1", "w1"))).alias("segs"))

    def folded(k: int) -> Column:
        return F.aggregate("segs", F.lit(0).cast("long"), lambda acc, s: (acc * s[f"w{k}"] + s[f"h{k}"]) % PRIMES[k])

    return fold.select("row_id", "doc_id", "text_sha256", "n_bytes", folded(0).alias("fp0"), folded(1).alias("fp1"))


FP = ["fp0", "fp1", "n_bytes"]


def _differing(docs: DataFrame, rows: DataFrame, segment_chars: int) -> DataFrame:
    """(doc_id, text_sha256) of rows whose text differs from that of the row their group would keep.

    ``rows``: doc_id, text_sha256, group_size, keep (struct doc_id, text_sha256) of groups of two or more. Both the rows
    and the segments they are compared with are dealt over as many salts as the group's size asks for.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), text.alias("text"))
    me = rows.select("doc_id", "text_sha256", "keep", "group_size").distinct()
    mine = read.join(me, read.doc_id.eqNullSafe(me.doc_id) & (read.text_sha256 == me.text_sha256)).select(me.doc_id, me.text_sha256, "keep", hot.salts(F.col("group_size")).alias("salts"), "text")
    parts = mine.select("doc_id", "text_sha256", "keep", "salts", F.posexplode(_segments(F.col("text"), segment_chars)).alias("seg", "part"))
    is_keeper = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_sha256") == F.col("keep.text_sha256"))
    kept = parts.filter(is_keeper).select(F.col("keep").alias("k"), F.col("seg").alias("s"), F.col("part").alias("kept_part"), "salts").dropDuplicates(["k", "s"])
    kept = kept.select("k", "s", "kept_part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("kept_salt"))
    others = parts.filter(~is_keeper).withColumn("salt", hot.salt(F.col("salts"), "doc_id", "text_sha256"))
    seen = others.join(kept, others.keep.eqNullSafe(kept.k) & (others.seg == kept.s) & (others.salt == kept.kept_salt), "left")
    return seen.groupBy("doc_id", "text_sha256").agg(F.bool_and(F.coalesce(F.col("part") == F.col("kept_part"), F.lit(False))).alias("same")).filter(~F.col("same")).drop("same")


def _groups(rows: DataFrame, by: list[str]) -> DataFrame:
    best = F.max(F.struct(F.col("doc_id"), F.col("text_sha256"))).alias("keep")
    return rows.groupBy(*by).agg(best, F.count(F.lit(1)).alias("group_size"))


def _with_groups(rows: DataFrame, by: list[str], total: int) -> DataFrame:
    """Join each row to its group of two or more; rows of hot groups are salted by the group's size."""
    return hot.join_groups(rows, _groups(rows, by).filter("group_size > 1"), by, "group_size", ["row_id"], total)


def exact_duplicates(docs: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    The largest doc_id of a group of identical texts stays.
    """
    rows = materialise(fingerprints(docs, segment_chars), "fingerprints")
    total = rows.count()
    joined = _with_groups(rows, FP, total)
    differ = materialise(_differing(docs, joined.filter("group_size > 1"), segment_chars), "unequal")
    if not differ.isEmpty():  # equal fingerprints of unequal texts: those texts form groups of their own
        tag = differ.withColumn("own", F.lit(True))
        tagged = rows.alias("r").join(tag.alias("t"), F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.text_sha256") == F.col("t.text_sha256")), "left")
        own = tagged.select("r.*", F.when(F.col("t.own"), F.col("r.text_sha256")).otherwise("").alias("own"))
        joined = _with_groups(own, [*FP, "own"], total)
    keep_id = F.when(F.col("group_size") > 1, F.col("keep.doc_id")).otherwise(F.col("doc_id"))
    out = joined.select("row_id", "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256", "n_bytes")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    once = Window.partitionBy("doc_id", "text_sha256").orderBy("row_id")
    keepers = out.filter(stays & (F.col("group_size") > 1)).withColumn("kept", F.row_number().over(once) == 1)
    rest = out.filter(~(stays & (F.col("group_size") > 1))).withColumn("kept", stays)
    return keepers.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each group of identical texts; columns as they were."""
    kept = exact_duplicates(docs).filter("kept").select("doc_id", "text_sha256")
    rows = docs.select(F.struct("*").alias("row"))  # packed, so that no column of theirs can clash
    mine = rows.withColumn("sha", F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256))
    both = mine.join(kept, F.col("row.doc_id").eqNullSafe(kept.doc_id) & (F.col("sha") == kept.text_sha256))
    once = Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(0))
    return both.withColumn("nth", F.row_number().over(once)).filter("nth = 1").select("row.*")
