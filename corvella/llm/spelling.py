"""Spelling variants by permuterm rotations.

Words are counted over whole texts; each ends in a terminator and stands, rotated, once per position. Two
words that differ in one replaced code point agree in a rotation but for its last code point, the edited one; a word that
lacks the edited code point has just that shorter rotation. So rotations are dealt and sorted by the key that skips the
edited code point, and the words of one key are all near one another. A key tells all but one code point of its
words, so its group holds at most one word per letter of the alphabet and the word without any, however large the table is: no
group needs splitting, and its best two words and its counts give each member its neighbours without a list of pairs.

A deletion within a run of equal code points is found once per code point of the run; it is counted at the first.
A word's form has at least twice its count, so chains of forms are short and roots are found by doubling.

Defined results: a null or empty text has no words; a null id is an empty text before the colon; rows that repeat an id, or
a whole row, are counted like any others; no documents, no rows; a very long text is searched in pieces cut between
words, and keys of very long words are replaced by their SHA-256; ties go to the word first in code-point order; other columns are ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.plans.storage import materialise

RUN = re.compile("[a-zÀ-ÿ]+")
GAP = re.compile("[^a-zÀ-ÿ]")
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
TERMINATOR = "$"
PIECE_CHARS = 1 << 20
HELD_WORDS = 1 << 18
LONG_KEY = 256
TYPO_EVERY = 97
MOST_ROUNDS = 64  # counts double along a chain


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in lower case (A-Z only), cut between words about every ``size`` code points."""
    low = text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
    lo = 0
    while len(low) - lo > size:
        gap = GAP.search(low, lo + size)
        if gap is None:
            break
        yield low[lo : gap.start()]
        lo = gap.end()
    yield low[lo:] if lo else low


def spelled(doc_id: int | None, text: str, least_chars: int, typo_every: int) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text; of one run in ``typo_every``, chosen by the crc32 of id and run, a code point is left out."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for piece in pieces(text):
        for run, n in Counter(RUN.findall(piece)).items():
            if len(run) >= least_chars:
                h = zlib.crc32(run.encode(), head)
                if typo_every and h % typo_every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < least_chars:
                        continue
                yield run, n


def count_words(docs: DataFrame, least_chars: int = 5, least_n: int = 3, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n) of words with at least ``least_chars`` code points and ``least_n`` occurrences in all ``docs`` (doc_id, text)."""

    def batch(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for word, n in spelled(doc_id, text.as_py(), least_chars, typo_every):
                    seen[word] += n
                if len(seen) > HELD_WORDS:
                    yield batch(seen)
                    seen.clear()
        yield batch(seen)

    counted = docs.filter("text IS NOT NULL").select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """(key, edited, fresh, word, n): every rotation of each word, and every rotation that skips its last code point ``edited``.

    ``fresh``: the edited code point differs from the one before it in the word.
    """
    each = words.select("word", "n", F.explode(F.sequence(F.lit(0), 2 * F.char_length("word"))).alias("step"))
    at, skips = F.floor(F.col("step") / 2).cast("int"), F.col("step") % 2
    each = each.select("word", "n", at.alias("at"), skips.alias("skips"))
    key = F.concat(F.expr("substring(word, at + skips + 1)"), F.lit(TERMINATOR), F.expr("substring(word, 1, at)"))
    edited = F.when(F.col("skips") == 1, F.expr("substring(word, at + 1, 1)"))
    fresh = (F.col("at") == 0) | (F.expr("substring(word, at, 1)") != edited)
    short = F.when(F.char_length(key) > LONG_KEY, F.concat(F.lit("#"), F.sha2(key, 256))).otherwise(key)
    return each.select(short.alias("key"), edited.alias("edited"), fresh.alias("fresh"), "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of each word with words at one inserted, deleted or replaced code point; best has the largest n."""
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.desc("n"), "word")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct((-F.col("n")).alias("m"), F.col("word").alias("w"))
    fresh = F.coalesce(F.col("edited").isNotNull() & F.col("fresh"), F.lit(False))
    scanned = rotations(words).select(
        "key", "word", "edited", fresh.alias("fresh"), F.count(F.lit(1)).over(group).alias("size"), F.count("edited").over(group).alias("with_edit"), F.sum(fresh.cast("long")).over(group).alias("fresh_edits"),
        F.first(entry).over(whole).alias("first"), F.nth_value(entry, 2).over(whole).alias("second"),
    ).filter("size > 1")
    shorter = (F.col("size") > F.col("with_edit")) & F.col("fresh")
    near = F.when(F.col("edited").isNull(), F.col("fresh_edits")).otherwise(F.col("with_edit") - 1 + shorter.cast("long"))
    best = F.when(F.col("first.w") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    merged = scanned.select("word", near.alias("near"), best.alias("best")).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return merged.select("word", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.w").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of words with a form: links are doubled until they end."""
    at = materialise(links.select("word", F.col("form").alias("root")), "forms")
    for _ in range(MOST_ROUNDS):
        step = at.select(F.col("word").alias("over"), F.col("root").alias("next"))
        jumped = at.join(step, at.root == step.over, "left")
        jumped = materialise(jumped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if jumped.filter("moved").isEmpty():
            return jumped.select("word", "root")
        at = jumped.select("word", "root")
    raise RuntimeError("forms did not settle")


def variants(docs: DataFrame, least_chars: int = 5, least_n: int = 3, times: int = 2, typo_every: int = TYPO_EVERY) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n if that is at least ``times`` (2 or more) the word's own n; ``root`` is where forms of forms end.
    """
    if times < 2:
        raise ValueError("forms need at least twice the count, else they may run in circles")
    words = materialise(count_words(docs, least_chars, least_n, typo_every), "words")
    known = words.join(neighbours(words), "word", "left")
    leads = F.col("best_n") >= times * F.col("n")
    rows = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best")).alias("form"), F.when(leads, F.col("best_n")).alias("form_n"))
    rows = materialise(rows, "variants")
    return rows.join(_roots(rows.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
