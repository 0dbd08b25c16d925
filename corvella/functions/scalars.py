"""Scalar functions on columns: identifiers, names, texts, vectors and series. All JVM-side but NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English stop words for term counting.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "their", "this", "to", "was", "we", "were", "with"]


def doi(c: Column) -> Column:
    """Bare lower-case DOI; lower first, so that any spelling of the prefix matches."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi\.org/|doi:)\s*", ""))


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cs])


def normal_id(c: Column) -> Column:
    """Lower, trimmed, inner white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _parts(c: Column, separators: str) -> Column:
    return F.filter(F.transform(F.split(c, separators), lambda x: F.trim(x)), lambda x: x != "")


def authors(c: Column) -> Column:
    """Names split at ; | and & — or at commas where none of these occurs."""
    strong = r";|\||\s+and\s+|\s+&\s+"
    return F.when(c.rlike(strong), _parts(c, strong)).otherwise(_parts(c, ","))


def keyword_list(c: Column) -> Column:
    """P5: split at | , ;"""
    return _parts(c, r"[|,;]")


def citation_count(text: Column, counts: Column) -> Column:
    """A number as text, else the sum of an array of counts, else 0."""
    return F.coalesce(text.try_cast("int"), F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))), F.lit(0))


def cited_dois(refs: Column) -> Column:
    """Distinct cleaned DOIs of an array of references."""
    return F.array_distinct(F.filter(F.transform(refs, doi), lambda x: x.isNotNull() & (x != "")))


def year_of(c: Column) -> Column:
    """The leading year of a date text if it lies in 1500..2100."""
    y = F.element_at(F.split(c, "-"), 1).try_cast("int")
    return F.when(y.between(1500, 2100), y)


def countries(affiliations: Column) -> Column:
    """Distinct last comma-separated parts of affiliation texts."""
    return F.array_distinct(F.filter(F.transform(affiliations, lambda a: F.trim(F.element_at(F.split(a, ","), -1))), lambda x: x != ""))


def citekey(author: Column, year: Column, title: Column) -> Column:
    """P10: surname, year or nd, first title word of four letters or more."""
    surname = F.regexp_replace(F.lower(F.element_at(F.split(F.trim(author), r"\s+"), -1)), "[^a-z0-9]", "")
    word = F.coalesce(F.element_at(F.filter(F.split(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", ""), " +"), lambda w: F.length(w) >= 4), 1), F.lit(""))
    return F.concat(surname, F.coalesce(year.cast("string"), F.lit("nd")), word)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean_text(c: Column, lower: bool = False, normalise: bool = False) -> Column:
    """Without maths, TeX commands and braces, white space collapsed; NFKC on request (a Python hop)."""
    c = nfkc(c) if normalise else c
    for pattern, by in ((r"\$[^$]*\$", " "), (r"\\[A-Za-z]+(\{[^}]*\})?", " "), (r"[{}]", " "), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, by)
    return F.lower(F.trim(c)) if lower else F.trim(c)


def tokens(c: Column, shortest: int = 3) -> Column:
    """Lower-case ascii word tokens without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z0-9_\-]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= shortest) & ~w.isin(STOP_WORDS))


def title_key(c: Column, strict: bool = False) -> Column:
    """Duplicate-finding key of a title."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]" if strict else r"[^\w\s]", " "), r"\s+", " "))


def abstract_of(index: Column) -> Column:
    """Text of an inverted index (word -> positions)."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.concat_ws(" ", F.transform(F.array_sort(pairs), lambda x: x["w"]))


def topics(fields: Column, keywords: Column, title: Column) -> Column:
    """Fields of study, else keywords, else the first five title tokens of four letters or more."""
    from_title = F.slice(F.filter(tokens(title), lambda w: F.length(w) >= 4), 1, 5)
    return F.when(F.size(fields) > 0, fields).when(F.size(keywords) > 0, keywords).otherwise(from_title)


def safe_cell(c: Column) -> Column:
    """A cell that a spreadsheet will not run."""
    flat = F.regexp_replace(c, r"[\r\n\t]+", " ")
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), flat)).otherwise(flat)


def institute(c: Column) -> Column:
    """What stands in brackets or after the first comma of an author text."""
    inside, after = F.regexp_extract(c, r"[(\[]([^)\]]+)[)\]]", 1), F.regexp_extract(c, r",\s*(.+)$", 1)
    return F.trim(F.when(inside != "", inside).when(after != "", after))


def word_chunks(c: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of words; the last is the first that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    words, step = F.filter(F.split(c, r"\s+"), lambda w: w != ""), size - overlap
    n = F.size(words)
    last = (F.ceil(F.greatest(n - size, F.lit(0)) / step) * step).cast("int")
    made = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.concat_ws(" ", F.slice(words, i + 1, size)))
    return F.when(n > 0, made).otherwise(F.array().cast("array<string>"))


def snippet(query: str, c: Column) -> Column:
    """80 characters before to 200 after the first hit, hits marked; else the first 200."""
    import re

    q = re.escape(query)
    at = F.regexp_instr(F.lower(c), F.lit(q.lower()))
    start = F.greatest(at - 80, F.lit(1))
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(c, start, F.lit(280 + len(query))), F.when(start + 279 + len(query) < F.char_length(c), "…").otherwise(""))
    escaped = F.replace(F.replace(F.replace(cut, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(at > 0, F.regexp_replace(escaped, f"(?i)({q})", "<mark>$1</mark>")).otherwise(F.substring(c, 1, 200))


def jaccard(a: Column, b: Column) -> Column:
    """P20: overlap of two arrays as sets; both empty is 0."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def hash_vector(c: Column, dim: int) -> Column:
    """A unit vector fixed by the text, for when no model is at hand."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64(c, i), F.lit(2001)).cast("double") / 1000 - 1)
    return F.transform(raw, lambda x: x / F.greatest(norm(raw), F.lit(1e-12)))


def rescaled(c: Column, lo: Column, hi: Column, out_min: float, out_max: float, log: bool = False) -> Column:
    """Into [out_min, out_max]; a constant column becomes the middle. Log scale shifts by the minimum where it is not positive."""
    shift = F.when(lo <= 0, 1 - lo).otherwise(0.0)
    f = (lambda x: F.ln(x + shift)) if log else (lambda x: x)
    return F.when(hi > lo, out_min + (f(c) - f(lo)) / (f(hi) - f(lo)) * (out_max - out_min)).otherwise((out_min + out_max) / 2)


def kappa_band(k: Column) -> Column:
    """P24."""
    c = F.when(k < 0, "poor")
    for top, name in ((0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial")):
        c = c.when(k <= top, name)
    return c.otherwise("almost perfect")


def i2_band(i2: Column) -> Column:
    """P24."""
    return F.when(i2 < 25, "low").when(i2 < 50, "moderate").when(i2 < 75, "substantial").otherwise("considerable")


def calibrate(c: Column, full: float, cross: float, none: float) -> Column:
    """P25: fuzzy membership, logistic between the anchors."""
    k = 5.0 / (full - none)
    return F.when(c >= full, 1.0).when(c <= none, 0.0).otherwise(1 / (1 + F.exp(-k * (c - cross))))


def dense_series(counts: Column, first: Column, last: Column) -> Column:
    """Map of year -> count as an array from first to last, zeros between."""
    return F.transform(F.sequence(first, last), lambda y: F.coalesce(F.element_at(counts, y), F.lit(0)))


def bucket_year(y: Column, width: int) -> Column:
    """P27."""
    return y - F.pmod(y, F.lit(width))
