"""Byte-level BPE whose pre-tokenisation is array work: no regular expression touches the text.

Code points become symbols of a small automaton (letter, number, mark, kinds of white space, quote
that opens a contraction). Each symbol is a function from states to states; functions compose
associatively, so rows of symbols are composed in parallel, the rows' functions are scanned by
doubling, and a second pass replays all rows at once from their known first state. Token borders
fall out as flags. The slices are merged pair by pair, lowest rank first, behind a bounded cache.

Defined results: null text is empty and has no ids; strings that look like special tokens are
ordinary text; null and repeated doc_ids are kept as they are; no documents, no rows; a very long text is
encoded whole, by one task, in rows of ``COLUMNS`` symbols; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.llm import ids

COLUMNS = 64
BATCH_CHARS = 1 << 20
CACHE_PIECES = 400_000
CACHED_LENGTH = 32

LETTER, NUMBER, MARK, QUOTE2, QUOTE3, SPACE_RUN, SPACE_JOINS, SPACE_LAST, END = range(9)
FREE, IN_LETTERS, IN_NUMBERS, IN_MARKS, JOINING, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
SEPARATOR = 0x110000
# The code points with the White_Space property.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _classes() -> np.ndarray:
    """Symbol of each code point; white space and quotes are refined by their neighbours."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], MARK) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[WHITE_SPACE] = SPACE_RUN
    return np.append(table, np.uint8(END))


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, border before the symbol) by [state * 16 + symbol]."""
    to, border = np.zeros((8, 16), dtype=np.uint8), np.zeros((8, 16), dtype=bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, MARK: IN_MARKS}
    for state in range(8):
        for symbol in range(9):
            if state in (ONE_MORE, TWO_MORE):
                to[state, symbol] = FREE if state == ONE_MORE else ONE_MORE
                continue
            if symbol in runs:
                to[state, symbol], new = runs[symbol], state not in (runs[symbol], JOINING)
            elif symbol in (QUOTE2, QUOTE3):
                new = state not in (IN_MARKS, JOINING)
                to[state, symbol] = (ONE_MORE if symbol == QUOTE2 else TWO_MORE) if new else IN_MARKS
            elif symbol == SPACE_RUN:
                to[state, symbol], new = IN_SPACE, state != IN_SPACE
            else:
                to[state, symbol], new = JOINING if symbol == SPACE_JOINS else FREE, True
            border[state, symbol] = new
    return to.ravel(), border.ravel()


NEXT, BORDER = _automaton()


def symbols(points: np.ndarray) -> np.ndarray:
    """Automaton symbols of code points (uint32), in which ``SEPARATOR`` ends each text."""
    out = _classes()[points]
    after = np.append(points[1:], SEPARATOR)
    kind_after = np.append(out[1:], END)
    last = (out == SPACE_RUN) & (kind_after != SPACE_RUN) & (kind_after != END)
    out[last] = np.where(points[last] == 32, SPACE_JOINS, SPACE_LAST)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        a, b = after[quotes], after[np.minimum(quotes + 1, len(points) - 1)]
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[quotes[two]] = QUOTE2
        out[quotes[three & ~two]] = QUOTE3
    return out


def borders(symbol: np.ndarray) -> np.ndarray:
    """True where a piece (or a separator) begins."""
    n = len(symbol)
    rows = -(-n // COLUMNS)
    grid = np.full(rows * COLUMNS, END, dtype=np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, COLUMNS).T)
    run = np.broadcast_to(np.arange(8, dtype=np.uint8)[:, None], (8, rows)).copy()
    for column in grid:  # composes every row's functions, all rows and states at once
        run = NEXT[(run << 4) + column]
    by_row = run.T.copy()  # row r: state before -> state after
    step = 1
    while step < rows:  # inclusive scan of the rows' functions
        by_row[step:] = np.take_along_axis(by_row[step:], by_row[:-step], axis=1)
        step *= 2
    state = np.concatenate([[FREE], by_row[:-1, FREE]]).astype(np.uint8)
    flags = np.empty((COLUMNS, rows), dtype=bool)
    for k, column in enumerate(grid):
        at = (state << 4) + column
        flags[k] = BORDER[at]
        state = NEXT[at]
    return flags.T.reshape(-1)[:n]


def cut(texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
    """Each text's pieces and their first character offsets."""
    big = "\0".join(texts)
    points = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    points = np.append(points, np.uint32(SEPARATOR))
    points[ends] = SEPARATOR
    at = np.flatnonzero(borders(symbols(points)))
    places = at.tolist()
    pieces = [big[a:b] for a, b in zip(places, places[1:], strict=False)]
    stops = np.searchsorted(at, ends)
    first, out = 0, []
    begin = 0
    for stop, end in zip(stops.tolist(), ends.tolist(), strict=True):
        out.append((pieces[first:stop], at[first:stop] - begin))
        first, begin = stop + 1, end + 1
    return out


class Merger(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self._short(raw) if len(raw) <= 64 else self._long(raw)
        out = np.asarray(ids, dtype="<u4").tobytes()
        if len(piece) <= CACHED_LENGTH and len(self) < CACHE_PIECES:
            self[piece] = out
        return out

    def _short(self, raw: bytes) -> list[int]:
        get = self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        none = len(self.ranks) + 1
        pair = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pair:
            best = min(pair)
            if best == none:
                break
            i = pair.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _long(self, raw: bytes) -> list[int]:
        """The same merges by a heap over a linked list, for pieces of any length."""
        n, get = len(raw), self.ranks.get
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        live = bytearray(b"\1") * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if not live[a] or end[a] != b or b >= n or not live[b] or end[b] != c:
                continue
            live[b], end[a] = 0, c
            if c < n:
                before[c] = a
                if (r := get(raw[a : end[c]])) is not None:
                    heapq.heappush(heap, (r, a, c, end[c]))
            p = before[a]
            if p >= 0 and (r := get(raw[p:c])) is not None:
                heapq.heappush(heap, (r, p, a, c))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out


@dataclass
class Encoded:
    """Ids of one text; ``starts`` and ``tokens`` (per piece: first character, number of ids) allow decoding any stretch."""

    ids: np.ndarray
    starts: np.ndarray
    tokens: np.ndarray


class ByteBPE:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merge = Merger(ranks)
        self.words: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for w, r in ranks.items():
            self.words[r] = w
        self.decimal = [str(i) for i in range(len(self.words))]

    def raw_ids(self, texts: list[str]) -> Iterator[tuple[bytes, list[str], np.ndarray]]:
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= BATCH_CHARS):
                held += len(texts[hi])
                hi += 1
            for pieces, starts in cut(texts[lo:hi]):
                yield b"".join(map(self.merge.__getitem__, pieces)), pieces, starts
            lo = hi

    def encode(self, texts: list[str]) -> Iterator[Encoded]:
        for raw, pieces, starts in self.raw_ids(texts):
            yield Encoded(np.frombuffer(raw, "<u4"), starts, np.fromiter((len(self.merge[p]) // 4 for p in pieces), dtype=np.int64, count=len(pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def decode_span(self, got: Encoded, first: int, last: int) -> bytes:
        """Bytes of pieces first..last-1, from their ids alone."""
        at = np.concatenate([[0], np.cumsum(got.tokens)])
        return self.decode(got.ids[at[first] : at[last]].tolist())


_LOADED: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode_table(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids (array), piece_starts, piece_tokens of every text."""
    schema = T.StructType([ids.text_field("doc_id"), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("piece_starts", T.ArrayType(T.LongType())), T.StructField("piece_tokens", T.ArrayType(T.LongType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = tokenizer(ranks)
        for f in frames:
            for lo in range(0, len(f), 256):
                part = f.iloc[lo : lo + 256]
                got = list(tool.encode(part["text"].tolist()))
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "ids": [g.ids for g in got], "piece_starts": [g.starts for g in got], "piece_tokens": [g.tokens for g in got]})

    texts = docs.select(ids.as_text("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return ids.restored(texts.mapInPandas(run, schema), docs.schema["doc_id"])


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again."""
    schema = T.StructType([ids.text_field("doc_id"), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = tokenizer(ranks)
        for f in frames:
            n, of_ids, of_text = [], [], []
            for raw, _, _ in tool.raw_ids(f["text"].tolist()):
                found = np.frombuffer(raw, "<u4").tolist()
                n.append(len(found))
                of_ids.append(hashlib.sha256(",".join(map(tool.decimal.__getitem__, found)).encode()).hexdigest())
                of_text.append(hashlib.sha256(tool.decode(found)).hexdigest())
            yield pd.DataFrame({"doc_id": f["doc_id"].array, "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text})

    texts = docs.select(ids.as_text("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return ids.restored(texts.mapInPandas(run, schema), docs.schema["doc_id"])
