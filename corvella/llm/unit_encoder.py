"""Token ids of whole texts by the tokenizers library, with a store of white-space delimited units.

For the two kinds of vocabulary file known here, no piece that the library merges within holds white space
after another character. So a text can be cut before each run of blanks and newlines, and the units encoded
apart; most units of a corpus repeat. Batches of texts with single blanks and newlines only are cut, and
their distinct units looked up, in Arrow; ids are then gathered from a pool of unit ids. A new unit of common
characters is split here and handed to the library's model piece by piece, any other goes through the whole
library. Texts with other runs or kinds of white space, or with the string of an added token, are encoded
whole, and so is every text where the file's normalizer or splitting rule is not one of the two.

``special_as_text``: take the strings of special tokens as ordinary text; by default they are what the library
makes of them.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space besides blank and newline, and characters that some rules take for it.
OTHER_SPACE = "\t\v\f\r\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿"
# Letters that every Unicode version calls letters; a unit of these, digits, marks and one blank or newline is common.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
LETTERS = re.compile(rf"[{LETTER}]+")
COMMON = re.compile(rf"[ \n][!-~{LETTER}]*")
KEEPS_SPACE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+")
DROPS_SPACE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\s{LETTER}0-9]+")
# The settings in a vocabulary file that the two rules stand for.
KNOWN = [
    (KEEPS_SPACE, False, None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    (
        DROPS_SPACE, True,
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    ),
]
STORE_UNITS = 2_000_000
CHUNK_BYTES = 16 << 20
ENDS_IN_MARK = "[A-Za-z][,.]$"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it is
    printable, else the next character from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}


def _rule(settings: dict) -> tuple[re.Pattern, bool] | None:
    """(splitting rule, lower case) of a vocabulary file; None where texts must be encoded whole."""
    model, added = settings["model"], settings.get("added_tokens", [])
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix")) or settings.get("truncation"):
        return None
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None
    return next(((pieces, lower) for pieces, lower, normalizer, splitter in KNOWN if (settings.get("normalizer"), settings.get("pre_tokenizer")) == (normalizer, splitter)), None)


class UnitEncoder:
    """``encoder(text)`` and ``encoder.batch(texts)``: ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.rule, self.model, self.table = _rule(settings), self.library.model, byte_alphabet()
        added = [t["content"] for t in settings.get("added_tokens", []) if t["content"] and not (special_as_text and t["special"])]
        self.not_simple = "|".join([r"[ \n][ \n]", f"[{OTHER_SPACE}]", *map(re.escape, added)])
        made = {c: [t.id for t in self.model.tokenize(c)] for c in ",."} if self.rule else {}
        self.marks = {c: ids[0] for c, ids in made.items()}
        if any(len(ids) != 1 for ids in made.values()):
            self.rule = None
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.starts, self.pool = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.uint32)  # the pool ends in a spare id

    def plain(self, text: str) -> bytes:
        """The library's own ids of one text."""
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit_ids(self, word: str) -> list[int]:
        """Ids of ``word`` after a blank; a word that starts with a newline has none before it."""
        pieces, lower = self.rule
        if LETTERS.fullmatch(word):  # one piece
            shown = word.lower() if lower else " " + word
            return [t.id for t in self.model.tokenize((shown if shown.isascii() else shown.encode().decode("latin-1")).translate(self.table))]
        unit = word if word[:1] == "\n" else " " + word
        if not COMMON.fullmatch(unit):
            return self.library.encode(unit, add_special_tokens=False).ids
        shown = unit.lower() if lower else unit
        ids: list[int] = []
        for p in pieces.findall(shown):
            ids.extend([t.id for t in self.model.tokenize((p if p.isascii() else p.encode().decode("latin-1")).translate(self.table))])
        return ids

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Place in the store of each of ``words`` (distinct); memory is bounded, as a full store is started again."""
        if len(self.known) > STORE_UNITS:
            self._forget()
        at = pc.index_in(words, value_set=self.known)
        missing = at.is_null()
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        new = words.filter(missing)
        if len(new):
            ids = [self._unit_ids(w) for w in new.to_pylist()]
            at[missing.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            self.known = pa.concat_arrays([self.known, new])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(size)])
            self.pool = np.concatenate([self.pool[:-1], np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(size.sum())), self.pool[-1:]])
        return at

    def _units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place in the store, id of a mark after it or -1) of each of ``words`` (distinct).

        A letter, then a comma or full stop at the end, is where both rules cut: such words are known by their stem.
        """
        marked = pc.match_substring_regex(words, ENDS_IN_MARK)
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        mark = np.full(len(words), -1, dtype=np.int64)
        last = pc.utf8_slice_codeunits(words, -1)
        for c, i in self.marks.items():
            mark[pc.and_(marked, pc.equal(last, c)).to_numpy(zero_copy_only=False)] = i
        return self._numbers(stems.dictionary)[stems.indices.to_numpy()], mark

    def __call__(self, text: str) -> bytes:
        return next(self.batch(pa.array([text])))

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text (null: empty), in order; about ``CHUNK_BYTES`` of text are worked on at a time."""
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        lo = 0
        while lo < len(size):
            hi, held = lo, 0
            while hi < len(size) and (hi == lo or held + size[hi] <= CHUNK_BYTES):
                held += size[hi]
                hi += 1
            yield from self._chunk(pc.fill_null(texts.slice(lo, hi - lo), ""))
            lo = hi

    def _chunk(self, texts: pa.Array) -> list[bytes]:
        if self.rule is None:
            return [self.plain(t) for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, self.not_simple).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.plain(texts[i].as_py())
        simple = np.flatnonzero(~odd)
        if len(simple):
            # a newline starts a unit as a blank does, but stays in it
            cut = pc.split_pattern(pc.replace_substring(texts.take(pa.array(simple)).cast(pa.string()), "\n", " \n"), " ")
            bounds = cut.offsets.to_numpy().astype(np.int64)
            bounds -= bounds[0]
            words = cut.flatten()
            coded = words.dictionary_encode()
            number, mark = self._units(coded.dictionary)
            codes = coded.indices.to_numpy()
            units, mark = number[codes], mark[codes]
            first = self.starts[units]
            size = self.starts[units + 1] - first + (mark >= 0)
            size[bounds[:-1]] = 0  # no blank before the first unit of a text: it is encoded by itself
            mark[bounds[:-1]] = -1
            ends = np.cumsum(size)
            ids = self.pool[np.repeat(first - (ends - size), size) + np.arange(ends[-1])]
            ids[ends[mark >= 0] - 1] = mark[mark >= 0]
            raw, a = ids.astype("<u4").tobytes(), 0
            heads = words.take(pa.array(bounds[:-1])).to_pylist()
            for i, head, b in zip(simple.tolist(), heads, (4 * ends[bounds[1:] - 1]).tolist(), strict=True):
                out[i] = self.plain(head) + raw[a:b]
                a = b
        return out


_LOADED: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> UnitEncoder:
    """One encoder for each worker process, kept between tasks."""
    key = path, special_as_text
    if key not in _LOADED:
        _LOADED[key] = UnitEncoder(path, special_as_text)
    return _LOADED[key]
