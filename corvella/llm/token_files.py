"""Token-id files: ids of documents in ascending doc_id order, range coded in checksummed blocks.

A file is: blocks of the range coder back to back; the directory (zlib: block offsets, then the
documents' ids, null flags and lengths); a footer. Documents run over block borders. One task
writes one file for its range of doc_ids, block group by block group, and one task reads one back.

Defined results: null text is empty; an empty text is its end id alone; null doc_ids come first;
repeated doc_ids are documents of their own, in the order of their text; no documents, no files; a very long text runs over as
many blocks as it needs, in one file; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.llm.files import Sink, Source
from corvella.llm.range_coder import BLOCK, LANES, decode_blocks, encode_blocks
from corvella.llm.unit_encoder import encoder
from corvella.plans.storage import fresh_path, materialise

MAGIC = b"RCTOKEN1"
FOOTER = struct.Struct("<QQQQI8s")  # directory offset and length, blocks, documents, alphabet, magic
END_ID = 2
ALPHABET = 1 << 16
MANIFEST = "file_no int, file string, n_docs long, n_ids long, n_bytes long"
MANIFEST_ARROW = pa.schema([("file_no", pa.int32()), ("file", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_ids", "n_bytes"))])
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class TokenWriter:
    """Collects ids and writes whole groups of blocks, so that memory holds one group at most."""

    def __init__(self, folder: str, alphabet: int):
        self.sink, self.alphabet = Sink(folder, ".rct"), alphabet
        self.held: list[bytes] = []
        self.held_ids = self.ids = 0
        self.offsets = [0]
        self.doc_ids, self.nulls, self.lengths = [], [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.doc_ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(raw) // 4)
        self.held.append(raw)
        self.held_ids += len(raw) // 4
        if self.held_ids >= BLOCK * LANES:
            self._flush(all_of_it=False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype="<u4")
        whole = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        blocks = [ids[lo : min(lo + BLOCK, whole)] for lo in range(0, whole, BLOCK)]
        for lo in range(0, len(blocks), LANES):
            for b in encode_blocks(blocks[lo : lo + LANES], self.alphabet):
                self.sink.write(b)
                self.offsets.append(self.sink.position)
        self.ids += whole
        self.held = [ids[whole:].tobytes()]
        self.held_ids = len(ids) - whole

    def close(self) -> dict:
        self._flush(all_of_it=True)
        directory = zlib.compress(
            b"".join([np.asarray(self.offsets, "<u8").tobytes(), np.asarray(self.doc_ids, "<i8").tobytes(), np.asarray(self.nulls, "u1").tobytes(), np.asarray(self.lengths, "<u8").tobytes()])
        )
        at = self.sink.write(directory)
        self.sink.write(FOOTER.pack(at, len(directory), len(self.offsets) - 1, len(self.doc_ids), self.alphabet, MAGIC))
        self.sink.close()
        return {"file": self.sink.name, "n_docs": len(self.doc_ids), "n_ids": self.ids, "n_bytes": self.sink.position}


class TokenReader:
    def __init__(self, name: str):
        self.source = Source(name)
        at, size, n_blocks, n_docs, self.alphabet, magic = FOOTER.unpack(self.source.read(self.source.size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token file")
        raw = zlib.decompress(self.source.read(at, size))
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1).astype(np.int64)
        p = 8 * (n_blocks + 1)
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, p)
        self.nulls = np.frombuffer(raw, "u1", n_docs, p + 8 * n_docs).astype(bool)
        self.lengths = np.frombuffer(raw, "<u8", n_docs, p + 9 * n_docs).astype(np.int64)

    def blocks(self, first: int, last: int) -> list[np.ndarray]:
        """Ids of blocks first..last-1 by one range read."""
        lo, hi = int(self.offsets[first]), int(self.offsets[last])
        raw = self.source.read(lo, hi - lo)
        cuts = (self.offsets[first : last + 1] - lo).tolist()
        return decode_blocks([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], self.alphabet)

    def documents(self) -> Iterator[tuple[int, bytes]]:
        """(position, ids) of each document in file order; memory holds one block group and one document."""
        at, held = 0, b""
        blocks = len(self.offsets) - 1
        first = 0
        for i, n in enumerate(self.lengths.tolist()):
            while len(held) - at < 4 * n and first < blocks:
                last = min(first + LANES, blocks)
                held = held[at:] + b"".join(b.tobytes() for b in self.blocks(first, last))
                at, first = 0, last
            yield i, held[at : at + 4 * n]
            at += 4 * n


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = END_ID, alphabet: int = ALPHABET, special_as_text: bool = False) -> DataFrame:
    """Encode ``docs`` into files in the shared folder; returns the manifest: one row per file, in doc_id order."""
    folder = fresh_path(docs.sparkSession, "token-files")
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(vocabulary, special_as_text), None
        for f in batches:
            for doc_id, raw in zip(f.column("doc_id").to_pylist(), encode.batch(f.column("text")), strict=True):
                if out is None:
                    out = TokenWriter(folder, alphabet)
                out.add(doc_id, raw + end)
        if out is not None:
            yield pa.RecordBatch.from_pylist([{"file_no": TaskContext.get().partitionId()} | out.close()], schema=MANIFEST_ARROW)

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, decoded from the files of ``manifest``: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("file_no", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, base in zip(f["file"], f["base"], strict=True):
                r = TokenReader(name)
                crc = np.fromiter((zlib.crc32(raw) for _, raw in r.documents()), dtype=np.int64, count=len(r.lengths))
                start = base + np.concatenate([[0], np.cumsum(r.lengths)[:-1]]).astype(np.int64)[: len(r.lengths)]
                ids = pd.Series(r.doc_ids, dtype="Int64").mask(r.nulls)
                yield pd.DataFrame({"doc_id": ids, "start": start, "n_tokens": r.lengths, "ids_crc32": crc})

    return files.repartitionByRange(n, "file_no").mapInPandas(read, DOCUMENT)
