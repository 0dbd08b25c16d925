"""WARC archives with a two-level capture index.

Writing: each task writes one archive, one gzip member per record. Among equal payloads the page with
the smallest page_id is a response; the others are revisit records that refer to it and store no
payload. Indexing: captures are sorted by reversed-host URL key and page_id over all tasks; each
task writes one index file of compressed blocks, closed by a sparse directory of the blocks' first
keys. Looking up: a key finds its index file among the files' first keys, its block by binary search in
the directory, its captures by binary search in the block, and then only those byte ranges of the
archives are read, neighbouring ranges together.

Defined results: null html is an empty payload, and empty payloads are equal; a null url has an empty
key; a null page_id comes before all others but is never referred to; rows that repeat both page_id
and payload are all responses (or all revisits of the same page), each with a record id of its own; no pages,
no records; a very long page is one record; other columns are ignored. The page's id stands in a field of its own.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.llm import hot, ids
from corvella.llm.files import Sink, Source, Sources
from corvella.plans.storage import fresh_path, materialise

MIN_PAYLOAD = 0
BLOCK_LINES = 1000
NULL_ID = -(1 << 63)
FOOTER = struct.Struct("<QQ8s")
MAGIC = b"CAPIDX01"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "urlkey string, page_key long, record_type string, file string, offset long, length long"
INDEX_FILE = "file_no int, first_key string, first_page long, file string, n_captures long"
NEAR_BYTES = 1 << 16
MOST_BYTES = 8 << 20


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``: host labels reversed, without scheme, user, port or fragment."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    path = F.regexp_replace(F.substring(rest, F.char_length(authority) + 1, F.char_length(rest)), r"#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(key)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of one gzip member."""
    data = zlib.decompressobj(31).decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header."""
    return block.partition(b"\r\n\r\n")[2]


def _page_name(page_id: int | None) -> str:
    return "null" if page_id is None else str(page_id)


def _page_record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    payload = html.encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("X-Page-Id", _page_name(page_id)),
        *([("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", _page_name(refers_to))]
    return record(fields, http if revisit else http + payload)


def _chosen(pages: DataFrame, min_payload: int) -> DataFrame:
    """Pages with digest and response_id: the smallest page_id of equal payloads. Common payloads are salted by their count."""
    html = F.coalesce(F.col("html"), F.lit(""))
    read = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), url_key(F.col("url")).alias("urlkey"))
    equal = read.filter(F.octet_length("html") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    equal = materialise(equal, "equal-payloads")  # asked twice: for hot ones, and for all
    return hot.join_groups(read, equal, ["digest"], "n", ["page_id", "urlkey"], int(equal.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))


def write_archives(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write ``pages`` (page_id, url, html); returns the captures: where each record is."""
    folder = fresh_path(pages.sparkSession, "warc")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                if out is None:
                    out = Sink(folder, ".warc.gz")
                    out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                page_id = None if r.page_id is None else int(r.page_id)
                refers = None if r.response_id is None else int(r.response_id)
                revisit = refers is not None and refers != page_id
                data = _page_record(page_id, r.url, r.html, base32(r.digest), refers, revisit)
                rows.append((r.urlkey, NULL_ID if page_id is None else page_id, "revisit" if revisit else "response", out.name, out.write(data), len(data)))
            yield pd.DataFrame(rows, columns=["urlkey", "page_key", "record_type", "file", "offset", "length"])
        if out is not None:
            out.close()

    chosen = _chosen(pages, min_payload)
    return materialise(chosen.select(ids.as_text("page_id"), "url", "html", "digest", ids.as_text("response_id"), "urlkey").mapInPandas(write, CAPTURE), "captures")


def _footer(at: int, size: int) -> bytes:
    return FOOTER.pack(at, size, MAGIC)


def _key_line(line: str) -> tuple[str, int]:
    key, page, _ = line.split("\t", 2)
    return json.loads(key), int(page)


def write_index(captures: DataFrame) -> DataFrame:
    """Sort captures and write the index files; returns one row per file with its first key."""
    folder = fresh_path(captures.sparkSession, "captures-index")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, first, n, held, directory = None, None, 0, [], []

        def close_block() -> None:
            if held:
                data = zlib.compress("\n".join(held).encode("utf-8", "surrogatepass"))
                directory.append((*_key_line(held[0]), out.write(data), len(data)))
                held.clear()

        for f in frames:
            for r in f.itertuples(index=False):
                if out is None:
                    out, first = Sink(folder, ".cdxz"), (r.urlkey, int(r.page_key))
                held.append(f"{json.dumps(r.urlkey)}\t{r.page_key}\t{json.dumps([r.record_type, r.file, int(r.offset), int(r.length)])}")
                n += 1
                if len(held) == BLOCK_LINES:
                    close_block()
        if out is not None:
            close_block()
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data + _footer(out.position, len(data)))
            out.close()
            yield pd.DataFrame([{"file_no": TaskContext.get().partitionId(), "first_key": first[0], "first_page": first[1], "file": out.name, "n_captures": n}])

    ranged = captures.repartitionByRange("urlkey", "page_key").sortWithinPartitions("urlkey", "page_key")
    return materialise(ranged.mapInPandas(write, INDEX_FILE), "index-files")


class IndexFile:
    """Directory in memory, blocks by range reads; the last block read is kept."""

    def __init__(self, name: str):
        self.source = Source(name)
        at, size, magic = FOOTER.unpack(self.source.read(self.source.size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a capture index")
        self.directory = [(k, p, o, n) for k, p, o, n in json.loads(zlib.decompress(self.source.read(at, size)))]
        self.firsts = [(k, p) for k, p, _, _ in self.directory]
        self.held, self.lines, self.keys = -1, [], []

    def _load(self, i: int) -> None:
        if i != self.held:
            _, _, offset, length = self.directory[i]
            self.lines = zlib.decompress(self.source.read(offset, length)).decode("utf-8", "surrogatepass").split("\n")
            self.keys, self.held = [_key_line(x) for x in self.lines], i

    def find(self, key: tuple[str, int]) -> list[tuple[str, str, int, int]]:
        """(record type, archive, offset, length) of all captures of ``key``."""
        out = []
        i = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while i < len(self.firsts) and self.firsts[i] <= key:
            self._load(i)
            for j in range(bisect.bisect_left(self.keys, key), len(self.keys)):
                if self.keys[j] != key:
                    break
                out.append(tuple(json.loads(self.lines[j].split("\t", 2)[2])))
            i += 1
        return out


def _ranges(captures: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Neighbouring (file, offset, length) joined: (file, offset, length, parts within)."""
    held: list = []
    for file, offset, length in sorted(set(captures)):
        if held and held[0] == file and offset - (held[1] + held[2]) <= NEAR_BYTES and offset + length - held[1] <= MOST_BYTES:
            held[3].append((offset - held[1], length))
            held[2] = max(held[2], offset + length - held[1])
        else:
            if held:
                yield tuple(held)
            held = [file, offset, length, [(0, length)]]
    if held:
        yield tuple(held)


def lookup(keys: DataFrame, index_files: DataFrame) -> DataFrame:
    """Records of all captures of ``keys`` (urlkey, page_key; distinct), read back from the archives.

    One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to. A response's payload
    must match its digest. The driver holds the first key of each index file (one per task that wrote it).
    """
    files = [(r.first_key, r.first_page, r.file) for r in index_files.orderBy("file_no").collect()]
    firsts = [(k, p) for k, p, _ in files]
    schema = T.StructType([ids.text_field("page_id"), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), ids.text_field("refers_to")])
    long_ids = [T.StructField(c, T.LongType()) for c in ("page_id", "refers_to")]

    @F.pandas_udf(T.IntegerType())
    def file_of(key: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([max(bisect.bisect_right(firsts, k) - 1, 0) for k in zip(key, page, strict=True)], dtype="int32")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archives, held, index = Sources(), -1, None
        for f in frames:
            at = []
            for no, key, page in zip(f["file_no"], f["urlkey"], f["page_key"], strict=True):
                if no != held:
                    held, index = no, IndexFile(files[no][2])
                at += [x[1:] for x in index.find((key, int(page)))]
            rows = []
            for name, offset, length, parts in _ranges(at):
                data = archives[name].read(offset, length)
                rows += [_summary(*parse(data[a : a + n])) for a, n in parts]
            yield pd.DataFrame(rows, columns=[c.name for c in schema])
        archives.close()

    if not files:
        return ids.restored(keys.sparkSession.createDataFrame([], schema), *long_ids)
    dealt = keys.select(file_of("urlkey", "page_key").alias("file_no"), "urlkey", "page_key").repartitionByRange(len(files), "file_no")
    return ids.restored(dealt.sortWithinPartitions("file_no", "urlkey", "page_key").mapInPandas(read, schema), *long_ids)


def _summary(fields: dict[str, str], block: bytes) -> tuple:
    def page(v: str | None) -> str | None:
        return None if v == "null" else v

    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["warc-payload-length"])
    if fields["warc-type"] == "response":
        payload = payload_of(block)
        if len(payload) != size or base32(hashlib.sha1(payload).hexdigest()) != digest:
            raise ValueError(f"{fields['warc-record-id']} does not match its digest")
    return page(fields["x-page-id"]), size, digest, fields["warc-type"], page(fields.get("x-refers-to-page"))


def page_keys(pages: DataFrame) -> DataFrame:
    """The distinct lookup keys of ``pages``."""
    return pages.select(url_key(F.col("url")).alias("urlkey"), F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page_key")).distinct()
