"""WARC: archives with revisit records, and a splittable reader of gzipped archives.

Writing: each task streams its pages into one archive, a gzip member per record (WARC 1.1). Of the
pages with the same payload the one with the smallest page_id carries it; the others become revisit
records by identical payload digest, with the HTTP header of the full payload.

Reading: each archive is cut into byte ranges; a task scans its range for the gzip magic number and
owns the records that start inside. A candidate counts only if its header decodes as WARC and members
follow one another from it for over 64 KiB, or to the end of the file. Bytes that look like members
inside a payload are passed over: they can lie open in a stored block of the outer member only, and
such a block holds less.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import batches, materialize, scratch

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range; read at once; of a member's start that its WARC header must begin in.
SPLIT, READ, PEEK = 32 << 20, 1 << 20, 16
#: The most bytes a stored block of DEFLATE holds.
STORED = 65_535
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_URN = "urn:kinfold:page:"
#: The smallest payload, in bytes, that a revisit record may stand for.
LEAST = 0


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """Header values hold no controls: percent-encoded as in a URL."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _name(page_id) -> str:
    return f"<{_URN}{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. refers_to: the page that carries the payload, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url else []
    head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block + b"\r\n\r\n") + z.flush()


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """pages(page_id, url, html) -> archives under folder; returns (path, bytes, records) of each.

    Null html is an empty payload, a null url leaves the field out. Payloads of under `least` bytes are
    never revisits. Rows that repeat a page_id each get a record; those with the smallest id of their
    payload are all responses. A page without id refers to its payload's smallest id, or is a response.
    """
    spark = pages.sparkSession
    batches(spark)
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    hashes = p.select("page_id", F.sha1("payload").alias("sha"), F.length("payload").alias("n"))
    # Only payloads that more than one page has need a lookup; the aggregate is combined before its shuffle.
    first = materialize(hashes.where(F.col("n") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("sha", "first"), "payloads", pages.count())
    rows = p.withColumn("sha", F.sha1("payload")).join(first, "sha", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.length("payload") >= least), F.col("first"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def members():
            nonlocal n
            for b in frames:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    n += 1
                    yield record(*row)

        it = members()
        if (head := next(it, None)) is not None:
            uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
            size = files.write(uri, _chain(head, it))
            yield pa.RecordBatch.from_pylist([{"path": uri, "bytes": size, "records": n}])

    # Written once, now: the archives are what the reader works on.
    return materialize(rows.mapInArrow(run, "path string, bytes long, records long"), "archives")


def _chain(head: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from rest


class Reader:
    """Records that start in [start, end) of an open random-access file of `size` bytes."""

    def __init__(self, file, size: int, start: int, end: int):
        self.file, self.size, self.start, self.end = file, size, start, min(end, size)
        self.at, self.buffer = 0, b""

    def bytes_at(self, pos: int, n: int) -> bytes:
        """Up to n bytes at pos, from a sliding buffer."""
        if not self.at <= pos or pos + n > self.at + len(self.buffer):
            self.file.seek(pos)
            self.at, self.buffer = pos, self.file.read(max(n, READ))
        return self.buffer[pos - self.at : pos - self.at + n]

    def looks_like_member(self, pos: int) -> bool:
        """Whether a gzip member whose text begins as a WARC record starts at pos."""
        if self.bytes_at(pos, 3) != MAGIC:
            return False
        z, out, p = zlib.decompressobj(31), b"", pos
        try:
            while len(out) < PEEK and not z.eof and (piece := self.bytes_at(p, 4096)):
                out += z.decompress(piece, PEEK - len(out))
                p += len(piece)
        except zlib.error:
            return False
        return re.match(rb"WARC/\d\.\d\r\n", out) is not None

    def member(self, pos: int) -> tuple[bytes, int] | None:
        """The text of the member at pos and where it ends; None if it does not decode or is cut short."""
        z, out, p = zlib.decompressobj(31), [], pos
        try:
            while not z.eof:
                if not (piece := self.bytes_at(p, READ)):
                    return None
                out.append(z.decompress(piece))
                p += len(piece)
        except zlib.error:
            return None
        return b"".join(out), p - len(z.unused_data)

    def candidate(self, pos: int) -> int | None:
        """The next position in the range, from pos, where a member seems to start."""
        while pos < self.end:
            piece = self.bytes_at(pos, min(READ, self.end - pos + 2))
            k = piece.find(MAGIC)
            if k < 0:
                pos += max(1, len(piece) - 2)
            elif pos + k < self.end and self.looks_like_member(pos + k):
                return pos + k
            else:
                pos += k + 1
        return None

    def chain(self, pos: int) -> tuple[list[bytes], int] | None:
        """Members from pos on, if they follow one another for over STORED bytes or to the end of the file; and where they stop."""
        out, at = [], pos
        while at < self.size and at - pos <= STORED:
            if (at > pos and not self.looks_like_member(at)) or (got := self.member(at)) is None:
                return None
            if at < self.end:
                out.append(got[0])
            at = got[1]
        return out, at

    def records(self) -> Iterator[bytes]:
        pos, sure = self.start, self.start == 0
        while pos < self.end:
            if sure and self.looks_like_member(pos) and (got := self.member(pos)) is not None:
                yield got[0]
                pos = got[1]
                continue
            if (pos := self.candidate(pos)) is None:
                return
            found = self.chain(pos)
            sure = found is not None
            if found:
                yield from found[0]
                pos = found[1]
            else:
                pos += 1


def parse(text: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes, payload_digest.

    The digest and length of a response are those of the payload read, which must agree with the header."""
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda name: None if (v := fields.get(name, f"<{_URN}null>")[len(_URN) + 1 : -1]) == "null" else int(v)
    n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    claimed, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != n or digest32(payload) != claimed):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what its header says")
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None, "payload_bytes": n, "payload_digest": claimed}


def splits(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """archives(path, bytes) -> (path, bytes, start), a row for each range."""
    return archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))


def read(archives: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """archives(path, bytes) -> one row per record: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest and, if asked for, payload. No archives give no rows."""
    spark = archives.sparkSession
    batches(spark)
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    types = {"page_id": "long", "refers_to": "long", "payload_bytes": "long", "payload": "binary"}
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds.get(types.get(n, ""), pa.string())) for n in names])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns)):
                store, name = files.at(path)
                rows, held = [], 0
                with store.open_input_file(name) as file:
                    for text in Reader(file, size, start, start + split).records():
                        rows.append({n: r[n] for r in [parse(text)] for n in names})
                        held += len(text)
                        if len(rows) >= 1024 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    ranges = splits(archives, split)
    n = max(1, min(ranges.count(), 4 * spark.sparkContext.defaultParallelism * 8))
    return ranges.repartition(n).mapInArrow(run, ", ".join(f"{c} {types.get(c, 'string')}" for c in names))


def round_trip(pages: DataFrame, folder: str | None = None, split: int = SPLIT, least: int = LEAST) -> DataFrame:
    """Write pages as archives, then read them back. ValueError if not every record came back."""
    archives = write(pages, folder or scratch(pages.sparkSession, "warc"), least)
    got = materialize(read(archives, split, payloads=False), "records")
    n, written = got.count(), archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if n != written:
        raise ValueError(f"{n} of {written} records could be read back")
    return got
