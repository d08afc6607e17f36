"""Token ids of whole documents, in document order, as shards of wavelet matrices; and back.

Documents are put in order by a range partitioning of their ids; each task encodes its texts in that
order and closes a shard whenever it holds SHARD ids, so its memory is bounded by a shard and one
document. A small manifest, summed up in order, gives every shard its first place.

The tokenizer splits a text before a single space that follows or precedes a non-space, so pieces
between such spaces are encoded once and remembered; other texts are encoded whole.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import batches, materialize, scratch
from .wavelet import Shard, encode

END = 0
_ID = attrgetter("id")
SHARD = 1 << 21
#: Pieces that a worker remembers, some 200 bytes each; misses in a row of lookups that make it start afresh.
REMEMBERED, LOOKUPS = 700_000, 1 << 20
#: Pieces whose ids are gathered at once.
GATHERED = 1 << 16
#: White space other than space and line end, and what some Unicode versions count as such.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "\u180e\u200b\ufeff"
_ASCII_SPACES = "".join(c for c in _SPACES if c.isascii())
_AROUND = re.compile(rf"[ \n{_SPACES}] (?:[ \n{_SPACES}]|\Z)")
#: Stands for a line end at the start of a piece.
NEWLINE = "\x00"
_STOPS = (",", ".")
# Fixed value: how byte-level BPE of this kind cuts a text into pre-tokens.
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The printable characters that byte-level BPE writes bytes as: a byte's own if it has one, else the next above 255."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class Pieces(dict):
    """piece -> bytes of its ids, for pieces that a space stands before; a new piece is encoded when asked for."""

    def __init__(self, model, kind: np.dtype):
        super().__init__()
        self.tokenize, self.code, self.letters = model.tokenize, "H" if kind == np.uint16 else "I", _byte_letters()
        self.others: dict[str, bytes] = {}
        self.misses = 0

    def _model(self, t: str) -> bytes:
        # Printable ASCII stands for itself, but for the space.
        spelt = t.replace(" ", self.letters[32]) if t.isascii() and t.isprintable() else t.encode().decode("latin-1").translate(self.letters)
        return array(self.code, map(_ID, self.tokenize(spelt))).tobytes()

    def pre_token(self, t: str) -> bytes:
        """Ids of one pre-token: with a space and letters it is a piece of its own."""
        if t[0] == " " and t[1:].isalpha():
            return self[t[1:]]
        if (got := self.others.get(t)) is None:
            got = self._model(t)
            if len(self.others) < REMEMBERED // 4:
                self.others[t] = got
        return got

    def __missing__(self, piece: str) -> bytes:
        self.misses += 1
        if piece.isalpha() and piece.isascii():
            got = array(self.code, map(_ID, self.tokenize(self.letters[32] + piece))).tobytes()
        elif piece.isalpha():
            got = self._model(" " + piece)
        elif piece[-1:] in _STOPS and piece[:-1].isalpha():
            got = self[piece[:-1]] + self.pre_token(piece[-1])
        elif piece[:1] == NEWLINE:
            got = self.pre_token("\n") + b"".join(map(self.pre_token, _PRE.findall(piece[1:])))
        else:
            got = b"".join(map(self.pre_token, _PRE.findall(" " + piece)))
        if len(self) < REMEMBERED:
            self[piece] = got
        return got


class Encoder:
    """encode_all(texts) gives what tokenizer.encode(text, add_special_tokens=False) gives for each text, as arrays.

    The pieces of all texts are told apart in Arrow first, so each is looked up once a call. Every new pre-token goes through the library's model once; texts that other rules apply to (added
    tokens, other pre-tokenizers) go through the library's encode() as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        p = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        self.by_piece = p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and p.get("use_regex", True) and self.tokenizer.normalizer is None
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.known = Pieces(self.tokenizer.model, self.kind)
        self.lookups = 0

    def _spaced(self, text: str) -> str | None:
        """The text to be cut before its spaces, and before its line ends too where those stand alone (then a space
        and NEWLINE stand for them); None if it must be encoded as a whole: a space with white space on either side,
        where the cut depends on more than the neighbours, an added token, or the character that NEWLINE is."""
        if NEWLINE in text or any(m in text for m in self.marks):
            return None
        # Searches for one or two characters are far cheaper than a pattern, and mostly all that is needed.
        odd = [c for c in (_ASCII_SPACES if text.isascii() else _SPACES) if c in text]
        breaks = "\n" in text
        if ("  " in text or breaks and "\n " in text or any(c + " " in text for c in odd)) and _AROUND.search(text):
            return None
        if breaks and not odd and "\n\n" not in text and " \n" not in text and "\n " not in text:
            text = text.replace("\n", " " + NEWLINE)
        return text

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        out, known = [np.empty(0, self.kind)] * len(texts), self.known
        rests, places = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            spaced = self._spaced(text) if self.by_piece else None
            if spaced is None:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
                continue
            first, space, rest = spaced.partition(" ")
            out[i] = np.frombuffer(b"".join(map(known.pre_token, _PRE.findall(first))), self.kind)
            if space:
                rests.append(rest)
                places.append(i)
        if rests:
            pieces = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
            distinct = pieces.flatten().dictionary_encode()
            ids, ends = self._gather(list(map(known.__getitem__, distinct.dictionary.to_pylist())), distinct.indices.to_numpy())
            at = pieces.offsets.to_numpy().tolist()
            for i, a, b in zip(places, at, at[1:]):
                out[i] = np.concatenate((out[i], ids[ends[a] : ends[b]]))
            self._forget(len(distinct))
        return out

    def _gather(self, blobs: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces `codes` one after another, and where each piece's begin, and the last one's end."""
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.kind.itemsize
        flat, first = np.frombuffer(b"".join(blobs), self.kind), np.cumsum(size) - size
        ends = np.concatenate(([0], np.cumsum(size[codes])))
        ids = np.empty(ends[-1], self.kind)
        for i in range(0, len(codes), GATHERED):
            c = codes[i : i + GATHERED]
            a, b = ends[i], ends[i + len(c)]
            ids[a:b] = flat[np.repeat(first[c] - ends[i : i + len(c)], size[c]) + np.arange(a, b)]
        return ids, ends

    def _forget(self, looked_up: int) -> None:
        self.lookups += looked_up
        if self.lookups > LOOKUPS:
            if 2 * self.known.misses > self.lookups:  # another kind of text has begun
                self.known.clear()
                self.known.others.clear()
            self.lookups = self.known.misses = 0


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it remembers serves its later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, folder: str, tokenizer: str, shard: int = SHARD, end: int = END) -> DataFrame:
    """docs(doc_id, text) -> wavelet files under folder; returns the manifest (path, part, place, n_tokens, start).

    Documents go in ascending doc_id, nulls first, rows of one id by a hash of their text; each text
    (null: empty) is encoded whole and closed by the id `end`. No rows give no files.
    """
    spark = docs.sparkSession
    batches(spark)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = d.withColumn("tie", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        stop = np.array([end], enc.kind)
        ids, names, lengths, held = [], [], [], 0

        def close():
            nonlocal ids, names, lengths, held, place
            uri = f"{folder}/part-{part:06d}-{place:06d}.wave"
            files.write(uri, encode(np.concatenate(ids), names, np.array(lengths)))
            row = {"path": uri, "part": part, "place": place, "n_tokens": held}
            ids, names, lengths, held, place = [], [], [], 0, place + 1
            return pa.RecordBatch.from_pylist([row])

        for b in frames:
            for doc, got in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist())):
                ids += [got, stop]
                names.append(doc)
                lengths.append(len(got) + 1)
                held += len(got) + 1
                if held >= shard:
                    yield close()
        if names:
            yield close()
        pa.default_memory_pool().release_unused()  # workers are used again

    made = materialize(ordered.mapInArrow(run, "path string, part long, place long, n_tokens long"), "shards")
    # The parts are summed up in order, then the shards of each part: no task sees all shards.
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = made.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("first"))
    placed = made.withColumn("start", before(Window.partitionBy("part").orderBy("place")))
    return materialize(placed.join(parts, "part").select("path", "part", "place", "n_tokens", (F.col("first") + F.col("start")).alias("start")), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """manifest(path, start) -> (doc_id, start, n_tokens, ids_crc32), a row per document, from the files."""
    spark = manifest.sparkSession

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, name = files.at(path)
                with store.open_input_stream(name) as file:
                    s = Shard(file.read())
                ids, at = s.ids().astype("<u4"), s.starts.tolist()
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(at, at[1:])]
                cols = [pa.array(s.doc_ids, pa.int64()), pa.array(s.starts[:-1] + start, pa.int64()), pa.array(s.lengths, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(manifest.count(), 32 * spark.sparkContext.defaultParallelism))
    return manifest.select("path", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, shard: int = SHARD) -> DataFrame:
    """Write docs' token ids as shards, then read them back."""
    return read(write(docs, folder or scratch(docs.sparkSession, "tokens"), tokenizer, shard))
