"""Wavelet matrix (Claude, Navarro and Ordonez, 2015) over token ids, in one compressed file.

Level by level from the highest bit, the sequence is split stably into the ids whose bit is 0 and those
whose bit is 1; each level keeps its bits in the order of arrival. With the number of ones before every
word of bits (rank), and its inverse (select), the planes alone answer which id stands at a place
(access), how often an id occurs before a place (rank, count) and where it occurs (select, occurrences).

File: 8 bytes of magic, 8 bytes of the header's length, the header (JSON: n, bits, zeros of each level,
block directory, documents), then zstd blocks: the document table and, for each plane, blocks of
BLOCK bytes of bits, little-endian within a byte. A reader can fetch any block by its offset.
"""

from __future__ import annotations

import json

import numpy as np
import zstandard

MAGIC = b"KFWAVE01"
BLOCK = 1 << 16


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def build(ids: np.ndarray) -> tuple[int, list[int], list[bytes]]:
    """Bits of an id, zeros of each level and the planes. ids: unsigned, uint16 or uint32."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    zeros, planes = [], []
    for level in range(bits - 1, -1, -1):
        one = (ids & ids.dtype.type(1 << level)) != 0
        planes.append(_pack(one))
        zeros.append(len(ids) - int(np.count_nonzero(one)))
        split = np.empty_like(ids)
        # Taking by places is faster than by truth values; "clip" spares the copy that a check of them would make.
        np.take(ids, np.flatnonzero(~one), out=split[: zeros[-1]], mode="clip")
        np.take(ids, np.flatnonzero(one), out=split[zeros[-1] :], mode="clip")
        ids = split
    return bits, zeros, planes


def encode(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """The file. doc_ids (None for null) and lengths say whose ids follow one another."""
    ids = ids.astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32)
    bits, zeros, planes = build(ids)
    z = zstandard.ZstdCompressor(level=1)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.astype("<i8").tobytes() + known.tobytes()
    blobs = [z.compress(table)]
    ones = []
    for p in planes:
        blobs += [z.compress(p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)]
        ones.append([int(np.bitwise_count(np.frombuffer(p[i : i + BLOCK], np.uint8)).sum()) for i in range(0, len(p), BLOCK)])
    header = {"n": len(ids), "bits": bits, "zeros": zeros, "docs": len(doc_ids), "blocks": [len(b) for b in blobs], "ones": ones}
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *blobs])


class Shard:
    """A file's contents: documents, and the queries of a wavelet matrix. Planes are unpacked when first needed."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        n = int.from_bytes(data[8:16], "little")
        h = json.loads(data[16 : 16 + n])
        self.n, self.bits, self.zeros = h["n"], h["bits"], h["zeros"]
        self._ones, self._data = h["ones"], memoryview(data)
        self._at = np.cumsum([16 + n, *h["blocks"]]).tolist()
        self._per = -(-(-(-self.n // 8)) // BLOCK)
        t = self._blob(0)
        d = h["docs"]
        known = np.frombuffer(t, np.uint8, d, 16 * d).astype(bool)
        self.lengths = np.frombuffer(t, "<i8", d, 8 * d)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.doc_ids = [int(i) if k else None for i, k in zip(np.frombuffer(t, "<i8", d), known)]
        self._cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _blob(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._data[self._at[k] : self._at[k + 1]])

    def plane(self, level: int) -> np.ndarray:
        """Bits of a level, as booleans."""
        raw = b"".join(self._blob(1 + level * self._per + i) for i in range(self._per))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)

    def _level(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed bytes and the ones before each byte."""
        if level not in self._cache:
            raw = np.frombuffer(b"".join(self._blob(1 + level * self._per + i) for i in range(self._per)), np.uint8)
            self._cache[level] = raw, np.concatenate(([0], np.cumsum(np.bitwise_count(raw), dtype=np.int64)))
        return self._cache[level]

    def _rank1(self, level: int, i: int) -> int:
        raw, before = self._level(level)
        q, r = divmod(i, 8)
        return int(before[q]) + (int(raw[q] & ((1 << r) - 1)).bit_count() if r else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value."""
        raw, before = self._level(level)
        count = before if bit else np.arange(len(before)) * 8 - before
        q = int(np.searchsorted(count, k, "right")) - 1
        k -= int(count[q])
        byte = int(raw[q]) if bit else ~int(raw[q]) & 255
        for r in range(8):
            if byte >> r & 1:
                if not k:
                    return 8 * q + r
                k -= 1
        raise IndexError(k)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            raw, _ = self._level(level)
            one = raw[i // 8] >> (i % 8) & 1
            r = self._rank1(level, i)
            value, i = value << 1 | int(one), self.zeros[level] + r if one else i - r
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before place i."""
        a, b = self._range(token, 0, i)
        return b - a

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            i = self._select(level, one, i - self.zeros[level] if one else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids: the splits undone from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = self.plane(level)
            b = np.empty_like(a)
            b[np.flatnonzero(~one)] = a[: self.zeros[level]]
            b[np.flatnonzero(one)] = a[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            a = b
        return a

    def document(self, k: int) -> np.ndarray:
        return np.array([self.access(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)
