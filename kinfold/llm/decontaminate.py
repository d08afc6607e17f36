"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

As in LSH Ensemble (Zhu et al., 2016), both sides are partitioned by the number of their shingles, because
a fixed containment t of an item of q shingles in a document of u means a Jaccard similarity of at least
t q / (u + q - t q), which falls with u and rises with q. Each pair of size classes (half octaves) has its
own one-permutation MinHash (Li et al., 2012), with just so many bins that a pair at that similarity shares
no bin minimum with a probability of at most MISS: for items of some 200 shingles under a tenth of the
shingles of a long document. Candidates share a minimum; the containment of the item's distinct shingles in the
document is then counted on the shingles themselves.

Items so short that no sketch smaller than the document would do (of under some ten shingles) are looked
up by all their hashes: that is the exact way. The recall of the others is 1 - MISS at the threshold and
nearer to 1 above it.

The items are the stated query set: they are sorted by size, cut into blocks of bounded bytes, and
each block is broadcast once and held against every document where it lies. Nothing is shuffled. Blocks
go in waves, so that what is broadcast at one time is bounded whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, map_texts, materialize, words

SHINGLE, THRESHOLD, MISS = 5, 0.8, 1e-4
#: Bytes of item text in one broadcast block; blocks that are broadcast at one time.
BLOCK_BYTES, WAVE = 8 << 20, 8
#: In place of a number of bins: no sketch, every hash is its own minimum.
ALL = 0


def shingles(w: list[bytes], size: int) -> list[bytes]:
    return [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]


def _hashes(parts: list[bytes]) -> np.ndarray:
    f = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter(map(f, parts), np.uint64, len(parts)))


def jaccard_floor(q: float, u: float, t: float) -> float:
    """The least Jaccard similarity of a document of u shingles that holds t of an item's q."""
    return t * q / (u + q - t * q)


def size_class(n: int) -> int:
    """Half octaves: the largest c with 2**(c / 2) <= n."""
    return (n * n).bit_length() - 1


def bins(doc_class: int, item_class: int, threshold: float) -> int:
    """The fewest bins for documents of a size class and items of another; ALL where twice as many as shingles would not do."""
    u, q = 2.0 ** ((doc_class + 1) / 2), np.ceil(2.0 ** (item_class / 2))
    # Shared shingles come whole: of a short item's, more than the threshold must be there.
    t = np.ceil(threshold * q) / q
    similarity, union = jaccard_floor(q, u, t), max(q, u + q - t * q)
    # A bin that either side has a hash in has the same minimum on both with the probability `similarity`, so that
    # many bins in use miss the pair with a probability of at most MISS.
    in_use = np.log(MISS) / np.log1p(-min(similarity, 1 - 1e-12))
    few, many = 0, int(2 * u)
    if many * -np.expm1(-union / many) < in_use:
        return ALL
    while many - few > 1:
        b = (few + many) // 2
        few, many = (few, b) if b * -np.expm1(-union / b) >= in_use else (b, many)
    return many


def minima(h: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash: the smallest hash of each of n even ranges of hashes. h sorted."""
    if n == ALL or not len(h):
        return h
    b = (h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    return h[np.concatenate(([True], b[1:] != b[:-1]))]


@dataclass
class Items:
    """A block of items with at least one word: shingle length min(size, words), distinct shingles, signatures by class."""

    ids: list[int]
    lengths: list[int]
    sets: list[frozenset]
    threshold: float
    index: dict = field(default_factory=dict)

    def signatures(self, length: int, doc_class: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For documents of a size class: a number of bins, and the sorted minima of the items (of this shingle length) that
        ask for as many bins, with whose they are. Item classes of equal bins go together."""
        if (key := (length, doc_class)) not in self.index:
            by: dict[int, list[int]] = {}
            for i, n in enumerate(self.lengths):
                if n == length:
                    by.setdefault(bins(doc_class, size_class(len(self.sets[i])), self.threshold), []).append(i)
            out = []
            for n, own in sorted(by.items()):
                each = [minima(_hashes(list(self.sets[i])), n) for i in own]
                h, who = np.concatenate(each), np.repeat(own, [len(e) for e in each])
                order = h.argsort(kind="stable")
                out.append((n, h[order], who[order]))
            self.index[key] = out
        return self.index[key]

    def search(self, text: str | None) -> Iterator[tuple[int, int, int, float]]:
        """(item_id, its distinct shingles, those in the text, containment), where that reaches the threshold."""
        w = words(text)
        for length in sorted(set(self.lengths)):
            if len(w) < length:
                continue
            parts = shingles(w, length)
            h, have = _hashes(parts), None
            for n_bins, items, who in self.signatures(length, size_class(len(h))):
                mine = minima(h, n_bins)
                # The shorter side is looked up in the longer one.
                if len(mine) < len(items):
                    a, b = np.searchsorted(items, mine), np.searchsorted(items, mine, "right")
                    met = a < b
                    hit = np.unique(np.concatenate([who[i:j] for i, j in zip(a[met].tolist(), b[met].tolist())])) if met.any() else ()
                else:
                    at = np.searchsorted(mine, items)
                    hit = np.unique(who[mine[np.minimum(at, len(mine) - 1)] == items])
                for i in map(int, hit):
                    have = have or set(parts)
                    if (n := len(self.sets[i] & have)) >= self.threshold * len(self.sets[i]):
                        yield self.ids[i], len(self.sets[i]), n, n / len(self.sets[i])


def prepare(rows: list[tuple[int, str]], size: int, threshold: float) -> Items:
    w = [(i, words(t)) for i, t in rows]
    w = [(i, x) for i, x in w if x]
    lengths = [min(size, len(x)) for _, x in w]
    return Items([i for i, _ in w], lengths, [frozenset(shingles(x, n)) for (_, x), n in zip(w, lengths)], threshold)


def blocks_of(items: DataFrame, size: int, threshold: float) -> Iterator[Items]:
    """The distinct items(item_id, text) with id and text, in blocks of at most about BLOCK_BYTES of text."""
    known = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and length(text) > 0").distinct()
    known = known.withColumn("bytes", F.octet_length("text"))
    # Blocks by size: items of one power of two of bytes, in as many hashed parts as their bytes ask for.
    k = F.floor(F.log2("bytes")).cast("int")
    classes = {r["k"]: r["b"] for r in known.groupBy(k.alias("k")).agg(F.sum("bytes").alias("b")).collect()}
    blocks, pending, room = [], [], BLOCK_BYTES
    for c, b in sorted(classes.items()):
        parts = -(-b // BLOCK_BYTES)
        if parts == 1 and b <= room:
            pending, room = [*pending, c], room - b
            continue
        if pending:
            blocks.append(k.isin(pending))
        pending, room = ([c], BLOCK_BYTES - b) if parts == 1 else ([], BLOCK_BYTES)
        blocks += [(k == c) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * parts)) == i) for i in range(2 * parts)] if parts > 1 else []
    if pending:
        blocks.append(k.isin(pending))
    for block in blocks:
        yield prepare([tuple(r) for r in known.where(block).select("item_id", "text").collect()], size, threshold)


def contaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (doc_id, item_id, item_shingles, shared, containment).

    A row for each document and item of which at least `threshold` of the distinct word shingles occur
    in the document. Words are runs without ASCII white space, A-Z lowered; an item of fewer than `size`
    words is one shingle of its own length. Null or empty texts and rows without id match nothing;
    repeated rows of documents give repeated rows, repeated items count once. Other columns are ignored;
    empty tables give no rows. Items beyond WAVE blocks add a scan of docs for each wave, whose rows are written
    before the next wave is broadcast.
    """
    spark = docs.sparkSession
    batches(spark)
    pairs = "doc_id long, item_id long, item_shingles long, shared long, containment double"
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and length(text) > 0")
    out = wave = None
    for got, last in _waves(spark, blocks_of(items, size, threshold)):

        def run(frames: Iterator[pd.DataFrame], got=got) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = [(d, *m) for d, t in zip(f["doc_id"], f["text"]) for b in got for m in b.value.search(t)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_shingles", "shared", "containment"])

        wave = texts.mapInPandas(run, pairs)
        if not last:
            wave = materialize(wave, "wave")
            for b in got:
                b.destroy()
        out = wave if out is None else out.unionByName(wave)
    return spark.createDataFrame([], pairs) if out is None else out


def _waves(spark, blocks: Iterator[Items]) -> Iterator[tuple[list, bool]]:
    """Broadcast blocks, WAVE at a time, and whether they are the last."""
    ahead = list(islice(blocks, WAVE))
    while ahead:
        got = [spark.sparkContext.broadcast(b) for b in ahead]
        ahead = list(islice(blocks, WAVE))
        yield got, not ahead


def clean(docs: DataFrame, items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text holds an item. Each row is decided by its own text, with or without doc_id;
    rows with null or empty texts stay, as do repeated rows; no items or no rows leave docs as they are."""
    keep = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    text = f"__c{docs.columns.index('text')}"
    d = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in keep.items()])
    for got, last in _waves(docs.sparkSession, blocks_of(items, size, threshold)):
        hits = lambda texts, got=got: {"__hit": [any(next(b.value.search(t), None) for b in got) for t in texts]}
        d = map_texts(d, list(keep), text, hits, "__hit boolean").where("NOT __hit").drop("__hit")
        if not last:
            d = materialize(d, "wave")
            for b in got:
                b.destroy()
    return d.select(*[F.col(k).alias(c) for k, c in keep.items()])
