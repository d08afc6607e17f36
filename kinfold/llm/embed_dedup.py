"""Embedding near-duplicates over an inverted multi-index (Babenko and Lempitsky, 2012).

Unit vectors are cut in halves; each half has its own codebook, fitted on a bounded sample, and the
pairs of code words form a grid of cells. Every vector lives in the cell of its nearest code words.
As a query it walks the cells in order of distance by the multi-sequence algorithm until the target
recall is reached: the walk ends where a cell is farther than the best one by more than a margin,
calibrated on the sample so that neighbours at the threshold are met with that probability. What it
meets is verified by cosine in double precision. Crowded cells are cut into blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import batches, materialize
from .components import connected_components
from .simhash import _forest

#: Vectors the codebooks are fitted on, where they have under an eighth as many words; code words of a half at most
#: (as many as such a sample can tell apart); members a cell aims at. Beyond some 10^9 vectors cells grow with the data
#: and are cut into blocks: results stay the same, only the work grows faster.
SAMPLE, MAX_WORDS, CELL = 8192, 4096, 64
BLOCK = 1024
MET = "rep long, n long, to long"


@dataclass
class MultiIndex:
    """Codebooks of both halves, (K, d/2) each, and the margin of the walk."""

    words: tuple[np.ndarray, np.ndarray]
    margin: float

    @property
    def dim(self) -> int:
        return self.words[0].shape[1] + self.words[1].shape[1]

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.words[0].shape[1]
        return _squared(unit[:, :h], self.words[0]), _squared(unit[:, h:], self.words[1])

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(1).astype(np.int64) * len(self.words[1]) + b.argmin(1)

    def walk(self, unit: np.ndarray) -> Iterator[list[int]]:
        """For each vector, the cells in order of distance, as far as the margin goes."""
        a, b = self.distances(unit)
        k2 = len(self.words[1])
        oa, ob = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        sa, sb = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
        for ra, rb, xa, xb in zip(sa.tolist(), sb.tolist(), oa.tolist(), ob.tolist()):
            limit, heap, out = ra[0] + rb[0] + self.margin, [(ra[0] + rb[0], 0, 0)], []
            while heap:
                s, i, j = heapq.heappop(heap)
                if s > limit:
                    break
                out.append(xa[i] * k2 + xb[j])
                if j + 1 < len(rb):
                    heapq.heappush(heap, (ra[i] + rb[j + 1], i, j + 1))
                if not j and i + 1 < len(ra):
                    heapq.heappush(heap, (ra[i + 1] + rb[0], i + 1, 0))
            yield out


def _squared(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ w.T + (w * w).sum(1))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    w = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = _squared(x, w).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=c, minlength=k) for c in x.T], 1)
        w = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return w


def words_for(count: int) -> int:
    """Code words of a half, a power of two, so that cells of `count` vectors hold about CELL."""
    return int(min(MAX_WORDS, 2 ** max(0, round(np.log2(max(1.0, count / CELL)) / 2))))


def fit(sample: np.ndarray, count: int, threshold: float, recall: float, seed: int = 7) -> MultiIndex:
    """Codebooks sized for `count` vectors, and the margin for `recall` of neighbours at cosine `threshold`.

    The margin is measured for made neighbours exactly at the threshold in random directions, and for
    the sample's own links; the larger holds.
    """
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    h = max(1, unit.shape[1] // 2)
    k = min(len(unit), words_for(count))
    index = MultiIndex((_kmeans(unit[:, :h], k, rng), _kmeans(unit[:, h:], k, rng)), 0.0)
    noise = rng.standard_normal(unit.shape)
    noise -= (noise * unit).sum(1, keepdims=True) * unit
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    (a, b), own, made = index.distances(unit), index.cells(unit), index.cells(threshold * unit + np.sqrt(1 - threshold**2) * noise)
    least = a.min(1) + b.min(1)
    over = lambda i, cell: a[i, cell // k] + b[i, cell % k] - least[i]
    links = []
    for i in range(0, len(unit), 256):
        x, y = np.nonzero(np.triu(unit[i : i + 256] @ unit.T, i + 1) >= threshold)
        links.append(over(x + i, own[y]).astype(np.float32))
    for far in (over(np.arange(len(unit)), made), np.concatenate(links)):
        if len(far):
            index.margin = max(index.margin, float(np.quantile(far, recall)) + 1e-6)
    return index


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled first: squares of very small or large components would under- or overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _probe(index, kind: str):
    """Vectors travel as they are stored (kind), half the bytes of doubles for floats, and lose nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["embedding"].to_numpy()).astype(np.float64)
            raw, x = [v.tobytes() for v in x.astype(kind)], _unit(x)
            yield pd.DataFrame({"cell": index.value.cells(x), "visitor": False, "rep": f["rep"], "mult": f["mult"], "raw": raw})
            lists = list(index.value.walk(x))
            n = [len(c) for c in lists]
            at = np.repeat(np.arange(len(f)), n)
            for i in range(0, len(at), 8192):
                j = at[i : i + 8192]
                cells = np.concatenate(lists)[i : i + 8192].astype(np.int64)
                yield pd.DataFrame({"cell": cells, "visitor": True, "rep": f["rep"].to_numpy()[j], "mult": f["mult"].to_numpy()[j], "raw": [raw[t] for t in j]})

    return run


def _verify(threshold: float, kind: str):
    """Rows sorted by (cell, hb, vb, visitor): counts of links and edges of a spanning forest, for each block."""

    def solve(homes: list, visitors: list) -> pd.DataFrame | None:
        unit = lambda rows: _unit(np.frombuffer(b"".join(r[2] for r in rows), kind).reshape(len(rows), -1).astype(np.float64))
        hr, hm = (np.array([r[i] for r in homes], np.int64) for i in (0, 1))
        vr, vm = (np.array([r[i] for r in visitors], np.int64) for i in (0, 1))
        hit = (unit(visitors) @ unit(homes).T >= threshold) & (vr[:, None] < hr[None, :])
        if not hit.any():
            return None
        v, h = np.nonzero(hit)
        nv, nh = hit @ hm, vm @ hit
        a, b = _forest(vr[v], hr[h])
        i, j = np.flatnonzero(nv), np.flatnonzero(nh)
        none = np.zeros(len(a), np.int64)
        return pd.DataFrame({"rep": np.concatenate((vr[i], hr[j], a)), "n": np.concatenate((nv[i], nh[j], none)), "to": pd.array([None] * (len(i) + len(j)) + b.tolist(), "Int64")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, homes, visitors = None, [], []

        def done():
            if homes and visitors and (out := solve(homes, visitors)) is not None:
                yield out

        for f in frames:
            for cell, hb, vb, visitor, rep, mult, raw in f.itertuples(index=False, name=None):
                if (cell, hb, vb) != key:
                    yield from done()
                    key, homes, visitors = (cell, hb, vb), [], []
                (visitors if visitor else homes).append((rep, mult, raw))
                if len(visitors) >= 2 * BLOCK:
                    yield from done()
                    visitors = []
        yield from done()

    return run


def _met(groups: DataFrame, n: int, threshold: float, recall: float, sample: int, kind: str) -> DataFrame:
    """n groups(rep, mult, embedding) of one length -> counts of links and edges of forests (MET)."""
    spark = groups.sparkSession
    sample = max(sample, 8 * words_for(n))
    picked = groups.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toPandas()["embedding"].to_list()
    x = np.array(picked, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    index = spark.sparkContext.broadcast(fit(x, n, threshold, recall))
    found = materialize(groups.select("rep", "mult", "embedding").mapInPandas(_probe(index, kind), "cell long, visitor boolean, rep long, mult long, raw binary"), "visits")
    sizes = found.groupBy("cell").agg(F.count_if(~F.col("visitor")).alias("n_h"), F.count_if("visitor").alias("n_v"))
    crowded = materialize(sizes.where((F.col("n_h") > 0) & (F.greatest("n_h", "n_v") > BLOCK)).select("cell", F.ceil(F.col("n_h") / BLOCK).cast("int").alias("n_hb"), F.ceil(F.col("n_v") / BLOCK).cast("int").alias("n_vb")), "crowded", 0)
    r = found.join(crowded, "cell", "left").fillna(1, ["n_hb", "n_vb"])
    r = r.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("visitor"), F.col("n_vb")).otherwise(F.col("n_hb"))).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("visitor"), F.col("n_hb")).otherwise(F.col("n_vb")) - 1)))
    r = r.select("cell", F.when(F.col("visitor"), F.col("other")).otherwise(F.col("own")).alias("hb"), F.when(F.col("visitor"), F.col("own")).otherwise(F.col("other")).alias("vb"), "visitor", "rep", "mult", "raw")
    keys = ["cell", "hb", "vb"]
    return materialize(r.repartition(*keys).sortWithinPartitions(*keys, "visitor").mapInPandas(_verify(threshold, kind), MET), "met", 2 * n)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, sample: int = SAMPLE) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, n_links, component_id, kept): one row per row of vectors.

    Two vectors link if their cosine in double precision is at least `threshold` and the index meets
    them; n_links counts the other rows linked directly, component_id is the smallest vec_id reachable
    and kept tells whether it is the row's own. Equal vectors are collapsed and counted. Vectors
    of different lengths do not link. Rows whose embedding is null, zero, empty, or holds a null or
    non-finite component link with nothing, nor do rows without vec_id (component_id null, kept).
    Other columns are ignored. No rows give no rows.
    """
    spark = vectors.sparkSession
    batches(spark)
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    e = F.col("embedding")
    good = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).withColumn("vkey", F.when(good & F.col("vec_id").isNotNull(), F.md5(e.cast("string"))))
    groups = rows.where("vkey is not null").groupBy("vkey").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("embedding").alias("embedding"))
    groups = materialize(groups, "vectors", vectors.count())
    # Vectors of one length each have an index of their own; one vector alone has nothing to meet.
    sizes = {r["d"]: r["n"] for r in groups.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return vectors.select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    met = spark.createDataFrame([], MET)
    for d, n in sorted(sizes.items()):
        if n > 1:
            met = met.unionByName(_met(groups.where(F.size("embedding") == d), n, threshold, recall, sample, kind))
    n = sum(sizes.values())
    counts = met.groupBy("rep").agg(F.sum("n").alias("n"))
    moved = connected_components(met.where("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")), n)
    info = groups.select("vkey", "rep", "mult").join(counts, "rep", "left").join(moved, F.col("rep") == F.col("id"), "left")
    info = info.select("vkey", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")).where("n_links > 0")
    out = rows.select("vec_id", "vkey").join(info, "vkey", "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
