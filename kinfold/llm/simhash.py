"""SimHash near-duplicates: segment popcounts, a grid range-join on them, exact Hamming checks.

A 64-bit fingerprint becomes 32 counts, one for each pair of bits. The Manhattan distance of two
count vectors never exceeds the Hamming distance of the fingerprints, so every link of Hamming
distance <= d lies within Manhattan distance d. The vector is cut into ceil((d + 1) / 2) groups;
by the pigeonhole principle two linked vectors differ by at most 1 in some group of radius 1, or
not at all in some group of radius 0. Each group is a grid of unit cells: a fingerprint lives in
its own cell of every group and visits the neighbouring cells within the radius. Within a cell,
visitors meet residents and the exact distance decides.

Equal fingerprints are collapsed first. Cells with many residents are cut into blocks, which are
compared pair by pair of blocks: the Manhattan distance of a pair is computed first, and only what it
lets through is checked by the Hamming distance. Each block reports a spanning forest of its links,
never all pairs; memory is bounded by the block size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, words
from .components import connected_components

SHINGLE, SEED, MAX_DISTANCE = 4, 42, 4
#: Residents, and visitors, of one block of a crowded cell.
BLOCK = 2048
#: Pairs compared at once.
PAIRS = 1 << 21
LOW = 0x5555555555555555


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `size` words, repeats included; fewer words: of the whole sequence."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(w) - size + 1)
    all_words, f = b" ".join(w), xxhash.xxh64_intdigest
    last = ends[-n:]
    return np.fromiter((f(all_words[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half the shingle hashes; no words give 0. Unsigned."""
    h = shingle_hashes(text, size, seed)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0]) if len(h) else 0


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp), fp as a signed long. Null and empty texts give 0."""

    def run(texts: list) -> dict:
        return {"fp": np.array([fingerprint(t, size, seed) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], "text", run, "fp long")


def _popcounts(fp):
    """The 32 two-bit counts, packed; without carries between them, so no sum can overflow."""
    a, b = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(counts, distance: int) -> tuple[list, list]:
    """Home cells and visited cells of packed counts, as structs (g, cell)."""
    n_groups = -(-(distance + 1) // 2)
    with_radius = distance + 1 - n_groups
    bounds = np.linspace(0, 32, n_groups + 1).round().astype(int).tolist()
    home, visit = [], []
    for g in range(n_groups):
        fields = range(bounds[g], bounds[g + 1])
        mask = F.lit(_signed(sum(3 << (2 * i) for i in fields)))
        cell = lambda c, g=g, mask=mask: F.struct(F.lit(g).alias("g"), c.bitwiseAND(mask).alias("cell"))
        home.append(cell(counts))
        visit.append(cell(counts))
        for i in fields if g < with_radius else ():
            v = F.shiftrightunsigned(counts, 2 * i).bitwiseAND(F.lit(3))
            rest = counts.bitwiseAND(F.lit(_signed(~(3 << (2 * i)) & (2**64 - 1))))
            visit.append(F.when(v < 2, cell(rest.bitwiseOR(F.shiftleft(v + 1, 2 * i)))))
            visit.append(F.when(v > 0, cell(rest.bitwiseOR(F.shiftleft(v - 1, 2 * i)))))
    return home, visit


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that connect what the links a-b connect."""
    ids, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, lab = inv[: len(a)], inv[len(a) :], np.arange(len(ids))
    while True:
        m = np.minimum(lab[x], lab[y])
        new = lab.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    tail = lab != np.arange(len(ids))
    return ids[tail], ids[lab[tail]]


def _steps(fp: np.ndarray) -> np.ndarray:
    """The two-bit counts written as 00, 01, 11: so many bits differ as the counts of two fingerprints lie apart."""
    a, b = fp & np.uint64(LOW), (fp >> np.uint64(1)) & np.uint64(LOW)
    return (a | b) | ((a & b) << np.uint64(1))


def _links(distance: int):
    """Partition function over rows sorted by (g, cell, hb, vb, visitor)."""

    def solve(f: dict[str, np.ndarray], starts: np.ndarray, out: list) -> None:
        n = len(f["fp"])
        size = np.diff(np.append(starts, n))
        group = np.repeat(np.arange(len(starts)), size)
        residents = np.bincount(group[~f["visitor"]], minlength=len(starts))
        vis = np.flatnonzero(f["visitor"] & (residents[group] > 0))
        per = residents[group[vis]]
        cum = np.concatenate(([0], np.cumsum(per)))
        steps, i = _steps(f["fp"]), 0
        while i < len(vis):
            j = max(i + 1, int(np.searchsorted(cum, cum[i] + PAIRS, "right")) - 1)
            left = np.repeat(vis[i:j], per[i:j])
            right = np.repeat(starts[group[vis[i:j]]] - (cum[i:j] - cum[i]), per[i:j]) + np.arange(cum[j] - cum[i])
            near = np.flatnonzero(np.bitwise_count(steps[left] ^ steps[right]) <= distance)
            left, right = left[near], right[near]
            hit = (np.bitwise_count(f["fp"][left] ^ f["fp"][right]) <= distance) & (f["rep"][left] != f["rep"][right])
            if hit.any():
                out.append(_forest(f["rep"][left[hit]], f["rep"][right[hit]]))
            i = j

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("g", "cell", "hb", "vb", "visitor", "fp", "rep")
        held: list[dict] = []
        rows = 0

        def flush(last: bool):
            nonlocal held, rows
            f = {k: np.concatenate([h[k] for h in held]) for k in names}
            new = np.zeros(rows, bool)
            new[:1] = True
            for k in ("g", "cell", "hb", "vb"):
                new[1:] |= f[k][1:] != f[k][:-1]
            starts, out = np.flatnonzero(new), []
            cut = rows if last else int(starts[-1])
            solve({k: v[:cut] for k, v in f.items()}, starts if last else starts[:-1], out)
            held, rows = ([] if last else [{k: v[cut:] for k, v in f.items()}]), rows - cut
            for a, b in out:
                yield pd.DataFrame({"a": a, "b": b})

        for x in frames:
            held.append({k: x[k].to_numpy().view(np.uint64) if k == "fp" else x[k].to_numpy() for k in names})
            rows += len(x)
            if rows >= 1 << 17:
                yield from flush(False)
        if rows:
            yield from flush(True)

    return run


def links(groups: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """groups(fp, rep), fp distinct -> edges (a, b) of reps that connect all fingerprints within the distance."""
    if not 1 <= distance <= 31:
        raise ValueError("distance must lie in 1..31")
    # Each row becomes some twenty: dealt anew, as few files hold them all.
    groups = groups.select("fp", "rep").repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    counts = _popcounts(F.col("fp"))
    home, visit = _cells(counts, distance)
    homes = groups.select("fp", "rep", F.explode(F.array(*home)).alias("c")).select("fp", "rep", "c.g", "c.cell")
    visits = groups.select("fp", "rep", F.explode(F.array_compact(F.array(*visit))).alias("c")).select("fp", "rep", "c.g", "c.cell")
    rows = homes.withColumn("visitor", F.lit(False)).unionByName(visits.withColumn("visitor", F.lit(True)))
    sizes = rows.groupBy("g", "cell").agg(F.count_if(~F.col("visitor")).alias("n_h"), F.count_if("visitor").alias("n_v"))
    crowded = materialize(sizes.where((F.col("n_h") > 0) & (F.greatest("n_h", "n_v") > BLOCK)).select("g", "cell", F.ceil(F.col("n_h") / BLOCK).cast("int").alias("n_hb"), F.ceil(F.col("n_v") / BLOCK).cast("int").alias("n_vb")), "crowded", 0)
    # A cell without visitors but its own residents still holds pairs, as residents visit their own cell.
    r = rows.join(crowded, ["g", "cell"], "left").fillna(1, ["n_hb", "n_vb"])
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("visitor"), F.col("n_vb")).otherwise(F.col("n_hb"))).cast("int")
    r = r.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("visitor"), F.col("n_hb")).otherwise(F.col("n_vb")) - 1)))
    r = r.select("g", "cell", F.when(F.col("visitor"), F.col("other")).otherwise(F.col("own")).alias("hb"), F.when(F.col("visitor"), F.col("own")).otherwise(F.col("other")).alias("vb"), "visitor", "fp", "rep")
    keys = ["g", "cell", "hb", "vb"]
    return r.repartition(*keys).sortWithinPartitions(*keys, "visitor").mapInPandas(_links(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint, component_id): one row per row of docs.

    Documents whose fingerprints differ in at most `distance` bits are linked; component_id is the
    smallest doc_id reachable over links. Null and empty texts have fingerprint 0 and link like any
    other. A row without doc_id links with nothing and has a null component_id. Rows that repeat a
    doc_id each get a row. Other columns are ignored. No rows give no rows.
    """
    prints = materialize(fingerprints(docs, size, seed), "prints")
    groups = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    groups = materialize(groups, "groups", prints.count())
    moved = connected_components(links(groups.select("fp", "rep"), distance), groups.count())
    # Only fingerprints whose documents are not all their own component need a lookup.
    lookup = groups.join(moved, groups.rep == moved.id, "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), "n", "rep").where("n > 1 or component_id != rep").select("fp", "component_id")
    out = prints.join(lookup, "fp", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), comp.alias("component_id"))
