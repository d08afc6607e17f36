"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a map-side combined minimum and an equi-join that adaptive execution can split, so
a hub with any number of edges is spread over tasks. Edges live in the shared folder only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star then one small-star step over edges (hi, lo), hi > lo."""
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    large = both.join(least, "hi").where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    large = large.where(F.col("hi") != F.col("lo")).distinct()
    down = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(down, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.unionByName(down.select("hi", F.col("m").alias("lo"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())


def connected_components(edges: DataFrame, rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of long ids -> (id, component_id): for every id that is not the smallest of its
    component, that smallest id. Loops, repeated edges and nulls add nothing; no edges give no rows.
    rows: about how many edges there are, for the number of files.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now = materialize(e.distinct(), "edges", rows)
    before = _signature(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        nxt = materialize(_stars(now), "stars", before[0])
        drop(now)
        now, after = nxt, _signature(nxt)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
