"""Seeded samples, folds and subsets. An id's place is the md5 of seed and id: the same on every engine and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), col.cast("string")).cast("binary"))


def ranked(rows: DataFrame, key: str, seed: int, part: list[str]) -> DataFrame:
    """rows with __r, the number from 1 of each row of a part in order of place and key, and __n, the rows of its part.

    Places are cut into 4,096 even bins by their leading digits: rows are numbered within a bin, and the bins of
    a part, few whatever its size, are summed up in order. No part is sorted in one task.
    """
    r = rows.withColumn("__p", place(F.col(key), seed)).withColumn("__bin", F.substring("__p", 1, 3))
    n = r.groupBy(*[F.col(c).alias(f"__{c}") for c in part], F.col("__bin").alias("__of")).agg(F.count("*").alias("__m"))
    own = Window.partitionBy(*[f"__{c}" for c in part])
    before = F.coalesce(F.sum("__m").over(own.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("__before", before).withColumn("__n", F.sum("__m").over(own))
    r = r.withColumn("__i", F.row_number().over(Window.partitionBy(*part, "__bin").orderBy("__p", key)))
    same = F.col("__bin") == F.col("__of")
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return r.join(n, same).select(*rows.columns, (F.col("__before") + F.col("__i")).alias("__r"), "__n")


def stratified(rows: DataFrame, key: str, stratum: str, fraction: float, seed: int) -> DataFrame:
    """M1. Of each stratum the round(fraction x n) rows of the lowest places, one at least."""
    r = ranked(rows, key, seed, [stratum])
    return r.where(F.col("__r") <= F.greatest(F.lit(1), F.round(F.lit(fraction) * F.col("__n")))).drop("__n", "__r")


def disjoint(rows: DataFrame, key: str, stratum: str, fractions: list[tuple[float, int]]) -> DataFrame:
    """M2, M3, U3. One sample after another from what is left, in column `sample` from 0."""
    out, rest = None, rows
    for i, (fraction, seed) in enumerate(fractions):
        s = stratified(rest, key, stratum, fraction, seed)
        rest = rest.join(s.select(key), key, "left_anti")
        out = s.withColumn("sample", F.lit(i)) if out is None else out.unionByName(s.withColumn("sample", F.lit(i)))
    return out


def folds(rows: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """M4. (group, fold): distinct groups in seeded order, dealt in turn."""
    g = ranked(rows.select(group).distinct(), group, seed, [])
    return g.select(group, F.pmod(F.col("__r") - 1, F.lit(n)).cast("int").alias("fold"))


def dev_subset(s1: DataFrame, pool: DataFrame, truth: DataFrame, n: int, extras: int, seed: int) -> DataFrame:
    """S12. n s1 records of each country, all their matches, and `extras` other pool records of each country and source.

    s1(s1_id, country), pool(cand_id, country, src) -> (id, src, reason)."""
    first = lambda rows, key, by, k: rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(place(F.col(key), seed), key))).where(F.col("__r") <= k).drop("__r")
    own = first(s1, "s1_id", ["country"], n)
    matched = pool.join(truth.join(own.select("s1_id"), "s1_id", "left_semi").select("cand_id").distinct(), "cand_id", "left_semi")
    other = first(pool.join(matched.select("cand_id"), "cand_id", "left_anti"), "cand_id", ["country", "src"], extras)
    rows = own.select(F.col("s1_id").alias("id"), F.lit(1).alias("src"), F.lit("entity").alias("reason"))
    for frame, reason in ((matched, "match"), (other, "extra")):
        rows = rows.unionByName(frame.select(F.col("cand_id").alias("id"), F.col("src").cast("int").alias("src"), F.lit(reason).alias("reason")))
    return rows


def negatives(positives: DataFrame, pool: DataFrame, part: list[str], seed: int) -> DataFrame:
    """J18. For each positive pair one pool record of the same part that is not a match of the s1 record, if there is one.

    Part members stand in a seeded ring; the negative is the next one after a seeded start. positives(s1_id,
    cand_id, part..) -> (s1_id, cand_id, negative)."""
    ring = ranked(pool.select("cand_id", *part), "cand_id", seed, part)
    p = ring.select("cand_id", *part, (F.col("__r") - 1).alias("at"))
    size = ring.groupBy(*part).agg(F.first("__n").alias("size"))
    start = F.conv(F.substring(place(F.concat_ws("/", "s1_id", "cand_id"), seed), 1, 8), 16, 10).cast("long")
    # One step beyond as many neighbours as the record has matches is sure to meet a stranger.
    truth = positives.select("s1_id", "cand_id").distinct()
    most = truth.groupBy("s1_id").agg(F.count("*").alias("m"))
    q = positives.join(size, part).join(most, "s1_id").withColumn("step", F.explode(F.sequence(F.lit(0), F.least("m", F.col("size") - 1).cast("int")))).withColumn("at", F.pmod(start + F.col("step"), F.col("size")))
    t = truth.withColumnRenamed("cand_id", "other")
    c = q.join(p.withColumnRenamed("cand_id", "other"), [*part, "at"]).join(t, ["s1_id", "other"], "left_anti")
    return c.groupBy("s1_id", "cand_id").agg(F.min_by("other", "step").alias("negative"))
