"""Profiles of files, truth and pairs: one aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import latin_fold, tokens

#: Shares that a text profile reports: name -> pattern.
PATTERNS = {"digit": r"[0-9]", "upper": r"^[^a-z]*[A-Z][^a-z]*$", "lower": r"^[^A-Z]*[a-z][^A-Z]*$", "non_ascii": r"[^\x00-\x7F]", "indic": V.INDIC, "at_or_hash": r"[@#]", "dotted": r"[A-Za-z]\.[A-Za-z]\.", "ampersand": r"&", "parenthesis": r"[()]", "comma": r",", "web": r"(?i)www\.|\.com|\.net|\.org"}
#: Ranges of values that ranks are summed up in.
RANGES = 64
NULL_WORDS = ("", "null", "none", "nan", "n/a", "na")


def text_profile(df: DataFrame, key: str, column: str) -> DataFrame:
    """E1. Rows, distinct ids and values, length quantiles, share of each pattern and of null words, in one pass."""
    c = F.coalesce(F.col(column).cast("string"), F.lit(""))
    q = [F.percentile(F.length(c), F.lit(p)).alias(f"len_p{int(100 * p)}") for p in (0.05, 0.5, 0.95)]
    shares = [F.round(F.avg(c.rlike(p).cast("double")), 6).alias(f"share_{n}") for n, p in PATTERNS.items()]
    null = F.round(F.avg(F.lower(F.trim(c)).isin(*NULL_WORDS).cast("double")), 6).alias("share_null")
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("ids"), F.countDistinct(c).alias("values"), *q, *shares, null)


def top_tokens(df: DataFrame, column: str, n: int = 60) -> DataFrame:
    """A9. The n most frequent tokens."""
    t = df.select(latin_fold(F.col(column)).alias("t")).select(F.explode(tokens(F.col("t"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(n)


def match_lengths(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """E2. How many entities have how many matches, none included."""
    n = truth.select("s1_id", "cand_id").distinct().groupBy("s1_id").agg(F.count("*").alias("matches"))
    return entities.select("s1_id").distinct().join(n, "s1_id", "left").fillna(0, ["matches"]).groupBy("matches").agg(F.count("*").alias("entities"))


def joint_lengths(truth: DataFrame, n: int = 20) -> DataFrame:
    """A12. Entities by their matches in source 2 and in source 3; the n most frequent pairs of numbers."""
    by = truth.groupBy("s1_id").agg(F.count_if(F.col("src") == 2).alias("n2"), F.count_if(F.col("src") == 3).alias("n3"))
    return by.groupBy("n2", "n3").agg(F.count("*").alias("entities")).orderBy(F.desc("entities"), "n2", "n3").limit(n)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """A11, E3. Rank correlation, ties at their mean rank. Ranks come from counts by value, summed up within
    ranges of values and over the ranges, so that no task sorts them all."""
    both = df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()

    def ranks(c: str) -> DataFrame:
        n = both.groupBy(c).agg(F.count("*").alias("n"))
        # Any edges give the same ranks; these make the ranges even.
        edges = sorted(set(both.approxQuantile(c, [i / RANGES for i in range(1, RANGES)], 0.001)))
        n = n.withColumn("range", sum((F.col(c) > e).cast("int") for e in edges) + F.lit(0))
        upto = F.sum("n").over(Window.partitionBy("range").orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sizes = n.groupBy("range").agg(F.sum("n").alias("all"))
        before = F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return n.withColumn("upto", upto).join(F.broadcast(sizes.select("range", before.alias("before"))), "range").select(c, (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias(f"r{c}"))

    return both.join(ranks("x"), "x").join(ranks("y"), "y").agg(F.round(F.corr("rx", "ry"), 6).alias("spearman"))


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """A10. Rows by bin (edge i, edge i + 1], numbered from 0; values outside have no bin."""
    c, b = F.col(column), F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        b = F.when((c > edges[i]) & (c <= edges[i + 1]), F.lit(i)).otherwise(b)
    return df.select(b.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def quantiles(df: DataFrame, by: list[str], column: str, ps: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """A13, E5. Exact quantiles of a column by group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.percentile(column, F.lit(p)), 6).alias(f"p{int(100 * p)}") for p in ps])


def row_gaps(rows: DataFrame, cluster: str, position: str) -> DataFrame:
    """E3. Count, median and least of the distances between neighbouring members of a cluster."""
    gap = F.col(position) - F.lag(position).over(Window.partitionBy(cluster).orderBy(position))
    return rows.withColumn("gap", gap).where("gap is not null").agg(F.count("*").alias("n"), F.percentile("gap", F.lit(0.5)).alias("median"), F.min("gap").alias("least"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """E3. Distinct keys of a, of b, and of both."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    j = x.join(y, key, "full")
    return j.agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def true_rank(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """E9. Of each true pair with a score: one more than the candidates of its s1 record that score strictly higher."""
    own = scores.join(truth.select("s1_id", "cand_id").distinct(), ["s1_id", "cand_id"], "left_semi").select("s1_id", "cand_id", F.col("cos").alias("own"))
    better = own.join(scores.select("s1_id", F.col("cos").alias("other")), "s1_id").groupBy("s1_id", "cand_id").agg((F.count_if(F.col("other") > F.col("own")) + 1).alias("rank"))
    return better


def dense_gate(truth: DataFrame, found: DataFrame, dense: DataFrame, block: str) -> DataFrame:
    """J17. By block: true pairs, those found, and of the missed ones those that the dense pass meets."""
    mark = lambda d, n: d.select("s1_id", "cand_id").distinct().withColumn(n, F.lit(1))
    r = truth.select("s1_id", "cand_id", block).distinct().join(mark(found, "f"), ["s1_id", "cand_id"], "left").join(mark(dense, "d"), ["s1_id", "cand_id"], "left")
    return r.groupBy(block).agg(F.count("*").alias("pairs"), F.count("f").alias("found"), F.count_if(F.col("f").isNull() & F.col("d").isNotNull()).alias("rescued"))
