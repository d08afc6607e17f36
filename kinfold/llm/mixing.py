"""Mixing sources to target weights by systematic sampling.

Within a source the running sum of expected copies plus one random offset crosses an integer as often as a
document is emitted. Expected copies are target / source size, but for what the large documents call for: those
that hold over 1 / LARGE of their source's words, at most LARGE of them. In order of size, each has the words
owed to it and the larger ones before it, rounded at the offset to a whole number of copies, and what they took
too much or too little is shared out over the expected copies of the other documents.

The others are in one order by (source, stratum, size, hash of the id). A source of many documents is dealt to strata
by the hash, in which sizes run up and down by turns: so no range of the order holds the long texts only,
and the words taken stay within some documents of what was aimed at.

The running sum is distributed: a range partitioning puts the order over the tasks, ties and all,
each row gets its place within its partition, and a small table of counts per partition and source
gives the rest. No source, whatever its share, is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXTS, materialize

WEIGHTS = (5, 2, 1)
#: Words of the mix per word of input; most copies' worth of a source.
SHARE, CAP = 1.5, 2.0
SEED = "mix-1"
#: Leading hex digits of an md5 that make a number.
DIGITS = 13
#: A document is large if its words times this exceed its source's.
LARGE = 50
#: Parts of a source that run through all its sizes, and the documents it has for each at least.
STRATA, STRATUM_ROWS = 64, 4096
#: Rows of the offsets (partitions + sources) up to which they are broadcast: some 10 MB.
MOST_OFFSETS = 100_000


def size_of(text) -> F.Column:
    """Runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _number(col) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), col).cast("binary")), 1, DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes(source, source_size) -> with target: water-filling of share x all words by weight, up to cap x a source.

    Sources are weighted in order of code points, null last. In order of cap / weight, the level of the
    sources that stay below their cap is (what is left) / (weights that are left); a source is capped if
    its own cap is below that level.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(n)) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    left = F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", F.greatest(F.lit(0.0), left / weight_left))
    s = s.withColumn("open", F.col("most") / F.col("weight") >= F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct((F.col("most") / F.col("weight")).alias("k"), "level"))).over(all_rows)["level"]
    return s.select("source", "source_size", F.when(F.coalesce(F.col("most") / F.col("weight") < final, F.lit(True)), F.col("most")).otherwise(final * F.col("weight")).alias("target"))


def _whole(large: DataFrame) -> DataFrame:
    """large(source, r, u, sizes in descending order) -> with all, the copies of each and the words taken so far, in the same order.

    Each gets the words owed to those so far, less what these took, in copies: cut to a whole number after adding
    the offset u, and held between the whole numbers around the ratio r.
    """
    step = lambda acc, size: F.struct(
        (acc["owed"] + size * F.col("r")).alias("owed"),
        (acc["taken"] + size * F.greatest(F.floor("r"), F.least(F.ceil("r"), F.floor((acc["owed"] + size * F.col("r") - acc["taken"]) / size + F.col("u"))))).cast("double").alias("taken"),
    )
    none = F.struct(F.lit(0.0).alias("owed"), F.lit(0.0).alias("taken"))
    grown = F.aggregate(
        "sizes",
        F.struct(none.alias("at"), F.array().cast("array<double>").alias("all")),
        lambda acc, size: F.struct(step(acc["at"], size).alias("at"), F.concat(acc["all"], F.array(step(acc["at"], size)["taken"])).alias("all")),
    )
    return large.withColumn("all", grown["all"])


def _decided(docs: DataFrame, keep: dict[str, str], weights, share: float, cap: float) -> DataFrame:
    """The columns `keep` (name -> column of docs) of every row, with __id, __source, __size, __source_size, __target, __n."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    d = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in keep.items()], F.col("doc_id").cast("long").alias("__id"), F.col("source").cast("string").alias("__source"), size_of(F.col("text")).alias("__size"), _number(text).alias("__h"))
    d = materialize(d, "sizes", codec=TEXTS)  # words are counted once; what follows reads the numbers
    sources = d.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"), F.count("*").alias("rows"))
    total = materialize(sources, "sources", 0)
    total = targets(total.select("source", "source_size"), weights, share, cap).join(total.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    u = _number(F.concat(F.lit("offset:"), F.coalesce("source", F.lit("")))) / F.lit(float(16**DIGITS))
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    total = materialize(total.select("source", "source_size", "target", "rows", r.alias("r"), u.alias("u")), "targets", 0)
    d = d.join(total, F.col("__source").eqNullSafe(F.col("source")))
    is_large = F.col("__size") * LARGE > F.col("source_size")

    # Under LARGE rows a source.
    place = Window.partitionBy("source").orderBy(F.desc("__size"), "__h", F.col("__id").asc_nulls_first())
    large = d.where(is_large).withColumn("__k", F.row_number().over(place))
    lists = _whole(large.groupBy("source", "r", "u").agg(F.array_sort(F.collect_list(F.struct("__k", "__size"))).alias("l")).withColumn("sizes", F.col("l.__size")))
    lists = materialize(lists.select(F.col("source").alias("s"), "sizes", "all"), "large", 0)
    before = F.when(F.col("__k") > 1, F.try_element_at("all", (F.col("__k") - 1).cast("int"))).otherwise(0.0)
    whole = large.join(lists, F.col("source").eqNullSafe(F.col("s"))).withColumn("__n", F.round((F.element_at("all", F.col("__k")) - before) / F.col("__size")).cast("long"))

    # What is left of the targets, for the others.
    took = lists.select("s", F.element_at("all", -1).alias("took"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"))
    rest = total.join(took, F.col("source").eqNullSafe(F.col("s")), "left")
    words = F.col("source_size") - F.coalesce("words", F.lit(0))
    ratio = F.when(words > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), (F.col("target") - F.coalesce("took", F.lit(0.0))) / words))).otherwise(0.0)
    rest = materialize(rest.select(F.col("source").alias("r_source"), F.col("source_size").alias("r_size"), F.col("target").alias("r_target"), F.col("u").alias("r_u"), ratio.alias("ratio")), "ratios", 0)

    stratum = F.pmod(F.col("__h"), F.least(F.lit(STRATA), F.lit(1) + F.floor(F.col("rows") / STRATUM_ROWS)).cast("long"))
    # Strata run up and down in size by turns, so that sizes stay next to each other where strata meet.
    snake = F.when(stratum % 2 == 0, F.col("__size")).otherwise(-F.col("__size"))
    small = d.where(~is_large).withColumns({"__stratum": stratum, "__snake": snake}).drop("source", "source_size", "target", "rows", "r", "u")
    order = [F.col("__source").asc_nulls_last(), "__stratum", "__snake", "__h", F.col("__id").asc_nulls_first()]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = small.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__stratum", "__snake", "__h")
    # The number counts rows within a partition from 0 and holds the partition above bit 33.
    placed = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()), "placed", codec=TEXTS)
    counts = placed.groupBy("__source", F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    counts = materialize(counts, "counts", 0)  # at most a row for each partition and each source
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("__source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__source", "part", "first", earlier.alias("before")).join(rest, F.col("__source").eqNullSafe(F.col("r_source")))
    offsets = offsets.select("r_source", F.col("part").alias("r_part"), "first", "before", "r_size", "r_target", "ratio", "r_u")
    if counts.count() <= MOST_OFFSETS:
        offsets = F.broadcast(offsets)
    p = placed.join(offsets, (F.shiftright("__at", 33) == F.col("r_part")) & F.col("__source").eqNullSafe(F.col("r_source")))
    rank = F.col("__at") - F.col("first") + F.col("before")
    crossed = F.floor(F.col("r_u") + (rank + 1) * F.col("ratio")) - F.floor(F.col("r_u") + rank * F.col("ratio"))
    out = lambda f, size, target, k: f.select(*keep, "__id", "__source", "__size", F.col(size).alias("__source_size"), F.col(target).alias("__target"), k.cast("long").alias("__n"))
    return out(p, "r_size", "r_target", crossed).unionByName(out(whole, "source_size", "target", F.col("__n")))


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, source, size, source_size, target, n_copies), one row per row.

    Null texts have size 0, null is a source of its own, null ids sort by the empty text's hash; rows
    that repeat id, source and size are told apart by place alone, so the result as a whole is the same
    in every run. A source without words takes nothing. No rows give no rows.
    """
    r = _decided(docs, {}, weights, share, cap)
    return r.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__n").alias("n_copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: docs' columns, each row as often as copies() says, with the same rules for nulls, empty texts,
    repeated rows and empty tables. Texts are shuffled once, by range."""
    keep = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    r = _decided(docs, keep, weights, share, cap).where("__n > 0")
    r = r.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return r.select(*[F.col(k).alias(c) for k, c in keep.items()])
