"""Dictionaries learned from counts: transliteration of tokens, regions of address components.

Every argmax breaks ties by the smaller token, so a dictionary does not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import tokens


def parallel_text(edges: DataFrame, s1: DataFrame, pool: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """T1. Labelled edges whose pool side has an Indic character in name or address; edges of excluded s1_ids out."""
    e = edges if excluded is None else edges.join(excluded.select("s1_id"), "s1_id", "left_anti")
    native = pool.where(F.col("name").rlike(V.INDIC) | F.col("address").rlike(V.INDIC))
    other = native.select("cand_id", F.col("name").alias("pool_name"), F.col("address").alias("pool_address"))
    return e.select("s1_id", "cand_id").join(other, "cand_id").join(s1.select("s1_id", "name", "address"), "s1_id")


def learn_tokens(pairs: DataFrame, latin: str, native: str, is_native: Column | None = None, min_count: int = 2, min_share: float = 0.6) -> DataFrame:
    """T2. pairs with folded texts -> (native, latin): what each native token stands for.

    Token lists of equal length are aligned by place, and the most frequent partner counts if it occurs
    min_count times and in min_share of the cases. Other tokens go by co-occurrence: of the partners in
    min_share of the pairs a token occurs in (min_count at least), the one with the highest share times
    ln(1 + pairs / pairs with the partner). is_native tells a native token t; Indic characters by default.
    """
    t = F.col("t")
    own = t.rlike(V.INDIC) if is_native is None else is_native
    # Array lambdas cannot take a column over t; so tokens are judged as rows. A pair is known by its tokens, and equal
    # pairs are one that counts m times: no key depends on partitions or on the order rows arrive in.
    p = pairs.select(tokens(F.col(latin)).alias("lt"), tokens(F.col(native)).alias("nt"))
    p = p.groupBy(F.md5(F.concat_ws(" ", F.array_join("lt", " "), F.lit("|"), F.array_join("nt", " ")).cast("binary")).alias("pair")).agg(F.any_value("lt").alias("lt"), F.any_value("nt").alias("nt"), F.count("*").alias("m"))
    nt = p.select("pair", "m", F.size("lt").alias("n_l"), F.size("nt").alias("n_n"), F.posexplode("nt").alias("at", "t")).withColumn("own", own)
    lt = p.select("pair", "m", F.posexplode("lt").alias("at", "t")).withColumn("own", own)
    usable = nt.groupBy("pair", "m").agg(F.max("own").alias("any")).where("any").join(lt.groupBy("pair").agg(F.max("own").alias("bad")), "pair", "left").where(~F.coalesce("bad", F.lit(False))).select("pair", "m")
    nt, lt = nt.join(usable.select("pair"), "pair"), lt.join(usable.select("pair"), "pair").select("pair", "m", F.col("at").alias("l_at"), F.col("t").alias("b"))
    nt = nt.where("own").withColumnRenamed("t", "a")
    aligned = nt.where("n_l = n_n").join(lt.drop("m"), "pair").where("at = l_at").groupBy("a", "b").agg(F.sum("m").alias("n"))
    by = Window.partitionBy("a")
    best = aligned.withColumn("all", F.sum("n").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "b"))).where("r = 1")
    placed = best.where((F.col("n") >= min_count) & (F.col("n") / F.col("all") >= min_share)).select("a", "b")
    a_sets, b_sets = nt.select("pair", "m", "a").distinct(), lt.select("pair", "m", "b").distinct()
    total = usable.agg(F.sum("m").alias("pairs"))
    a_df = a_sets.groupBy("a").agg(F.sum("m").alias("a_df")).where(F.col("a_df") >= min_count).join(placed, "a", "left_anti")
    b_df = b_sets.groupBy("b").agg(F.sum("m").alias("b_df"))
    met = a_sets.join(a_df, "a").join(b_sets.drop("m"), "pair").groupBy("a", "b", "a_df").agg(F.sum("m").alias("n")).where(F.col("n") / F.col("a_df") >= min_share)
    scored = met.join(b_df, "b").crossJoin(F.broadcast(total)).withColumn("score", F.col("n") / F.col("a_df") * F.log(1 + F.col("pairs") / F.col("b_df")))
    scored = scored.withColumn("r", F.row_number().over(by.orderBy(F.desc(F.round("score", 9)), "b"))).where("r = 1").select("a", "b")
    return placed.unionByName(scored).select(F.col("a").alias("native"), F.col("b").alias("latin"))


def _argmax(counts: DataFrame, min_count: int, min_share: float) -> DataFrame:
    """counts(block, component, region, n) -> (block, component, region) where one region dominates."""
    by = Window.partitionBy("block", "component")
    c = counts.withColumn("all", F.sum("n").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "region")))
    return c.where((F.col("r") == 1) & (F.col("all") >= min_count) & (F.col("n") / F.col("all") >= min_share)).select("block", "component", "region")


def region_vocabulary(parts: DataFrame, min_last: int = 300, min_share: float = 0.8) -> DataFrame:
    """R1. parts(id, block, components) -> (block, component) of regions: often last, seldom elsewhere."""
    rows = parts.select("block", F.size("components").alias("n"), F.posexplode("components").alias("at", "component"))
    last = F.count_if(F.col("at") == F.col("n") - 1)
    c = rows.groupBy("block", "component").agg(last.alias("last"), F.count("*").alias("all"))
    return c.where((F.col("last") >= min_last) & (F.col("last") / F.col("all") >= min_share)).select("block", "component")


def _last_known(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, region): the last component of each record that is in the vocabulary."""
    rows = parts.select("id", "block", F.posexplode("components").alias("at", "component")).join(vocabulary, ["block", "component"])
    return rows.groupBy("id").agg(F.max_by("component", "at").alias("region"))


def component_regions(parts: DataFrame, vocabulary: DataFrame, min_count: int = 3, min_share: float = 0.95) -> DataFrame:
    """R2. (block, component, region) for components that go with one region, without labels."""
    rows = parts.select("id", "block", F.explode("components").alias("component")).join(vocabulary, ["block", "component"], "left_anti")
    counts = rows.join(_last_known(parts, vocabulary), "id").groupBy("block", "component", "region").agg(F.count("*").alias("n"))
    return _argmax(counts, min_count, min_share)


def pair_regions(edges: DataFrame, s1_regions: DataFrame, pool_parts: DataFrame, min_count: int = 20, min_share: float = 0.9) -> DataFrame:
    """R3. The same from labelled pairs: components of the pool side with the region of the s1 side."""
    r = s1_regions.where("region != ''").select(F.col("id").alias("s1_id"), "region")
    rows = edges.select("s1_id", "cand_id").join(r, "s1_id").join(pool_parts.select(F.col("id").alias("cand_id"), "block", F.explode("components").alias("component")), "cand_id")
    return _argmax(rows.groupBy("block", "component", "region").agg(F.count("*").alias("n")), min_count, min_share)


def assign_regions(parts: DataFrame, vocabulary: DataFrame, cmap: DataFrame, gmap: DataFrame | None = None) -> DataFrame:
    """R4, R5. parts(id, block, components) -> (id, region), '' if unknown.

    First the last component in the vocabulary; else the last with an entry in either map (cmap before
    gmap at one place); else the last two tokens, then the last one, of a longer last component, looked up
    in vocabulary, cmap, gmap in this order.
    """
    at_end = F.try_element_at("components", F.lit(-1))
    toks = F.filter(F.split(at_end, " "), lambda t: t != "")
    whole = parts.select("id", "block", F.posexplode("components").alias("at", "component")).withColumn("stage", F.lit(0))
    tails = [parts.where(F.size("components") > 0).where(F.size(toks) > n).select("id", "block", F.lit(-n).alias("at"), F.array_join(F.slice(toks, -n, n), " ").alias("component"), F.lit(1).alias("stage")) for n in (1, 2)]
    keys = whole
    for t in tails:
        keys = keys.unionByName(t)
    entries = vocabulary.select("block", "component", F.col("component").alias("region"), F.lit(0).alias("source"))
    entries = entries.unionByName(cmap.select("block", "component", "region", F.lit(1).alias("source")))
    if gmap is not None:
        entries = entries.unionByName(gmap.select("block", "component", "region", F.lit(2).alias("source")))
    hits = keys.join(entries.where("region != ''"), ["block", "component"])
    # Order of the rules: whole components in the vocabulary, whole ones in a map, then tails, two tokens first.
    rule = F.when(F.col("stage") == 1, 2).when(F.col("source") == 0, 0).otherwise(1)
    place = F.when(F.col("stage") == 1, F.col("at")).otherwise(-F.col("at"))
    best = hits.groupBy("id").agg(F.min_by("region", F.struct(rule.alias("rule"), place.alias("place"), F.col("source"))).alias("region"))
    return parts.select("id").join(best, "id", "left").select("id", F.coalesce("region", F.lit("")).alias("region"))


def region_audit(regions: DataFrame, edges: DataFrame, pool_regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """R6. For labelled pairs, by block: whether both sides have a region and whether they agree."""
    r = edges.join(regions.select(F.col("id").alias("s1_id"), F.col("region").alias("a")), "s1_id").join(pool_regions.select(F.col("id").alias("cand_id"), F.col("region").alias("b")), "cand_id").join(blocks, "s1_id")
    known = (F.col("a") != "") & (F.col("b") != "")
    return r.groupBy("block", known.alias("covered"), (known & (F.col("a") == F.col("b"))).alias("same")).agg(F.count("*").alias("n"))
