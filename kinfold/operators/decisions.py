"""Decisions on scored pairs, their metric, and the analysis of their errors.

Ties in p always go to the smaller candidate id, then the smaller s1 id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Grids of ranks, probabilities, losses and thresholds.
TOP_N = (3, 4, 5, 6, 8, 10, 12, 15, 20, 30)
MIN_P = (0.0, 0.0005, 0.001, 0.003, 0.01, 0.02, 0.05)
BUDGETS = (0.0005, 0.001, 0.002, 0.005, 0.01)
T1 = tuple(round(0.02 * i, 2) for i in range(1, 48))
T2 = tuple(round(0.1 + 0.02 * i, 2) for i in range(45))


def assign_and_rank(pairs: DataFrame, exclusive: bool = True) -> DataFrame:
    """M11. Each candidate goes to the s1 record that scores it highest; then ranks within s1 records.

    The best pair of a candidate is a map-side combined aggregate, so popular candidates do not pile up.
    """
    rows = pairs
    if exclusive:
        best = pairs.groupBy("cand_id").agg(F.min_by("s1_id", F.struct(-F.col("p"), "s1_id")).alias("s1_id"))
        rows = pairs.join(best, ["s1_id", "cand_id"], "left_semi")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("p"), "cand_id")))


def accepted(rank: Column, p: Column, t1, t2) -> Column:
    """M12. The first needs t1, later ones t2."""
    return F.when(rank == 1, p >= t1).otherwise(p >= t2)


def decide(pairs: DataFrame, t1: float, t2: float, exclusive: bool = True) -> DataFrame:
    """(s1_id, matches): accepted candidates in order of rank."""
    d = assign_and_rank(pairs, exclusive).where(accepted(F.col("rank"), F.col("p"), t1, t2))
    return d.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))).alias("m")).select("s1_id", F.col("m.cand_id").alias("matches"))


def decide_by_block(pairs: DataFrame, thresholds: DataFrame, block: str, exclusive: bool = True) -> DataFrame:
    """M18. Thresholds (block, t1, t2) of each block; pairs carry the block."""
    d = assign_and_rank(pairs, exclusive).join(F.broadcast(thresholds), block)
    d = d.where(accepted(F.col("rank"), F.col("p"), F.col("t1"), F.col("t2")))
    return d.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))).alias("m")).select("s1_id", F.col("m.cand_id").alias("matches"))


def f_half(tp: Column, pred: Column, true: Column) -> Column:
    """M14. F0.5 from counts: without truth 1 if nothing is predicted, else 0; without a hit 0."""
    return F.when(true == 0, (pred == 0).cast("double")).when(tp == 0, 0.0).otherwise(1.25 * tp / (1.25 * tp + 0.25 * (true - tp) + (pred - tp)))


def entity_counts(predicted: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1_id, tp, pred, true) for every entity; both pair tables are (s1_id, cand_id), repeats count once."""
    both = predicted.select("s1_id", "cand_id", F.lit(1).alias("pred"), F.lit(0).alias("true")).unionByName(truth.select("s1_id", "cand_id", F.lit(0).alias("pred"), F.lit(1).alias("true")))
    pair = both.groupBy("s1_id", "cand_id").agg(F.max("pred").alias("pred"), F.max("true").alias("true"))
    n = pair.groupBy("s1_id").agg(F.sum(F.col("pred") * F.col("true")).alias("tp"), F.sum("pred").alias("pred"), F.sum("true").alias("true"))
    return entities.select("s1_id").distinct().join(n, "s1_id", "left").fillna(0, ["tp", "pred", "true"])


def macro_f(predicted: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """M15. Mean F0.5 over all entities (null without any)."""
    return entity_counts(predicted, truth, entities).agg(F.round(F.avg(f_half(F.col("tp"), F.col("pred"), F.col("true"))), 6).alias("f05"))


def tune(pairs: DataFrame, truth: DataFrame, entities: DataFrame, grid1=T1, grid2=T2, exclusive: bool = True) -> DataFrame:
    """M13. (t1, t2, f05) of the best thresholds, t2 >= t1; the first in order of t1, t2 among equals.

    What a threshold changes is a step function of p, so an entity is first reduced to its counts per
    threshold: the grid multiplies entities, not pairs.
    """
    hits = truth.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1))
    d = assign_and_rank(pairs, exclusive).join(hits, ["s1_id", "cand_id"], "left").fillna(0, ["hit"])
    first = d.where("rank = 1").select("s1_id", F.col("p").alias("p1"), F.col("hit").alias("h1"))
    level = sum(((F.col("p") >= t).cast("int") for t in grid2), F.lit(0))  # how many of the ascending grid2 it reaches
    later = d.where("rank > 1").groupBy("s1_id", level.alias("level")).agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    # Per entity and t2: candidates and hits that reach it.
    steps = F.explode(F.sequence(F.lit(1), F.col("level"))).alias("i")
    reach = later.where("level > 0").select("s1_id", "n", "h", steps).groupBy("s1_id", "i").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    spark = pairs.sparkSession
    g2 = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid2)], "i int, t2 double")
    g1 = spark.createDataFrame([(float(t),) for t in grid1], "t1 double")
    base = entities.select("s1_id").distinct().join(truth.select("s1_id", "cand_id").distinct().groupBy("s1_id").agg(F.count("*").alias("true")), "s1_id", "left").join(first, "s1_id", "left").fillna(0, ["true", "h1"])
    # Entities that look alike are counted once.
    per = base.crossJoin(F.broadcast(g2)).join(reach, ["s1_id", "i"], "left").fillna(0, ["n", "h"]).groupBy("t2", "true", "p1", "h1", "n", "h").agg(F.count("*").alias("entities"))
    r = per.crossJoin(F.broadcast(g1)).where("t2 >= t1")
    one = F.coalesce(F.col("p1") >= F.col("t1"), F.lit(False)).cast("int")
    f = f_half(one * F.col("h1") + F.col("h"), one + F.col("n"), F.col("true"))
    score = r.groupBy("t1", "t2").agg(F.round(F.sum(f * F.col("entities")) / F.sum("entities"), 9).alias("f05"))
    return score.orderBy(F.desc("f05"), "t1", "t2").limit(1).select("t1", "t2", F.round("f05", 6).alias("f05"))


def rule_grid(pairs: DataFrame, n_entities: int, top_n=TOP_N, min_p=MIN_P) -> DataFrame:
    """(top_n, min_p, recall_loss, per_entity) for pairs(pre_p, pre_rank, label), in one pass over them."""
    cells = [(n, t) for n in top_n for t in min_p]
    keep = [(F.col("pre_rank") <= n) & (F.col("pre_p") >= t) for n, t in cells]
    row = pairs.agg(F.sum("label").alias("true"), *[F.count_if(k).alias(f"k{i}") for i, k in enumerate(keep)], *[F.count_if(k & (F.col("label") == 1)).alias(f"h{i}") for i, k in enumerate(keep)])
    return row.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("top_n"), F.lit(float(t)).alias("min_p"), F.col(f"k{i}").alias("k"), F.col(f"h{i}").alias("h")) for i, (n, t) in enumerate(cells)])).alias("c")).select("c.top_n", "c.min_p", (1 - F.col("c.h") / F.greatest("true", F.lit(1))).alias("recall_loss"), (F.col("c.k") / F.lit(n_entities)).alias("per_entity"))


def choose_rule(grid: DataFrame, budgets=(0.002,)) -> DataFrame:
    """M6. For each budget of recall, the rule with the fewest candidates per entity within it; else the most."""
    b = F.explode(F.array(*[F.lit(float(x)) for x in budgets])).alias("budget")
    r = grid.select("*", b).withColumn("ok", F.col("recall_loss") <= F.col("budget"))
    order = F.struct((~F.col("ok")).alias("bad"), F.when(F.col("ok"), F.col("per_entity")).otherwise(-F.col("per_entity")).alias("k"), "top_n", "min_p")
    best = r.groupBy("budget").agg(F.min_by(F.struct("top_n", "min_p", "recall_loss", "per_entity"), order).alias("c"))
    return best.select("budget", "c.top_n", "c.min_p", F.round("c.recall_loss", 6).alias("recall_loss"), F.round("c.per_entity", 6).alias("per_entity"))


def apply_rule(pairs: DataFrame, top_n: int, min_p: float) -> DataFrame:
    """M7."""
    return pairs.where((F.col("pre_rank") <= top_n) & (F.col("pre_p") >= min_p))


def pre_rank(pairs: DataFrame, p: str = "pre_p") -> DataFrame:
    """W2."""
    return pairs.withColumn("pre_rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc(p), "cand_id")))


def report(predicted: DataFrame, candidates: DataFrame, truth: DataFrame, entities: DataFrame, block: str) -> DataFrame:
    """M16. By block: F0.5, the F0.5 of a perfect choice among the candidates, pair recall, candidates per entity."""
    hits = candidates.join(truth.select("s1_id", "cand_id").distinct(), ["s1_id", "cand_id"], "left_semi")
    own = entities.select("s1_id", block).distinct()
    f = lambda pairs, name: entity_counts(pairs, truth, entities).select("s1_id", f_half(F.col("tp"), F.col("pred"), F.col("true")).alias(name), F.col("tp").alias(f"{name}_tp"), F.col("true").alias(f"{name}_true"))
    n = candidates.groupBy("s1_id").agg(F.count("*").alias("n"))
    r = own.join(f(predicted, "f"), "s1_id").join(f(hits, "o"), "s1_id").join(n, "s1_id", "left").fillna(0, ["n"])
    return r.groupBy(block).agg(F.round(F.avg("f"), 6).alias("f05"), F.round(F.avg("o"), 6).alias("oracle_f05"), F.round(F.sum("o_tp") / F.sum("o_true"), 6).alias("pair_recall"), F.round(F.avg("n"), 6).alias("candidates"))


def error_budget(predicted: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """M19. Mean F0.5 as it is, if every false positive were gone, and if every miss were found."""
    c = entity_counts(predicted, truth, entities)
    tp, pred, true = F.col("tp"), F.col("pred"), F.col("true")
    avg = lambda f, name: F.round(F.avg(f), 6).alias(name)
    return c.agg(avg(f_half(tp, pred, true), "f05"), avg(f_half(tp, tp, true), "without_fp"), avg(f_half(true, pred - tp + true, true), "without_fn"))


def misses(truth: DataFrame, retrieved: DataFrame, pruned: DataFrame) -> DataFrame:
    """M20. True pairs by where they were lost: at retrieval, at pruning, or not."""
    t = truth.select("s1_id", "cand_id").distinct()
    flag = lambda d, name: d.select("s1_id", "cand_id").distinct().withColumn(name, F.lit(True))
    r = t.join(flag(retrieved, "r"), ["s1_id", "cand_id"], "left").join(flag(pruned, "k"), ["s1_id", "cand_id"], "left")
    where = F.when(F.col("k"), "kept").when(F.col("r"), "pruned").otherwise("not_retrieved")
    return r.groupBy(where.alias("fate")).agg(F.count("*").alias("n"))


def naive(pairs: DataFrame, truth: DataFrame, entities: DataFrame, weights: tuple[float, ...], cuts: tuple[float, ...]) -> DataFrame:
    """M22. Best (w, t) of predicting the pairs whose w cos_name + (1 - w) cos_addr reaches t."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(float(w), float(t)) for w in weights for t in cuts], "w double, t double")
    hit = truth.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1))
    p = pairs.join(hit, ["s1_id", "cand_id"], "left").fillna(0, ["hit"])
    c = p.crossJoin(F.broadcast(grid)).where(F.round(F.col("w") * F.col("cos_name") + (1 - F.col("w")) * F.col("cos_addr"), 6) >= F.col("t"))
    c = c.groupBy("w", "t", "s1_id").agg(F.count("*").alias("pred"), F.sum("hit").alias("tp"))
    true = entities.select("s1_id").distinct().join(truth.select("s1_id", "cand_id").distinct().groupBy("s1_id").agg(F.count("*").alias("true")), "s1_id", "left").fillna(0, ["true"])
    r = true.crossJoin(F.broadcast(grid)).join(c, ["w", "t", "s1_id"], "left").fillna(0, ["pred", "tp"])
    s = r.groupBy("w", "t").agg(F.round(F.avg(f_half(F.col("tp"), F.col("pred"), F.col("true"))), 9).alias("f05"))
    return s.orderBy(F.desc("f05"), "w", "t").limit(1).select("w", "t", F.round("f05", 6).alias("f05"))
