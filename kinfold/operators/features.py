"""Features of candidate pairs as column expressions and windows; string similarities are UDFs.

Pairs carry the columns of the s1 side as a_<name> and of the pool side as b_<name>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import dedup_tokens, words


def _num(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def attach(pairs: DataFrame, s1: DataFrame, pool: DataFrame, columns: list[str]) -> DataFrame:
    """J15. Pairs first, strings last: attributes of both sides by equi-join."""
    a = s1.select("s1_id", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = pool.select("cand_id", *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(a, "s1_id").join(b, "cand_id")


def flags() -> dict[str, Column]:
    """F4, F5, F6."""
    c = F.col
    acronym = lambda x, y: (c(x) == c(y)) & F.length(y).between(2, 6)
    return {
        "n_acr_match": _num(acronym("a_name_acr", "b_name_nospace") | acronym("b_name_acr", "a_name_nospace")),
        "legal_equal": _num(c("a_legal") == c("b_legal")),
        "legal_one_missing": _num((c("a_legal") == "") != (c("b_legal") == "")),
        "p_native": _num(c("b_name_native")),
        "p_handle": _num(c("b_name_handle")),
        "p_dba": _num(c("b_name_dba")),
        "s1_ntok": c("a_name_ntok"),
        "p_ntok": c("b_name_ntok"),
        "p_addr_empty": _num(c("b_addr_empty")),
        "s1_ntok_addr": c("a_addr_ntok"),
        "p_ntok_addr": c("b_addr_ntok"),
    }


def numbers() -> dict[str, Column]:
    """House numbers and legal forms."""
    a, b = words(F.col("a_addr_nums")), words(F.col("b_addr_nums"))
    x, y = F.col("a_addr_primary"), F.col("b_addr_primary")
    both = (F.size(a) > 0) & (F.size(b) > 0)
    shared = F.size(F.array_intersect(a, b))
    known = (x != "") & (y != "")
    near = F.exists(F.slice(a, 1, 4), lambda p: F.exists(F.slice(b, 1, 4), lambda q: F.levenshtein(p, q) <= 1))
    la, lb = words(F.col("a_legal")), words(F.col("b_legal"))
    return {
        "num_jacc": F.when(both, F.round(shared / F.size(F.array_union(a, b)), 6)).otherwise(0.0),
        "num_any_overlap": _num(both & (shared > 0)),
        "num_conflict": _num(both & (shared == 0)),
        "num_both": _num(both),
        "num_primary_eq": _num(known & (x == y)),
        "num_primary_lev": F.when(known, F.levenshtein(x, y)).otherwise(-1),
        "x_legal_conflict": _num((F.size(la) > 0) & (F.size(lb) > 0) & ~F.arrays_overlap(la, lb)),
        "xnum_suffix": _num(known & (x != y) & (x.endswith(y) | y.endswith(x) | x.startswith(y) | y.startswith(x))),
        "xnum_subset": _num(both & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))),
        "xnum_lev1": _num(both & (shared == 0) & near),
    }


def similarities() -> dict[str, Column]:
    """F1, F2, F3, F7, F18."""
    n, s, d = ("a_name_core", "b_name_core"), ("a_name_nospace", "b_name_nospace"), ("a_addr_core", "b_addr_core")
    on = lambda f, p: f(F.col(p[0]), F.col(p[1]))
    x, y = dedup_tokens(F.col(n[0])), dedup_tokens(F.col(n[1]))
    return {
        "n_ratio": on(S.ratio_of, n), "n_tset": on(S.token_set_of, n), "n_tsort": on(S.token_sort_of, n), "n_partial": on(S.partial_of, n), "n_jw": on(S.jaro_winkler_of, n),
        "n_nospace_ratio": on(S.ratio_of, s), "n_nospace_partial": on(S.partial_of, s),
        "a_ratio": on(S.ratio_of, d), "a_tset": on(S.token_set_of, d), "a_tsort": on(S.token_sort_of, d), "a_partial": on(S.partial_of, d),
        "xn_dedup_ratio": S.ratio_of(x, y), "xn_dedup_tset": S.token_set_of(x, y), "xn_core_equal": _num(x == y),
    }


def context(pairs: DataFrame, part: list[str]) -> DataFrame:
    """F11, F12, F13. Ranks of the cosines of a pair within its s1 record: within `part` (country, source) and over all."""
    own, everywhere = Window.partitionBy("s1_id", *part), Window.partitionBy("s1_id")
    out = {
        "ctx_rank_combo_src": F.rank().over(own.orderBy(F.desc("cos_combo"))),
        "ctx_rank_name_all": F.rank().over(own.orderBy(F.desc("cos_name"))),
        "ctx_rank_addr_all": F.rank().over(own.orderBy(F.desc("cos_addr"))),
        "ctx_gap_combo": F.round(F.max("cos_combo").over(own) - F.col("cos_combo"), 6),
        "ctx_ncand": F.count("*").over(own),
        "ctx_rank_combo_all": F.rank().over(everywhere.orderBy(F.desc("cos_combo"))),
    }
    return pairs.withColumns(out)


def frequencies(records: DataFrame, column: str, part: list[str], name: str) -> DataFrame:
    """F14. records with how many of its part share its value: a combined count, joined back (a window would gather hot values)."""
    counts = records.groupBy(*part, column).agg(F.count("*").alias(name))
    return records.join(counts, [*part, column], "left")


def group(pairs: DataFrame, p: str = "pre_p") -> DataFrame:
    """F17. Statistics of the first scores of an s1 record, and its top candidate (ties: the smaller id)."""
    by = Window.partitionBy("s1_id")
    rows = pairs.withColumns({
        "g_pre_max": F.max(p).over(by),
        "g_n_pre50": F.count_if(F.col(p) >= 0.5).over(by),
        "g_n_pre10": F.count_if(F.col(p) >= 0.1).over(by),
        "g_pre_sum": F.round(F.sum(p).over(by), 6),
        "g_top": F.first("cand_id").over(by.orderBy(F.desc(p), "cand_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    return rows.withColumns({
        "g_pre_gap": F.round(F.col("g_pre_max") - F.col(p), 6),
        "g_pre_share": F.round(F.col(p) / F.greatest("g_pre_sum", F.lit(1e-6)), 6),
        "g_is_top": _num(F.col("cand_id") == F.col("g_top")),
    })


def against_top(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """F22. Token-set similarity of a candidate to the top candidate of its group."""
    top = pool.select(F.col("cand_id").alias("g_top"), F.col("name_core").alias("t_name"), F.col("addr_core").alias("t_addr"))
    own = lambda c: dedup_tokens(F.col(c))
    r = pairs.join(top, "g_top")
    return r.withColumns({"g_top_name_sim": S.token_set_of(own("b_name_core"), own("t_name")), "g_top_addr_sim": S.token_set_of(F.col("b_addr_core"), F.col("t_addr"))}).drop("t_name", "t_addr")


def scored(pairs: DataFrame, scores: DataFrame, prefix: str = "ce") -> DataFrame:
    """J14, F23. Scores joined on, null where there is none; rank, gap and count of the s1 record's scores."""
    p, by = f"{prefix}_p", Window.partitionBy("s1_id")
    r = pairs.join(scores.select("s1_id", "cand_id", F.col("ce_p").alias(p)), ["s1_id", "cand_id"], "left")
    return r.withColumns({
        f"{prefix}_rank": F.when(F.col(p).isNotNull(), F.rank().over(by.orderBy(F.desc_nulls_last(p)))),
        f"{prefix}_gap": F.round(F.max(p).over(by) - F.col(p), 6),
        f"{prefix}_n50": F.count_if(F.coalesce(F.col(p) >= 0.5, F.lit(False))).over(by),
    })


def optional(df: DataFrame, prefixes: tuple[str, ...] = ("ce_", "ce2_")) -> list[str]:
    """F24. Feature columns that only some tables have."""
    return [c for c in df.columns if c.startswith(prefixes)]
