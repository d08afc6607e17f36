"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A conversation that was logged again after each turn appears as many conversations, each a prefix of
the next. Every turn gets a 128-bit hash of its place, role and text; the running exclusive-or of
those is a rolling hash of the turns so far. A conversation whose whole hash is a proper prefix hash
of another is dropped by an anti-join; of equal conversations the one with the smallest conv_id
stays. What remains is rendered.

Only hashes are shuffled for the collapse; hashes of prefixes are made distinct before the join, so
a first turn that a third of all conversations share is one row of it. The running exclusive-or is a
streaming window over one conversation's hashes; texts meet only in the rendered row that is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Markup of a rendered turn, as in ChatML.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, n, h1, h2, more): the rolling hash after n turns, and whether more follow.

    Turns go by turn (nulls first), then role, then text; rows that agree in all of them stay repeated.
    Null roles and texts differ from empty ones.
    """
    content = [F.hex(F.encode(F.col(c).cast("string"), "UTF-8")) for c in ("role", "text")]
    key = F.concat_ws("|", *[F.coalesce(c, F.lit("~")) for c in content])
    m = F.md5(key.cast("binary"))
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), m.alias("m"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "m")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("n", F.row_number().over(order))
    for i, name in ((1, "h1"), (2, "h2")):
        t = t.withColumn(name, F.bit_xor(F.xxhash64(F.lit(i), "n", "m")).over(so_far))
    return t.select("conv_id", "n", "h1", "h2", F.lead(F.lit(True), 1, False).over(order).alias("more"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no longer one begins with; of equal ones, the smallest id.

    Rows without conv_id belong to no conversation and are left out. No rows give no rows.
    """
    p = materialize(prefix_hashes(turns.where("conv_id is not null")), "prefixes")
    whole = p.where(~F.col("more")).groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = p.where("more").select("n", "h1", "h2").distinct()
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """turns -> (conv_id, n_turns, text): the maximal conversations in chat markup, a row each.

    Null roles and texts are rendered as empty. A marker inside a text is taken apart by a zero-width
    space, so that it ends no turn.
    """
    kept = maximal(turns)
    plain = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<|\u200bim_"))
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).where("conv_id is not null")
    content = [F.coalesce(F.hex(F.encode(F.col(c), "UTF-8")), F.lit("~")) for c in ("role", "text")]
    t = t.withColumn("m", F.md5(F.concat_ws("|", *content).cast("binary")))
    t = t.withColumn("piece", F.concat(F.lit(START), plain("role"), F.lit(MIDDLE), plain("text"), F.lit(END)))
    # Joined and grouped by the same key: one shuffle of the texts, and only of what is kept.
    t = t.join(kept, "conv_id").groupBy("conv_id", "n_turns")
    whole = t.agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"), "m", "piece"))).alias("all"))
    return whole.select("conv_id", "n_turns", F.array_join("all.piece", "").alias("text"))
