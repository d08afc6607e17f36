"""Sinks: Parquet, id lists as TSV with integrity checks, JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, codec: str = "snappy") -> None:
    """K1, K7. Committed as a whole by Spark's committer; by: partition folders."""
    w = df.write.mode("overwrite").option("compression", codec)
    (w.partitionBy(*by) if by else w).parquet(path)


def id_lists(entities: DataFrame, lists: DataFrame, column: str) -> DataFrame:
    """K2. entities(s1_id, pos), lists(s1_id, ids) -> (source1_entity_id, <column>, pos): every entity once, ids joined
    by commas, first occurrences only, empty where there is none."""
    flat = lists.groupBy("s1_id").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    j = entities.join(flat, "s1_id", "left")
    return j.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias(column), "pos")


def write_id_lists(rows: DataFrame, path: str, column: str) -> None:
    """K2. One text file, LF line ends, header first, in the order of pos."""
    head = rows.sparkSession.createDataFrame([(f"source1_entity_id\t{column}", -1)], "line string, pos long")
    body = rows.select(F.concat_ws("\t", F.col("source1_entity_id").cast("string"), F.col(column)).alias("line"), F.col("pos").cast("long").alias("pos"))
    # One ordered file is what this format is; Spark merges sorted partitions into it.
    head.unionByName(body).orderBy("pos").coalesce(1).select("line").write.mode("overwrite").option("lineSep", "\n").text(path)


def read_id_lists(spark: SparkSession, path: str, column: str) -> DataFrame:
    """K3. (s1_id, ids) of a file that write_id_lists made; a carriage return or another header is an error."""
    lines = spark.read.option("lineSep", "\n").text(path)
    head = f"source1_entity_id\t{column}"
    if lines.where(F.col("value").contains("\r")).take(1) or lines.where(F.col("value") == head).count() != 1:
        raise ValueError(f"{path}: not an id list of {column}")
    cut = F.split("value", "\t", -1)
    rows = lines.where(F.col("value") != head)
    if rows.where(F.size(cut) != 2).take(1):
        raise ValueError(f"{path}: a line is not two fields")
    return rows.select(cut[0].alias("s1_id"), F.filter(F.split(cut[1], ","), lambda x: x != "").alias("ids"))


def check_lists(matches: DataFrame, candidates: DataFrame, entities: DataFrame, known: DataFrame, prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """K4. (problem, n) for both lists (s1_id, ids): repeated rows, repeated ids, wrong prefix, unknown ids, matches
    that are no candidates, missing and surplus rows. A clean pair of lists gives no rows."""
    found = []

    def add(df: DataFrame, problem: str):
        found.append(df.agg(F.count("*").alias("n")).select(F.lit(problem).alias("problem"), "n"))

    for name, lists in (("matches", matches), ("candidates", candidates)):
        add(lists.groupBy("s1_id").agg(F.count("*").alias("k")).where("k > 1"), f"{name}: repeated row")
        add(lists.where(F.size(F.array_distinct("ids")) < F.size("ids")), f"{name}: repeated id")
        each = lists.select("s1_id", F.explode("ids").alias("cand_id"))
        add(each.where(~F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("cand_id").cast("string"), p))), f"{name}: prefix")
        add(each.join(known.select("cand_id"), "cand_id", "left_anti"), f"{name}: unknown id")
        add(entities.select("s1_id").join(lists.select("s1_id"), "s1_id", "left_anti"), f"{name}: missing row")
        add(lists.select("s1_id").join(entities.select("s1_id"), "s1_id", "left_anti"), f"{name}: surplus row")
    pairs = [d.select("s1_id", F.explode("ids").alias("cand_id")) for d in (matches, candidates)]
    add(pairs[0].join(pairs[1], ["s1_id", "cand_id"], "left_anti"), "match is no candidate")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")


def list_stats(lists: DataFrame) -> DataFrame:
    """K4. Rows, empty ones and mean length."""
    return lists.agg(F.count("*").alias("rows"), F.count_if(F.size("ids") == 0).alias("empty"), F.round(F.avg(F.size("ids")), 6).alias("mean_len"))


def write_json(spark: SparkSession, value, path: str) -> None:
    """K5. A small value (a rule, a report) as JSON, through Spark so that any store will do."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=False).first()[0])
