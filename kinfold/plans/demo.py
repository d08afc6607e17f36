"""The linkage model laid over the driver's tables, as SQL that Spark and DuckDB read alike.

part: records with noise added by rule, source by p_partkey % 10, country by p_type.
lineitem: scored pairs, an order being the entity and a part the candidate; returns are the truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECORDS = """
SELECT CAST(p_partkey AS BIGINT) AS id,
  CAST(CASE WHEN p_partkey % 10 < 2 THEN 1 WHEN p_partkey % 10 < 6 THEN 2 ELSE 3 END AS INT) AS src, p_type AS country,
  CASE p_partkey % 8
    WHEN 0 THEN concat(p_name, ' L.L.C.')
    WHEN 1 THEN concat('acme trading as ', p_name)
    WHEN 2 THEN concat('The ', upper(p_name), ' Pvt. Ltd.')
    WHEN 3 THEN concat('www.', replace(p_name, ' ', ''), '.com')
    WHEN 4 THEN concat(p_name, ' & sons (ID: ', CAST(p_size AS VARCHAR(9)), ')')
    WHEN 5 THEN replace(p_name, 'e', '3')
    ELSE p_name END AS name,
  CASE p_partkey % 5
    WHEN 0 THEN concat('00', CAST(p_size AS VARCHAR(9)), ' ', p_type, ' STREET, PMB ', CAST(p_partkey AS VARCHAR(20)), ', ', p_brand)
    WHEN 1 THEN concat(CAST(p_size AS VARCHAR(9)), 'b Second Avenue, NULL, ', p_type)
    WHEN 2 THEN concat(CAST(p_size AS VARCHAR(9)), 'nd ', p_brand, ' road N/A, ', p_type)
    WHEN 3 THEN ''
    ELSE concat(CAST(p_size AS VARCHAR(9)), ' ', p_brand, ' rd, ', p_type) END AS address
FROM part
"""

PAIRS = "SELECT l_orderkey AS s1_id, l_partkey AS cand_id, max(l_discount * 10) AS p FROM lineitem GROUP BY l_orderkey, l_partkey"
TRUTH = "SELECT DISTINCT l_orderkey AS s1_id, l_partkey AS cand_id, CAST(CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 3 END AS INT) AS src FROM lineitem WHERE l_returnflag = 'R'"
ENTITIES = "SELECT o_orderkey AS s1_id, o_orderpriority AS block FROM orders"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "part")
    return spark.sql(RECORDS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    return spark.sql(PAIRS)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    return spark.sql(TRUTH)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "orders")
    return spark.sql(ENTITIES)
