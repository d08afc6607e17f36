"""Sources: typed TSV, record tables with assertions, truth, Parquet with pushdown, neighbour and file catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD = ("entity_id", "business_name", "business_address", "country")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, path: str) -> str:
    """S1. The path, or with .gz if only that exists; in any store Spark reads."""
    for p in (path, path + ".gz"):
        if _exists(spark, p):
            return p
    raise FileNotFoundError(path)


def read_tsv(spark: SparkSession, path: str, columns: list[str], header: list[str] | None = None) -> DataFrame:
    """S2. Tab-separated text with standard quotes; every value a string, NA and null kept, empty as ''.

    header: the file's columns in order, read from its first line if not given.
    """
    path = resolve(spark, path)
    if header is None:
        header = spark.read.text(path).first()[0].rstrip("\r").replace('"', "").split("\t")
    schema = StructType([StructField(c, StringType()) for c in header])
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=False, enforceSchema=True)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def violations(records: DataFrame, prefix: str, key: str = "entity_id") -> DataFrame:
    """S3. What breaks the rules of a record table: ids that occur more than once, ids without the prefix."""
    twice = records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).cast("string").alias("id"), F.lit("repeated").alias("problem"))
    wrong = records.where(~F.col(key).cast("string").startswith(prefix) | F.col(key).isNull()).select(F.col(key).cast("string").alias("id"), F.lit("prefix").alias("problem"))
    return twice.unionByName(wrong)


def read_source(spark: SparkSession, folder: str, split: str, src: int, check: bool = True) -> DataFrame:
    """S3. One source of a split, checked on request."""
    df = read_tsv(spark, f"{folder}/{split}/{split}_source{src}.tsv", list(RECORD))
    if check and (bad := violations(df, f"S{src}-").take(1)):
        raise ValueError(f"{split} source {src}: {bad[0]['id']} is {bad[0]['problem']}")
    return df


def truth_edges(truth: DataFrame) -> DataFrame:
    """S4, S6, D2. (s1_id, cand_id) of a truth table with comma lists; singletons have no edge."""
    ids = F.filter(F.transform(F.split("matched_entity_ids", ","), lambda x: F.trim(x)), lambda x: x != "")
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(ids).alias("cand_id"))


def read_truth(spark: SparkSession, folder: str) -> DataFrame:
    return read_tsv(spark, f"{folder}/train/train_ground_truth.tsv", ["source1_entity_id", "matched_entity_ids"])


def read_records(spark: SparkSession, path: str, split: str, src: int, country: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """S5, S7, S8. Normalised records, partitioned by split, src and country: the filters prune folders."""
    df = spark.read.parquet(path).where((F.col("split") == split) & (F.col("src") == src))
    df = df if country is None else df.where(F.col("country") == country)
    return df.select(*columns) if columns else df


def read_neighbours(spark: SparkSession, path: str, country: str, k: int) -> DataFrame:
    """S10. Dense neighbours of a country: its own file if there is one, else the whole table; ranks up to k."""
    own = f"{path}_{country}.parquet"
    df = spark.read.parquet(own if _exists(spark, own) else f"{path}.parquet")
    return df.where(F.col("dense_rank") <= k)


def find(spark: SparkSession, roots: list[str], name: str) -> str:
    """S11. First file of this name under the roots, in order, however deep."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for root in roots:
        p = jvm.org.apache.hadoop.fs.Path(root)
        store = p.getFileSystem(conf)
        if not store.exists(p):
            continue
        files, hits = store.listFiles(p, True), []
        while files.hasNext():
            f = files.next().getPath()
            if f.getName() == name:
                hits.append(f.toString())
        if hits:
            return min(hits)
    raise FileNotFoundError(name)
