"""What the operators share: scratch tables in the cluster's shared folder, words, and id hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..ship import ship

#: Rows and bytes of one Arrow batch; texts can be long, so rows alone do not bound a batch.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20

ROWS_A_FILE = 500_000

_own: dict[str, str] = {}

#: Codec of scratch tables that hold whole texts: several of them lie on the shared disk at one time.
TEXTS = "zstd"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder all executors share: spark.checkpoint.dir, or in local mode one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="kinfold-")
    return _own[sc.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under this application's own."""
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/kinfold/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete all that this application's operators left in the shared folder. Results are read from there, so
    a job calls this once it has written what it wants to keep."""
    delete(spark, _home(spark))


def materialize(df: DataFrame, name: str, rows: int | None = None, codec: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends at files that outlive executors.

    rows: about how many are written at most; they go to as few files as ROWS_A_FILE allows, dealt in turn,
    where there would be more otherwise. Many tiny files cost more than the small shuffle.
    codec: the session's, if None; TEXTS for tables that hold whole texts.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if rows is not None and (k := 1 + rows // ROWS_A_FILE) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(k)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what materialize() wrote for df."""
    delete(df.sparkSession, df._scratch)


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds on its way to Python, and see that Python has this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return what a worker has freed to the system. Workers are used again, and hold the peak of every task otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def words(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def id_fraction(col: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the value and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1 << 40)) / F.lit(float(1 << 40))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(df: DataFrame, keep: list[str], text: str, fn, new: str) -> DataFrame:
    """df's columns `keep`, passed through as they are (nulls and large integers too), and the columns
    `new` (DDL), which fn makes from the list of texts of a batch as {name: list or array}."""
    batches(df.sparkSession)
    added = StructType.fromDDL(new)
    schema = StructType(df.select(*keep).schema.fields + added.fields)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            out = fn(b.column(len(keep)).to_pylist())
            cols = [pa.array(out[f.name], to_arrow_type(f.dataType)) for f in added]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=schema.names)

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
