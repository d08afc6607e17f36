"""Scratch tables of the linkage queries in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

from ..shuffles import cleaned

_own: dict[str, str] = {}


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: what is used often is computed once, and plans stay short.

    The files lie where kinfold.llm.common.sweep() looks, as results are read from there.
    """
    spark = df.sparkSession
    sc, base = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = _own.setdefault(sc.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="kinfold-")
        _own[sc.applicationId] = base
    path = f"{base.rstrip('/')}/kinfold/{sc.applicationId}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*kept: DataFrame) -> None:
    """Delete what keep() wrote for these, once all that is made of them is written."""
    for df in kept:
        jvm, spark = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark.sessionState().newHadoopConf()).delete(path, True)
