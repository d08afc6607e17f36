"""Gradient-boosted matchers with out-of-fold scores (MLlib), and the interface to outside scorers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from .sampling import folds as fold_table


def _prepared(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles, with a flag beside each for a missing value."""
    cols = {f"f_{c}": F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    return df.withColumns(cols).withColumns({f"m_{c}": F.col(f"f_{c}").isNull().cast("double") for c in features})


def fit(train: DataFrame, features: list[str], *, rounds: int = 40, depth: int = 5, valid: str | None = None, seed: int = 7) -> PipelineModel:
    """M5, M8. Boosted trees on features; rows whose column `valid` is true decide when to stop."""
    raw = [f"f_{c}" for c in features]
    gbt = GBTClassifier(labelCol="label", featuresCol="__v", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    if valid:
        gbt = gbt.setValidationIndicatorCol(valid)
    stages = [Imputer(inputCols=raw, outputCols=[f"i_{c}" for c in features], strategy="median"), VectorAssembler(inputCols=[f"i_{c}" for c in features] + [f"m_{c}" for c in features], outputCol="__v"), gbt]
    data = _prepared(train.withColumn("label", F.col("label").cast("double")), features)
    # A column without any value has no median.
    return Pipeline(stages=stages).fit(data.fillna(0.0, [c for c in raw if data.where(F.col(c).isNotNull()).isEmpty()]))


def predict(model: PipelineModel, df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    out = model.transform(_prepared(df, features).fillna(0.0, []))
    return out.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def predict_mean(models: list[PipelineModel], df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    """M9. Mean of the models' probabilities."""
    out = df
    for i, m in enumerate(models):
        out = predict(m, out, features, f"__p{i}")
    return out.withColumn(name, sum((F.col(f"__p{i}") for i in range(len(models))), F.lit(0.0)) / len(models)).drop(*[f"__p{i}" for i in range(len(models))])


def out_of_fold(df: DataFrame, features: list[str], n_folds: int = 4, seed: int = 42, name: str = "p", **options) -> tuple[DataFrame, list[PipelineModel]]:
    """M5, M8. df(s1_id, cand_id, features, label) with each row scored by the model that has not seen its s1 record."""
    d = df.join(fold_table(df, "s1_id", n_folds, seed), "s1_id")
    models, parts = [], []
    for k in range(n_folds):
        m = fit(d.withColumn("__valid", F.col("fold") == k), features, valid="__valid", **options)
        models.append(m)
        parts.append(predict(m, d.where(F.col("fold") == k), features, name).drop("fold"))
    return reduce(DataFrame.unionByName, parts), models


def importances(model: PipelineModel, features: list[str], top: int = 20) -> list[tuple[str, float]]:
    """M10."""
    w = model.stages[-1].featureImportances.toArray()
    return sorted(((c, float(w[i])) for i, c in enumerate(features)), key=lambda x: -x[1])[:top]


def save(model: PipelineModel, path: str) -> None:
    """K6."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def band(pairs: DataFrame, low: float, high: float, p: str = "pre_p") -> DataFrame:
    """G8. The pairs that are worth an expensive score: filter before the scorer runs."""
    return pairs.where(F.col(p).between(low, high))


def pair_texts(pairs: DataFrame, s1: DataFrame, pool: DataFrame, limit: int = 300) -> DataFrame:
    """S9, K8, D15. text_a and text_b of pairs: name, ' ; ', address, cut at `limit` characters."""
    text = lambda df, key, name: df.select(key, F.substring(F.concat_ws(" ; ", F.coalesce("name", F.lit("")), F.coalesce("address", F.lit(""))), 1, limit).alias(name))
    return pairs.join(text(s1, "s1_id", "text_a"), "s1_id").join(text(pool, "cand_id", "text_b"), "cand_id")


def score_texts(pairs: DataFrame, scorer: Callable, batch: int = 256) -> DataFrame:
    """G2, G7, W6. (s1_id, cand_id, ce_p) by any scorer(list of text_a, list of text_b) -> probabilities.

    Rows go to it by length within a partition, so that a batch holds texts of about one length.
    """
    import pandas as pd

    def run(frames):
        for f in frames:
            for i in range(0, len(f), batch):
                g = f.iloc[i : i + batch]
                yield pd.DataFrame({"s1_id": g["s1_id"], "cand_id": g["cand_id"], "ce_p": scorer(g["text_a"].tolist(), g["text_b"].tolist())})

    ids = pairs.select("s1_id", "cand_id").schema
    by_length = pairs.select("s1_id", "cand_id", "text_a", "text_b").sortWithinPartitions(F.length("text_a") + F.length("text_b"))
    return by_length.mapInPandas(run, StructType([*ids.fields, StructField("ce_p", DoubleType())]))


def embed(texts: DataFrame, encoder: Callable, column: str = "text", batch: int = 256) -> DataFrame:
    """G6. texts with `vec`, an array of floats, by any encoder(list of texts) -> vectors."""
    import pandas as pd

    def run(frames):
        for f in frames:
            yield f.assign(vec=[list(map(float, v)) for i in range(0, len(f), batch) for v in encoder(f[column].iloc[i : i + batch].tolist())])

    return texts.mapInPandas(run, StructType([*texts.schema.fields, StructField("vec", ArrayType(FloatType()))]))


def pseudo_label(labelled: DataFrame, scored: DataFrame, low: float, high: float, p: str = "p") -> DataFrame:
    """M21. Labelled rows and unlabelled ones whose score is sure, with `pseudo` telling them apart."""
    sure = scored.where((F.col(p) <= low) | (F.col(p) >= high)).withColumn("label", (F.col(p) >= high).cast("int"))
    cols = [c for c in labelled.columns if c in sure.columns]
    return labelled.select(*cols, F.lit(False).alias("pseudo")).unionByName(sure.select(*cols, F.lit(True).alias("pseudo")))


def rank_gap(df: DataFrame, p: str) -> DataFrame:
    by = Window.partitionBy("s1_id")
    return df.withColumn("gap", F.max(p).over(by) - F.col(p))
