"""Toxicity by a classifier chain over hashed words.

The categories of a document are predicted one after the other, each by a sparse logistic regression
on the words of the text and the probabilities of the categories before it. A later model is trained
on out-of-fold probabilities of the earlier ones, so that it meets in training what it meets in use.
The cut of each category is the out-of-fold threshold of the best F1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import batches, map_texts, words

BUCKETS = 1 << 18
#: Labelled documents the chain is fitted on at most; folds of the out-of-fold predictions.
SAMPLE, FOLDS = 8000, 4
#: Times that a fit goes through its rows.
EPOCHS = 12
_STRIP = bytes(b for b in range(128) if not chr(b).isalnum())
_EMPTY = (np.empty(0, np.int64), np.empty(0))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words without surrounding ASCII punctuation, weighed 1 + ln tf; not scaled by length,
    so that a few telling words weigh the same in a long text."""
    n = Counter(words(text))
    if not n:
        return _EMPTY
    h = np.fromiter((zlib.crc32(w.strip(_STRIP)) for w in n), np.int64, len(n)) & (BUCKETS - 1)
    cols, inv = np.unique(h, return_inverse=True)
    tf = np.bincount(inv, weights=np.fromiter(n.values(), np.float64, len(n)))
    return cols, 1 + np.log(tf)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold of the best F1; in the middle of the gap below the lowest accepted score."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    last = np.append(p[1:] != p[:-1], True)
    k = int(np.flatnonzero(last)[f1[last].argmax()])
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, folds: int = FOLDS) -> list[dict]:
    """docs(doc_id, text), labels(doc_id, <categories>) with 0/1 -> one model per category, in order.

    Labels with a null id or category are left out; of the rest, the `sample` smallest by a hash of the id
    are used, and of the rows of documents that bear them the `sample` smallest by a hash of id and features.
    Null and empty texts count as texts without words. Without both values among the rows a category is never
    predicted. Fits of the folds run as tasks, so that the driver holds features and weights only.
    """
    spark = docs.sparkSession
    batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), *[F.col(c).cast("int") for c in categories]).dropna()
    picked = known.orderBy(F.xxhash64(F.lit("toxicity"), "__id"), "__id", *categories).limit(sample)
    ids = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string")).join(F.broadcast(picked), "__id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            g = [features(t) for t in f["text"]]
            out = f[["__id", *categories]].copy()
            out["cols"] = [c.astype(np.int32).tobytes() for c, _ in g]
            out["vals"] = [v.astype(np.float32).tobytes() for _, v in g]
            yield out

    schema = "__id long, " + ", ".join(f"`{c}` int" for c in categories) + ", cols binary, vals binary"
    found = ids.select("__id", *categories, "text").mapInPandas(run, schema)
    rows = found.orderBy(F.xxhash64("__id", "cols", "vals"), "__id", *categories).limit(sample).toPandas().sort_values(["__id", *categories, "cols"], ignore_index=True)
    x = linear.rows_of([(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32)) for c, v in zip(rows["cols"], rows["vals"])])
    # Rows of one document share a fold.
    fold = rows["__id"].factorize()[0] % folds
    models, width = [], BUCKETS
    for c in categories:
        y = rows[c].to_numpy(np.int64)
        if len(np.unique(y)) < 2:
            models.append({"name": c, "never": True})
            x = x.with_column(width, np.zeros(len(x)))
            width += 1
            continue
        oof = np.full(len(y), y.mean())
        for k, (p, w, b) in _fits(spark, x, y, fold, folds, width).items():
            if k < folds:
                oof[fold == k] = p
            else:
                models.append({"name": c, "never": False, "w": w, "b": b})
        models[-1]["cut"] = _best_cut(oof, y)
        x = x.with_column(width, _logit(oof))
        width += 1
    return models


def fit(x: linear.Rows, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the log odds of y."""
    w, b = linear.train(x, y, width, 2, epochs=EPOCHS, batch=32, alpha=0.3, l1=1e-4, l2=1e-5)
    return (w[:, 1] - w[:, 0]).astype(np.float32), float(b[1] - b[0])


def probabilities(x: linear.Rows, w: np.ndarray, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(linear.logits(w[:, None].astype(np.float64), np.array([b]), x)[:, 0], -500, 500)))


def _fits(spark, x: linear.Rows, y: np.ndarray, fold: np.ndarray, folds: int, width: int) -> dict:
    """k -> (probabilities of fold k by a fit on the others, or their share of ones where that has one value only);
    folds -> (none, weights and bias of a fit on all rows). A task each."""
    got = spark.sparkContext.broadcast((x, y, fold))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, fold = got.value
        for f in frames:
            for k in f["id"].tolist():
                inside, outside = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
                if not len(inside) and k < folds or len(np.unique(y[outside])) < 2:
                    yield pd.DataFrame({"k": [k], "p": [np.full(len(inside), y.mean()).tobytes()], "cols": [b""], "w": [b""], "b": [0.0]})
                    continue
                w, b = fit(x.take(outside), y[outside], width)
                at = np.flatnonzero(w) if k == folds else np.empty(0, np.int64)
                yield pd.DataFrame({"k": [k], "p": [probabilities(x.take(inside), w, b).tobytes()], "cols": [at.tobytes()], "w": [w[at].tobytes()], "b": [b]})

    out = {}
    for r in spark.range(0, folds + 1, 1, folds + 1).mapInPandas(run, "k long, p binary, cols binary, w binary, b double").collect():
        w = np.zeros(width, np.float32)
        w[np.frombuffer(r["cols"], np.int64)] = np.frombuffer(r["w"], np.float32)
        out[r["k"]] = np.frombuffer(r["p"], np.float64), w, r["b"]
    return dict(sorted(out.items()))


def apply_chain(text: str | None, models: list[dict]) -> list[float]:
    cols, vals = features(text)
    earlier: list[float] = []
    for m in models:
        if m["never"]:
            earlier.append(0.0)
            continue
        s = m["b"] + float(m["w"][cols] @ vals) + sum(float(w) * float(_logit(np.array(p))) for w, p in zip(m["w"][BUCKETS:], earlier))
        earlier.append(float(1 / (1 + np.exp(-np.clip(s, -500, 500)))))
    return earlier


def score(docs: DataFrame, models: list[dict], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with text -> the columns `keep`, p_<category> double and is_<category> boolean for each category.

    Null and empty texts are scored as texts without words, and never accepted. One row per row.
    """
    got = docs.sparkSession.sparkContext.broadcast(models)

    def run(texts: list) -> dict:
        p = np.array([apply_chain(t, got.value) for t in texts]).reshape(len(texts), len(got.value))
        some = np.array([bool(t) and not t.isspace() for t in texts], bool)
        out = {}
        for i, m in enumerate(got.value):
            out |= {f"p_{m['name']}": p[:, i], f"is_{m['name']}": (p[:, i] >= m.get("cut", 2.0)) & some}
        return out

    return map_texts(docs, list(keep), "text", run, ", ".join(f"`p_{m['name']}` double, `is_{m['name']}` boolean" for m in models))
