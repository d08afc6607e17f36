"""Language identification: TF-IDF character n-grams, FTRL multinomial regression, temperature.

N-grams of 1 to 3 characters of the lowered text (words padded by one space, digits and other
non-letters skipped) are hashed to BUCKETS columns. Document frequencies come from every training
document; the classifier is fitted on about PER_LANG documents of each language at most, picked by a
hash of id and text, repeated rows once; a fifth of those is kept apart for the temperature.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import batches, id_fraction, map_texts

BUCKETS = 1 << 15
#: Labelled documents a language the classifier is fitted on (and all languages, by the memory of a driver); languages
#: a model holds, by the same.
PER_LANG, IN_ALL, MOST_LANGS = 1000, 100_000, 1000
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}")
_GAPS = regex.compile(r"[^\p{L}\p{M}]+")
#: Characters hashed at once.
CHUNK = 1 << 18


def _text(text: str | None) -> str:
    """Letters and marks in NFC lower case, other runs as one space, padded; empty without letters."""
    if not text or not _LETTERS.search(text):
        return ""
    return " " + _GAPS.sub(" ", unicodedata.normalize("NFC", text).lower()).strip() + " "


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram columns in order, and how often each occurs. None without letters."""
    t = _text(text)
    total = np.zeros(BUCKETS, np.int64)
    mask = np.uint32(BUCKETS - 1)
    for i in range(0, len(t), CHUNK):
        c = np.frombuffer(t[i : i + CHUNK + 2].encode("utf-32-le"), np.uint32)
        for n in (1, 2, 3):
            m = min(CHUNK, len(t) - i, len(c) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ c[k : k + m]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            total += np.bincount((h * np.uint32(0xC2B2AE35) >> np.uint32(12)) & mask, minlength=BUCKETS)
    cols = np.flatnonzero(total)
    return cols, total[cols]


def weigh(cols: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + ln tf) idf, in unit length."""
    v = (1 + np.log(counts)) * idf[cols]
    return v / max(1e-12, np.sqrt(v @ v)) if len(v) else v


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows of texts(text): in how many documents each column occurs, and how many there are."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for f in frames:
            for t in f["text"]:
                df[grams(t)[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"col": np.append(at, -1), "n": np.append(df[at], n)})

    rows = texts.mapInPandas(count, "col long, n long").groupBy("col").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS)
    at = rows["col"] >= 0
    df[rows["col"][at]] = rows["n"][at]
    return df, int(rows["n"][~at].sum())


def train(docs: DataFrame, per_lang: int = PER_LANG, seed: str = "langid") -> dict:
    """docs(doc_id, text, lang), lang not null -> model: langs, idf, weights, bias, temperature.

    Document frequencies are those of all rows. Rows without letters (null and empty texts too) fit nothing, rows
    that repeat id, text and lang fit once; null ids are ids like any other. Without rows the model has no language.
    Over MOST_LANGS languages raise ValueError.
    """
    batches(docs.sparkSession)
    n_of = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS + 1).collect()}
    if len(n_of) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages")
    langs = sorted(n_of)
    if not langs:
        return {"langs": []}
    df, n = document_frequencies(docs.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    most = min(per_lang, IN_ALL // len(langs))
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, most / n_of[lang])))])[F.col("lang")]
    mixed = F.struct(F.col("doc_id"), F.col("text"))
    picked = docs.where(id_fraction(mixed, seed) < share).select("doc_id", "text", "lang")

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            g = [grams(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "lang": f["lang"], "cols": [c.astype(np.uint16).tobytes() for c, _ in g], "n": [k.astype(np.uint32).tobytes() for _, k in g]})

    # Rows of the same hash are the same row; the limit holds whatever the hashes do.
    order = F.xxhash64(F.lit(seed), "doc_id", "cols", "n")
    found = picked.mapInPandas(features, "doc_id long, lang string, cols binary, n binary").dropDuplicates()
    rows = found.orderBy(order, "lang", "doc_id").limit(2 * most * len(langs)).toPandas()
    parts = []
    for c, k in zip(rows["cols"], rows["n"]):
        cols = np.frombuffer(c, np.uint16).astype(np.int64)
        parts.append((cols, weigh(cols, np.frombuffer(k, np.uint32).astype(np.float64), idf)))
    some = np.array([len(c) > 0 for c, _ in parts], bool)
    x, y = linear.rows_of([p for p, s in zip(parts, some) if s]), rows["lang"][some].map({v: i for i, v in enumerate(langs)}).to_numpy(np.int64)
    held = np.arange(len(x)) % 5 == 4
    w, b = linear.train(x.take(np.flatnonzero(~held)), y[~held], BUCKETS, len(langs), l1=2e-5, l2=1e-6)
    t = linear.temperature(linear.logits(w, b, x.take(np.flatnonzero(held))), y[held])
    return {"langs": langs, "idf": idf, "weights": w.astype(np.float32), "bias": b, "temperature": t}


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with text -> the columns `keep`, lang_pred, score. A text that is null or has no letter, and any
    text under a model without languages, gives `und` with score 0."""
    got = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> dict:
        m, names, scores = got.value, [], []
        for t in texts:
            cols, n = grams(t) if m["langs"] else ((), ())
            if not len(cols):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            s = weigh(cols, n, m["idf"]) @ m["weights"][cols] + m["bias"]
            p = linear.softmax(s[None] / m["temperature"])[0]
            names.append(m["langs"][int(p.argmax())])
            scores.append(min(1.0, float(p.max())))
        return {"lang_pred": names, "score": np.array(scores, np.float64)}

    return map_texts(docs, list(keep), "text", run, "lang_pred string, score double")
