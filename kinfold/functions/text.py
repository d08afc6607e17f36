"""Normalisation of names and addresses as column expressions.

Only latin_fold needs Python, as Spark has no Unicode normaliser; it is handed non-ASCII values alone.
Null texts count as empty throughout, and no function returns null for them.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import vocabulary as V


def _some(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _set(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(V.TOKEN), F.lit(0))


def words(c: Column) -> Column:
    """Parts between spaces, empty ones left out."""
    return F.filter(F.split(c, " +"), lambda t: t != "")


@functools.cache
def _accents() -> re.Pattern:
    marks = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c))
    return re.compile(f"(?<=[\x00-ɏ])[{re.escape(marks)}]+")


def fold(text: str) -> str:
    """Lower case in NFKC, accents taken off Latin letters; marks of other scripts are vowels and stay."""
    taken_apart = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).lower())
    return unicodedata.normalize("NFC", _accents().sub("", taken_apart))


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _fold_each(s: pd.Series) -> pd.Series:
    return s.map(lambda parts: [fold(p) for p in parts], na_action="ignore")


_ASCII = r"^[\x00-\x7F]*$"


def latin_fold(c: Column) -> Column:
    """N1. ASCII stays in the JVM: only its case changes. Make it a column before a lambda refers to it."""
    t = _some(c)
    plain = t.rlike(_ASCII)
    return F.when(plain, F.lower(t)).otherwise(_fold(F.when(~plain, t)))


def collapse_acronyms(c: Column) -> Column:
    """Dots taken out of dotted acronyms: what lies between them is zipped with what they become."""
    found = F.regexp_extract_all(c, F.lit(V.DOTTED), F.lit(0))
    return F.array_join(F.transform(F.split(c, V.DOTTED, -1), lambda part, i: F.concat(part, F.coalesce(F.replace(F.get(found, i), F.lit("."), F.lit("")), F.lit("")))), "")


def _settled(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """df's columns `keep` and the new ones, as the one row of a generator. A filter on them stays above it;
    pushed below, it would write out every step as often as it is referred to, in one expression."""
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def with_views(df: DataFrame, name: str, address: str, country: str) -> DataFrame:
    """N2 and N3 together. Both texts are folded first: with a Python function above the steps of the names,
    Catalyst would put those steps into one expression, each as often as it is referred to."""
    d = df.select("*", latin_fold(F.col(name)).alias("__fn"), latin_fold(F.col(address)).alias("__fa"))
    return with_addr_views(with_name_views(d, name, country, "__fn"), address, country, "__fa").drop("__fn", "__fa")


def with_name_views(df: DataFrame, name: str, country: str, folded: str | None = None) -> DataFrame:
    """N2. df with name_core, name_nospace, name_acr, legal, name_native, name_handle, name_dba, name_ntok.

    Step by step in columns of their own, so that no step is computed twice. folded: the folded text, if
    df has it as a column.
    """
    c, keep = F.col, df.columns
    d = df.withColumn("__f", c(folded) if folded else latin_fold(c(name)))
    d = d.withColumn("__parts", F.split("__f", V.ALIAS, -1))
    d = d.withColumn("name_dba", (F.size("__parts") > 1) & F.element_at("__parts", -1).rlike(r"\S"))
    d = d.withColumn("__s", F.when(c("name_dba"), F.element_at("__parts", -1)).otherwise(c("__f")))
    t = F.regexp_replace(F.replace(c("__s"), F.lit("www."), F.lit(" ")), V.WEB_ENDING, " ")
    d = d.withColumn("__t", F.replace(t, F.lit("m/s"), F.lit(" ")))
    d = d.withColumn("__tk", tokens(F.regexp_replace(collapse_acronyms(c("__t")), "[&+]", " and ")))
    only = F.get("__tk", 0)
    d = d.withColumn("__glued", (F.size("__tk") == 1) & only.endswith("com") & (F.length(only) > 6))
    d = d.withColumn("__toks", F.when(c("__glued"), F.array(F.substring(only, F.lit(1), F.length(only) - 3))).otherwise(c("__tk")))
    out, own = _set([*V.LEGAL_FORMS, *V.HONORIFICS, *V.STOPWORDS, *V.COUNTRY_WORDS]), F.lower(_some(c(country)))
    telling = F.filter("__toks", lambda t: ~F.array_contains(out, t) & (t != own))
    less = F.filter("__toks", lambda t: ~F.array_contains(_set(V.HONORIFICS), t))
    d = d.withColumns({"__telling": telling, "__less": less})
    d = d.withColumn("__core", F.when(F.size("__telling") > 0, c("__telling")).when(F.size("__less") > 0, c("__less")).otherwise(c("__toks")))
    legal_map = _map(V.LEGAL_FORMS)
    legal = F.array_sort(F.array_distinct(F.filter(F.transform("__toks", lambda t: legal_map[t]), lambda t: t.isNotNull())))
    d = d.withColumn("__latin", F.filter("__core", lambda t: ~t.rlike(V.INDIC)))
    initials = F.filter(F.transform("__latin", lambda t: F.substring(t, 1, 1)), lambda x: x.rlike(r"\p{L}"))
    return _settled(
        d,
        keep,
        F.array_join("__core", " ").alias("name_core"),
        F.array_join("__latin", "").alias("name_nospace"),
        F.array_join(initials, "").alias("name_acr"),
        F.array_join(legal, " ").alias("legal"),
        c("__s").rlike(V.INDIC).alias("name_native"),
        (c("__s").rlike(V.HANDLE) | c("__glued")).alias("name_handle"),
        c("name_dba").alias("name_dba"),
        F.size("__core").alias("name_ntok"),
    )


def _bare(number: Column) -> Column:
    return F.regexp_replace(number, "^0+(?=.)", "")


def with_addr_views(df: DataFrame, addr: str, country: str, folded: str | None = None) -> DataFrame:
    """N3. df with addr_core, addr_nums, addr_primary, addr_empty, addr_ntok."""
    c, keep = F.col, df.columns
    d = df.withColumn("__f", c(folded) if folded else latin_fold(c(addr)))
    s = F.regexp_replace(F.regexp_replace("__f", V.POST_BOX, " "), V.NOT_APPLICABLE, " ")
    d = d.withColumn("__toks", F.filter(tokens(s), lambda t: ~F.array_contains(_set(V.ADDRESS_NULLS), t)))
    ordinal_words, street, french = _map(V.ORDINAL_WORDS), _map(V.STREET_WORDS), _map(V.FRENCH_WORDS)
    in_france = F.coalesce(c(country) == "France", F.lit(False))

    def read(t: Column) -> Column:
        """What a token adds to the text and, if it holds a number, to the numbers."""
        digits = F.translate(t, V.INDIC_DIGITS, V.ASCII_DIGITS)
        number = _bare(F.regexp_extract(digits, "^([0-9]+)", 1))
        suffix = F.regexp_extract(t, V.NUMBER_SUFFIX, 2)
        pair = lambda out, num: F.struct(out.alias("out"), num.alias("num"))
        word = F.when(in_france & french[t].isNotNull(), french[t]).otherwise(F.coalesce(street[t], t))
        return (
            F.when(digits.rlike("^[0-9]+$"), pair(F.array(number), F.array(number)))
            .when(t.rlike(V.ORDINAL), pair(F.array(number), F.array(number)))
            .when(t.rlike(V.NUMBER_SUFFIX), pair(F.array(number, suffix), F.array(number)))
            .when(ordinal_words[t].isNotNull(), pair(F.array(ordinal_words[t]), F.array(ordinal_words[t])))
            .otherwise(pair(F.array(word), F.array().cast("array<string>")))
        )

    d = d.withColumn("__read", F.transform("__toks", read))
    d = d.withColumns({"__out": F.flatten(F.transform("__read", lambda p: p["out"])), "__nums": F.array_distinct(F.flatten(F.transform("__read", lambda p: p["num"])))})
    return _settled(
        d,
        keep,
        F.array_join("__out", " ").alias("addr_core"),
        F.array_join("__nums", " ").alias("addr_nums"),
        F.coalesce(F.get("__nums", 0), F.lit("")).alias("addr_primary"),
        (F.size("__out") == 0).alias("addr_empty"),
        F.size("__out").alias("addr_ntok"),
    )


def clean_name(core: Column) -> Column:
    """N8, for retrieval only: record tags out, look-alike digits within words back to letters."""
    toks = words(F.regexp_replace(core, V.ID_TAG, " "))
    return F.array_join(F.transform(toks, lambda t: F.when(t.rlike(V.LOOKALIKE), F.translate(t, V.LOOKALIKE_FROM, V.LOOKALIKE_TO)).otherwise(t)), " ")


def retrieval_text(kind: str, core: Column, addr: Column) -> Column:
    """N9. The text a pass searches: name, addr, or combo (name tokens marked, then the address)."""
    if kind == "name":
        return clean_name(core)
    if kind == "addr":
        return addr
    if kind == "combo":
        return F.concat(F.array_join(F.transform(words(clean_name(core)), lambda t: F.concat(F.lit("n:"), t)), " "), F.lit(" "), addr)
    raise ValueError(kind)


def dedup_tokens(c: Column) -> Column:
    """N10. Runs of one token made one."""
    w = words(c)
    return F.array_join(F.filter(w, lambda t, i: (i == 0) | (t != F.get(w, i - 1))), " ")


def with_components(df: DataFrame, addr: str, out: str = "components") -> DataFrame:
    """N11. Parts between commas and semicolons: folded, cleaned, empty ones out. Transliterate first."""
    keep, plain = df.columns, F.col("__a").rlike(_ASCII)
    d = df.withColumn("__a", _some(F.col(addr))).withColumn("__parts", F.split("__a", "[,;]", -1))
    d = d.withColumn("__folded", F.when(plain, F.transform("__parts", F.lower)).otherwise(_fold_each(F.when(~plain, F.col("__parts")))))
    # What is neither a letter, a digit nor of an Indic script separates words.
    clean = F.filter(F.transform("__folded", lambda p: F.trim(F.regexp_replace(p, r"[^a-z0-9ऀ-෿]+", " "))), lambda p: p != "")
    return _settled(d, keep, clean.alias(out))
