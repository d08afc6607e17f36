"""Romanisation of Indic tokens (N12) and the application of a learned dictionary."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V


#: Marks between sounds: an inherent a, which gives way to a JOIN right after it.
INHERENT, JOIN = "\x01", "\x02"


def _spelling(ch: str) -> str:
    """What a character contributes, from its Unicode name: digits their value, nasal signs n, letters and vowel
    signs the sound they are called by, other signs nothing. Vowel signs and viramas start with a JOIN."""
    block, _, kind = unicodedata.name(ch, "").partition(" ")
    if "DIGIT" in kind:
        return str(unicodedata.digit(ch, 0))
    joins = JOIN * ("VIRAMA" in kind or "VOWEL SIGN" in kind)
    if "ANUSVARA" in kind or "CANDRABINDU" in kind:
        return joins + "n"
    called = re.search(r"(?:VOWEL SIGN|LETTER) (.*)", kind)
    sound = called[1].lower().replace("vocalic ", "") if called else ""
    sound = sound if joins else sound.replace(" ", "")
    return joins + re.sub(r"(?<=.)a$", INHERENT, sound)


@cache
def spellings() -> dict[int, str]:
    """The characters of the Indic blocks, by code point."""
    return {c: _spelling(chr(c)) for c in range(V.INDIC_FIRST, V.INDIC_LAST + 1)}


def romanise(token: str) -> str:
    """The spellings of the characters; a vowel sign or virama takes the place of the inherent a before it, and of
    equal vowels in a row one stays."""
    spelt = token.translate(spellings()).replace(INHERENT + JOIN, "").replace(INHERENT, "a").replace(JOIN, "")
    return re.sub(r"(a)a+|(e)e+|(i)i+|(o)o+|(u)u+", lambda m: m[0][0], spelt)


@F.pandas_udf(StringType())
def romanise_of(s: pd.Series) -> pd.Series:
    return s.map(romanise, na_action="ignore")


def dictionary_for(texts: DataFrame, column: str, learned: DataFrame) -> DataFrame:
    """(native, latin) for every distinct Indic token of texts: the learned form, else the romanised one.

    Python sees each distinct token once."""
    found = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(V.INDIC + "+"), F.lit(0))).alias("native")).distinct()
    return found.join(learned.select("native", "latin"), "native", "left").select("native", F.coalesce("latin", romanise_of("native")).alias("latin"))


def apply_dictionary(texts: DataFrame, key: str, column: str, dictionary: DataFrame) -> DataFrame:
    """texts with `column` transliterated: every Indic token replaced by its entry between spaces.

    Texts without Indic characters do not take part in the join.
    """
    native = F.coalesce(F.col(column).rlike(V.INDIC), F.lit(False))
    cut = rf"(?<={V.INDIC})(?!{V.INDIC})|(?<!{V.INDIC})(?={V.INDIC})"
    parts = texts.where(native).select(key, F.posexplode(F.split(F.col(column), cut, -1)).alias("at", "part"))
    joined = parts.join(dictionary, parts.part == dictionary.native, "left")
    piece = F.when(F.col("part").rlike(V.INDIC), F.concat(F.lit(" "), F.coalesce("latin", "part"), F.lit(" "))).otherwise(F.col("part"))
    whole = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))).alias("all")).select(key, F.array_join("all.piece", "").alias("__done"))
    return texts.join(whole, key, "left").withColumn(column, F.coalesce("__done", F.col(column))).drop("__done")


def with_map(c: Column, entries: Column) -> Column:
    """The same for a dictionary small enough to be a map literal."""
    cut = rf"(?<={V.INDIC})(?!{V.INDIC})|(?<!{V.INDIC})(?={V.INDIC})"
    return F.array_join(F.transform(F.split(c, cut, -1), lambda p: F.when(p.rlike(V.INDIC), F.concat(F.lit(" "), F.coalesce(entries[p], p), F.lit(" "))).otherwise(p)), "")
