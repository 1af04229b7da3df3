"""Text forms used for matching names and headers.

Plain ASCII text is handled by built-in functions alone; other text needs NFKC and case folding, which Spark lacks, so
those two go through an Arrow function that returns ASCII input at once.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Categories and code points that carry no identity (symbols, formats, emoji).
DROPPED = re.compile("[\U0001f000-\U0001faff︀-️☀-➿⬀-⯿\U0001f1e6-\U0001f1ff‍]")
DROPPED_CATEGORIES = ("So", "Sk", "Cf", "Cs", "Co")
ASCII = r"^[\x00-\x7f]*$"
CJK = r"[\x{4e00}-\x{9fff}]+"


def _normal(s: str | None) -> str:
    return unicodedata.normalize("NFKC", s) if s else ""


def _nfkc_series(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x and x.isascii() else _normal(x))


def _folded_series(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(_normal(x).split()).casefold())


def _norm_series(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str:
        kept = (c for c in DROPPED.sub("", _normal(x)) if unicodedata.category(c) not in DROPPED_CATEGORIES)
        return "".join("".join(kept).split()).casefold()

    return s.map(one)


def _nfkc(c: Column) -> Column:
    return F.pandas_udf(_nfkc_series, T.StringType())(c)


def _folded(c: Column) -> Column:
    return F.pandas_udf(_folded_series, T.StringType())(c)


def _norm(c: Column) -> Column:
    return F.pandas_udf(_norm_series, T.StringType())(c)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def nfkc(c: Column, ascii_only: bool = False) -> Column:
    """NFKC form, null as empty. ascii_only promises ASCII input and keeps the plan free of Python."""
    return _text(c) if ascii_only else _nfkc(c)


def norm(c: Column, ascii_only: bool = False) -> Column:
    """NFKC, symbols and emoji dropped, white space removed, case folded."""
    return F.lower(F.regexp_replace(_text(c), r"[\^`\s\x1c-\x1f]+", "")) if ascii_only else _norm(c)


def header_key(c: Column, ascii_only: bool = False) -> Column:
    """NFKC, white space removed, case folded."""
    return F.lower(F.regexp_replace(_text(c), r"[\s\x1c-\x1f]+", "")) if ascii_only else _folded(c)


def cjk(normal: Column) -> Column:
    """The Chinese characters of an NFKC form."""
    return F.array_join(F.regexp_extract_all(normal, F.lit(f"({CJK})"), F.lit(1)), "")


def ascii_part(normed: Column) -> Column:
    """norm form without Chinese characters and without trailing _ - or ."""
    return F.regexp_replace(F.regexp_replace(normed, CJK, ""), r"[_\-.]+$", "")


def is_hex24(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^[0-9a-fA-F]{24}$"), F.lit(False))


def add_forms(df: DataFrame, name: str, prefix: str, ascii_only: bool = False) -> DataFrame:
    """Append {prefix}norm, {prefix}cjk and {prefix}ascii of a name column."""
    df = df.withColumn(f"{prefix}norm", norm(F.col(name), ascii_only))
    han = F.lit("") if ascii_only else cjk(nfkc(F.col(name)))
    return df.withColumn(f"{prefix}cjk", han).withColumn(f"{prefix}ascii", ascii_part(F.col(f"{prefix}norm")))


def transliterate(df: DataFrame, han: str, lexicon: DataFrame, out: str) -> DataFrame:
    """Append the joined syllables of a Chinese string by a lexicon (char, syllable); unknown characters stay. One reading for each character."""
    chars = df.select(han).distinct().select(han, F.posexplode(F.split(F.col(han), "")).alias("at", "char")).where("char <> ''")
    read = chars.join(lexicon, "char", "left").groupBy(han).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("syllable", "char").alias("s")))), lambda x: x["s"]), "").alias(out))
    return df.join(read, han, "left").withColumn(out, F.lower(F.coalesce(out, F.lit(""))))


def translate_messages(df: DataFrame, col: str, dictionary: DataFrame, rules: list[tuple[str, str]], out: str) -> DataFrame:
    """Exact dictionary (source, target), else the first matching rule (pattern, replacement with $1), else unchanged."""
    joined = df.join(dictionary.select(F.col("source").alias("__source"), F.col("target").alias("__target")), F.col(col) == F.col("__source"), "left")
    text = F.when(F.col("__target").isNotNull(), F.col("__target"))
    for pattern, replacement in rules:
        text = text.when(F.col(col).rlike(f"^(?:{pattern})$"), F.regexp_replace(col, f"^(?:{pattern})$", replacement))
    return joined.withColumn(out, text.otherwise(F.col(col))).drop("__source", "__target")


def name_contains(wanted: Column, wanted_cjk: Column, shown: Column, shown_cjk: Column) -> Column:
    """Whether a name (norm and cjk forms) is inside another; an empty name is inside any."""
    return ((wanted_cjk != "") & F.contains(shown_cjk, wanted_cjk)) | (wanted == "") | F.contains(shown, wanted)
