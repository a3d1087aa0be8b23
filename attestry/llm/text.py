"""Text forms shared by the operators on records."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE_AND_PUNCTUATION = r"(?U)[\s\p{P}]+"


def digest(c: Column) -> Column:
    """Sixteen bytes that stand for a text in shuffles."""
    return F.unhex(F.md5(c))


def caseless(c: Column) -> Column:
    """Case-blind form: upper then lower, with ß of either case as SS. The step between also keeps the optimizer from dropping the upper."""
    return F.lower(F.replace(F.replace(F.upper(c), F.lit("ß"), F.lit("SS")), F.lit("ẞ"), F.lit("SS")))


def is_blank(c: Column) -> Column:
    """Null, empty or only white space of any kind."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def bare(c: Column) -> Column:
    """Without white space and punctuation (Unicode P), case ignored."""
    return caseless(F.regexp_replace(c, SPACE_AND_PUNCTUATION, ""))


def words(c: Column) -> Column:
    """Canonical words, joined by single spaces: case ignored; punctuation, symbols, bracket marks and white space as breaks."""
    plain = caseless(c)
    for mark in ("-lrb-", "-rrb-"):
        plain = F.replace(plain, F.lit(mark), F.lit(" "))
    return F.trim(F.regexp_replace(plain, r"(?U)[\s\p{P}\p{S}]+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize("NFC", x) for x in s], dtype=object)


def composed(c: Column) -> Column:
    """NFC. Only texts beyond ASCII go through Python."""
    return F.coalesce(nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
