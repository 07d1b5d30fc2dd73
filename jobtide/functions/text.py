"""Text predicates and small text functions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.lookups import INVALID_TEXTS

# Everything that counts as white space; the plain trim functions take spaces only.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Text without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITESPACE))


def sub(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, pattern, replacement)


def is_invalid(c: Column, invalid: Sequence[str] = INVALID_TEXTS) -> Column:
    """True for NULL, blank and placeholder texts; never NULL."""
    return strip(F.coalesce(c, F.lit(""))).isin(list(invalid))


def valid_or_null(c: Column, invalid: Sequence[str] = INVALID_TEXTS) -> Column:
    return F.when(~is_invalid(c, invalid), c)


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def present(flag: Column) -> Column:
    """Number of rows for which the flag holds."""
    return F.coalesce(F.sum(F.when(flag, 1).otherwise(0)), F.lit(0)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def decode_entities(c: Column) -> Column:
    """HTML entities to characters. Only texts with an ampersand leave the JVM."""
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def _fold(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


@F.pandas_udf(T.StringType())
def _fold_text(s: pd.Series) -> pd.Series:
    return s.map(_fold, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_texts(s: pd.Series) -> pd.Series:
    return s.map(lambda parts: [_fold(p) for p in parts], na_action="ignore")


def _not_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; ASCII texts stay in the JVM."""
    return F.coalesce(_fold_text(F.when(_not_ascii(c), c)), c)


def fold_accents_all(parts: Column, source: Column) -> Column:
    """``fold_accents`` of each element; ``source`` is the text the parts were cut from."""
    return F.coalesce(_fold_texts(F.when(_not_ascii(source), parts)), parts)


def settle(df: DataFrame, *columns: str) -> DataFrame:
    """Compute costly columns once.

    A filter on a projected column is pushed below the projection, and every use
    of the column there repeats its expression. A generator is a boundary that
    filters on its output do not cross.
    """
    fields = F.struct(*[F.col(f"`{c}`") for c in columns])
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    settled = df.select(*others, F.inline(F.array(fields)))
    return settled.select(*[F.col(f"`{c}`") for c in df.columns])
