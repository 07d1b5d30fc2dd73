"""Column and row selection on posting records."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions import patterns as P
from jobtide.functions.text import is_invalid, present, strip, valid_or_null
from jobtide.lookups import (
    CRITICAL_FIELDS, DISALLOWED_LOCATIONS, EU_COUNTRIES, INVALID_TEXTS, SIMILARITY_STEPS,
    UNUSED_FIELDS,
)
from jobtide.operators.counters import Counters


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def existing(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def drop_fields(df: DataFrame, names: Sequence[str] = UNUSED_FIELDS) -> tuple[DataFrame, list[str]]:
    """Drop the listed columns that exist, and say which they were."""
    dropped = existing(df, names)
    return df.drop(*dropped), dropped


def place_after(df: DataFrame, column: str, anchor: str) -> DataFrame:
    """Move a column right behind another."""
    names = [c for c in df.columns if c != column]
    names.insert(names.index(anchor) + 1, column)
    return df.select(*[col(n) for n in names])


def keep_valid(df: DataFrame, column: str, invalid: Sequence[str] = INVALID_TEXTS) -> DataFrame:
    return df.where(~is_invalid(col(column), invalid))


def invalid_to_null(df: DataFrame, columns: Sequence[str], counters: Counters | None = None) -> DataFrame:
    """Placeholder texts become NULL in the listed columns that exist.

    Counts ``invalid: <column>``: what is NULL afterwards was invalid.
    """
    names = existing(df, columns)
    out = df.withColumns({n: valid_or_null(col(n)) for n in names}) if names else df
    return out if counters is None else counters.watch(out, {f"invalid: {n}": present(col(n).isNull()) for n in names})


def invalid_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, invalid) per listed column that exists, in one pass."""
    names = existing(df, columns)
    flags = df.agg(*[present(is_invalid(col(n))).alias(f"c{i}") for i, n in enumerate(names)])
    return to_long(flags, {n: f"c{i}" for i, n in enumerate(names)}, "column", "invalid")


def to_long(one_row: DataFrame, names: dict[str, str], label: str, value: str) -> DataFrame:
    """Turn the columns of a one-row result into (label, value) rows."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias(label), F.col(c).alias(value)) for n, c in names.items()
    ])
    return one_row.select(F.inline(pairs))


def all_invalid(df: DataFrame, fields: Sequence[str] = CRITICAL_FIELDS) -> Column:
    """True when every critical field that exists is invalid; false when none exists."""
    names = existing(df, fields)
    if not names:
        return F.lit(False)
    return reduce(lambda a, b: a & b, [is_invalid(col(n)) for n in names])


def keep_critical(
    df: DataFrame, fields: Sequence[str] = CRITICAL_FIELDS, counters: Counters | None = None
) -> DataFrame:
    """Records with a valid critical field. Counts ``critical: removed`` and ``critical: kept``."""
    df = df.withColumn("_lost", all_invalid(df, fields))
    if counters is not None:
        df = counters.watch(df, {"critical: removed": present(F.col("_lost")), "critical: kept": present(~F.col("_lost"))})
    return df.where(~F.col("_lost")).drop("_lost")


def split_by_critical(
    df: DataFrame, fields: Sequence[str] = CRITICAL_FIELDS
) -> tuple[DataFrame, DataFrame]:
    """Kept records, and records whose critical fields are all invalid."""
    lost = all_invalid(df, fields)
    return df.where(~lost), df.where(lost)


def drop_locations(
    df: DataFrame, column: str = "Location", disallowed: Sequence[str] = DISALLOWED_LOCATIONS,
    counters: Counters | None = None,
) -> DataFrame:
    """Rows whose location is not on the list; NULL stays. Counts ``disallowed locations``."""
    listed = F.coalesce(col(column).isin(list(disallowed)), F.lit(False))
    if counters is not None:
        df = counters.watch(df, {"disallowed locations": present(listed)})
    return df.where(~listed)


def is_noise_token(c: Column) -> Column:
    """Blank tokens and profile-match notices."""
    return (strip(c) == "") | c.rlike(P.NOISE_TOKEN)


def in_countries(
    df: DataFrame, column: str = "country", countries: Sequence[str] | None = EU_COUNTRIES
) -> DataFrame:
    """Rows with a country on the list, or with any country when there is no list."""
    df = df.where(col(column).isNotNull())
    return df if countries is None else df.where(col(column).isin(list(countries)))


def band_limits(at: float, steps: Sequence[float] = SIMILARITY_STEPS) -> tuple[float, float]:
    """Lower and upper limit of a band; an unknown value stands for the lowest step."""
    if at not in steps:
        at = steps[0]
    return at, 1.0 if at == steps[-1] else min(at + 0.10, 1.0)


def in_band(similarity: Column, at: float, steps: Sequence[float] = SIMILARITY_STEPS) -> Column:
    """Half-open band; the top band also takes exactly 1.0, but nothing above it."""
    low, high = band_limits(at, steps)
    inside = similarity < high
    if high == 1.0:
        inside = inside | (similarity == 1.0)
    return (similarity >= low) & inside


def contains_text(c: Column, query: str) -> Column:
    """Case-insensitive substring search; ``%`` and ``_`` in the query act as wildcards.

    A backslash makes the character behind it literal, whatever it is.
    """
    kept = re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], f"%{query}%", flags=re.DOTALL)
    return c.ilike(kept)


def at_least(df: DataFrame, column: str, minimum: float) -> DataFrame:
    return df.where(col(column) >= minimum)


def catalogue_texts(items: DataFrame, types: Sequence[str] = ("Knowledge", "Skill")) -> DataFrame:
    """Described items of the wanted types."""
    return items.where(col("type").isin(list(types)) & col("description").isNotNull())


def pick_field(df: DataFrame, spellings: Sequence[str]) -> Column:
    """First value among the spellings that exist which is neither NULL nor empty."""
    values = [F.nullif(col(n).cast("string"), F.lit("")) for n in existing(df, spellings)]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def not_equal_or_null(c: Column, value: str) -> Column:
    return ~c.eqNullSafe(value)
