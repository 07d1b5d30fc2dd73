"""Profiles of posting records and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions.text import is_invalid, percent, present
from jobtide.lookups import CRITICAL_FIELDS
from jobtide.operators.records import all_invalid, col, existing, not_equal_or_null, to_long


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def shape(df: DataFrame) -> DataFrame:
    """(column, type, row_count) per column."""
    columns = F.array(*[
        F.struct(F.lit(n).alias("column"), F.lit(t).alias("type")) for n, t in df.dtypes
    ])
    counted = df.agg(F.count("*").alias("row_count"))
    return counted.select(F.inline(columns), "row_count")


def invalid_profile(df: DataFrame) -> DataFrame:
    """(column, invalid, invalid_pct) per text column, in one pass."""
    names = text_columns(df)
    sums = df.agg(
        F.count("*").alias("n"), *[present(is_invalid(col(c))).alias(f"c{i}") for i, c in enumerate(names)]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"c{i}").alias("invalid"),
            percent(F.col(f"c{i}"), F.col("n")).alias("invalid_pct"),
        )
        for i, c in enumerate(names)
    ]
    return sums.select(F.inline(F.array(*rows)))


def _digests(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Columns to group by for equality of rows; texts are replaced by their SHA-256."""
    out = []
    for i, c in enumerate(columns):
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        out.append((F.sha2(col(c), 256) if is_text else col(c)).alias(f"k{i}"))
    return out


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows beyond the first of each group of equal rows; NULLs are equal.

    Digests move instead of whole texts, and groups are combined before they do.
    """
    groups = df.groupBy(*_digests(df, columns or df.columns)).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def duplicates_ignoring(df: DataFrame, ignored: str) -> DataFrame:
    return duplicate_rows(df, [c for c in df.columns if c != ignored])


def mean_lengths(df: DataFrame) -> DataFrame:
    """(column, avg_length) per text column; NULL does not count."""
    names = text_columns(df)
    sums = df.agg(*[F.avg(F.length(col(c))).alias(f"c{i}") for i, c in enumerate(names)])
    return to_long(sums, {c: f"c{i}" for i, c in enumerate(names)}, "column", "avg_length")


def location_column(df: DataFrame) -> str | None:
    """First column whose name speaks of a location."""
    words = ("location", "country", "city")
    return next((c for c in df.columns if any(w in c.lower() for w in words)), None)


def top_values(df: DataFrame, column: str, count: int = 10) -> DataFrame:
    """Most frequent values, ties by value; NULL does not count."""
    rows = df.where(col(column).isNotNull()).groupBy(col(column).alias("value"))
    return rows.agg(F.count("*").alias("records")).orderBy(F.desc("records"), "value").limit(count)


def status_distribution(df: DataFrame, column: str, listed: str | None = None) -> DataFrame:
    """(status, records); with ``listed``, only of the records that differ from it."""
    if listed is not None:
        df = df.where(not_equal_or_null(col(column), listed))
    rows = df.where(col(column).isNotNull())
    return rows.groupBy(col(column).alias("status")).agg(F.count("*").alias("records"))


def status_samples(df: DataFrame, column: str, listed: str, key: str, count: int = 3) -> DataFrame:
    """First records whose status differs from the expected one."""
    rows = df.where(not_equal_or_null(col(column), listed))
    return rows.select(col(key), col(column).alias("status")).orderBy(key).limit(count)


def critical_report(df: DataFrame, fields: Sequence[str] = CRITICAL_FIELDS) -> DataFrame:
    """(field, records, valid, nulls, invalid, total_missing_ref) per critical field.

    ``invalid`` includes NULLs. ``total_missing_ref`` adds NULLs to it once more,
    as the usual report of this data does.
    """
    names = existing(df, fields)
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        aggs += [present(col(c).isNull()).alias(f"n{i}"), present(is_invalid(col(c))).alias(f"i{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("field"), F.col("n").alias("records"),
            (F.col("n") - F.col(f"i{i}")).alias("valid"), F.col(f"n{i}").alias("nulls"),
            F.col(f"i{i}").alias("invalid"),
            (F.col(f"n{i}") + F.col(f"i{i}")).alias("total_missing_ref"),
        )
        for i, c in enumerate(names)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def all_invalid_share(df: DataFrame, fields: Sequence[str] = CRITICAL_FIELDS) -> DataFrame:
    """One row: records whose critical fields are all invalid, and their percentage."""
    sums = df.agg(F.count("*").alias("records"), present(all_invalid(df, fields)).alias("all_invalid"))
    return sums.withColumn("all_invalid_pct", percent(F.col("all_invalid"), F.col("records")))


def invalid_cross_table(df: DataFrame, first: str = "Skill", second: str = "Description") -> DataFrame:
    """(first_invalid, second_invalid, records, pct): all four cells, also empty ones."""
    a, b = is_invalid(col(first)), is_invalid(col(second))
    cells = [(x, y) for x in (True, False) for y in (True, False)]
    sums = df.agg(
        F.count("*").alias("n"),
        *[present((a == x) & (b == y)).alias(f"c{i}") for i, (x, y) in enumerate(cells)],
    )
    rows = [
        F.struct(
            F.lit(x).alias("first_invalid"), F.lit(y).alias("second_invalid"),
            F.col(f"c{i}").alias("records"), percent(F.col(f"c{i}"), F.col("n")).alias("pct"),
        )
        for i, (x, y) in enumerate(cells)
    ]
    return sums.select(F.inline(F.array(*rows)))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls) per column."""
    sums = df.agg(*[present(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return to_long(sums, {c: f"c{i}" for i, c in enumerate(df.columns)}, "column", "nulls")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(col(column)).alias("distinct_values"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, records) without NULL."""
    return status_distribution(df, column).withColumnRenamed("status", "value")
