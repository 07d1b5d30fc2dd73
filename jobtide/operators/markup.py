"""Markup detection and the reports around cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions import patterns as P
from jobtide.functions import scan
from jobtide.functions.blocks import kept_text, labelled_blocks
from jobtide.functions.cleaning import clean_text, collapse_blanks, drop_gender_markers
from jobtide.functions.text import percent, present, settle, strip
from jobtide.operators.blocks import block_stat_columns, filter_blocks
from jobtide.operators.counters import Counters
from jobtide.operators.records import col, existing, to_long

LABELS = list(P.MARKUP_LABELS)


def field_name(label: str) -> str:
    return label.lower().replace(" ", "_")


FIELDS = {label: field_name(label) for label in LABELS}


def markup_flags(c: Column) -> Column:
    """Struct with one flag per markup pattern; NULL counts as empty text. Only the body of a text is searched."""
    text = scan.body(F.coalesce(c, F.lit("")))
    return F.struct(*[
        text.rlike(pattern).alias(FIELDS[label]) for label, pattern in P.MARKUP_LABELS.items()
    ])


def with_markup(df: DataFrame, column: str, into: str = "markup") -> DataFrame:
    return df.withColumn(into, markup_flags(col(column)))


def any_markup(flags: Column) -> Column:
    return reduce(lambda a, b: a | b, [flags[f] for f in FIELDS.values()])


def has_markup(c: Column) -> Column:
    """True when some pattern matches; later patterns run only if earlier ones did not."""
    text = scan.body(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in P.MARKUP_LABELS.values()])


def markup_types(flags: Column) -> Column:
    """Labels that fired, in report order."""
    return F.array_compact(F.array(*[F.when(flags[f], label) for label, f in FIELDS.items()]))


def records_with_markup(df: DataFrame, column: str) -> DataFrame:
    return df.where(has_markup(col(column)))


def flagged_records(df: DataFrame, column: str) -> DataFrame:
    """Records with markup, with the labels that fired."""
    flagged = settle(with_markup(df, column), "markup")
    types = markup_types(F.col("markup"))
    return flagged.where(any_markup(F.col("markup"))).withColumn("markup_types", types).drop("markup")


def markup_counts(df: DataFrame, column: str) -> DataFrame:
    """(label, records), in one pass."""
    flagged = df.select(markup_flags(col(column)).alias("markup"))
    sums = flagged.agg(*[present(F.col(f"markup.{f}")).alias(f) for f in FIELDS.values()])
    return to_long(sums, FIELDS, "label", "records")


def markup_share(df: DataFrame, column: str) -> DataFrame:
    """One row: records, records with markup and their percentage."""
    sums = df.agg(F.count("*").alias("records"), present(has_markup(col(column))).alias("with_markup"))
    return sums.withColumn("markup_pct", percent(F.col("with_markup"), F.col("records")))


def markup_previews(
    df: DataFrame, column: str, key: str, count: int = 3, length: int = 300
) -> DataFrame:
    """First flagged records with a shortened text."""
    text = col(column)
    shortened = F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("...")))
    return (
        flagged_records(df, column)
        .select(col(key), F.coalesce(shortened, text).alias("preview"), "markup_types")
        .orderBy(key)
        .limit(count)
    )


def count_markup(df: DataFrame, column: str, name: str, counters: Counters | None) -> DataFrame:
    """The same rows; counts those with markup under ``markup: <name>``."""
    return df if counters is None else counters.watch(df, {f"markup: {name}": present(has_markup(col(column)))})


def clean_descriptions(
    df: DataFrame, column: str = "Description", counters: Counters | None = None, count_before: bool = True
) -> DataFrame:
    """Drop boilerplate blocks, then clean the text that is left.

    Counts ``markup: before`` (if wanted) and ``markup: after``, the records with markup, and what
    ``filter_blocks`` counts, while the texts are cleaned.
    """
    if count_before:
        df = count_markup(df, column, "before", counters)
    df = clean_text(filter_blocks(df, column, counters), column)
    return count_markup(df, column, "after", counters)


def _before_and_after(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    df = df.select(*[col(k) for k in keep], col(column).alias("before"))
    df = df.withColumn("blocks", labelled_blocks(F.col("before")))
    df = df.withColumn("after", kept_text(F.col("before"), F.col("blocks")))
    return clean_text(df, "after")


def cleaning_report(df: DataFrame, column: str = "Description") -> DataFrame:
    """One row: flagged before and after cleaning, and what block filtering removed."""
    return _before_and_after(df, column).agg(
        F.count("*").alias("records"),
        present(has_markup(F.col("before"))).alias("flagged_before"),
        present(has_markup(F.col("after"))).alias("flagged_after"),
        *block_stat_columns(F.col("blocks")),
    )


def cleaning_examples(df: DataFrame, column: str, key: str, count: int = 20) -> DataFrame:
    """Text before and after cleaning of the first flagged records.

    The records are picked before cleaning, so only they are cleaned.
    """
    picked = flagged_records(df.select(col(key), col(column)), column).orderBy(key).limit(count)
    # Settled: the optimizer pushes projections below a limit, and all flagged records would be cleaned.
    picked = settle(picked, column)
    return _before_and_after(picked, column, [key, "markup_types"]).drop("blocks")


def clean_gender_markers(
    df: DataFrame, columns: Sequence[str] = ("Title", "Description"), counters: Counters | None = None
) -> DataFrame:
    """Drop gender markers; only records that hold one are re-spaced and stripped.

    Counts ``gender markers: <column>``; the test that decides is the one that is counted.
    """
    names = existing(df, columns)
    marked = {f"_marked{i}": col(n).rlike(P.GENDER_MARKER) for i, n in enumerate(names)}
    if counters is not None and names:
        df = settle(df.withColumns(marked), *marked)
        df = counters.watch(df, {f"gender markers: {n}": present(F.col(m)) for n, m in zip(names, marked)})
        marked = {m: F.col(m) for m in marked}
    out = {}
    for name, test in zip(names, marked.values()):
        c = col(name)
        out[name] = F.when(test, strip(collapse_blanks(drop_gender_markers(c)))).otherwise(c)
    return df.withColumns(out).drop(*marked) if out else df


def gender_marker_counts(
    df: DataFrame, columns: Sequence[str] = ("Title", "Description")
) -> DataFrame:
    """(column, records) with a gender marker."""
    names = existing(df, columns)
    sums = df.agg(*[present(col(n).rlike(P.GENDER_MARKER)).alias(f"c{i}") for i, n in enumerate(names)])
    return to_long(sums, {n: f"c{i}" for i, n in enumerate(names)}, "column", "records")
