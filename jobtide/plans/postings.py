"""The whole posting clean-up as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from jobtide.functions.text import blank_to_null, present, settle
from jobtide.lookups import CRITICAL_FIELDS, NULLABLE_FIELDS
from jobtide.operators import derive, markup, records
from jobtide.operators.counters import Counters
from jobtide.operators.records import col


def clean_postings(raw: DataFrame, overrides: DataFrame | None, counters: Counters | None = None) -> DataFrame:
    """Raw postings to cleaned postings; every field is optional.

    ``overrides`` is the table of area names and their countries (see
    ``files.read_overrides``). It has no default, so that no run goes without it
    by mistake; None leaves locations as they are.

    Nothing is shuffled: all steps work within a row, and the location table is
    joined by broadcast where its size allows. ``counters`` get what every step changed or
    removed, from the run that gives the rows: read them after the rows were written.
    """
    df, _ = records.drop_fields(raw)
    df = records.invalid_to_null(df, NULLABLE_FIELDS, counters)
    if "Location" in df.columns:
        df = records.drop_locations(df, counters=counters)
    described = "Description" in df.columns
    if described:
        df = markup.count_markup(df, "Description", "before", counters)
    df = markup.clean_gender_markers(df, counters=counters)
    if described:
        df = markup.clean_descriptions(df, counters=counters, count_before=False)
        df = df.withColumn("Description", blank_to_null(col("Description")))
        if counters is not None:
            df = counters.watch(df, {"descriptions without text": present(col("Description").isNull())})
    if "Skill" in df.columns:
        df = derive.clean_skill_fields(df, counters=counters)
    df = derive.add_country(df, overrides)
    df = derive.add_work_modality(df, counters=counters)
    df = derive.add_company(df)
    df = settle(df, *records.existing(df, CRITICAL_FIELDS))
    return records.keep_critical(df, counters=counters)
