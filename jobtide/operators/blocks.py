"""Boilerplate block filtering and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions import patterns as P
from jobtide.functions.blocks import kept_text, labelled_blocks, removed_count, split_blocks
from jobtide.functions.text import present, settle
from jobtide.operators.counters import Counters
from jobtide.operators.records import col, to_long

CATEGORIES = {label: f"category_{i}" for i, label in enumerate(P.BLOCK_CATEGORIES)}


def explode_blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, block) rows."""
    return df.select(col(key), F.posexplode(split_blocks(col(column))).alias("pos", "block"))


def explode_categories(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, category) rows, with a NULL category for kept blocks."""
    blocks = df.select(col(key), F.posexplode(labelled_blocks(col(column))).alias("pos", "b"))
    return blocks.select(col(key), "pos", F.col("b.category").alias("category"))


def filter_blocks(df: DataFrame, column: str, counters: Counters | None = None) -> DataFrame:
    """Drop boilerplate blocks; texts with blocks are joined again by line feeds.

    Counts ``blocks: records``, ``blocks: removed`` and ``blocks: <category>``, from the
    blocks that are cut anyway.
    """
    df = df.withColumn("_blocks", labelled_blocks(col(column)))
    if counters is not None:
        # Watched and joined from one array of blocks: it is settled, so that neither repeats the work.
        df = settle(df, "_blocks")
        per_category = {f"blocks: {label}": removed_sum(F.col("_blocks"), label) for label in CATEGORIES}
        records = present(removed_count(F.col("_blocks")) > 0)
        df = counters.watch(df, {"blocks: records": records, "blocks: removed": removed_sum(F.col("_blocks")), **per_category})
    return df.withColumn(column, kept_text(col(column), F.col("_blocks"))).drop("_blocks")


def removed_sum(labelled: Column, category: str | None = None) -> Column:
    return F.coalesce(F.sum(removed_count(labelled, category)), F.lit(0)).cast("long")


def block_stat_columns(labelled: Column) -> list[Column]:
    return [
        present(removed_count(labelled) > 0).alias("records_with_removed_blocks"),
        removed_sum(labelled).alias("blocks_removed"),
    ]


def block_stats(df: DataFrame, column: str) -> DataFrame:
    """(stat, value): records touched, blocks removed, and blocks removed per category.

    Counted within each row and summed, so no block is shuffled.
    """
    labelled = df.select(labelled_blocks(col(column)).alias("blocks"))
    per_category = [removed_sum(F.col("blocks"), label).alias(name) for label, name in CATEGORIES.items()]
    sums = labelled.agg(*block_stat_columns(F.col("blocks")), *per_category)
    names = {n: n for n in ("records_with_removed_blocks", "blocks_removed")}
    return to_long(sums, {**names, **CATEGORIES}, "stat", "value")
