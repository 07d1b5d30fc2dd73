"""Demand and mapping reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.functions.text import present
from jobtide.lookups import COUNTRY_ALIASES, EU_COUNTRIES, SIMILARITY_STEPS
from jobtide.operators.records import col, contains_text, in_band, in_countries, to_long
from jobtide.session import cut_lineage


def at_least_one(name: str, value: int) -> int:
    if value < 1:
        raise ValueError(f"{name} has to be 1 or more")
    return value


def mapping_view(similarity: DataFrame, skills: DataFrame, items: DataFrame) -> DataFrame:
    """Matches with skill and item texts, ranked within skill and model, ties by item."""
    order = Window.partitionBy("skill_id", "model_name").orderBy(F.desc("similarity"), "tks_id")
    ranked = (
        similarity
        .join(skills.select(col("id").alias("skill_id"), "normalized_skill"), "skill_id")
        .join(items.select(col("id").alias("tks_id"), col("description").alias("tks_description")), "tks_id")
        .withColumn("rank", F.row_number().over(order))
    )
    return ranked.select(
        "skill_id", "normalized_skill", "tks_id", "tks_description", "similarity", "model_name", "rank"
    )


def mapping_rows(
    view: DataFrame,
    model: str,
    at: float = SIMILARITY_STEPS[0],
    top_k: int = 3,
    skill_query: str = "",
    steps: Sequence[float] = SIMILARITY_STEPS,
) -> DataFrame:
    """Rows of a similarity band within the first k ranks, optionally for some skills."""
    rows = view.where(F.col("model_name") == model).where(F.col("rank") <= top_k)
    rows = rows.where(in_band(F.col("similarity"), at, steps))
    if skill_query.strip():
        rows = rows.where(contains_text(F.col("normalized_skill"), skill_query.strip()))
    return rows.drop("model_name")


def ordered_mapping(rows: DataFrame) -> DataFrame:
    """Lowest similarity first, then by skill and item."""
    return rows.orderBy("similarity", "normalized_skill", "skill_id", "tks_id")


def row_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def mapping_page(rows: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of the mapping; a page past the end has no rows.

    The rows are sorted into ranges, which are checkpointed; from the number of rows of
    each range (one small row per task, on the driver) follows where the page lies, so a
    far page reads only its own ranges and never brings the rows before it together.
    """
    size, first = at_least_one("page_size", page_size), (at_least_one("page", page) - 1) * page_size
    columns = [col(c) for c in rows.columns]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(ordered_mapping(rows).select(*columns, F.spark_partition_id().alias("_part"), place.alias("_place")))
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    wanted, before = F.lit(False), 0
    for part in sorted(counts):
        low, high = max(first - before, 0), min(first + size - before, counts[part])
        if low < high:
            wanted = wanted | ((F.col("_part") == part) & F.col("_place").between(low, high - 1))
        before += counts[part]
    return ordered_mapping(placed.where(wanted).select(*columns))


def page_summary(rows: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """One row: total rows, total pages (at least one) and the page shown."""
    size, page = at_least_one("page_size", page_size), at_least_one("page", page)
    pages = F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long")
    return row_total(rows).select(
        "total", pages.alias("total_pages"),
        F.least(F.lit(page), pages).cast("long").alias("page"),
    )


def skill_counts(bridge: DataFrame) -> DataFrame:
    """Distinct postings per skill."""
    return bridge.groupBy("normalized_skill").agg(F.countDistinct("job_posting_id").alias("occurrences"))


def skill_frequency(bridge: DataFrame, postings: DataFrame, top_n: int = 30) -> DataFrame:
    """The n most frequent skills, with their share of all postings."""
    total = postings.agg(F.count("*")).scalar()
    top = skill_counts(bridge).orderBy(F.desc("occurrences"), "normalized_skill").limit(at_least_one("top_n", top_n))
    share = F.coalesce(F.try_divide(F.col("occurrences"), total), F.lit(0.0))
    return top.select(
        "normalized_skill", "occurrences", share.alias("frequency"),
        (share * 100).alias("frequency_pct"), F.round(share * 100, 2).alias("label_suffix"),
    )


def postings_per_country(
    postings: DataFrame, countries: Sequence[str] | None = EU_COUNTRIES
) -> DataFrame:
    """Distinct postings per country."""
    rows = in_countries(postings, "country", countries)
    return rows.groupBy("country").agg(F.countDistinct("id").alias("total_postings"))


def demand_by_country(
    bridge: DataFrame,
    postings: DataFrame,
    top_n: int = 5,
    countries: Sequence[str] | None = EU_COUNTRIES,
) -> DataFrame:
    """(country, total_postings, rank, skill, count, frequency, frequency_pct), n skills per country.

    ``id`` is the key of the postings. Making (posting, skill) unique first
    combines repeated tokens before they move, and leaves plain counts behind the
    join, so that Spark is free to split a posting that holds many rows. The rank
    limit cuts each country to n skills before the last, small exchange.
    """
    placed = in_countries(postings, "country", countries).select(
        col("id").alias("job_posting_id"), "country"
    )
    totals = placed.groupBy("country").agg(F.count("*").alias("total_postings"))
    counts = (
        bridge.select("job_posting_id", "normalized_skill")
        .distinct()
        .join(placed, "job_posting_id")
        .groupBy("country", "normalized_skill")
        .agg(F.count("*").alias("count"))
    )
    order = Window.partitionBy("country").orderBy(F.desc("count"), "normalized_skill")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= at_least_one("top_n", top_n))
    share = F.coalesce(F.try_divide(F.col("count"), F.col("total_postings")), F.lit(0.0))
    return top.join(totals, "country").select(
        "country", "total_postings", "rank", col("normalized_skill").alias("skill"), "count",
        F.round(share, 4).alias("frequency"), F.round(share * 100, 2).alias("frequency_pct"),
    )


def country_summaries(demand: DataFrame) -> DataFrame:
    """One row per country with its skills as an array, countries with most postings first."""
    skill = F.struct("rank", "skill", "count", "frequency", "frequency_pct")
    grouped = demand.groupBy("country", "total_postings").agg(
        F.sort_array(F.collect_list(skill)).alias("top_skills")
    )
    return grouped.orderBy(F.desc("total_postings"), "country")


def top_skill(demand: DataFrame) -> DataFrame:
    """The leading skill of each country."""
    return demand.where(F.col("rank") == 1).select("country", "skill", "count", "frequency_pct")


def map_name(c: Column, aliases: Mapping[str, str] = COUNTRY_ALIASES) -> Column:
    """A map's country name as the data spells it."""
    named = None
    for old, new in aliases.items():
        named = F.when(c == old, new) if named is None else named.when(c == old, new)
    return c if named is None else named.otherwise(c)


def map_classes(totals: DataFrame, map_countries: DataFrame | None = None) -> DataFrame:
    """Colour class per country: 3 above 0.66 of the largest, 2 above 0.33, 1 below.

    With a table of map countries, each gets a row, and 0 stands for a map on
    which no country has postings.
    """
    largest = totals.agg(F.max("total_postings")).scalar()
    rows = totals
    if map_countries is not None:
        named = map_countries.select("map_name", map_name(F.col("map_name")).alias("country"))
        rows = named.join(totals, "country", "left").withColumn(
            "total_postings", F.coalesce("total_postings", F.lit(0))
        )
    ratio = F.col("total_postings") / largest
    level = F.when(ratio > 0.66, 3).when(ratio > 0.33, 2).otherwise(1)
    return rows.withColumn("level", F.when(F.coalesce(largest, F.lit(0)) == 0, 0).otherwise(level))


def legend_bounds(totals: DataFrame) -> DataFrame:
    """One row: upper bounds of the three classes."""
    largest = F.coalesce(F.max("total_postings"), F.lit(0))
    return totals.agg(*[
        F.floor(largest * step + F.lit(0.5)).cast("long").alias(name)
        for name, step in (("low", 0.33), ("middle", 0.66), ("high", 1.0))
    ])


def best_similarity(similarity: DataFrame, model: str) -> DataFrame:
    """Best similarity per matched skill."""
    rows = similarity.where(F.col("model_name") == model)
    return rows.groupBy("skill_id").agg(F.max("similarity").alias("best_similarity"))


def mean_similarity(similarity: DataFrame, model: str) -> DataFrame:
    """One row: mean of the best similarities, 0.0 when nothing matched."""
    mean = F.coalesce(F.avg("best_similarity"), F.lit(0.0))
    return best_similarity(similarity, model).agg(mean.alias("mean_similarity"))


def coverage(
    similarity: DataFrame,
    skills: DataFrame,
    model: str,
    thresholds: Sequence[float] = tuple(SIMILARITY_STEPS),
) -> DataFrame:
    """(threshold, covered, total_skills, coverage); no rows when there are no skills."""
    total = skills.agg(F.count("*")).scalar()
    best = best_similarity(similarity, model)
    counts = best.agg(*[
        present(F.col("best_similarity") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)
    ])
    rows = to_long(counts, {t: f"t{i}" for i, t in enumerate(thresholds)}, "threshold", "covered")
    rows = rows.withColumn("total_skills", total).where("total_skills > 0")
    return rows.withColumn("coverage", F.try_divide("covered", "total_skills"))


def match_counts(similarity: DataFrame, skills: DataFrame, model: str) -> DataFrame:
    """One row: all skills, and skills with a match."""
    matched = best_similarity(similarity, model).agg(F.count("*")).scalar()
    return skills.agg(F.count("*").alias("total_skills")).withColumn("matched_skills", matched)
