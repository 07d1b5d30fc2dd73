"""From a posting's skill text to a skill dimension and a posting-skill bridge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions import patterns as P
from jobtide.functions.text import fold_accents, fold_accents_all, settle, strip, sub
from jobtide.lookups import CANONICAL_TERMS, EXCLUDED_SKILLS, PRODUCT_ALIASES
from jobtide.operators.records import catalogue_texts, col, is_noise_token
from jobtide.sources.tables import first_per_key, new_rows, number_rows


def split_skills(c: Column) -> Column:
    """Comma-separated parts, stripped, without blanks; NULL gives NULL."""
    return F.filter(F.transform(F.split(c, ",", -1), strip), lambda p: p != "")


def tidy(folded: Column) -> Column:
    """Ampersands spelled out, dashes unified and white space collapsed in folded text."""
    text = F.replace(folded, F.lit("&"), F.lit(" and "))
    return strip(sub(sub(text, P.UNICODE_DASH, "-"), r"(?U)[\s\x1c-\x1f]+", " "))


def basic_clean(c: Column) -> Column:
    return tidy(fold_accents(strip(c)))


def main_part(c: Column) -> Column:
    """Text without a trailing parenthetical; the whole text when there is none."""
    return strip(sub(c, P.TRAILING_PARENTHETICAL, "$1"))


def acronym(c: Column) -> Column:
    """The trailing parenthetical when it looks like an acronym, else NULL."""
    inside = strip(sub(strip(F.regexp_extract(c, P.TRAILING_PARENTHETICAL, 2)), P.NOT_ACRONYM_CHAR, " "))
    return F.when(inside.rlike(P.ACRONYM), inside)


def plain_words(c: Column) -> Column:
    """Lower case, only letters, digits, ``+.#`` and single spaces, short forms of operations spelled out."""
    text = F.translate(F.lower(c), "/-", "  ")
    text = F.trim(sub(sub(text, P.NOT_SKILL_CHAR, " "), r" +", " "))
    text = sub(text, r"\bops\b", "operations")
    return sub(text, r"\bsecops\b", "security operations")


def look_up(c: Column, table: Mapping[str, str]) -> Column:
    """One pass through a fixed lookup table; texts that are not in it stay."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def canonical(c: Column) -> Column:
    """Product aliases, then canonical terms; results are not looked up again."""
    return look_up(look_up(c, PRODUCT_ALIASES), CANONICAL_TERMS)


def normalise(tidied: Column) -> Column:
    return canonical(plain_words(main_part(tidied)))


def normalise_token(c: Column) -> Column:
    """The whole normalisation of one raw skill."""
    return normalise(basic_clean(c))


def token_alias(c: Column) -> Column:
    """Lower-cased acronym of a raw skill, where it has one."""
    return F.lower(acronym(basic_clean(c)))


def included(normalised: Column, excluded: Sequence[str] = EXCLUDED_SKILLS) -> Column:
    return (normalised != "") & ~normalised.isin(list(excluded))


def explode_skills(df: DataFrame, id_column: str = "id", skill_column: str = "skill") -> DataFrame:
    """(job_posting_id, pos, raw_skill, normalized_skill) per usable token.

    Accents are folded for all parts of a field at once, and only for fields
    that hold some, so that most rows never leave the JVM.
    """
    fields = df.where(col(skill_column).isNotNull()).select(
        col(id_column).alias("job_posting_id"), col(skill_column).alias("_skill")
    )
    parts = fields.withColumn("_parts", split_skills(F.col("_skill")))
    folded = parts.select(
        "job_posting_id", "_parts",
        fold_accents_all(F.col("_parts"), F.col("_skill")).alias("_folded"),
    )
    pairs = folded.select(
        "job_posting_id",
        F.posexplode(F.arrays_zip(F.col("_parts").alias("raw"), F.col("_folded").alias("folded"))).alias("pos", "t"),
    )
    tokens = pairs.where(~is_noise_token(F.col("t.raw"))).select(
        "job_posting_id", "pos", F.col("t.raw").alias("raw_skill"), tidy(F.col("t.folded")).alias("_tidy"),
    )
    tokens = settle(tokens.withColumn("_plain", plain_words(main_part(F.col("_tidy")))), "_plain")
    tokens = settle(tokens.withColumn("normalized_skill", canonical(F.col("_plain"))), "normalized_skill")
    return tokens.where(included(F.col("normalized_skill"))).drop("_tidy", "_plain")


def distinct_skills(tokens: DataFrame) -> DataFrame:
    return tokens.select("normalized_skill").distinct()


def skill_dim(tokens: DataFrame) -> DataFrame:
    """(id, normalized_skill), numbered in text order."""
    return number_rows(distinct_skills(tokens), ["normalized_skill"])


def extend_skill_dim(dim: DataFrame, tokens: DataFrame) -> DataFrame:
    """The dimension with skills it lacked; known skills keep their ids."""
    fresh = new_rows(distinct_skills(tokens), dim, ["normalized_skill"])
    last = F.coalesce(dim.agg(F.max("id")).scalar(), F.lit(0))
    numbered = number_rows(fresh, ["normalized_skill"])
    return dim.unionByName(numbered.withColumn("id", (F.col("id") + last).cast("long")))


def posting_skills(tokens: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """(job_posting_id, normalized_skill, raw_skill): first spelling per posting and skill."""
    key = ["job_posting_id", "normalized_skill"]
    rows = tokens.select(*key, "raw_skill", *[col(c) for c in order])
    return first_per_key(rows, key, [*order, "raw_skill"]).select(*key, "raw_skill")


def job_skill(tokens: DataFrame, dim: DataFrame) -> DataFrame:
    """(job_posting_id, skill_id, raw_skill); tokens outside the dimension are left out.

    Each skill occurs once in the dimension, so a skill that holds a large share
    of the bridge only repeats one row when Spark splits it.
    """
    bridge = posting_skills(tokens)
    ids = dim.select(F.col("id").alias("skill_id"), "normalized_skill")
    return bridge.join(ids, "normalized_skill").select("job_posting_id", "skill_id", "raw_skill")


def framework_texts(items: DataFrame) -> DataFrame:
    """(tks_id, embedding_text) of the described knowledge and skill items."""
    return catalogue_texts(items).select(
        F.col("id").alias("tks_id"), F.col("description").alias("embedding_text")
    )


def raw_token_total(df: DataFrame, skill_column: str = "skill") -> DataFrame:
    """One row: comma parts over all skill texts; an empty text has none."""
    parts = F.when(col(skill_column) == "", 0).otherwise(F.size(F.split(col(skill_column), ",", -1)))
    return df.where(col(skill_column).isNotNull()).agg(F.sum(parts).cast("long").alias("raw_tokens"))


def distinct_raw_tokens(df: DataFrame, skill_column: str = "skill") -> DataFrame:
    """One row: distinct lower-cased parts, trimmed of spaces, without blanks."""
    parts = df.select(F.explode(F.split(col(skill_column), ",", -1)).alias("part"))
    token = F.lower(F.trim("part"))
    return parts.where(F.trim("part") != "").agg(F.countDistinct(token).alias("distinct_tokens"))
