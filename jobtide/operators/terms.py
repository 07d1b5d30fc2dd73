"""Term frequencies per field: the data behind a term cloud."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions.text import strip, sub
from jobtide.lookups import FIELD_SPELLINGS, FUNCTION_WORDS
from jobtide.operators.records import col, existing, pick_field

# Groups in which the terms of a field are ranked before they meet.
TERM_GROUPS = 64


def spark_stop_words(language: str = "english") -> list[str]:
    """Spark ML's stop-word list; needs a running session."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)


def plain_text(c: Column) -> Column:
    """Lower case, only ``a-z``, digits and single spaces."""
    kept = sub(F.lower(c), r"(?U)[^a-z0-9\s\x1c-\x1f]", " ")
    return strip(sub(kept, r"(?U)[\s\x1c-\x1f]+", " "))


def plain_skills(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Parts of a comma-separated text or of a list, each made plain, joined by spaces."""
    if isinstance(dtype, T.ArrayType):
        parts = F.filter(c, lambda p: p.isNotNull() & (p != ""))
    else:
        parts = F.filter(F.transform(F.split(c, ",", -1), strip), lambda p: p != "")
    return F.coalesce(F.array_join(F.transform(parts, plain_text), " "), F.lit(""))


def field_texts(df: DataFrame, spellings: Mapping[str, Sequence[str]] = FIELD_SPELLINGS) -> DataFrame:
    """(field, text) with the plain text of title, description and skill."""
    columns = {}
    for field, names in spellings.items():
        names = existing(df, names)
        if field == "skill" and names and isinstance(df.schema[names[0]].dataType, T.ArrayType):
            columns[field] = F.when(F.size(col(names[0])) > 0, plain_skills(col(names[0]), df.schema[names[0]].dataType))
        else:
            picked = pick_field(df, names)
            plain = plain_skills(picked) if field == "skill" else plain_text(picked)
            columns[field] = F.when(picked.isNotNull(), plain)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("text")) for f, c in columns.items()])
    return df.select(F.inline(pairs)).where("text IS NOT NULL")


def term_counts(
    texts: DataFrame, stop_words: Sequence[str] = tuple(FUNCTION_WORDS["en"]), merge_plurals: bool = True
) -> DataFrame:
    """(field, term, occurrences) without stop-words and plain numbers.

    A plural in -s counts for its singular where the singular occurs. Singular
    and plural share a stem, so both fall into one group and no join is needed.
    """
    tokens = texts.select("field", F.explode(F.split("text", " +", -1)).alias("word"))
    tokens = tokens.where((F.col("word") != "") & ~F.col("word").isin(list(stop_words)))
    tokens = tokens.where(~F.col("word").rlike("^[0-9]+$"))
    if not merge_plurals:
        counts = tokens.groupBy("field", F.col("word").alias("term"))
        return counts.agg(F.count("*").alias("occurrences"))
    word = F.col("word")
    is_plural = word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 1)
    tokens = tokens.select(
        "field", is_plural.alias("plural"),
        F.when(is_plural, F.expr("substring(word, 1, length(word) - 1)")).otherwise(word).alias("stem"),
    )
    grouped = tokens.groupBy("field", "stem").agg(
        F.count("*").alias("occurrences"), F.count_if(~F.col("plural")).alias("singular")
    )
    term = F.when(F.col("singular") > 0, F.col("stem")).otherwise(F.concat("stem", F.lit("s")))
    return grouped.select("field", term.alias("term"), "occurrences")


def top_terms(
    texts: DataFrame,
    max_words: int = 150,
    stop_words: Sequence[str] = tuple(FUNCTION_WORDS["en"]),
    merge_plurals: bool = True,
) -> DataFrame:
    """(field, rank, term, occurrences, weight): the most frequent terms of each field.

    The weight is relative to the field's most frequent term. The terms of a field are
    ranked in groups by hash first, so that only the ``max_words`` best of each group are
    brought together, however many words are asked for.
    """
    best = [F.desc("occurrences"), "term"]
    counts = term_counts(texts, stop_words, merge_plurals).withColumn("_group", F.pmod(F.hash("term"), F.lit(TERM_GROUPS)))
    inner = F.row_number().over(Window.partitionBy("field", "_group").orderBy(*best))
    counts = counts.withColumn("_rank", inner).where(F.col("_rank") <= max_words).drop("_rank", "_group")
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(*best)))
    top = ranked.where(F.col("rank") <= max_words)
    largest = F.max("occurrences").over(Window.partitionBy("field"))
    return top.select("field", "rank", "term", "occurrences", (F.col("occurrences") / largest).alias("weight"))
