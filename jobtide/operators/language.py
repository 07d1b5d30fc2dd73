"""Language of texts, and routing of texts through a translator."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions.text import percent, present, strip
from jobtide.lookups import FUNCTION_WORDS
from jobtide.operators.counters import Counters
from jobtide.operators.records import col, keep_valid
from jobtide.sources.tables import head_sample

Profiles = Mapping[str, Sequence[str]]
Rewriter = Callable[[str], str]


def spark_profiles(languages: Mapping[str, str]) -> dict[str, list[str]]:
    """Longer word lists from Spark ML, e.g. ``{"sv": "swedish"}``; needs a running session."""
    from pyspark.ml.feature import StopWordsRemover

    return {code: StopWordsRemover.loadDefaultStopWords(name) for code, name in languages.items()}


def words(c: Column) -> Column:
    return F.split(F.lower(c), r"[^\p{L}]+", -1)


def language_scores(tokens: Column, profiles: Profiles = FUNCTION_WORDS) -> Column:
    """(hits, code) structs: how many words of a text each language's list holds."""
    def hits(vocabulary: Sequence[str]) -> Column:
        return F.size(F.filter(tokens, lambda w: w.isin(list(vocabulary))))

    return F.array(*[
        F.struct(hits(v).alias("hits"), F.lit(code).alias("code")) for code, v in profiles.items()
    ])


def best_language(tokens: Column, profiles: Profiles = FUNCTION_WORDS) -> Column:
    """Language whose list holds most of the words; the first listed wins a tie.

    Scored within the row, so nothing is shuffled. "unknown" when no list has a hit.
    """
    best = F.reduce(
        language_scores(tokens, profiles),
        F.struct(F.lit(0).alias("hits"), F.lit("unknown").alias("code")),
        lambda acc, s: F.when(s["hits"] > acc["hits"], s).otherwise(acc),
    )
    return F.coalesce(best["code"], F.lit("unknown"))


def detect_language(c: Column, profiles: Profiles = FUNCTION_WORDS) -> Column:
    """Language of a text, as one column function."""
    return best_language(words(c), profiles)


def with_language(
    df: DataFrame, column: str, into: str = "language", profiles: Profiles = FUNCTION_WORDS,
    detector: Callable[[Column], Column] | None = None, snippet_chars: int | None = None,
) -> DataFrame:
    """Language code per text. ``detector`` may be any column function, e.g. a Pandas UDF.

    The whole text is read unless a snippet length is given. The built-in detector
    gets its words from a projection of their own, as every language reads them.
    """
    text = col(column) if snippet_chars is None else F.substring(col(column), 1, snippet_chars)
    if detector is not None:
        return df.withColumn(into, detector(text))
    worded = df.withColumn("_words", words(text))
    return worded.withColumn(into, best_language(F.col("_words"), profiles)).drop("_words")


def language_distribution(
    df: DataFrame, column: str, key: Sequence[str], mode: str = "full", sample_size: int = 500,
    **detection,
) -> DataFrame:
    """(language, records, sampled_records) over the valid texts, or over the first of them."""
    texts = head_sample(keep_valid(df, column), key, mode, sample_size)
    found = with_language(texts, column, "language", **detection)
    counts = found.groupBy("language").agg(F.count("*").alias("records"))
    # One row per language, so the total is a window over a handful of rows.
    return counts.withColumn("sampled_records", F.sum("records").over(Window.partitionBy()))


def english_share(found: DataFrame, column: str = "language", floor: float = 90.0) -> DataFrame:
    """One row: records, English records, their percentage, and whether it is below the floor."""
    sums = found.agg(F.count("*").alias("records"), present(col(column) == "en").alias("english"))
    sums = sums.withColumn("english_pct", percent(F.col("english"), F.col("records")))
    return sums.withColumn("below_floor", F.col("english_pct") < floor)


def route(c: Column, language: Column | None) -> Column:
    """missing, skip or translate."""
    known = F.lit(False) if language is None else F.coalesce(~language.isin("unknown", "en"), F.lit(False))
    return F.when(c.isNull() | (strip(c) == ""), "missing").when(known, "translate").otherwise("skip")


def with_route(
    df: DataFrame, column: str, into: str = "route", snippet_chars: int | None = None,
    detector: Callable[[Column], Column] | None = None, detect: bool = True,
) -> DataFrame:
    """Route of each text; without detection no text is translated."""
    if not detect:
        return df.withColumn(into, route(col(column), None))
    found = with_language(df, column, "_language", detector=detector, snippet_chars=snippet_chars)
    return found.withColumn(into, route(col(column), F.col("_language"))).drop("_language")


def chunks(c: Column, size: int = 4000) -> Column:
    """The text in pieces of at most ``size`` characters; NULL for an empty one.

    One pass over the text: taking each piece by its position would read the text up to there every time.
    """
    return F.when(F.length(c) > 0, F.regexp_extract_all(c, F.lit(f"(?s).{{1,{int(size)}}}"), F.lit(0)))


def rewrite_chunks(pieces: Column, load_rewriter: Callable[[], Rewriter]) -> Column:
    """Rewrite the pieces of a text and join them; NULL when the rewriter fails.

    The rewriter is loaded once per task.
    """
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = load_rewriter()

        def whole(parts):
            if parts is None:
                return None
            try:
                return "".join(rewriter(p) for p in parts)
            except Exception:
                return None

        for batch in batches:
            yield batch.map(whole)

    return run(pieces)


def translate_fields(
    df: DataFrame, fields: Sequence[str], load_rewriter: Callable[[], Rewriter],
    chunk_size: int = 4000, snippet_chars: int | None = None,
    detector: Callable[[Column], Column] | None = None, detect: bool = True, counters: Counters | None = None,
) -> DataFrame:
    """Rewrite the texts routed to translation, and add ``<field>_outcome``.

    Only those texts reach Python. A text whose rewriting fails stays as it is. Counts
    ``<field>: <outcome>``.
    """
    for field in fields:
        if field not in df.columns:
            continue
        df = with_route(df, field, "_route", snippet_chars, detector, detect)
        routed = F.when(F.col("_route") == "translate", chunks(col(field), chunk_size))
        df = df.withColumn("_new", rewrite_chunks(routed, load_rewriter))
        outcome = (
            F.when(F.col("_route") == "missing", "missing")
            .when(F.col("_route") == "skip", "skipped")
            .when(F.col("_new").isNull(), "failed")
            .otherwise("translated")
        )
        df = df.withColumn(f"{field}_outcome", outcome)
        df = df.withColumn(field, F.coalesce("_new", col(field))).drop("_route", "_new")
        if counters is not None:
            df = counters.watch(df, {f"{field}: {o}": present(col(f"{field}_outcome") == o) for o in OUTCOMES})
    return df


OUTCOMES = ["translated", "skipped", "missing", "failed"]


def translation_stats(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, translated, skipped, missing, failed) per field, in one pass."""
    names = [f for f in fields if f"{f}_outcome" in df.columns]
    sums = df.agg(*[
        present(col(f"{f}_outcome") == o).alias(f"{o}{i}") for i, f in enumerate(names) for o in OUTCOMES
    ])
    rows = [
        F.struct(F.lit(f).alias("field"), *[F.col(f"{o}{i}").alias(o) for o in OUTCOMES])
        for i, f in enumerate(names)
    ]
    return sums.select(F.inline(F.array(*rows)))
