"""A language detector that is learned from labelled texts: smoothed character n-grams.

Pairs and triples of the letters of a text (words in lower case, one blank between and
around them) fall into a fixed number of buckets. Spark counts the buckets of each
language; their logarithmic shares, as whole numbers, are the model: one bounded array.
A text belongs to the language that makes its n-grams likeliest. What is too close to a
second language, or fits its own worse than learning texts that were left out, is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Buckets of n-grams, languages of one model, and the unit of its logarithms.
BUCKETS, LANGUAGES, UNIT = 1 << 16, 64, 1024
#: Added to every count.
PRIOR = 0.5
#: Share of the left-out texts that may fall below each of the two limits.
SHARE = 0.002
#: First digits of the MD5 of texts that are left out when the limits are learned.
LEFT_OUT = ("0", "1", "2")
#: Characters of text handled at once.
SLICE = 1 << 20

_FACTORS = (7_919, 104_729, 1_299_709)
_FAR = 1 << 30


def letters(c: Column) -> Column:
    """Words of letters in lower case with one blank between and around them; two blanks if there is none."""
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+", " "))
    return F.concat(F.lit(" "), plain, F.lit(" "))


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all pairs and triples of the texts, and the text of each. Texts without a letter have none."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts)), sizes)
    some = (sizes > 2)[of]
    found, whose = [], []
    for n in (2, 3):
        many = max(len(joined) - n + 1, 0)
        total = np.full(many, n - 2, np.int64)
        for j in range(n):
            total += joined[j : many + j] * _FACTORS[j]
        inside = (of[:many] == of[n - 1 : many + n - 1]) & some[:many]
        found.append((total % BUCKETS)[inside])
        whose.append(of[:many][inside])
    return np.concatenate(found), np.concatenate(whose)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def judge(weights: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the likeliest language (-1: no letter), margin over the second, and fit: both per n-gram, in units."""
    best, margin, fit = np.full(len(texts), -1, np.int64), np.zeros(len(texts), np.int64), np.full(len(texts), -_FAR, np.int64)
    if not len(weights):
        return best, margin, fit
    for a, b in _slices(texts):
        found, of = buckets(texts[a:b])
        # Whole numbers, so their sums as doubles are exact.
        sums = np.array([np.bincount(of, w[found], b - a) for w in weights]).astype(np.int64)
        grams = np.bincount(of, minlength=b - a)
        some = np.flatnonzero(grams)
        top = sums[:, some].argmax(0)
        high = sums[top, some]
        sums[top, some] = np.iinfo(np.int64).min
        second = sums[:, some].max(0)
        best[a + some] = top
        fit[a + some] = high // grams[some]
        margin[a + some] = (high - second) // grams[some] if len(weights) > 1 else _FAR
    return best, margin, fit


def weights_of(counts: np.ndarray) -> np.ndarray:
    """Logarithms of the smoothed shares of each language's buckets, rounded down to whole units."""
    totals = counts.sum(1, keepdims=True)
    return np.floor(UNIT * np.log((counts + PRIOR) / (totals + PRIOR * BUCKETS))).astype(np.int32)


@dataclass
class LanguageModel:
    """Languages in the order of their codes, a row of weights for each, and the limits below which a text is unknown."""

    languages: list[str]
    weights: np.ndarray
    least_margin: int = 0
    least_fit: int = -_FAR

    def named(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[str]:
        sure = (found[0] >= 0) & (found[1] >= self.least_margin) & (found[2] >= self.least_fit)
        return [self.languages[i] if ok else UNKNOWN for i, ok in zip(found[0].tolist(), sure.tolist())]

    def column(self, spark: SparkSession, c: Column) -> Column:
        """(language, margin, fit) of each text, for a column function; NULL and texts without a letter are unknown."""
        sent = spark.sparkContext.broadcast(self)

        @F.pandas_udf("language string, margin long, fit long")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = sent.value
            for batch in batches:
                found = judge(model.weights, batch.tolist())
                yield pd.DataFrame({"language": model.named(found), "margin": found[1], "fit": found[2]})

        return run(letters(c))

    def detector(self, spark: SparkSession):
        """A detector for ``language.with_language`` and what builds on it."""
        return lambda c: self.column(spark, c)["language"]


def _counts(labelled: DataFrame) -> DataFrame:
    """(lang, held, bucket, n): each task adds up its own texts first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, bool], np.ndarray] = {}
        for batch in batches:
            langs, held, texts = (batch.column(i).to_pylist() for i in range(3))
            groups = [(lang, out) for lang, out in zip(langs, held)]
            for a, b in _slices(texts):
                found, of = buckets(texts[a:b])
                names = sorted(set(groups[a:b]))
                at = np.array([names.index(g) for g in groups[a:b]], np.int64)
                added = np.bincount(at[of] * BUCKETS + found, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names, added):
                    sums[name] = sums[name] + row if name in sums else row
                if len(sums) > 4 * LANGUAGES:
                    yield from out_of(sums)
                    sums = {}
        yield from out_of(sums)

    def out_of(sums: dict[tuple[str, bool], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (lang, held), row in sums.items():
            at = np.flatnonzero(row)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array([held] * len(at), pa.bool_()), pa.array(at.astype(np.int32)), pa.array(row[at])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "held", "bucket", "n"])

    found = labelled.mapInArrow(run, "lang string, held boolean, bucket int, n long")
    return found.groupBy("lang", "held", "bucket").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE) -> LanguageModel:
    """Model from the rows that have a language and a letter; without any it calls every text unknown.

    All rows are counted, in one pass, and equal texts as often as they are there. The
    limits are those below which ``share`` of the left-out texts fall (about three
    sixteenths, by the MD5 of the text) when a model of the others judges them rightly.
    Only counts reach the driver: at most ``LANGUAGES`` x ``BUCKETS`` numbers; more languages
    raise ``ValueError``.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.substring(F.md5(F.col(f"`{text}`").cast("binary")), 1, 1).isin(*LEFT_OUT).alias("held"),
        letters(F.col(f"`{text}`")).alias("text"),
    ).where("lang IS NOT NULL AND length(text) > 2")
    languages = [r["lang"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()]
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages.sort(key=lambda x: x.encode())
    found = _counts(rows).toArrow()
    counts = np.zeros((2, len(languages), BUCKETS))
    place = {lang: i for i, lang in enumerate(languages)}
    at = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    held = found.column("held").to_numpy().astype(np.int64)
    counts[held, at, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    model = LanguageModel(languages, weights_of(counts.sum(0)))
    # Margins and fits are whole numbers of a small range, so their frequencies are few rows.
    trial = LanguageModel(languages, weights_of(counts[0]))
    tried = rows.where("held").select("lang", trial.column(spark, F.col("text")).alias("found")).where("found.language = lang")
    limits = []
    for name in ("margin", "fit"):
        table = tried.groupBy(f"found.{name}").count().toArrow()
        limits.append(lowest(table.column(0).to_numpy(), table.column(1).to_numpy(), share))
    model.least_margin, model.least_fit = (limit if limit is not None else usual for limit, usual in zip(limits, (0, -_FAR)))
    return model


def lowest(values: np.ndarray, many: np.ndarray, share: float) -> int | None:
    """The least value that more than the share of all numbers do not exceed."""
    if not len(values):
        return None
    order = np.argsort(values)
    upto = np.cumsum(many[order])
    return int(values[order][np.searchsorted(upto, share * upto[-1], "right")])
