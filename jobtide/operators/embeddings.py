"""Encoding texts as vectors, storing them, and checks on them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.operators.records import col
from jobtide.sources.tables import insert_if_absent

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]


def pending(
    dim: DataFrame, stored: DataFrame, model: str, dim_key: str, stored_key: str, limit: int | None = None
) -> DataFrame:
    """Rows the model has no vector for yet; with a limit, the first ones by key."""
    done = stored.where(F.col("model_name") == model).select(col(stored_key).alias(dim_key))
    rows = dim.join(done, dim_key, "left_anti").select(*[col(c) for c in dim.columns])
    return rows if limit is None else rows.orderBy(dim_key).limit(limit)


def ngram_encoder(dim: int = 64, n: int = 3) -> Encoder:
    """Counts of hashed character n-grams: a model-free default encoder. Each distinct n-gram of a batch is hashed once."""
    @lru_cache(maxsize=1 << 18)
    def bucket(gram: str) -> int:
        return int(hashlib.md5(gram.encode("utf-8")).hexdigest()[:7], 16) % dim

    def encode(texts: list[str]) -> np.ndarray:
        sizes = [max(len(text) - n + 1, 0) for text in texts]
        # Code points of all texts as one array, so that n-grams are made unique as numbers, not as strings.
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        begin = np.concatenate([[0], np.cumsum([len(text) for text in texts])])[:-1]
        rows = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
        grams = np.ascontiguousarray(points[at.astype(np.int64)[:, None] + np.arange(n)]).view(f"V{4 * n}").ravel()
        distinct, which = np.unique(grams, return_inverse=True)
        buckets = np.array([bucket(g.tobytes().decode("utf-32-le", "surrogatepass")) for g in distinct], np.int64)
        cells = rows * dim + (buckets[which] if len(which) else which)
        return np.bincount(cells, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float64)

    return encode


def encode(
    df: DataFrame, text_column: str, load_encoder: Callable[[], Encoder], batch_size: int = 64,
    into: str = "embedding",
) -> DataFrame:
    """Vectors of a text column.

    ``load_encoder`` runs once per task, inside the task, so that a model is
    neither shipped with the plan nor loaded per batch.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_encoder()
        for texts in batches:
            values = texts.tolist()
            out: list = [None] * len(values)
            known = [i for i, t in enumerate(values) if t is not None]
            for start in range(0, len(known), batch_size):
                part = known[start:start + batch_size]
                for i, vector in zip(part, model([values[i] for i in part])):
                    out[i] = np.asarray(vector, dtype=np.float64)
            yield pd.Series(out, dtype="object")

    return df.withColumn(into, run(col(text_column)))


def l2_normalise(v: Column) -> Column:
    """Vector of unit length; a zero vector stays as it is."""
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    # The norm is the argument of a lambda: in the body of one it would be computed again for every element.
    unit = F.transform(F.array(F.sqrt(squares)), lambda norm: F.when(
        norm > 0, F.transform(v, lambda x: x.cast("double") / norm)
    ).otherwise(v.cast("array<double>")))
    return unit[0]


def normalise_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, l2_normalise(col(column)))


def store_vectors(new: DataFrame, stored: DataFrame, model: str, key: str) -> DataFrame:
    """The vector table after adding a model's vectors; stored vectors win."""
    rows = new.select(col(key), F.lit(model).alias("model_name"), "embedding")
    return insert_if_absent(rows, stored.select(*rows.columns), [key, "model_name"])


def length_profile(df: DataFrame, text_column: str) -> DataFrame:
    """One row: longest text and 95th percentile of the lengths, interpolated."""
    lengths = df.where(col(text_column).isNotNull()).select(F.length(col(text_column)).alias("n"))
    return lengths.agg(
        F.max("n").alias("max_chars"), F.percentile("n", F.lit(0.95)).alias("p95_chars")
    )


def of_model(df: DataFrame, model: str, key: str) -> DataFrame:
    """Vectors of one model; the table is stored by model, so only its files are read."""
    return df.where(F.col("model_name") == model).select(col(key), "embedding")


def dimension_check(df: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: vectors, distinct widths, and whether the vectors can be compared."""
    sizes = df.agg(
        F.count("*").alias("vectors"), F.countDistinct(F.size(col(column))).alias("widths")
    )
    usable = (F.col("vectors") > 0) & (F.col("widths") == 1)
    return sizes.withColumn("usable", usable)
