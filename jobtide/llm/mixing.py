"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken as often as the source's target asks for, a
number with a fraction. Two fractions at a time are rounded: words are moved at random
from one document to the other until one of the two is whole. That keeps each
document's expectation, and the words of the source. What is left of each group of
documents goes up a tree of groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from jobtide.llm.bytetext import column, flat, map_texts, mix, words
from jobtide.llm.components import written

#: Documents of a leaf of the tree, and leaves or groups that one group above joins.
LEAF, FANOUT = 1_024, 64
#: Sources that one mix may have; their totals are on the driver.
SOURCES = 100_000
_NEAR = 1e-9


def targets(sizes: dict[str | None, int], weights: list[float], most: float = 3.0) -> dict[str | None, float]:
    """Words to take of each source: shares of all words by weight, none above ``most`` times the source's own.

    Sources stand in code-point order, NULL last, and take the weights in turn. What is cut
    off goes to the others by weight, until none is above its bound.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, bound = float(sum(sizes.values())), {s: most * sizes[s] for s in order}
    capped: set[str | None] = set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(bound[s] for s in order if s in capped)
        scale = sum(weight[s] for s in free)
        share = {s: rest * weight[s] / scale for s in free} if scale else {}
        above = [s for s in free if share[s] > bound[s]]
        if not above:
            return {s: bound[s] if s in capped else share[s] for s in order}
        capped.update(above)


def pivotal(parts: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions in the given order; returns them, and the index of the one that is left between 0 and 1 (-1: none).

    Words move between the open document and the next one; the direction is drawn so that
    each fraction keeps its expectation.
    """
    p, open_ = parts.astype(float).tolist(), -1
    sizes, draws = sizes.tolist(), draws.tolist()
    for i in range(len(p)):
        if p[i] < _NEAR or p[i] > 1 - _NEAR:
            p[i] = float(round(p[i]))
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b = sizes[open_], sizes[i]
        up = min((1 - p[open_]) * a, p[i] * b)
        down = min(p[open_] * a, (1 - p[i]) * b)
        move = up if draws[i] * (up + down) < down else -down
        p[open_] += move / a
        p[i] -= move / b
        left = -1
        for j in (open_, i):
            if p[j] < _NEAR or p[j] > 1 - _NEAR:
                p[j] = float(round(p[j]))
            else:
                left = j
        open_ = left
    return np.array(p), open_


def with_sizes(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``size``: the number of words ``[^\\x20\\x09-\\x0D]+`` of the whole text (NULL: 0)."""
    def make():
        def work(texts: pa.Array) -> list:
            return [np.diff(words(*flat(texts))[2]).astype(np.int64)]

        return work

    return map_texts(df, text, [StructField("size", LongType())], make, keep)


def decide(
    df: DataFrame, weights: list[float], key: str = "doc_id", source: str = "source", text: str = "text", most: float = 3.0,
    seed: int = 1, leaf: int = LEAF, fanout: int = FANOUT,
) -> tuple[DataFrame, DataFrame]:
    """The sized rows (key, source, h, size), and the decisions (key, source, h, size, source_size, target, copies).

    Rows with equal key, source and text are one unit of all their words and are taken
    equally often, so the decision is the same for each. Documents without words get the
    whole part of their rate. Only narrow rows move; a source's documents are spread over
    groups of about ``leaf`` units by hash, however large the source is. Draws depend on
    the seed, the keys and the texts alone, so that reruns agree.
    """
    spark = df.sparkSession
    given = df.select(
        column(key).alias("__key"), column(source).cast("string").alias("__source"),
        F.xxhash64(column(text).cast("string")).alias("h"), column(text).cast("string").alias("text"),
    )
    sized = written(with_sizes(given, "text", ["__key", "__source", "h"]), "sized")
    units = sized.groupBy("__key", "__source", "h", "size").agg(F.count(F.lit(1)).alias("m"))
    units = written(units.select("*", F.xxhash64("__key", "h", F.lit(seed)).alias("r")), "units")
    totals = units.groupBy("__source").agg(F.sum(F.expr("size * m")).alias("s"), F.count(F.lit(1)).alias("n")).limit(SOURCES + 1).collect()
    if len(totals) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    sizes = {r["__source"]: r["s"] for r in totals}
    wanted = targets(sizes, weights, most)
    rows = [
        (r["__source"], r["s"], wanted[r["__source"]], min(wanted[r["__source"]] / r["s"], float(most)) if r["s"] else 0.0, max(1, -(-r["n"] // leaf)))
        for r in totals
    ]
    table = spark.createDataFrame(rows, "__source string, source_size long, target double, rate double, leaves long")
    # At most SOURCES rows of a name and four numbers.
    joined = units.join(F.broadcast(table), units["__source"].eqNullSafe(table["__source"])).drop(table["__source"])
    columns = ["__key", "__source", "h", "size", "m", "r", "source_size", "target", "whole"]
    level = joined.select(
        *columns[:-1], F.floor(F.col("rate") + _NEAR).alias("whole"),
        F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("rate") - F.floor(F.col("rate") + _NEAR))).otherwise(0.0).alias("p"),
        F.pmod("r", "leaves").alias("group"),
    )
    kind = level.schema
    decided, height, widest = [], 0, max([r[4] for r in rows], default=1)
    while True:
        done = written(level.groupBy("__source", "group").applyInPandas(_rounder(height), kind), f"level{height}")
        decided.append(done.where("group < 0"))
        left = done.where("group >= 0")
        if widest == 1:
            # One document per source at most is left. The nearer whole number keeps the source nearest to its target.
            decided.append(left.withColumn("p", F.round("p")))
            break
        widest = -(-widest // fanout)
        level = left.withColumn("group", F.floor(F.col("group") / fanout))
        height += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    out = out.select("__key", "__source", "h", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))
    return sized, written(out, "decisions")


def _rounder(height: int):
    """Rounds one group of a level; what is left open keeps its group, the others get -1."""
    salt = np.uint64((height + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)

    def rounded(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "r", "h"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        draws = mix(part["r"].to_numpy().view(np.uint64) + salt) / float(1 << 64)
        part["p"], left = pivotal(part["p"].to_numpy(), (part["size"] * part["m"]).to_numpy(), draws)
        part["group"] = np.where(np.arange(len(part)) == left, part["group"], -1)
        return part

    return rounded


def _beside(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows with their decision; NULLs match."""
    d = decisions.select(*[F.col(c).alias("d" + c) for c in ("__key", "__source", "h")], "source_size", "target", "copies")
    same = F.col("__key").eqNullSafe(F.col("d__key")) & F.col("__source").eqNullSafe(F.col("d__source")) & F.col("h").eqNullSafe(F.col("dh"))
    return rows.join(d, same).drop("d__key", "d__source", "dh")


def report(df: DataFrame, weights: list[float], key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """(key, size, source_size, target, taken) of each row; taken is its copies times its size.

    NULL texts have size 0 and take nothing; a NULL source is one like others, the last;
    NULL keys are fine. Rows with equal key, source and text are taken equally often, and
    every repeated row has a row. Other columns are not read; no rows give none.
    """
    sized, decisions = decide(df, weights, key, source, text, **options)
    return _beside(sized, decisions).select(F.col("__key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(df: DataFrame, weights: list[float], key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of df, each as often as it is taken. No rows give no rows; columns stay as they are."""
    _, decisions = decide(df, weights, key, source, text, **options)
    rows = df.select(
        *[column(c) for c in df.columns], column(key).alias("__key"), column(source).cast("string").alias("__source"),
        F.xxhash64(column(text).cast("string")).alias("h"),
    )
    taken = _beside(rows, decisions.where("copies > 0"))
    return taken.withColumn("__copy", F.explode(F.expr("sequence(1L, copies)"))).select(*[column(c) for c in df.columns])
