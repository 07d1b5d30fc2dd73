"""Partitions of a large catalogue around pivots, and bounds on the scores that they can hold.

Every item belongs to the pivot that it is most similar to. A partition knows how far its
items are turned away from their pivot at most, and their least and greatest length. By
the triangle inequality of angles no item of it can score higher with a vector than the
vector's angle to the pivot, less that much, allows; partitions below the minimum (or below
the k-th score that a vector has already) are never met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.operators.records import col

#: Items that pivots are chosen from (those of the smallest hashes), and most pivots.
SAMPLE, PIVOTS = 4_096, 256
#: Angles come from cosines with about eight sure digits.
SLACK = 1e-6


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    vectors = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


def _directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero vectors stay) and lengths."""
    lengths = np.sqrt((vectors * vectors).sum(1))
    return vectors / np.where(lengths > 0, lengths, 1)[:, None], lengths


def farthest_first(vectors: np.ndarray, count: int) -> np.ndarray:
    """Directions of ``count`` vectors at most, each the least similar to those before it; equal ones are left out."""
    units, lengths = _directions(vectors[np.sqrt((vectors * vectors).sum(1)) > 0]) if len(vectors) else (vectors, None)
    if not len(units):
        return np.empty((0, vectors.shape[1] if vectors.ndim == 2 else 0))
    chosen, near = [0], units @ units[0]
    while len(chosen) < min(count, len(units)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-12:
            break
        chosen.append(far)
        near = np.maximum(near, units @ units[far])
    return units[chosen]


@dataclass
class Partitions:
    """Pivots with what is known of their items; ``subs`` is the number of blocks of each."""

    pivots: np.ndarray
    angle: np.ndarray
    least: np.ndarray
    most: np.ndarray
    subs: np.ndarray
    #: Items of each.
    count: np.ndarray | None = None

    def cells(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each partition, ascending, and how many parts each cell is cut into.

        A cell holds partitions of ``most`` items together, or one larger partition in parts of that size.
        """
        cell, parts, held = np.zeros(len(self.count), np.int64), [0], 0
        for i, n in enumerate(self.count.astype(np.int64).tolist()):
            if i and held + n > most:
                parts.append(0)
                held = 0
            held += n
            cell[i] = len(parts) - 1
            parts[-1] = -(-held // most)
        return cell, np.array(parts, np.int64)

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The partition of each vector; those without a direction belong to the first."""
        return (_directions(vectors)[0] @ self.pivots.T).argmax(1)

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """The highest score that each vector can have in each partition; -inf for empty ones."""
        units, lengths = _directions(vectors)
        turned = np.arccos(np.clip(units @ self.pivots.T, -1, 1)) - self.angle
        cosine = np.cos(np.clip(turned, 0, np.pi))
        high = np.where(cosine >= 0, self.most, self.least) * cosine * lengths[:, None]
        return np.where(self.subs > 0, high, -np.inf)


def partitions(items: DataFrame, item_block: int, key: str) -> Partitions | None:
    """Partitions of (key, embedding) with blocks of about ``item_block`` items; None without a vector that has a direction."""
    n = items.count()
    drawn = items.orderBy(F.xxhash64(col(key)), col(key)).limit(SAMPLE).select("embedding").toArrow().column(0)
    wanted = 1 if n <= item_block else min(PIVOTS, 4 * -(-n // item_block))
    pivots = farthest_first(matrix(drawn), wanted) if n else np.empty((0, 0))
    if not len(pivots):
        return None
    sent = items.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        count, angle, least, most = np.zeros(len(known), np.int64), np.zeros(len(known)), np.full(len(known), np.inf), np.zeros(len(known))
        for batch in batches:
            if not batch.num_rows:
                continue
            units, lengths = _directions(matrix(batch.column(0)))
            cosines = units @ known.T
            home = cosines.argmax(1)
            # A vector without a direction scores 0 with everything: no angle is too far for it.
            turned = np.where(lengths > 0, np.arccos(np.clip(cosines[np.arange(len(home)), home], -1, 1)), np.pi)
            count += np.bincount(home, minlength=len(known))
            np.maximum.at(angle, home, turned)
            np.minimum.at(least, home, lengths)
            np.maximum.at(most, home, lengths)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[used]) for x in (np.arange(len(known)), count, angle, least, most)], ["part", "n", "angle", "least", "most"]
        )

    rows = items.select("embedding").mapInArrow(measure, "part long, n long, angle double, least double, most double")
    found = rows.groupBy("part").agg(F.sum("n").alias("n"), F.max("angle").alias("angle"), F.min("least").alias("least"), F.max("most").alias("most")).toArrow()
    part = found.column("part").to_numpy()
    angle, least, most, count = (np.zeros(len(pivots)) for _ in range(4))
    angle[part], least[part], most[part] = (found.column(c).to_numpy() for c in ("angle", "least", "most"))
    count[part] = found.column("n").to_numpy()
    count = count.astype(np.int64)
    return Partitions(pivots, angle, least, most, -(-count // item_block), count)


def routed(skills: DataFrame, parts: Partitions, minimum: float, first: bool | None, cell: np.ndarray | None = None) -> DataFrame:
    """(row, embedding, cell, wanted): each vector once beside every cell with partitions that it has to meet, and these.

    ``first``: the one partition where it can score highest, if that reaches the minimum; False: all others that reach the
    minimum and the vector's ``floor``, which stays beside it; None: all that reach the minimum. Without cells every partition is one.
    """
    sent = skills.sparkSession.sparkContext.broadcast((parts, np.arange(len(parts.subs)) if cell is None else cell))
    columns = ["row", "embedding"] + (["floor"] if first is False else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, cell = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                some = batch.slice(start, 4096)
                high = parts.bounds(matrix(some.column(1)))
                each, best = np.arange(len(high)), high.argmax(1)
                if first:
                    rows = np.flatnonzero(high[each, best] >= minimum - SLACK)
                    to = best[rows]
                else:
                    least = np.full(len(high), minimum)
                    if first is False:
                        high[each, best] = -np.inf
                        least = np.maximum(some.column(2).to_numpy(zero_copy_only=False), minimum)
                    rows, to = np.nonzero(high >= least[:, None] - SLACK)
                # Partitions of a cell lie side by side, so that a vector's pairs do as well.
                at = cell[to]
                begins = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (at[1:] != at[:-1])])[: len(rows)])
                chosen = some.take(pa.array(rows[begins]))
                wanted = pa.ListArray.from_arrays(pa.array(np.append(begins, len(rows)).astype(np.int32)), pa.array(to.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*chosen.columns, pa.array(at[begins].astype(np.int32)), wanted], [*columns, "cell", "wanted"]
                )

    given = skills.select(*columns)
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    return given.mapInArrow(run, f"row {kinds['row']}, embedding {kinds['embedding']}{', floor double' if first is False else ''}, cell int, wanted array<int>")


def numbers(values: np.ndarray, at: Column) -> Column:
    """The element of a short array for each row."""
    return F.element_at(F.lit(values.tolist()).cast("array<int>"), at + 1)
