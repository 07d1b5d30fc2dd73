"""Top-k similarity of skill vectors to catalogue vectors, exact and blocked.

No pair below the limits is ever emitted: vectors meet in blocks, as dense matrix
products that emit at most k rows per skill. A second step keeps the k best of the
blocks.

Catalogues are small beside the skills: one that fits a block goes to the tasks, and no
skill is copied at all. A larger one is cut into partitions around pivots, and a skill
meets only those that can hold an item above its limits (see ``pivots``): first the one where it
can score highest, then, with the k-th score found there, the others. Many partitions share a cell,
so that a skill moves once to each cell, however many of its partitions it has to meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.operators import pivots
from jobtide.operators.pivots import matrix as _matrix
from jobtide.operators.records import col
from jobtide.session import cut_lineage

# Scores are compared to this many digits, so that ties between equal vectors do
# not depend on the shape of the block they were computed in.
SCORE_DIGITS = 10
# Candidates are taken this much below a limit, and decided after rounding.
SLACK = 1e-9
# Bytes of vectors (as doubles) on each side of a meeting, and vectors on each side where all pairs are asked for: its
# result is one table, of that many pairs at most.
CELL_BYTES, PAIR_SKILLS, PAIR_ITEMS = 16 << 20, 8192, 4096
# Scores found in a meeting before those that are no longer among a vector's k best are dropped.
HELD = 1 << 17


def _first_k(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, place: np.ndarray, top_k: int) -> tuple[np.ndarray, ...]:
    """The k highest values of each row, ties by place."""
    order = np.lexsort((place, -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    taken = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < top_k
    return rows[taken], cols[taken], values[taken]


def _block_scores(top_k: int | None, minimum: float, slice_rows: int):
    """Function of two Arrow tables: rows (skill position, item position, similarity)."""

    def best(left: np.ndarray, right: np.ndarray):
        for start in range(0, len(left), slice_rows):
            scores = left[start:start + slice_rows] @ right.T
            keep = scores >= minimum - SLACK
            # A selective minimum leaves few pairs; else cut each row near its k-th score.
            crowded = top_k is not None and top_k < scores.shape[1] and np.count_nonzero(keep) > 16 * top_k * len(scores)
            if crowded:
                kth = np.partition(scores, scores.shape[1] - top_k, axis=1)[:, -top_k]
                keep &= scores >= kth[:, None] - SLACK
            found = np.flatnonzero(keep)
            rows, cols = np.divmod(found, scores.shape[1])
            values = np.round(scores.ravel()[found], SCORE_DIGITS)
            enough = values >= minimum
            rows, cols, values = rows[enough], cols[enough], values[enough]
            if top_k is not None:
                # Columns are in item order.
                rows, cols, values = _first_k(rows, cols, values, cols, top_k)
            yield rows + start, cols, values

    return best


class _Side:
    """Vectors with their lengths, and again in single precision if no product of theirs leaves its range."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.lengths = vectors, np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.single = vectors.astype(np.float32) if self.lengths.max(initial=0) < 1e15 else None


def _above(left: _Side, some: np.ndarray, right: _Side, begin: int, end: int, least: np.ndarray, top_k: int, slice_rows: int):
    """Per slice of some rows: (row, column, score) that reach the row's least score, cut near its k-th in a crowded slice.

    All pairs are looked at in single precision, with room for its error; the few that pass get their score in double precision.
    """
    single = left.single is not None and right.single is not None
    a, b = (left.single, right.single) if single else (left.vectors, right.vectors)
    columns, down = b[begin:end].T, a.dtype.type(-np.inf)
    # Both vectors are rounded once, and each of the products and sums: twice the textbook bound.
    error = 2 * (a.shape[1] + 4) * (2.0**-24 if single else 2.0**-53) * np.fmax.reduce(right.lengths[begin:end], initial=0)
    for start in range(0, len(some), slice_rows):
        mine = some[start:start + slice_rows]
        scores = a[mine] @ columns
        room = SLACK + error * left.lengths[mine]
        # Rounded down, a bound in single precision lets no less through.
        bound = np.nextafter((least[mine] - room).astype(a.dtype), down)
        found = np.flatnonzero(scores >= bound[:, None])
        if top_k < scores.shape[1] and len(found) > 16 * top_k * len(scores):
            kth = np.partition(scores, scores.shape[1] - top_k, axis=1)[:, -top_k]
            bound = np.fmax(bound, np.nextafter((kth - 2 * room).astype(a.dtype), down))
            found = np.flatnonzero(scores >= bound[:, None])
        if len(found):
            at, cols = np.divmod(found, scores.shape[1])
            rows, cols = mine[at], cols + begin
            values = np.round(np.einsum("ij,ij->i", left.vectors[rows], right.vectors[cols]), SCORE_DIGITS)
            enough = values >= least[rows]
            yield rows[enough], cols[enough], values[enough]


def score_pairs(
    skills: DataFrame,
    items: DataFrame,
    top_k: int | None = 3,
    minimum: float | None = None,
    skill_key: str = "skill_id",
    item_key: str = "tks_id",
    skill_block: int = 4096,
    item_block: int = 32768,
    slice_rows: int = 256,
    item_bytes: int = 64 << 20,
) -> DataFrame:
    """(skill, item, similarity) at or above the minimum (0.55), at most k per skill and item block.

    With ``top_k=None`` all pairs at or above the minimum are kept, which the caller
    then has to name: a low one gives very many pairs. Both sides hold unit vectors
    in ``embedding`` and are unique in their key.

    A catalogue of at most ``item_block`` items and ``item_bytes`` bytes goes to the
    tasks, and no skill moves. Of a larger one a skill meets the blocks that may hold an
    item for it. The results are the same.
    """
    if top_k is None and minimum is None:
        raise ValueError("all pairs need a minimum similarity")
    minimum = 0.55 if minimum is None else minimum
    best = _block_scores(top_k, minimum, slice_rows)
    fields = {f.name: f.dataType.simpleString() for f in skills.schema.fields + items.schema.fields}
    schema = f"`{skill_key}` {fields[skill_key]}, `{item_key}` {fields[item_key]}, similarity double"
    vector = F.col("embedding").cast("array<double>").alias("embedding")

    def moved(df: DataFrame) -> Column:
        """Vectors as they are stored, where these are single or double precision: doubles made of them are twice as large."""
        return col("embedding") if df.schema["embedding"].dataType.simpleString() == "array<float>" else vector

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        """``b`` is sorted by its key."""
        if a.num_rows and b.num_rows:
            parts = list(best(_matrix(a["embedding"]), _matrix(b["embedding"])))
            rows, cols, values = (np.concatenate(x) for x in zip(*parts))
        else:
            rows, cols, values = np.empty(0, int), np.empty(0, int), np.empty(0)
        return pa.table({
            skill_key: a[skill_key].take(pa.array(rows)),
            item_key: b[item_key].take(pa.array(cols)),
            "similarity": pa.array(values, pa.float64()),
        })

    # One row more than the bound tells a larger catalogue; no more of it comes to the driver.
    known = items.select(col(item_key), vector)
    width = items.agg(F.max(F.size("embedding"))).first()[0] or 0
    if item_block * max(width, 1) * 8 <= item_bytes or items.limit(item_block + 1).count() * width * 8 <= item_bytes:
        whole = known.limit(item_block + 1).toArrow()
        if whole.num_rows <= item_block:
            sent = skills.sparkSession.sparkContext.broadcast(whole.sort_by(item_key))

            def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for start in range(0, batch.num_rows, skill_block):
                        yield from block(pa.Table.from_batches([batch.slice(start, skill_block)]), sent.value).to_batches()

            return skills.select(col(skill_key), vector).mapInArrow(meet, schema)

    known = items.select(col(item_key), moved(items))
    parts = pivots.partitions(known, item_block, item_key)
    if parts is None:
        # Without a vector that has a direction all scores are 0.
        parts = pivots.Partitions(np.zeros((1, width or 1)), np.full(1, np.pi), np.zeros(1), np.zeros(1), np.ones(1, int), np.array([known.count()]))
    fitting = max(1, CELL_BYTES // (8 * max(width, 1)))
    cell, subs = parts.cells(fitting if top_k is not None else min(fitting, PAIR_ITEMS))
    most_skills = fitting if top_k is not None else min(fitting, PAIR_SKILLS)
    sent_parts = skills.sparkSession.sparkContext.broadcast(parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = sent_parts.value.home(_matrix(batch.column(1))) if batch.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home.astype(np.int32)), pa.array(cell[home].astype(np.int32))], [item_key, "embedding", "part", "cell"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    placed = known.mapInArrow(place, f"`{item_key}` {kinds[item_key]}, embedding {kinds['embedding']}, part int, cell int")
    placed = placed.withColumn("sub", F.pmod(F.xxhash64(col(item_key)), pivots.numbers(subs, F.col("cell"))).cast("int"))
    rows = skills.select(col(skill_key).alias("row"), moved(skills))

    def join_blocks(a: pa.Table, b: pa.Table) -> pa.Table:
        """Every vector with the items of the partitions that it wants, in blocks; of a cell it keeps its k best.

        A vector that has k scores, from before or from the partitions met so far, takes no lower one.
        """
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        least = np.full(a.num_rows, float(minimum))
        if "floor" in a.column_names:
            least = np.maximum(least, a["floor"].to_numpy())

        def fewer() -> None:
            """Of what is found the k best of each vector, and no vector takes less from now on than its k-th."""
            at, cols, values = (np.concatenate(x) for x in zip(*found))
            at, cols, values = _first_k(at, cols, values, order[cols], top_k)
            found[:] = [(at, cols, values)]
            if len(at):
                last = np.flatnonzero(np.concatenate([at[1:] != at[:-1], [True]]))
                full = last[np.diff(last, prepend=-1) >= top_k]
                least[at[full]] = np.maximum(least[at[full]], values[full])

        if a.num_rows and b.num_rows:
            b = b.sort_by([("part", "ascending"), (item_key, "ascending")])
            left, right, part = _matrix(a["embedding"]), _matrix(b["embedding"]), b["part"].to_numpy()
            wanted = a["wanted"].combine_chunks()
            wants, owner = wanted.flatten().to_numpy(), np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy())
            one, other = (_Side(left), _Side(right)) if top_k is not None else (None, None)
            order, many = np.argsort(pc.sort_indices(b[item_key]).to_numpy()), 0
            begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            for begin, end in zip(begins, [*begins[1:], len(part)]):
                mine = owner[wants == part[begin]]
                for i in range(0, len(mine), skill_block):
                    some = mine[i:i + skill_block]
                    for j in range(begin, end, item_block):
                        until = min(j + item_block, end)
                        if top_k is None:
                            found += [(some[r], c + j, v) for r, c, v in best(left[some], right[j:until])]
                            continue
                        made = list(_above(one, some, other, j, until, least, top_k, slice_rows))
                        found += made
                        many += sum(len(r) for r, _, _ in made)
                        if many > HELD:
                            fewer()
                            many = 0
            if top_k is not None:
                fewer()
        at, cols, values = (np.concatenate(x) for x in zip(*found))
        return pa.table({skill_key: a["row"].take(pa.array(at)), item_key: b[item_key].take(pa.array(cols)), "similarity": pa.array(values, pa.float64())})

    def meet_parts(routed: DataFrame) -> DataFrame:
        # How many skills come to each cell: one small row for each, on the driver. Meetings are many enough for all tasks.
        counts = {r["cell"]: r["count"] for r in routed.groupBy("cell").count().collect()}
        meetings = sum(n * int(subs[c]) for c, n in counts.items())
        each = min(most_skills, max(skill_block, -(-meetings // (4 * skills.sparkSession.sparkContext.defaultParallelism))))
        shares = np.array([-(-counts.get(i, 0) // each) for i in range(len(subs))])
        left = routed.withColumn("share", F.pmod(F.xxhash64("row"), pivots.numbers(shares, F.col("cell"))).cast("int"))
        left = left.withColumn("sub", F.explode(F.sequence(F.lit(0), pivots.numbers(subs, F.col("cell")) - 1)))
        right = placed.withColumn("shares", pivots.numbers(shares, F.col("cell"))).where("shares > 0")
        right = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        grid = ["cell", "sub", "share"]
        return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(join_blocks, schema)

    if top_k is None:
        return meet_parts(pivots.routed(rows, parts, minimum, None, cell))
    # Checkpointed: the floors and the result both need it.
    first = cut_lineage(meet_parts(pivots.routed(rows, parts, minimum, True, cell)))
    kth = top_items(first, top_k, skill_key, item_key).groupBy(col(skill_key).alias("row"))
    kth = kth.agg(F.when(F.count("*") >= top_k, F.min("similarity")).alias("floor"))
    floors = rows.join(kth, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = first.unionByName(meet_parts(pivots.routed(floors, parts, minimum, False, cell)))
    return top_items(found, top_k, skill_key, item_key)


def rank_items(scores: DataFrame, skill_key: str = "skill_id", item_key: str = "tks_id") -> DataFrame:
    """Rank within a skill by similarity, ties by item."""
    order = Window.partitionBy(skill_key).orderBy(F.desc("similarity"), item_key)
    return scores.withColumn("rank", F.row_number().over(order))


def top_items(
    scores: DataFrame, top_k: int, skill_key: str = "skill_id", item_key: str = "tks_id"
) -> DataFrame:
    """The k best rows per skill."""
    return rank_items(scores, skill_key, item_key).where(F.col("rank") <= top_k).drop("rank")


def top_matches(
    skills: DataFrame,
    items: DataFrame,
    top_k: int = 3,
    minimum: float = 0.55,
    skill_key: str = "skill_id",
    item_key: str = "tks_id",
    **blocking: int,
) -> DataFrame:
    """The k best items per skill at or above the minimum similarity."""
    scores = score_pairs(skills, items, top_k, minimum, skill_key, item_key, **blocking)
    return top_items(scores, top_k, skill_key, item_key)


def similarity_rows(matches: DataFrame, model: str) -> DataFrame:
    """Matches in the shape of the similarity table."""
    return matches.select("skill_id", "tks_id", F.lit(model).alias("model_name"), "similarity")
