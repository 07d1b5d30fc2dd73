"""Exact top-k search by inner product, with a KD-tree per shard.

The space is cut into regions by the medians of a bounded sample, widest dimension first,
and a region into shards by hash. A shard's tree goes on splitting at medians and keeps the
tight bounding box of every node. A query visits the leaves in the order of the largest
score that their boxes allow, and stops where that can't reach its kth score any more. It
searches its own shard first; the kth score found there goes with it, and only to the
regions whose box still allows as much.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from jobtide.llm.bytetext import column
from jobtide.llm.components import written

#: Vectors of a shard (expected) and of a leaf, and queries that travel together.
SHARD, LEAF, BLOCK = 16_384, 128, 512
#: Most regions, and the vectors (those of the smallest hashes) whose medians cut them.
REGIONS, SAMPLE = 1_024, 16_384
#: Components are kept within this range: beyond it no score fits a long.
WIDEST = float(1 << 62)
#: Scores are exact as doubles below this.
EXACT = float(1 << 53)
#: Largest score that is told apart, and that fits the result.
LARGEST, LONG = 10**38 - 1, (1 << 63) - 1


class Tree:
    """Leaves of a KD-tree, each with its tight box."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order, leaves = np.argsort(ids, kind="stable"), []
        stack = [order] if len(order) else []
        while stack:
            part = stack.pop()
            if len(part) <= leaf:
                leaves.append(part)
                continue
            x = vectors[part]
            wide = int(np.argmax(x.max(0) - x.min(0)))
            half = np.argpartition(x[:, wide], len(part) // 2)
            stack += [part[half[: len(part) // 2]], part[half[len(part) // 2 :]]]
        self.ids = [ids[p] for p in leaves]
        self.vectors = [vectors[p] for p in leaves]
        self.low = np.array([v.min(0) for v in self.vectors])
        self.high = np.array([v.max(0) for v in self.vectors])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest score that each leaf's box allows each query."""
        return bounds(queries, self.low, self.high)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, id, score) of the k best of each query, none below its floor; ties go to smaller ids.

        Queries go through their leaves together, best bound first, in waves of growing
        size; after each wave the kth scores are propagated. Scores are doubles where
        these are exact, else Python's integers (of all that may reach the floor).
        """
        none = np.empty(0, np.int64)
        best_q, best_id, best_s = none, none, none
        if not self.ids or not len(queries):
            return best_q, best_id, best_s
        reach = float((np.abs(queries).max(0) * np.maximum(np.abs(self.low), np.abs(self.high)).max(0)).sum())
        exact = reach < EXACT
        # What rounding may add to a score or bound.
        slack = 0.0 if exact else reach * queries.shape[1] * 2.0**-50
        bound = self.bounds(queries) + slack
        order = np.argsort(-bound, 1, kind="stable")
        floor = floors.astype(np.float64).copy()
        done, wave = 0, 1
        while done < order.shape[1]:
            part = order[:, done : done + wave]
            open_ = np.take_along_axis(bound, part, 1) >= floor[:, None]
            if not open_.any():
                break
            rows, slots = np.nonzero(open_)
            leaf_of = part[rows, slots]
            by_leaf = np.argsort(leaf_of, kind="stable")
            rows, leaf_of = rows[by_leaf], leaf_of[by_leaf]
            cuts = np.append(np.flatnonzero(np.append(True, leaf_of[1:] != leaf_of[:-1])), len(leaf_of))
            found = [(best_q, best_id, best_s)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                leaf, mine = leaf_of[a], rows[a:b]
                scores = queries[mine] @ self.vectors[leaf].T
                q, c = np.nonzero((scores + slack >= floor[mine][:, None]) & (self.ids[leaf][None, :] != query_ids[mine][:, None]))
                if exact:
                    values = scores[q, c].astype(np.int64)
                else:
                    values = np.array([whole_score(queries[mine[i]], self.vectors[leaf][j]) for i, j in zip(q, c)], object)
                found.append((mine[q], self.ids[leaf][c], values))
            best_q, best_id, best_s = (np.concatenate(x) for x in zip(*found))
            rank = ranked(best_q, best_id, best_s)
            best_q, best_id, best_s = best_q[rank], best_id[rank], best_s[rank]
            place = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
            full = place == k - 1
            # A double may be above the integer it stands for.
            kth = best_s[full].astype(np.float64)
            floor[best_q[full]] = np.maximum(floor[best_q[full]], kth if exact else np.nextafter(kth, -np.inf))
            keep = place < k
            best_q, best_id, best_s = best_q[keep], best_id[keep], best_s[keep]
            done, wave = done + wave, 2 * wave
        return best_q, best_id, best_s


def whole_score(x: np.ndarray, y: np.ndarray) -> int:
    """Inner product of whole numbers held as doubles, as an integer of any size; beyond ``LARGEST`` all are that."""
    total = sum(int(a) * int(b) for a, b in zip(x.tolist(), y.tolist()))
    return max(-LARGEST, min(LARGEST, total))


def ranked(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Order by query, score from high to low, and id."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores, queries))
    return np.array(sorted(range(len(ids)), key=lambda i: (queries[i], -scores[i], ids[i])), np.int64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest score that each box allows each query."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


@dataclass
class Regions:
    """Cuts of a binary tree, in the order of a heap: region i is leaf i of its lowest level."""

    wide: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, count: int) -> Regions:
        """About ``count`` regions (a power of two) by the medians of the vectors."""
        depth = max(0, int(np.ceil(np.log2(max(count, 1)))))
        wide, at = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = {0: np.arange(len(vectors))}
        for node in range(len(wide)):
            part = parts.pop(node)
            x = vectors[part]
            if len(part):
                wide[node] = np.argmax(x.max(0) - x.min(0))
                at[node] = np.median(x[:, wide[node]])
            right = x[:, wide[node]] >= at[node] if len(part) else np.empty(0, bool)
            parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
        return cls(wide, at)

    def __len__(self) -> int:
        return len(self.wide) + 1

    def place(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        while len(self.wide) and len(node) and node[0] < len(self.wide):
            node = 2 * node + 1 + (vectors[np.arange(len(node)), self.wide[node]] >= self.at[node])
        return node - len(self.wide)


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): each component x becomes floor(scale * x), x as a double; v holds these whole numbers as doubles.

    Vectors that are NULL or hold NULL or components that aren't finite are left out, and
    so are NULL keys. Lengths may differ: the shorter of two is as if filled with zeros.
    Components beyond 2**62 count as 2**62: no score of them fits the result.
    """
    x = column(vector).cast("array<double>")
    sound = column(key).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))

    def whole(e: F.Column) -> F.Column:
        # Doubles from 2**53 on are whole; as decimals or longs they might not fit.
        inside = F.least(F.greatest(e, F.lit(-WIDEST / scale)), F.lit(WIDEST / scale)) * float(scale)
        return F.when(F.abs(inside) < EXACT, F.floor(inside).cast("double")).otherwise(inside)

    return df.where(sound).select(column(key).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), width))
    sizes = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


_HITS = "query_id long, id long, score decimal(38,0)"


def _hits(query_ids: np.ndarray, found: tuple) -> pa.RecordBatch:
    q, ids, scores = found
    values = pa.array([int(s) for s in scores.tolist()], pa.decimal128(38)) if scores.dtype == object else pa.array(scores).cast(pa.decimal128(38))
    return pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids), values], ["query_id", "id", "score"])


def top_k(vectors: DataFrame, is_query: str, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score) of each query's k highest integer inner products; ties go to smaller ids.

    ``vectors`` has (id, v), v whole numbers; the rows for which the SQL condition ``is_query`` holds are
    searched for among all rows with another id. Fewer candidates give fewer rows; no
    queries give none. Repeated ids are candidates of their own, and queries of their own
    share one answer. Ranks are exact for scores up to 10**38; one that doesn't fit a long is
    given as the nearest long.
    """
    spark = vectors.sparkSession
    given = written(vectors.select("id", F.col("v").cast("array<double>").alias("v")), "vectors")
    facts = given.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = facts["n"], max(facts["width"] or 0, 1)
    drawn = given.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toArrow().column(0)
    regions = spark.sparkContext.broadcast(Regions.of(_matrix(drawn, width), min(REGIONS, -(-n // shard))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = regions.value.place(_matrix(batch.column(1), width)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], ["id", "v", "asks", "region"])

    asked = given.select("id", "v", F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"))
    placed = written(asked.mapInArrow(place, "id long, v array<double>, asks boolean, region int"), "placed")
    boxes, subs = _boxes(placed, len(regions.value), width, shard)
    sub = F.pmod(F.xxhash64("id", "v"), F.element_at(F.lit(subs.tolist()).cast("array<int>"), F.col("region") + 1)).cast("int")
    rows = placed.withColumn("sub", sub)
    tasks = max(1, int(subs.sum()))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, matrix, asks in _shards(batches, width):
            some = np.flatnonzero(asks)
            some = some[np.unique(ids[some], return_index=True)[1]]
            tree = Tree(ids, matrix)
            for a in range(0, len(some), block):
                mine = some[a : a + block]
                yield _hits(ids[mine], tree.search(ids[mine], matrix[mine], np.full(len(mine), -np.inf), k))

    dealt = rows.select("region", "sub", "id", "v", "asks").repartition(tasks, "region", "sub").sortWithinPartitions("region", "sub")
    home = written(dealt.mapInArrow(own, _HITS), "home")
    if tasks == 1:
        found = home
    else:
        asking = _routed(rows, home, boxes, subs, width, k)
        both = rows.select("region", "sub", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("floor")).unionByName(
            asking.select("region", "sub", F.lit(1).alias("kind"), "id", "v", "floor")
        )

        def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, parts, tree = None, [], None
            for batch in batches:
                keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
                cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if a == b:
                        continue
                    part = batch.slice(a, b - a)
                    if keys[a][:2] != current:
                        current, parts, tree = keys[a][:2], [], None
                    ids, matrix = part.column(3).to_numpy(), _matrix(part.column(4), width)
                    if keys[a][2] == 0:
                        parts.append((ids, matrix))
                        continue
                    tree = tree or Tree(np.concatenate([p[0] for p in parts] or [np.empty(0, np.int64)]), np.concatenate([p[1] for p in parts] or [np.empty((0, width))]))
                    floor = part.column(5).to_numpy()
                    for c in range(0, len(ids), block):
                        yield _hits(ids[c : c + block], tree.search(ids[c : c + block], matrix[c : c + block], floor[c : c + block], k))

        dealt = both.repartition(tasks, "region", "sub").sortWithinPartitions("region", "sub", "kind")
        found = home.unionByName(dealt.mapInArrow(away, _HITS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", F.greatest(F.least("score", F.lit(LONG)), F.lit(-LONG)).cast("long").alias("score"))


def _shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """((region, sub), ids, vectors, whether they ask) of each shard, from rows in order of it."""
    key, held = None, []
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and keys[a] != key:
                yield key, *_joined(held)
                held = []
            key = keys[a]
            part = batch.slice(a, b - a)
            held.append((part.column(2).to_numpy(), _matrix(part.column(3), width), part.column(4).to_numpy(zero_copy_only=False)))
    if held:
        yield key, *_joined(held)


def _joined(held: list[tuple]) -> tuple:
    return tuple(np.concatenate(x) for x in zip(*held))


def _boxes(placed: DataFrame, regions: int, width: int, shard: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Box of each region, and its number of shards; at most ``REGIONS`` x width numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, many = np.full((regions, width), np.inf), np.full((regions, width), -np.inf), np.zeros(regions, np.int64)
        for batch in batches:
            if batch.num_rows:
                region, matrix = batch.column(1).to_numpy(), _matrix(batch.column(0), width)
                np.minimum.at(low, region, matrix)
                np.maximum.at(high, region, matrix)
                many += np.bincount(region, minlength=regions)
        used = np.flatnonzero(many)
        dims = np.tile(np.arange(width, dtype=np.int32), len(used))
        columns = [np.repeat(used, width).astype(np.int32), dims, low[used].ravel(), high[used].ravel(), np.where(dims == 0, np.repeat(many[used], width), 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["region", "dim", "low", "high", "n"])

    rows = placed.select("v", "region").mapInArrow(run, "region int, dim int, low double, high double, n long")
    got = rows.groupBy("region", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow()
    low, high, many = np.zeros((regions, width)), np.zeros((regions, width)), np.zeros(regions, np.int64)
    at = got.column("region").to_numpy(), got.column("dim").to_numpy()
    low[at], high[at] = got.column("low").to_numpy(), got.column("high").to_numpy()
    np.add.at(many, at[0], got.column("n").to_numpy())
    return (low, high), -(-many // shard)


def _routed(rows: DataFrame, home: DataFrame, boxes: tuple, subs: np.ndarray, width: int, k: int) -> DataFrame:
    """(region, sub, id, v, floor) of each query beside the shards other than its own whose region may hold as much as its kth score."""
    kth = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("kth"))
    asking = rows.where("asks").groupBy("id").agg(F.min(F.struct("region", "sub", "v")).alias("q"))
    asking = asking.join(kth, asking["id"] == kth["query_id"], "left").select("id", "q.v", F.col("q.region").alias("own"), F.col("q.sub").alias("own_sub"), "kth")
    sent = rows.sparkSession.sparkContext.broadcast((*boxes, subs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, many = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                queries = _matrix(part.column(1), width)
                bound = bounds(queries, low, high)
                # Rounding of large scores; those of small ones are exact.
                bound += np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T * width * 2.0**-50
                kth = part.column(4).fill_null(float("-inf")).to_numpy()
                floor = np.where(np.abs(kth) < EXACT, kth, np.nextafter(kth, -np.inf))
                q, region = np.nonzero((bound >= floor[:, None]) & (many > 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).take(pa.array(q)) for i in (0, 1, 2, 3)] + [pa.array(floor[q]), pa.array(region.astype(np.int32))],
                    ["id", "v", "own", "own_sub", "floor", "region"],
                )

    near = asking.mapInArrow(run, "id long, v array<double>, own int, own_sub int, floor double, region int")
    count = F.element_at(F.lit(subs.tolist()).cast("array<int>"), F.col("region") + 1)
    every = near.withColumn("sub", F.explode(F.sequence(F.lit(0), count - 1)))
    return every.where("NOT (region = own AND sub = own_sub)").select("region", "sub", "id", "v", "floor")
