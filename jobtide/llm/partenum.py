"""N-gram Jaccard join: signatures of partitioned feature domains, exact check, components.

Sets of like size that are similar enough differ in few features. The feature domain is
cut into more partitions than that, in groups; for each group the contents of every
subset of its partitions that leaves ``spare`` out are hashed. By the pigeonhole
principle two sufficiently similar sets agree in at least one such signature.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.bytetext import column, flat, hash_spans, mix, shingles, slices, tidy, words
from jobtide.llm.components import components, removed, written

#: Bits of the filters that pick the rows to be read, at least and at most; a fuller one only lets more through.
FILTER_BITS = (1 << 20, 1 << 26)
#: Members of a bucket that are compared as one block.
BUCKET = 4_096
#: Bits of a set's short parity sketch, at least and at most: so many that 3 elements come to 2 bits at most. A full sketch,
#: by which few bits differ for many elements, would let all pairs of large sets pass. Long sketches have LONGER times the bits.
SHORT_BITS, LONGER = (512, 1 << 18), 4
#: Bytes that the sets of a round of pairs, or the members of a round of buckets, may have; if more, a part of all sets' bytes.
ROUND_BYTES, ROUND_PART = 64 << 20, 8
#: Bytes of a bucket's member on its way (as shuffled), with a short sketch of the usual size.
MEMBER_BYTES = 90
#: Pairs of members that are looked at together.
COMPARED = 1 << 18
#: Nodes without a key get one from here on, by their name.
NO_KEY, KEY_MASK = 9_000_000_000_000_000_000, (1 << 44) - 1

_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Scheme:
    """Bands of set sizes, and for each the number of groups that the similarity num/den asks for."""

    def __init__(self, num: int, den: int, parts: int = 2, spare: int = 1, slack: float = 0.1, band: float = 1.6):
        """``band``: ratio of the sizes at the two ends of a band. ``slack``: share of the signatures that are sure to agree."""
        self.num, self.den, self.parts, self.spare, self.slack, self.band = num, den, parts, spare, slack, band
        self.subsets = list(combinations(range(parts), parts - spare))
        self.low = [1]

    def bands(self, size: int) -> list[int]:
        """The set's own band, and those of larger sets that it may be similar to."""
        while self.low[-1] * self.num <= size * self.den:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * self.band)))
        own = int(np.searchsorted(self.low, size, "right")) - 1
        return [own, *[b for b in range(own + 1, len(self.low)) if self.low[b] * self.num <= size * self.den]]

    def agreeing(self, groups: int, k: int) -> int:
        """Signatures at least that agree if k features differ: each spoils one partition, at worst spread evenly."""
        each, more = divmod(k, groups)
        kept = self.parts - self.spare
        left = [comb(max(self.parts - d, 0), kept) for d in (each, each + 1)]
        return (groups - more) * left[0] + more * left[1]

    @lru_cache(maxsize=None)  # noqa: B019  (one scheme lives per task)
    def groups(self, band: int) -> tuple[int, int]:
        """Groups of the band, and how many signatures are sure to agree there."""
        while len(self.low) <= band + 1:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * self.band)))
        k = 2 * (self.low[band + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        groups = 1
        while self.agreeing(groups, k) < 1 + int(self.slack * groups * len(self.subsets)):
            groups += 1
        return groups, self.agreeing(groups, k)

    @lru_cache(maxsize=None)  # noqa: B019
    def plan(self, size: int) -> list[tuple[int, int, int]]:
        return [(b, *self.groups(b)) for b in self.bands(size)]


def _sums(values: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of values by place: exact, by halves of 32 bits (below 2**21 values a place)."""
    low = np.bincount(where, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(where, (values >> np.uint64(32)).astype(np.float64), n)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def signatures(sets: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of non-empty sets, and the index of the set of each.

    If two sets are sure to agree in m signatures, each may leave out its m - 1 smallest by
    (features covered, value): the largest that they agree in is among the kept ones of
    both. Small signatures say little, and many unrelated sets would share them.
    """
    out, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    plans = [scheme.plan(len(s)) for s in sets]
    for turn in range(max(map(len, plans), default=0)):
        mine = [i for i, p in enumerate(plans) if len(p) > turn]
        band, groups, sure = np.array([plans[i][turn] for i in mine], np.int64).T
        values = np.concatenate([sets[i] for i in mine])
        owner = np.repeat(np.arange(len(mine)), [len(sets[i]) for i in mine])
        n = groups * scheme.parts
        first = np.concatenate([[0], np.cumsum(n)])
        spread = mix(values + _SALT[0] * (band[owner].astype(np.uint64) + np.uint64(1)))
        place = first[owner] + ((spread >> np.uint64(32)) * n[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total = _sums(mix(values ^ _SALT[1]), place, first[-1]).reshape(-1, scheme.parts)
        count = np.bincount(place, minlength=first[-1]).reshape(-1, scheme.parts)
        group_of = np.repeat(np.arange(len(mine)), groups)
        index = (np.arange(len(group_of)) - np.concatenate([[0], np.cumsum(groups)])[group_of]).astype(np.uint64)
        made = []
        for j, subset in enumerate(scheme.subsets):
            size = count[:, subset].sum(1)
            key = total[:, subset].sum(1, dtype=np.uint64) + size.astype(np.uint64) * _SALT[2]
            key += (index * np.uint64(len(scheme.subsets)) + np.uint64(j)) * _SALT[3] + band[group_of].astype(np.uint64) * _SALT[0]
            made.append((mix(key), size))
        keys, sizes = (np.concatenate(x) for x in zip(*made))
        whose = np.tile(group_of, len(scheme.subsets))
        order = np.lexsort((keys, sizes, whose))
        begin = np.concatenate([[0], np.cumsum(groups * len(scheme.subsets))])
        use = order[np.arange(len(order)) - begin[whose[order]] >= sure[whose[order]] - 1]
        out.append(keys[use])
        of.append(np.array(mine, np.int64)[whose[use]])
    return np.concatenate(out), np.concatenate(of)


def _read(texts: pa.Array, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct shingles of each text, and a 64-bit name of each set (0: empty)."""
    data, offsets = flat(texts)
    starts, ends, first = words(data, offsets)
    values, where = shingles(hash_spans(data, starts, ends), first, n)
    sets = [np.unique(values[a:b]) for a, b in zip(where[:-1], where[1:])]
    names = np.array([int(mix(s ^ _SALT[2]).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
    sizes = np.array([len(s) for s in sets], np.uint64)
    names = np.where(sizes > 0, mix(names + sizes * _SALT[3]), np.uint64(0))
    return sets, names


def _pass(df: DataFrame, key: list[str], schema: str, work) -> DataFrame:
    """One pass over the texts; ``work`` gets (kept columns, texts) of a slice and gives the output columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                made = work([part.column(i) for i in range(len(key))], part.column(len(key)))
                yield pa.RecordBatch.from_arrays([x for _, x in made], [c for c, _ in made])

    return df.select(*key, "__text").mapInArrow(tidy(run), schema)


def _stars(rows: DataFrame) -> DataFrame:
    """(sig, leader, node, sizes) for each further set of a signature; the leader is its smallest name.

    Rows come sorted, so that a task keeps one leader, however many sets share a signature.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig0 = lead0 = size0 = node0 = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, node, size = (batch.column(i).to_numpy() for i in range(3))
            new = np.concatenate([[sig[0] != sig0], sig[1:] != sig[:-1]])
            again = np.concatenate([[sig[0] == sig0 and node[0] == node0], (sig[1:] == sig[:-1]) & (node[1:] == node[:-1])])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
            leader = np.where(begin >= 0, node[begin], lead0 if lead0 is not None else 0)
            leader_size = np.where(begin >= 0, size[begin], size0 if size0 is not None else 0)
            use = ~new & ~again & (leader != node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[use]) for x in (sig, leader, node, leader_size.astype(np.int32), size)],
                ["sig", "leader", "node", "leader_n", "n"],
            )
            sig0, lead0, size0, node0 = sig[-1], leader[-1], leader_size[-1], node[-1]

    spread = rows.repartition("sig").sortWithinPartitions("sig", "node")
    return spread.mapInArrow(tidy(run), "sig long, leader long, node long, leader_n int, n int")


class _Marks:
    """A bit filter of 64-bit values, sent to the tasks. Its bits follow the number of values up to a fixed size."""

    def __init__(self, values: DataFrame, name: str):
        spark = values.sparkSession
        self.bits = FILTER_BITS[0]
        many = values.count()
        while self.bits < min(8 * many, FILTER_BITS[1]):
            self.bits *= 2
        got = (
            values.select(F.col(name).bitwiseAND(F.lit(self.bits - 1)).alias("p"))
            .groupBy(F.expr("shiftright(p, 6)").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("bits")).toArrow()
        )
        out = np.zeros(self.bits // 64, np.uint64)
        out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
        self.sent = spark.sparkContext.broadcast(out)

    def hit(self, values: np.ndarray) -> np.ndarray:
        at = values & np.uint64(self.bits - 1)
        return (self.sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _read_marked(marks: _Marks, places: pa.Array, keys: pa.Array, texts: pa.Array, n: int) -> tuple[np.ndarray, list, np.ndarray]:
    """Indexes of the rows whose key is marked or NULL, and what ``_read`` gives for them: no other text is read."""
    use = np.flatnonzero(marks.hit(places.to_numpy().view(np.uint64)) | keys.is_null().to_numpy(zero_copy_only=False))
    return use, *_read(texts if len(use) == len(texts) else texts.take(pa.array(use)), n)


def _parity(s: np.ndarray) -> bytes:
    """Per bit the parity of the set's elements there: two sets differ in as many elements as bits at least."""
    bits = SHORT_BITS[0]
    while 2 * len(s) > 3 * bits and bits < SHORT_BITS[1]:
        bits *= 2
    bits *= LONGER
    count = np.bincount((mix(s + _SALT[1]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches of ``width`` words: parities of whole parts, so differing bits are a lower bound again."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, width), 1)


def _shortened(sketches: DataFrame) -> DataFrame:
    """(node, size, content) with short sketches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [_folded(w := np.frombuffer(x, np.uint64).reshape(1, -1), w.size // LONGER).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(short, pa.binary())], ["node", "size", "content"])

    return sketches.select("node", "size", "content").mapInArrow(run, "node long, size int, content binary")


def _contents(wanted: DataFrame, texts: DataFrame, n: int, content) -> DataFrame:
    """(node, size, content) of the wanted (node, rep), each set read from one document.

    A bit filter of the keys tells which texts are read, and one of the names which sets leave the pass.
    """
    keyed = _Marks(wanted.select(F.xxhash64("rep").alias("at")), "at")
    named = _Marks(wanted, "node")

    def pick(kept: list, given: pa.Array) -> list:
        rows, sets, names = _read_marked(keyed, kept[1], kept[0], given, n)
        use = [i for i in np.flatnonzero(named.hit(names)).tolist() if len(sets[i])]
        keys = kept[0].take(pa.array(rows[use], pa.int64())).to_pylist()
        reps = [NO_KEY + (int(names[i]) & KEY_MASK) if k is None else k for i, k in zip(use, keys)]
        return [
            ("node", pa.array(names[use].view(np.int64))), ("rep", pa.array(reps, pa.int64())),
            ("size", pa.array([len(sets[i]) for i in use], pa.int32())), ("content", pa.array([content(sets[i]) for i in use], pa.binary())),
        ]

    found = _pass(texts.withColumn("__at", F.xxhash64("__key")), ["__key", "__at"], "node long, rep long, size int, content binary", pick)
    return found.join(wanted, ["node", "rep"], "left_semi").select("node", "size", "content")


def _both(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The pairs (a, b) with the contents (x, y) and sizes (xn, yn) of their sets."""
    left = contents.select(F.col("node").alias("a"), F.col("size").alias("xn"), F.col("content").alias("x"))
    right = contents.select(F.col("node").alias("b"), F.col("size").alias("yn"), F.col("content").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "xn", "yn")


def _kept(df: DataFrame, test) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array(test(batch), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(good) for i in (0, 1)], ["a", "b"])

    return df.mapInArrow(tidy(run), "a long, b long")


class _Sketches:
    """Sketches of several lengths; two of them are compared at the length of the shorter one."""

    def __init__(self, column: pa.Array):
        held = column.to_pylist()
        self.width = np.array([len(x) // 8 for x in held], np.int64)
        # Those of one length are one block.
        self.place, self.blocks = np.zeros(len(held), np.int64), {}
        for width in np.unique(self.width).tolist():
            of = np.flatnonzero(self.width == width)
            self.place[of] = np.arange(len(of))
            self.blocks[width] = np.frombuffer(b"".join([held[i] for i in of.tolist()]), np.uint64).reshape(-1, width)

    def at(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The sketches of the rows, folded to ``width`` words."""
        if len(self.blocks) == 1 and width in self.blocks:
            return self.blocks[width][rows]
        out = np.empty((len(rows), width), np.uint64)
        for own in np.unique(self.width[rows]).tolist():
            mine = np.flatnonzero(self.width[rows] == own)
            out[mine] = _folded(self.blocks[own][self.place[rows[mine]]], width)
        return out


def _close(x: _Sketches, i: np.ndarray, y: _Sketches, j: np.ndarray, both: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of sketches (i of x, j of y) may belong to similar sets; ``both``: the sum of the two sizes."""
    differing, shorter = np.zeros(len(i), np.int64), np.minimum(x.width[i], y.width[j])
    for width in np.unique(shorter).tolist():
        pairs = np.flatnonzero(shorter == width)
        # So many at a time that they take some MB.
        step = max(1, (1 << 18) // width)
        for start in range(0, len(pairs), step):
            some = pairs[start : start + step]
            differing[some] = np.bitwise_count(x.at(i[some], width) ^ y.at(j[some], width)).sum(1, dtype=np.int64)
    return differing * (den + num) <= both * (den - num)


def _volume(near: DataFrame, sizes: DataFrame) -> int:
    """Bytes of the two sets of each pair."""
    left = sizes.select(F.col("node").alias("a"), F.col("size").alias("xn"))
    right = sizes.select(F.col("node").alias("b"), F.col("size").alias("yn"))
    return 8 * (near.join(left, "a").join(right, "b").agg(F.sum(F.col("xn").cast("long") + F.col("yn"))).first()[0] or 0)


def _in_rounds(make, by: list[str], rounds: int, name: str) -> DataFrame:
    """What ``make`` gives for each round of the hashes of columns (it gets the condition), each written before the next begins."""
    made = [written(make(F.pmod(F.xxhash64(*by), F.lit(rounds)) == turn if rounds > 1 else F.lit(True)), name) for turn in range(rounds)]
    if rounds == 1:
        return made[0]
    whole = written(reduce(DataFrame.unionByName, made).distinct(), name)
    removed(*made)
    return whole


def _links(near: DataFrame, nodes: DataFrame, sizes: DataFrame, texts: DataFrame, n: int, num: int, den: int, most: int) -> DataFrame:
    """(a, b): smallest keys of the near pairs whose sets are similar enough by their exact intersection.

    Whole sets are the widest thing that moves: the pairs are looked at in rounds of about ``most`` bytes of sets.
    """
    def alike(batch: pa.RecordBatch) -> list[bool]:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            good.append(den * shared >= num * (len(x) + len(y) - shared))
        return good

    def linked(mine: Column) -> DataFrame:
        some = near.where(mine)
        wanted.append(written(some.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node"), "wanted"))
        return _named(_kept(_both(some, _contents(wanted[-1], texts, n, np.ndarray.tobytes)), alike), nodes).distinct()

    wanted: list[DataFrame] = []
    links = _in_rounds(linked, ["a", "b"], max(1, -(-_volume(near, sizes) // most)), "links")
    removed(*wanted)
    return links


def _apart(members: DataFrame, num: int, den: int, leaders: bool) -> DataFrame:
    """Near pairs (a, b) within a bucket of (sig, node, n, component, content) whose components differ.

    Short sketches are compared inside the tasks, so that few pairs come out. A bucket of
    more than BUCKET members is cut into blocks, and each pair of blocks is a group. With
    ``leaders`` one member of each block, another one in every bucket, is compared with
    its block alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy() for i in range(3)]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            first = tuple(k[0] for k in keys)
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if held and (i or first != last):
                    yield from compare(held)
                    held = []
                held.append(batch.slice(a, b - a))
            last = tuple(k[-1] for k in keys)
        if held:
            yield from compare(held)

    def compare(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        p, q = group.column(1)[0].as_py(), group.column(2)[0].as_py()
        block, node, size, component = (group.column(i).to_numpy() for i in range(3, 7))
        sketches, size = _Sketches(group.column(7)), size.astype(np.int64)
        rows, columns = np.flatnonzero(block == p), np.flatnonzero(block == q)
        if leaders:
            sig = np.uint64(group.column(0)[0].as_py() & (1 << 64) - 1)
            rows = rows[[np.argmin(mix(node[rows].view(np.uint64) ^ sig))]]
        step = max(1, COMPARED // max(1, len(columns)))
        for start in range(0, len(rows), step):
            some = rows[start : start + step]
            low, high = np.minimum.outer(size[some], size[columns]), np.maximum.outer(size[some], size[columns])
            use = (component[some][:, None] != component[columns][None, :]) & (den * low >= num * high)
            if p == q and not leaders:
                use &= node[some][:, None] < node[columns][None, :]
            i, j = np.nonzero(use)
            for at in range(0, len(i), 1 << 14):
                x, y = some[i[at : at + (1 << 14)]], columns[j[at : at + (1 << 14)]]
                good = _close(sketches, x, sketches, y, size[x] + size[y], num, den)
                a, b = node[x[good]], node[y[good]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    others = F.array("block") if leaders else F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(others, lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q")))
    placed = members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("pair", F.explode(pairs))
    placed = placed.select("sig", F.col("pair.p").cast("int").alias("p"), F.col("pair.q").cast("int").alias("q"), "block", "node", "n", "component", "content")
    return placed.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q").mapInArrow(tidy(run), "a long, b long").distinct()


def jaccard_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, scheme: dict | None = None,
) -> DataFrame:
    """(key, n_shingles, component_id): the documents linked by Jaccard similarity of at least num/den.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a set is the distinct
    n-word shingles (fewer words: the whole sequence as one). Texts without words, and
    NULL, have an empty set and are linked with nothing. Keys are integers; component_id is
    the smallest key reachable by links (NULL keys take part but count as no key). Repeated
    rows and keys stay as they are; other columns are not read; no rows give no rows.

    Equal sets are one node. Nodes that share a signature form a bucket; each is compared
    with the bucket's first, by sketch and then exactly, and what is linked forms
    components. Then the sketches of a bucket's members that are still in different
    components are compared within the tasks, and near ones exactly: with one leader per
    bucket, then all, so that no link between different components is missed. Only near
    pairs ever become rows.
    """
    rows, labels = _labelled(df.select(column(key).cast("long").alias("__key"), column(text).cast("string").alias("__text")), n, num, den, scheme)
    found = labels.select("node", F.when(F.col("component") < NO_KEY, F.col("component")).alias("component_id"))
    name = F.col("__key").alias(key)
    out = rows.join(found, "node", "left")
    return out.select(name, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("__key")).alias("component_id"))


def near_copies(
    df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, scheme: dict | None = None,
) -> DataFrame:
    """(key, hash): distinct key and xxhash64 of the text of the rows that have a better one in their component.

    The best one has the smallest (key, set, hash). Rows without a key have a best one of their own in each component.
    """
    content = column(text).cast("string")
    # Nodes are named by id and text: sets of one id are not linked by it.
    name = F.xxhash64(column(key).cast("long"), content).bitwiseAND(F.lit((1 << 62) - 1))
    texts = df.select(name.alias("__key"), column(key).cast("long").alias("__id"), F.xxhash64(content).alias("__hash"), content.alias("__text"))
    rows, labels = _labelled(texts, n, num, den, scheme or {"slack": 0.3, "rounds": 2})
    placed = rows.join(labels, "node").select("component", F.col("__id").isNull().alias("unkeyed"), F.struct("__id", "node", "__hash").alias("place"))
    best = placed.groupBy("component", "unkeyed").agg(F.min("place").alias("best"))
    worse = placed.join(best, ["component", "unkeyed"]).where("NOT (place <=> best)")
    return worse.select(F.col("place.__id").alias(key), F.col("place.__hash").alias("hash")).distinct()


def _labelled(texts: DataFrame, n: int, num: int, den: int, scheme: dict | None) -> tuple[DataFrame, DataFrame]:
    """(the columns before __text, n, node) of every row, and (node, component) of every node."""
    options = dict(scheme or {})
    # Signatures are the largest thing that moves: in rounds, by their value, a part of them stands on disk at a time.
    rounds = options.pop("rounds", 1)
    given_names = texts.columns[:-1]

    def measure(kept: list, given: pa.Array) -> list:
        sets, names = _read(given, n)
        return [*zip(given_names, kept), ("n", pa.array([len(s) for s in sets], pa.int64())), ("node", pa.array(names.view(np.int64)))]

    rows = written(_pass(texts, given_names, "".join(f"{c} long, " for c in given_names) + "n long, node long", measure), "sizes")
    nodes = written(
        rows.where("n > 0").groupBy("node").agg(F.min("__key").alias("rep"))
        .select("node", F.coalesce("rep", F.expr(f"{NO_KEY} + (node & {KEY_MASK})")).alias("rep")),
        "nodes",
    )

    keyed = _Marks(nodes.select(F.xxhash64("rep").alias("at")), "at")

    def sign(kept: list, given: pa.Array, turn: int) -> list:
        # Of the copies of a set only the one that stands for it is read (and the few whose key looks like another's).
        _, sets, names = _read_marked(keyed, kept[1], kept[0], given, n)
        use = [i for i in np.unique(names, return_index=True)[1].tolist() if len(sets[i])]
        sigs, of = signatures([sets[i] for i in use], made())
        mine = (sigs >> np.uint64(32)) % np.uint64(rounds) == np.uint64(turn)
        sigs, of = sigs[mine], of[mine]
        which = np.array(use, np.int64)[of] if len(use) else of
        sizes = np.array([len(s) for s in sets], np.int32)
        return [
            ("sig", pa.array(sigs.view(np.int64))), ("node", pa.array(names[which].view(np.int64))), ("n", pa.array(sizes[which])),
        ]

    schemes: list[Scheme] = []

    def made() -> Scheme:
        if not schemes:
            schemes.append(Scheme(num, den, **options))
        return schemes[0]

    placed = texts.withColumn("__at", F.xxhash64("__key"))
    parts = [
        written(_stars(_pass(placed, ["__key", "__at"], "sig long, node long, n int", partial(sign, turn=turn))), "stars")
        for turn in range(rounds)
    ]
    stars = reduce(DataFrame.unionByName, parts)
    most = max(ROUND_BYTES, 8 * (rows.agg(F.sum("n")).first()[0] or 0) // ROUND_PART)
    alike = f"{den} * least(leader_n, n) >= {num} * greatest(leader_n, n)"
    pairs = written(stars.where(alike).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    leaders = stars.select("sig", F.col("leader").alias("node"), F.col("leader_n").alias("n")).distinct()
    members = stars.select("sig", "node", "n").unionByName(leaders)
    wanted = written(members.select("node").distinct().join(nodes, "node"), "wanted")
    sketches = written(_contents(wanted, texts, n, _parity), "sketches")
    removed(wanted)
    short = written(_shortened(sketches), "short")

    def close(batch: pa.RecordBatch) -> np.ndarray:
        if not batch.num_rows:
            return np.empty(0, bool)
        both, every = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy(), np.arange(batch.num_rows)
        return _close(_Sketches(batch.column(2)), every, _Sketches(batch.column(3)), every, both, num, den)

    # Most pairs only meet by chance: short sketches rule them out, and the long ones move for the others.
    maybe = written(_kept(_both(pairs, short), close).distinct(), "maybe")
    near = written(_kept(_both(maybe, sketches), close), "near")
    removed(maybe)
    links = _links(near, nodes, short, texts, n, num, den, most)
    parts += [near, links]
    labels = written(_labels(nodes, components(links)), "node_labels")

    compared = [pairs]
    # Members of one bucket that are still apart: with one leader per bucket first, which joins
    # most of what belongs together, then with one another. In a bucket of two they have been compared.
    for leaders in (True, False):
        placed = members.join(labels, "node")
        mixed = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("many"))
        blocks = F.ceil(F.col("many") / BUCKET).cast("int").alias("blocks")
        mixed = written(mixed.where("lo < hi AND many > 2").select("sig", "many", blocks), "mixed")
        known = reduce(DataFrame.unionByName, compared)
        # Members move with their sketches: in rounds of buckets, a part of them stands on disk at a time.
        moved = MEMBER_BYTES * (mixed.agg(F.sum(F.col("many") * (F.lit(1) if leaders else F.col("blocks")))).first()[0] or 0)
        apart = _in_rounds(
            lambda mine: _apart(_placed(members, labels, mixed, short, mine), num, den, leaders).join(known, ["a", "b"], "left_anti"),
            ["sig"], max(1, -(-moved // most)), "apart",
        )
        parts += [mixed, apart]
        if not apart.isEmpty():
            close_ones = written(_kept(_both(apart, sketches), close), "near")
            parts += [close_ones, _links(close_ones, nodes, short, texts, n, num, den, most)]
            links = links.unionByName(parts[-1])
            before, labels = labels, written(_labels(nodes, components(links)), "node_labels")
            removed(before)
            compared.append(apart)
    removed(*parts, *compared, sketches, short, nodes)
    return rows, labels


def _placed(members: DataFrame, labels: DataFrame, mixed: DataFrame, short: DataFrame, mine: Column) -> DataFrame:
    """(sig, node, n, component, blocks, content): the members of the mixed buckets whose signatures are meant."""
    return members.where(mine).join(labels, "node").join(mixed.where(mine).drop("many"), "sig").join(short.drop("size"), "node")


def _named(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the smallest keys of the nodes."""
    a = nodes.select(F.col("node").alias("a"), F.col("rep").alias("ra"))
    b = nodes.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
    return links.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def _labels(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) of every node."""
    return nodes.join(found, nodes["rep"] == found["id"], "left").select("node", F.coalesce("component", "rep").alias("component"))
