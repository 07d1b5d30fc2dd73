"""Phrase collocation mining by direct-address tiling.

Words, then frequent phrases, get ids by frequency rank. A phrase of m words is a pair of
a frequent phrase of m - 1 words and a word; the matrix of these pairs is cut into square
tiles. A task counts full tiles with dense ``bincount`` and the others as sorted
coordinates; then the frequent pairs are ranked anew, for phrases one word longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.bytetext import LOWER, column, flat, hash_spans, mix, slices
from jobtide.llm.components import removed, written
from jobtide.llm.partenum import _Marks as Marks

#: Ranks on a side of a tile.
TILE = 1024
#: Pairs in a tile and slice from which on it is counted densely, and tiles that a task keeps dense.
DENSE, DENSE_TILES = 1 << 14, 12
#: Phrases of one length that have a rank; the rest are counted under their 64-bit names.
RANKED = 1 << 16
#: Coordinates (or words) that a task holds before it passes their counts on.
HELD = 1 << 20

_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_GAP = _PIECE.copy()
_GAP[[9, 32]] = True
_FACTOR = np.uint64(0xD1342543DE82EF95)


class _Words:
    """Words of a slice of texts: their spans, names (by language) and whether each continues a piece."""

    def __init__(self, texts: pa.Array, langs: np.ndarray):
        data, offsets = flat(texts)
        inside = ~_GAP[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        start, stop = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | cut[1:-1]
        stop[:-1] &= ~inside[1:] | cut[1:-1]
        self.data, self.starts, self.ends = data, np.flatnonzero(start), np.flatnonzero(stop) + 1
        of = np.searchsorted(offsets, self.starts, "right") - 1
        self.of = of
        self.names = mix(hash_spans(data, self.starts, self.ends, LOWER) + langs[of].view(np.uint64))
        breaks = np.concatenate([[0], np.cumsum(_PIECE[data])])
        self.goes_on = np.zeros(len(of), bool)
        self.goes_on[1:] = (of[1:] == of[:-1]) & (breaks[self.starts[1:]] == breaks[self.ends[:-1]])

    def word(self, i: int) -> str:
        return LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes().decode()


def longer(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Name of the phrase that is one word longer."""
    return mix(phrase * _FACTOR + word)


class Ranks:
    """Ranks of the most frequent phrases (or words) of one length, and a filter of the others; sent to the tasks."""

    def __init__(self, frequent: DataFrame, ranked: int):
        rows = frequent.select("id", "f").orderBy(F.col("f").desc(), "id").limit(ranked).toArrow()
        names = rows.column(0).to_numpy().view(np.uint64)
        self.sent = frequent.sparkSession.sparkContext.broadcast(names)
        self.rest = Marks(frequent.select("id"), "id") if len(names) >= ranked else None

    def opened(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Function from names to (rank or -1, whether frequent; a few that aren't may be called so if not all have ranks)."""
        names = self.sent.value
        order = np.argsort(names)
        sorted_names = names[order]
        bits = 20
        slot = (names >> np.uint64(64 - bits)).astype(np.int64)
        table = np.full(1 << bits, -1, np.int32)
        table[slot] = np.arange(len(names), dtype=np.int32)
        several = np.bincount(slot, minlength=1 << bits) > 1
        rest = self.rest

        def look(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(names):
                return np.full(len(wanted), -1, np.int64), np.zeros(len(wanted), bool)
            at = (wanted >> np.uint64(64 - bits)).astype(np.int64)
            rank = table[at].astype(np.int64)
            rank[names[rank] != wanted] = -1
            again = np.flatnonzero((rank < 0) & several[at])
            if len(again):
                place = np.minimum(np.searchsorted(sorted_names, wanted[again]), len(names) - 1)
                rank[again] = np.where(sorted_names[place] == wanted[again], order[place], -1)
            good = rank >= 0
            if rest is not None:
                good |= rest.hit(wanted)
            return rank, good

        return look


class Tiles:
    """Counts of (row, column) rank pairs of one task: dense tiles, and sorted coordinates for the rest."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.keys, self.counts, self.held = [], [], 0

    def add(self, row: np.ndarray, col: np.ndarray) -> None:
        tile = row // TILE * (1 << 32) + col // TILE
        found, where, many = np.unique(tile, return_inverse=True, return_counts=True)
        full = np.zeros(len(found), bool)
        for i in np.argsort(-many).tolist():
            number = int(found[i])
            if number not in self.dense and many[i] >= DENSE and len(self.dense) < DENSE_TILES:
                self.dense[number] = np.zeros(TILE * TILE, np.int64)
            full[i] = number in self.dense
        for i in np.flatnonzero(full).tolist():
            use = where == i
            self.dense[int(found[i])] += np.bincount(row[use] % TILE * TILE + col[use] % TILE, minlength=TILE * TILE)
        sparse = ~full[where]
        keys, counts = np.unique((row[sparse] << 32) + col[sparse], return_counts=True)
        self._hold(keys, counts)

    def _hold(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 4 * HELD:
            self._merge()

    def _merge(self) -> None:
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(where, np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def full(self) -> bool:
        if self.held > HELD and len(self.keys) > 1:
            self._merge()
        return self.held > HELD

    def drain(self, dense: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, count) of the coordinates, at last of the dense tiles too; the coordinates are forgotten."""
        if self.keys:
            self._merge()
        keys, counts = (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.keys, self.counts, self.held = [], [], 0
        rows, cols, many = [keys >> 32], [keys & 0xFFFFFFFF], [counts]
        for number, cells in self.dense.items() if dense else ():
            at = np.flatnonzero(cells)
            rows.append((number >> 32) * TILE + at // TILE)
            cols.append((number & 0xFFFFFFFF) * TILE + at % TILE)
            many.append(cells[at])
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(many)


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, id, f) of every word; each task adds its own occurrences up first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                text = _Words(part.column(2), part.column(1).to_numpy())
                names, first, many = np.unique(text.names, return_index=True, return_counts=True)
                langs = part.column(0)
                for name, i, n in zip(names.tolist(), first.tolist(), many.tolist()):
                    entry = known.get(name)
                    if entry is None:
                        known[name] = [langs[int(text.of[i])].as_py(), text.word(i), n]
                    else:
                        entry[2] += n
                if len(known) > HELD // 4:
                    yield out(known)
                    known = {}
        yield out(known)

    def out(known: dict[int, list]) -> pa.RecordBatch:
        names = np.array(list(known), np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([e[0] for e in known.values()], pa.string()), pa.array([e[1] for e in known.values()], pa.string()),
                pa.array(names), pa.array([e[2] for e in known.values()], pa.int64()),
            ],
            ["lang", "word", "id", "f"],
        )

    return texts.mapInArrow(run, "lang string, word string, id long, f long").groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


def _pair_counts(texts: DataFrame, size: int, words: Ranks, phrases: Ranks, least: int) -> DataFrame:
    """(id, prefix, last, f) of the phrases of ``size`` words that occur ``least`` times, both parts of size - 1 words frequent.

    Pairs of ranks move as ranks, which are small numbers; only frequent ones get their names.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_of, phrase_of, tiles = words.opened(), phrases.opened(), Tiles()
        rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, "text"):
                text = _Words(part.column(2), part.column(1).to_numpy())
                names, n = text.names, len(text.names) - size + 1
                if n <= 0:
                    continue
                # Phrases of size - 1 words at each place, and how many words follow without a break.
                phrase = names[: n + 1].copy()
                runs = np.ones(n + 1, bool)
                for j in range(1, size - 1):
                    phrase = longer(phrase, names[j : j + n + 1])
                    runs &= text.goes_on[j : j + n + 1]
                at = np.flatnonzero(runs[:n] & runs[1:] & text.goes_on[size - 1 : size - 1 + n])
                rank, good = np.full(n + 1, -1, np.int64), np.zeros(n + 1, bool)
                some = np.unique(np.concatenate([at, at + 1]))
                rank[some], good[some] = phrase_of(phrase[some])
                at = at[good[at] & good[at + 1]]
                col, _ = word_of(names[at + size - 1])
                row = rank[at]
                ranked = (row >= 0) & (col >= 0)
                tiles.add(row[ranked], col[ranked])
                other = at[~ranked]
                if len(other):
                    rest.append(summed(phrase[other], names[other + size - 1], np.ones(len(other), np.int64)))
                    if sum(len(r[0]) for r in rest) > 4 * HELD:
                        rest = [summed(*(np.concatenate(x) for x in zip(*rest)))]
                        if len(rest[0][0]) > HELD:
                            yield out(*rest[0])
                            rest = []
                if tiles.full():
                    yield ranked_rows(*tiles.drain(False))
        yield ranked_rows(*tiles.drain(True))
        if rest:
            yield out(*summed(*(np.concatenate(x) for x in zip(*rest))))

    def summed(prefix: np.ndarray, last: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, first, where = np.unique(longer(prefix, last), return_index=True, return_inverse=True)
        return prefix[first], last[first], np.bincount(where, many).astype(np.int64)

    def ranked_rows(row: np.ndarray, col: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        return rows(row, col, many, True)

    def out(prefix: np.ndarray, last: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        return rows(prefix.view(np.int64), last.view(np.int64), many, False)

    def rows(a: np.ndarray, b: np.ndarray, many: np.ndarray, ranked: bool) -> pa.RecordBatch:
        columns = [pa.array(a), pa.array(b), pa.array(np.full(len(a), ranked)), pa.array(many)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "ranked", "f"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_names, col_names = phrases.sent.value, words.sent.value
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ranked = batch.column(2).to_numpy(zero_copy_only=False)
            prefix, last = a.view(np.uint64).copy(), b.view(np.uint64).copy()
            prefix[ranked], last[ranked] = row_names[a[ranked]], col_names[b[ranked]]
            columns = [longer(prefix, last).view(np.int64), prefix.view(np.int64), last.view(np.int64), batch.column(3)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["id", "prefix", "last", "f"])

    counted = texts.mapInArrow(run, "a long, b long, ranked boolean, f long").groupBy("a", "b", "ranked").agg(F.sum("f").alias("f"))
    return counted.where(F.col("f") >= least).mapInArrow(name, "id long, prefix long, last long, f long")


def frequent_phrases(
    df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, ranked: int = RANKED,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the phrases of at most ``longest`` words that occur ``least`` times, and (lang, n).

    Texts are lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into
    words ``[^\\x20\\x09]+``; counted are all contiguous occurrences within pieces. NULL texts
    are empty, a NULL lang is ``und``; repeated rows count as often as they are there; other
    columns are not read. No rows give no rows; n counts all words of a language that has any.

    A phrase is counted only where both its parts of one word less are frequent, one pass
    for each length. What a task sends on has been added up in it, so a common phrase moves
    once per task. The ``ranked`` most frequent phrases of a length are sent to the tasks,
    with a bit filter of bounded size for the others, which are counted by their names of 64 bits.
    """
    texts = df.select(F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"), column(text).cast("string").alias("text"))
    texts = texts.select("lang", F.xxhash64("lang").alias("code"), "text")
    words = written(_word_counts(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    level = words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "id", "f")
    single, found = level, [level.select("lang", "phrase", F.lit(1).alias("size"), "f")]
    word_ranks = ranks = Ranks(level, ranked)
    for size in range(2, longest + 1):
        pairs = written(_pair_counts(texts, size, word_ranks, ranks, least), "pairs")
        before = level.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("begin"))
        last = single.select(F.col("id").alias("last"), F.col("phrase").alias("word"))
        named = pairs.join(before, "prefix").join(last, "last").select("lang", F.concat_ws(" ", "begin", "word").alias("phrase"), "id", "f")
        level = written(named, f"phrases-{size}")
        removed(pairs)
        found.append(level.select("lang", "phrase", F.lit(size).alias("size"), "f"))
        ranks = Ranks(level, ranked)
    return reduce(DataFrame.unionByName, found), totals


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, top: int = 2000, ranked: int = RANKED,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by the score of their worst cut.

    A phrase of 2 words or more with f = a is cut into a first part with f = l and a rest with
    f = r; its score is floor(1000 * a * n / (l * r)) where that is least, ties to the
    shortest first part. Phrases that stand only inside one longer frequent phrase (as often)
    are left out. Ranks follow score and a, both descending, then the phrase by its bytes.
    What counts as an occurrence, and NULL, empty and repeated rows: see ``frequent_phrases``.
    """
    phrases, totals = frequent_phrases(df, text, lang, longest, least, ranked)
    phrases = written(phrases, "phrases")
    candidates = phrases.where("size >= 2")
    # A longer phrase that is as frequent has one word more, at either end: those between are as frequent too.
    begin, end = (F.array_join(F.slice("w", a, F.col("size") - 1), " ") for a in (1, 2))
    inner = candidates.where("size >= 3").withColumn("w", F.split("phrase", " "))
    inner = inner.select("lang", F.explode(F.array(begin, end)).alias("phrase"), "f").distinct()
    left = candidates.join(inner, ["lang", "phrase", "f"], "left_anti").withColumn("w", F.split("phrase", " "))
    cut = left.select("lang", "phrase", "f", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "f", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    counts = phrases.select("lang", "phrase", "f")
    cut = cut.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    exact = "CAST({} AS DECIMAL(19, 0))"
    score = F.expr(f"{exact.format('1000 * f')} * {exact.format('n')} div ({exact.format('l')} * {exact.format('r')})")
    # The phrase's f and the language's n are the same in all its cuts.
    worst = cut.select("lang", "phrase", "f", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    worst = worst.groupBy("lang", "phrase", "f", "n").agg(F.min("cut").alias("cut"))
    flat_rows = worst.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    placed = flat_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return placed.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
