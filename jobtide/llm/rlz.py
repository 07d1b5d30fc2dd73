"""Substring dedup: Relative Lempel-Ziv parsing of documents against indexed reference blocks.

A *window* is a run of consecutive words. Of the shorter runs inside a window the one with
the smallest hash is its anchor, in whatever document the window stands. So a document has
to be parsed against those reference blocks only that its anchors lead to: no other block
can hold one of its windows. Anchors of a single document are dropped first; what
surrounds the others (the *pieces*) goes to the blocks, where it is factored greedily.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from jobtide.llm.bytetext import column, flat, hash_spans, mix, slices, words
from jobtide.llm.components import removed, written
from jobtide.llm.partenum import _Marks as Marks

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 13, 7
#: Rows of one anchor from which on its windows go to blocks of their own.
HOT = 1 << 16
#: Pieces that a task parses at once, at least.
BLOCK = 1 << 16
#: Bytes of a word's hash within a piece, beside the 64 bits of its anchor.
WORD_BYTES = 5

_random = np.random.default_rng(20250211)
_PLACES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SALT = _random.integers(1, 1 << 63, 8, dtype=np.uint64)


class _Text:
    """Words of the texts of a slice: their hashes, the text of each, and the texts' first words."""

    def __init__(self, texts: pa.Array):
        data, offsets = flat(texts)
        starts, ends, self.first = words(data, offsets)
        self.hashes = hash_spans(data, starts, ends, None)
        self.count = np.diff(self.first)
        self.of = np.repeat(np.arange(len(self.count)), self.count)

    def runs(self, n: int) -> np.ndarray:
        """Hash of the n words that begin at each word (those that pass the end of a text mean nothing)."""
        many = len(self.hashes) - n + 1
        out = np.zeros(len(self.hashes), np.uint64)
        for j in range(n if many > 0 else 0):
            out[:many] += self.hashes[j : many + j] * _PLACES[j]
        return mix(out)


def _anchors(text: _Text, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words where an anchor begins, in order, and the hashes of the anchors."""
    runs, choice = text.runs(anchor), window - anchor + 1
    if len(runs) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    begin = np.flatnonzero(text.of[: len(runs) - window + 1] == text.of[window - 1 :])
    inside = np.lib.stride_tricks.sliding_window_view(runs, choice)
    at = [inside[begin[a : a + (1 << 18)]].argmin(1) + begin[a : a + (1 << 18)] for a in range(0, len(begin), 1 << 18)]
    at = np.concatenate(at) if at else np.empty(0, np.int64)
    # Later windows never choose an earlier place.
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return at, runs[at]


def _once(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of the first of equal rows (key, hash of the text)."""
    both = mix(keys.view(np.uint64) + _SALT[0]) ^ hashes.view(np.uint64)
    return np.sort(np.unique(both, return_index=True)[1])


def _anchor_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(route, doc, h, at, weight) of the anchors of every text.

    An anchor that several documents of a slice have is known to be shared: its rows go
    anywhere (weight 0), and one row (at -1, weighing as many) tells the other slices.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                use = _once(part.column(0).to_numpy(), part.column(1).to_numpy())
                part = part.take(pa.array(use)) if len(use) < part.num_rows else part
                doc, h = part.column(0).to_numpy(), part.column(1).to_numpy()
                text = _Text(part.column(2))
                at, value = _anchors(text, window, anchor)
                of = text.of[at]
                order = np.lexsort((doc[of], value))
                at, value, of = at[order], value[order], of[order]
                new = np.concatenate([[True], value[1:] != value[:-1]]) if len(at) else np.empty(0, bool)
                begin = np.flatnonzero(new)
                size = np.diff(np.concatenate([begin, [len(at)]]))
                low, high = doc[of[begin]], doc[of[begin + size - 1]]
                known = np.repeat(low < high, size)
                local = (at - text.first[of]).astype(np.int32)
                route = np.where(known, mix(h[of].view(np.uint64) + local.astype(np.uint64)), value)
                told = low < high
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([route, value[begin][told]]).view(np.int64)),
                        pa.array(np.concatenate([doc[of], low[told]])), pa.array(np.concatenate([h[of], np.zeros(told.sum(), np.int64)])),
                        pa.array(np.concatenate([local, np.full(told.sum(), -1, np.int32)])),
                        pa.array(np.concatenate([np.where(known, 0, 1), size[told]]).astype(np.int32)),
                    ],
                    ["route", "doc", "h", "at", "weight"],
                )

    return rows.mapInArrow(run, "route long, doc long, h long, at int, weight int")


def _shared(rows: DataFrame, window: int, anchor: int, hot: int) -> DataFrame:
    """(route, doc, h, at, many) of the anchors that documents of different keys have.

    ``many``: the anchor (then the route) has more than ``hot`` rows.
    """
    group = Window.partitionBy("route")
    seen = _anchor_rows(rows, window, anchor).select(
        "*", F.min("doc").over(group).alias("low"), F.max("doc").over(group).alias("high"),
        F.max("weight").over(group).alias("most"), F.sum("weight").over(group).alias("all"),
    )
    many = (F.col("weight") > 0) & (F.col("all") > hot)
    seen = seen.where("weight = 0 OR low < high OR most > 1").withColumn("many", many)
    return written(seen.where("at >= 0 OR many").select("route", "doc", "h", "at", "many"), "anchors")


def _split(route: np.ndarray, lo: np.ndarray, hi: np.ndarray, content: np.ndarray, hot: np.ndarray, window: int) -> tuple:
    """Pieces of hot anchors cut into their windows: (index of the piece, route, lo, hi, content)."""
    cold = np.flatnonzero(~hot)
    parts = [(cold, route[cold], lo[cold], hi[cold], content[cold])]
    slot = np.arange(content.shape[1])
    for o in range(content.shape[1] - window + 1):
        use = np.flatnonzero(hot & (lo <= o) & (hi >= o + window))
        if len(use):
            words_of = np.where((slot >= o) & (slot < o + window), content[use], np.uint64(0))
            named = mix(route[use] + (words_of * _PLACES[: len(slot)]).sum(1, dtype=np.uint64) + np.uint64(o) * _SALT[1])
            parts.append((use, named, np.full(len(use), o), np.full(len(use), o + window), words_of))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _pieces(rows: DataFrame, shared: DataFrame, window: int, anchor: int) -> DataFrame:
    """(route, doc, h, start, lo, hi, content): the words around each shared anchor, slots lo to hi of a piece.

    Of equal pieces of a slice only the one with the smallest key goes on with its content:
    what the others hold stands in a document before them, and is a finished span.
    """
    hot = Marks(shared.where("many").select("route").distinct(), "route")
    places = shared.where("at >= 0").groupBy("doc", "h").agg(F.collect_set("at").alias("at"))
    side, slots = window - anchor, 2 * window - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                use = _once(part.column(0).to_numpy(), part.column(1).to_numpy())
                part = part.take(pa.array(use)) if len(use) < part.num_rows else part
                doc, h, text, listed = part.column(0).to_numpy(), part.column(1).to_numpy(), _Text(part.column(2)), part.column(3)
                at = listed.flatten().to_numpy().astype(np.int64)
                of = np.repeat(np.arange(len(doc)), np.diff(listed.offsets.to_numpy()))
                route = text.runs(anchor)[text.first[of] + at]
                lo, hi = np.maximum(0, side - at), np.minimum(slots, text.count[of] - at + side)
                for a in range(0, len(at), BLOCK):
                    some = slice(a, a + BLOCK)
                    slot = np.arange(slots)
                    index = (text.first[of[some]] + at[some] - side)[:, None] + slot
                    good = (slot >= lo[some, None]) & (slot < hi[some, None])
                    content = text.hashes[np.where(good, index, 0)] & np.uint64((1 << 8 * WORD_BYTES) - 1)
                    yield made(
                        doc, h, of[some], at[some] - side,
                        *_split(route[some], lo[some], hi[some], np.where(good, content, np.uint64(0)), hot.hit(route[some]), window),
                    )

    def made(doc, h, of, start, piece, route, lo, hi, content) -> pa.RecordBatch:
        of, start = of[piece], start[piece]
        name = mix(route + (content * _PLACES[:slots]).sum(1, dtype=np.uint64) + (lo * 256 + hi).astype(np.uint64) * _SALT[2])
        order = np.lexsort((doc[of], name))
        of, start, route, lo, hi, content, name = (x[order] for x in (of, start, route, lo, hi, content, name))
        new = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.empty(0, bool)
        lead = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0)) if len(name) else np.empty(0, np.int64)
        done = (doc[of[lead]] < doc[of]) & (content == content[lead]).all(1) & (lo == lo[lead]) & (hi == hi[lead])
        route = np.where(done, mix(h[of].view(np.uint64) + start.astype(np.uint64)), route)
        packed = np.ascontiguousarray(content.astype("<u8")).view(np.uint8).reshape(len(name), slots, 8)[:, :, :WORD_BYTES]
        packed = np.ascontiguousarray(packed).reshape(len(name), slots * WORD_BYTES)
        sizes = np.where(done, 0, slots * WORD_BYTES)
        binary = pa.Array.from_buffers(
            pa.binary(), len(name),
            [pa.array(~done).buffers()[1], pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32).tobytes()), pa.py_buffer(packed[~done].tobytes())],
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(route.view(np.int64)), pa.array(doc[of]), pa.array(h[of]), *(pa.array(x.astype(np.int32)) for x in (start, lo, hi)), binary],
            ["route", "doc", "h", "start", "lo", "hi", "content"],
        )

    texts = rows.join(places, ["doc", "h"]).select("doc", "h", "text", "at")
    return texts.mapInArrow(run, "route long, doc long, h long, start int, lo int, hi int, content binary")


def factors(route: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, content: np.ndarray, window: int) -> tuple:
    """(piece, slot, words) of the factors of at least a window that a document of a smaller key holds.

    The pieces of a block are in order of (route, doc). Its index has the windows of every
    piece, each with the first document that has it. A cursor runs over each piece: where
    the index has its window in a document before, a factor begins and goes on as long as
    that document agrees; then the cursor moves to the first window across the factor's
    end, so that windows over a boundary are looked up as well. Else it moves by one word.
    """
    n, slots = content.shape
    first = np.full((slots - window + 1, n), -1, np.int64)
    for o in range(slots - window + 1):
        have = np.flatnonzero((lo <= o) & (hi >= o + window))
        key = route[have].copy()
        for j in range(window):
            key += content[have, o + j] * _PLACES[j]
        key = mix(key)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        lead = have[order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]] if len(key) else have
        mine = have[order]
        same = (route[lead] == route[mine]) & (content[lead, o : o + window] == content[mine, o : o + window]).all(1)
        first[o, mine] = np.where(same, lead, mine)
    found: list[tuple[np.ndarray, ...]] = []
    cursor, slot = lo.astype(np.int64), np.arange(slots)
    active = np.flatnonzero(cursor + window <= hi)
    while len(active):
        at = cursor[active]
        source = first[at, active]
        hit = doc[source] < doc[active]
        i, j, a = active[hit], source[hit], at[hit]
        end = np.minimum(hi[i], hi[j])
        differ = ((content[i] != content[j]) | (slot >= end[:, None])) & (slot >= a[:, None])
        length = np.where(differ.any(1), differ.argmax(1), slots) - a
        found.append((i, a, length))
        step = np.ones(len(active), np.int64)
        step[hit] = length - window + 1
        cursor[active] = at + step
        active = active[cursor[active] + window <= hi[active]]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def _parsed(pieces: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc, h, span): factors of the pieces as spans of words, start * 2**32 + number.

    Rows come in order of (route, doc). A task parses whole routes; of a route that goes on
    in the next block the different pieces stay as its reference.
    """
    slots = 2 * window - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rest, size = None, 0
        for batch in batches:
            done = np.flatnonzero(batch.column(6).is_null().to_numpy(zero_copy_only=False))
            if len(done):
                doc, h, start, lo, hi = (batch.column(i).to_numpy()[done] for i in range(1, 6))
                yield spans(doc, h, start + lo, hi - lo)
            todo = batch.filter(batch.column(6).is_valid())
            if todo.num_rows:
                route, doc, h, start, lo, hi = (todo.column(i).to_numpy() for i in range(6))
                wide = np.zeros((todo.num_rows, slots, 8), np.uint8)
                wide[:, :, :WORD_BYTES] = np.frombuffer(b"".join(todo.column(6).to_pylist()), np.uint8).reshape(-1, slots, WORD_BYTES)
                held.append((route.view(np.uint64), doc, h, start, lo, hi, wide.view("<u8")[:, :, 0]))
                size += todo.num_rows
            if size >= BLOCK:
                made, rest = block(held, rest)
                held, size = [], 0
                yield made
        if held:
            yield block(held, rest)[0]

    def block(held: list[tuple], rest: tuple | None) -> tuple[pa.RecordBatch, tuple]:
        known = len(rest[0]) if rest else 0
        route, doc, h, start, lo, hi, content = (np.concatenate(x) for x in zip(*([rest] if rest else []), *held))
        piece, slot, length = factors(route, doc, lo, hi, content, window)
        new = piece >= known
        piece, slot, length = piece[new], slot[new], length[new]
        last = np.flatnonzero(route == route[-1])
        name = mix((content[last] * _PLACES[:slots]).sum(1, dtype=np.uint64) + (lo[last] * 256 + hi[last]).astype(np.uint64) * _SALT[2])
        stay = last[np.sort(np.unique(name, return_index=True)[1])]
        return spans(doc[piece], h[piece], start[piece] + slot, length), tuple(x[stay] for x in (route, doc, h, start, lo, hi, content))

    def spans(doc, h, start, length) -> pa.RecordBatch:
        packed = (start.astype(np.int64) << 32) + length.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h), pa.array(packed)], ["doc", "h", "span"])

    dealt = pieces.repartition("route").sortWithinPartitions("route", "doc")
    return dealt.mapInArrow(run, "doc long, h long, span long")


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    texts = column(text).cast("string")
    return df.select(column(key).cast("long").alias("doc"), F.xxhash64(texts).alias("h"), texts.alias("text"))


def repeated_spans(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT,
) -> DataFrame:
    """(key, h, spans): where the texts repeat a window of a document with a smaller key.

    ``h`` is xxhash64 of the text (a row is known by both); ``spans`` is an array of
    start * 2**32 + number, in words; they may overlap. Together they hold exactly the words
    of the windows whose word sequence also begins in a document with a smaller key.
    Words are runs of ``[^\\x20\\x09-\\x0D]``, compared unchanged, by 40 bits of their hashes
    next to the 64 bits of the seven-word anchor. Texts without a repeated window, of fewer
    words than a window, empty or NULL, and rows without a key have no row; the latter are
    no source of others either. Rows of one key are no source of each other; equal rows have
    one row. Other columns are not read. No rows give no rows.

    Only words around anchors that several documents have ever leave the pass over the
    texts. A route gets at most ``hot`` pieces (an anchor of more is cut into its windows,
    whose pieces are all equal), and tasks stream their routes in blocks.
    """
    rows = _rows(df, key, text).where("doc IS NOT NULL")
    shared = _shared(rows, window, anchor, hot)
    found = written(_parsed(_pieces(rows, shared, window, anchor), window, anchor), "spans")
    removed(shared)
    return found.groupBy("doc", "h").agg(F.collect_set("span").alias("spans")).withColumnRenamed("doc", key)


def without_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", keep: Iterable[str] | None = None, window: int = WINDOW,
    anchor: int = ANCHOR, hot: int = HOT,
) -> DataFrame:
    """The kept columns (default: all) beside n_words, n_removed and kept (the words that stay, joined by one space).

    What goes are the words of ``repeated_spans``, judged on the input. Every row has a row,
    in whatever number it is repeated; NULL and empty texts have no words and an empty
    ``kept``. A kept column named like an output is replaced by it; other names don't matter.
    """
    outputs = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]
    names = [c for c in (df.columns if keep is None else keep) if c not in {f.name for f in outputs}]
    carried = F.struct(*[column(c) for c in names]) if names else F.lit(None).cast("int")
    texts = column(text).cast("string")
    rows = df.select(carried.alias("row"), column(key).cast("long").alias("doc"), F.xxhash64(texts).alias("h"), texts.alias("text"))
    spans = repeated_spans(df, key, text, window, anchor, hot).withColumnRenamed(key, "doc")
    given = rows.join(spans, ["doc", "h"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), *_cut(part.column(1), part.column(2))], ["row", *[f.name for f in outputs]])

    made = given.mapInArrow(run, StructType([given.schema["row"], *outputs]))
    return made.select(*[F.col("row").getField(c).alias(c) for c in names], *[f.name for f in outputs])


def _cut(texts: pa.Array, spans: pa.Array) -> list[pa.Array]:
    """(words, words removed, what is kept) of each text."""
    data, offsets = flat(texts)
    starts, ends, first = words(data, offsets)
    total = len(starts)
    packed = spans.flatten().to_numpy()
    many = np.where(spans.is_valid().to_numpy(zero_copy_only=False), np.diff(spans.offsets.to_numpy()), 0)
    begin = first[np.repeat(np.arange(len(many)), many)] + (packed >> 32)
    over = np.bincount(begin, minlength=total + 1) - np.bincount(begin + (packed & 0xFFFFFFFF), minlength=total + 1)
    stays = np.cumsum(over)[:total] == 0
    before = np.concatenate([[0], np.cumsum(stays)])
    count, left = np.diff(first), np.diff(before[first])
    s, size = starts[stays], (ends - starts)[stays] + 1
    # The space behind the last word of a text goes.
    size[before[first[1:]][left > 0] - 1] -= 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = data[np.minimum(np.repeat(s - to[:-1], size) + np.arange(to[-1]), max(len(data) - 1, 0))] if total else np.empty(0, np.uint8)
    inner = np.ones(len(s), bool)
    inner[before[first[1:]][left > 0] - 1] = False
    out[to[1:][inner] - 1] = 32
    where = to[before[first]].astype(np.int32)
    kept = pa.Array.from_buffers(pa.string(), len(count), [None, pa.py_buffer(where.tobytes()), pa.py_buffer(out.tobytes())])
    return [pa.array(count), pa.array(count - left), kept]
