"""Where in a text the cleaning and markup patterns can match at all.

One pass over the bytes of whole batches marks what every match of a pattern must hold:
marks such as ``<`` or ``@``, digits, dots within words, lone letters of gender markers,
the first letters of URLs and calls to action. The text between the first and the last of
them, widened to ends of sentences, is its *body*; regular expressions that run on the
body alone find what they find in the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are looked at together.
SLICE = 1 << 21

_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "<>[](){}*_`@\"\\#~/&0123456789"]] = True
# Beyond ASCII only the letters of U+00C0 to U+00FF are known to matter to no pattern.
_MARK[0xC0:] = True
_MARK[0xC3] = False
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
# Letters of U+00C0 to U+00FF belong to words; the two signs among them are marks.
_LETTER = _WORD.copy()
_LETTER[0x80:0xC0] = _LETTER[0xC3] = True
_LONE = np.zeros(256, bool)
_LONE[[ord(c) for c in "mfwxdhMFWXDH"]] = True
#: Beginnings of URLs and of what every call to action holds.
_BEGINNINGS = [int.from_bytes(x, "little") for x in (b"http", b"www.", b"join", b"cont", b"appl")]


def marks(data: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Which bytes a match must hold one of; ``edge`` has the places where a text begins or ends."""
    n = len(data)
    # The byte behind each one, blank at the end of a text; and the one before.
    after, before = np.empty_like(data), np.empty_like(data)
    after[:-1], before[1:] = data[1:], data[:-1]
    after[edge[1:] - 1] = before[edge[:-1]] = 32
    out = _MARK[data]
    out |= (data == 46) & ~_SPACE[after]
    out |= (data == 45) & (after == 45)
    quote = data == 39
    out |= quote & ~(_WORD[before] & _WORD[after])
    out |= (data == 0xC3) & ((after == 0x97) | (after == 0xB7))
    word = _LETTER[data]
    starts = np.flatnonzero(word & ~_LETTER[before])
    ends = np.flatnonzero(word & ~_LETTER[after]) + 1
    short = ends - starts <= 3
    starts, ends = starts[short], ends[short]
    lone = _LONE[data]
    alone = lone[starts] & lone[ends - 1] & lone[(starts + ends - 1) >> 1]
    out[starts[alone]] = True
    if n >= 4:
        low = (data | 32).astype(np.uint32)
        four = low[:-3] | low[1:-2] << 8 | low[2:-1] << 16 | low[3:] << 24
        for beginning in _BEGINNINGS:
            out[:-3] |= four == beginning
    return out


def bodies(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the body of each text begins and ends, in bytes; the same place for a text without marks.

    It begins with the last full stop (``.!?`` before a blank or a new line) before the
    first mark, or with the text. Such a stop belongs to no match that begins before it,
    and it keeps ``^`` from matching behind it. It ends with the first full stop behind
    the word that follows the last mark's own, or with the text.
    """
    begin, end = offsets[:-1], offsets[1:]
    full = begin < end
    edge = np.concatenate([begin[full], offsets[-1:]])
    if not full.any():
        return begin.copy(), begin.copy()
    marked = np.flatnonzero(marks(data, edge))
    space = _SPACE[data]
    after = np.ones(len(data), bool)
    after[:-1] = (data[1:] == 32) | (data[1:] == 10)
    after[end[full] - 1] = False
    stops = np.flatnonzero(_STOP[data] & after)
    blanks = np.flatnonzero(space)
    others = np.flatnonzero(~space)

    def following(places: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first of the places from each point on, the end of its text if there is none."""
        found = np.searchsorted(places, at)
        return np.minimum(np.append(places, len(data))[found], end)

    low, high = np.searchsorted(marked, begin), np.searchsorted(marked, end)
    some = high > low
    edge_marks = np.append(marked, 0)
    first, last = edge_marks[np.minimum(low, len(marked))], edge_marks[np.maximum(high - 1, 0)]
    stop = np.searchsorted(stops, first) - 1
    start = np.where(stop >= 0, np.append(stops, 0)[stop], 0)
    start = np.where((stop >= 0) & (start >= begin), start, begin)
    behind = following(blanks, following(others, following(blanks, last)))
    finish = np.minimum(following(stops, behind) + 1, end)
    return np.where(some, start, begin), np.where(some, finish, begin)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def located(texts: pa.Array) -> pa.Array:
    """(skip, take) in characters: what comes before the body, and the body itself. NULL and unmarked texts have an empty one."""
    texts = pc.fill_null(texts, "")
    out = []
    row = 0
    offsets = _flat(texts)[1] if len(texts) else np.zeros(1, np.int64)
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        data, own = _flat(texts.slice(row, stop - row))
        start, finish = bodies(data, own)
        # Characters up to each byte: those that do not continue one.
        upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        out.append((upto[start] - upto[own[:-1]], upto[finish] - upto[start]))
        row = stop
    skip, take = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2
    return pa.StructArray.from_arrays([pa.array(skip.astype(np.int32)), pa.array(take.astype(np.int32))], ["skip", "take"])


@F.arrow_udf(T.StructType([T.StructField("skip", T.IntegerType()), T.StructField("take", T.IntegerType())]))
def _located(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield located(batch)


def place(c: Column) -> Column:
    """(skip, take): where the body of a text is."""
    return _located(c)


def body(c: Column, at: Column | None = None) -> Column:
    """The part of a text in which patterns can match; empty without any, NULL for NULL."""
    at = place(c) if at is None else at
    return F.substring(c, at["skip"] + 1, at["take"])


def rejoined(c: Column, at: Column, middle: Column) -> Column:
    """The text with another body."""
    head = F.substring(c, F.lit(1), at["skip"])
    tail = F.substring(c, at["skip"] + at["take"] + 1, F.length(c))
    return F.concat(head, middle, tail)
