"""Vectorised reading of whole texts inside tasks: slices, words, span hashes, shingles.

Texts stay in Arrow buffers; words are found and hashed with array operations, so
that no Python object is made per word. Work is cut into pieces of bounded size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of text handled at once, and of one hashed piece.
SLICE, PIECE = 1 << 20, 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240607)
_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_PLACES = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def release() -> None:
    """Gives freed memory back to the machine: workers wait for their next task beside those that are at work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library than GNU's.
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that releases memory at its end."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def column(name: str) -> F.Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one more at the end). NULL is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, one row at least."""
    _, offsets = flat(batch.column(name))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        for i, factor in enumerate((_FACTOR, _INVERSE)):
            table = np.full(max(n, PIECE + 1), factor)
            table[0] = 1
            _powers[i : i + 1] = [np.cumprod(table, dtype=np.uint64)]
    return _powers[0], _powers[1]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = LOWER) -> np.ndarray:
    """64-bit hashes of byte spans that are in order and don't overlap; ``table`` maps the bytes first."""
    values = _VALUES if table is None else _VALUES[table]
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + PIECE, "right")))
        a, b = starts[low], ends[high - 1]
        power, inverse = _power(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[data[a:b]] * power[: b - a], out=total[1:])
        s, e = starts[low:high] - a, ends[low:high] - a
        out[low:high] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        low = high
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the index of each text's first word (one more at the end)."""
    inside = ~SPACE[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words per text, and where each text's begin (one more at the end).

    A text of fewer words has one: its whole sequence. A text without words has none.
    """
    count = np.diff(first)
    number = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(number)])
    out = np.empty(offsets[-1], np.uint64)
    if len(hashes) >= n:
        run = np.zeros(len(hashes) - n + 1, np.uint64)
        for j in range(n):
            run += hashes[j : len(hashes) - n + 1 + j] * _PLACES[j]
        whole = np.flatnonzero(count >= n)
        size = number[whole]
        place = np.repeat(first[whole] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        out[np.repeat(offsets[whole] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] = run[place]
    for j in range(1, n):
        short = np.flatnonzero(count == j)
        total = np.full(len(short), j, np.uint64)
        for k in range(j):
            total += hashes[first[short] + k] * _PLACES[k]
        out[offsets[short]] = total
    return mix(out), offsets


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = flat(texts)
    starts, ends, first = words(data, offsets)
    values, where = shingles(hash_spans(data, starts, ends), first, n)
    return [np.unique(values[a:b]) for a, b in zip(where[:-1], where[1:])]


def map_texts(
    df: DataFrame, text: str, outputs: list[StructField], make: Callable[[], Callable[[pa.Array], list]],
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """The kept columns (default: all) beside columns computed from whole texts.

    ``make`` runs once per task and returns a function from a slice of texts to the
    output columns. A kept column named like an output is replaced by it.
    """
    names = {f.name for f in outputs}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    # A text column that is kept moves once.
    same = text in keep and df.schema[text].dataType == StringType()
    given = df.select(*[column(c) for c in keep], *([] if same else [column(text).cast("string").alias("__text")]))
    schema = StructType(given.schema.fields[: len(keep)] + outputs)
    name, at = (text, keep.index(text)) if same else ("__text", len(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in slices(batch, name):
                work = work or make()
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in work(part.column(at))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))] + made, [*keep, *[f.name for f in outputs]]
                )

    return given.mapInArrow(tidy(run), schema)
