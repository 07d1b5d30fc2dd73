"""Pre-token spans of texts in the first 256 code points, by array operations.

The two patterns are those of the public vocabularies; other texts go through the
tokenizer library, which is slower but knows every script.
"""

from __future__ import annotations

import numpy as np

SPACE, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
CLASS[[*range(65, 91), *range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = LETTER
CLASS[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
LOWER = np.arange(256, dtype=np.uint8)
LOWER[[*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] += 32


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more at the end)."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _runs(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, single: int) -> np.ndarray:
    """Marks the first byte of each run of one class; bytes of class ``single`` stand alone."""
    mark = np.zeros(len(data) + 1, bool)
    mark[offsets] = True
    mark[1:-1] |= kinds[1:] != kinds[:-1]
    if single >= 0:
        mark[:-1] |= kinds == single
    mark[-1] = True
    return mark


def _contractions(
    data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, run: np.ndarray, mark: np.ndarray
) -> None:
    """Joins a lone apostrophe that begins a pre-token with the s, t, re, ve, m, ll or d behind it."""
    n = len(data)
    at = np.flatnonzero((data == 39) & run[:-1] & run[1:] & mark[:-1])
    at = at[at + 1 < n]
    at = at[(kinds[at + 1] == LETTER) & ~np.isin(at + 1, offsets)]
    if not len(at):
        return
    one = data[at + 1]
    two = np.where(at + 2 < n, data[np.minimum(at + 2, n - 1)], 0)
    inside = np.where(at + 2 < n, ~run[np.minimum(at + 2, n)], False)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = inside & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
    for hit, size in ((at[short], 2), (at[long & ~short], 3)):
        mark[hit + 1] = False
        behind = hit + size
        ok = (behind < n) & (kinds[np.minimum(behind, n - 1)] == LETTER)
        mark[behind[ok]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of lower-case words, single digits and symbol runs; white space is dropped. Third: each text's first span."""
    kinds = CLASS[data]
    run = _runs(data, offsets, kinds, DIGIT)
    mark = run.copy()
    _contractions(data, offsets, kinds, run, mark)
    starts = np.flatnonzero(mark[:-1])
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    solid = kinds[starts] != SPACE if len(starts) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    return starts, ends, np.searchsorted(starts, offsets)


def byte_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the byte-level pattern, where one blank goes with what follows it. Third: each text's first span."""
    kinds = CLASS[data]
    run = _runs(data, offsets, kinds, -1)
    mark = run.copy()
    n = len(data)
    final = np.zeros(n + 1, bool)
    final[offsets] = True
    final[n] = True
    # last byte of each white-space run that something follows in the same text
    last = np.flatnonzero((kinds == SPACE) & run[1:] & ~final[1:]) if n else np.zeros(0, np.int64)
    mark[last] = True
    mark[last[data[last] == 32] + 1] = False
    _contractions(data, offsets, kinds, run, mark)
    starts = np.flatnonzero(mark[:-1])
    ends = np.append(starts[1:], n) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)
