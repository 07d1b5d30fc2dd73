"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both sides agree.

A byte-level vocabulary cuts a text into pre-tokens by a pattern that looks forward
only: what follows a position at which a pre-token begins depends on nothing before
it. So a chunk that began anywhere is right from the first position on at which its
own cuts and those of the chunk before, which are proven, fall together.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField

from jobtide.llm import latin
from jobtide.llm.bytetext import hash_spans, map_texts

#: Entries of a task's memory of pre-tokens, before it is emptied.
MEMORY = 400_000
#: Code points behind a cut that may still change it, unless a special string is longer.
REACH = 4

Cuts = tuple[np.ndarray, np.ndarray]


class Encoder:
    """Pre-token cuts and their token counts, as the tokenizers library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text())
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            raise ValueError("stable boundaries are proven for byte-level vocabularies with the usual pattern only")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.reach = max([REACH, *(len(t) for t in self.special)])
        self.memory: dict[int, int] = {}

    def plain(self, text: str) -> bytes | None:
        """The text in one byte per code point, or None if the library has to cut it."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if any(t in text for t in self.special) else raw

    def _counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        codes, distinct = pd.factorize(hash_spans(data, starts, ends, None))
        if len(self.memory) > MEMORY:
            self.memory.clear()
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.memory]
        if new:
            where = np.empty(len(keys), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            texts = [data[starts[w] : ends[w]].tobytes().decode("latin-1") for w in where[new].tolist()]
            for i, found in zip(new, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                self.memory[keys[i]] = len(found.ids)
        return np.fromiter(map(self.memory.__getitem__, keys), np.int64, len(keys))[codes]

    def cuts(self, text: str) -> Cuts:
        """Where each pre-token (or special string) begins, and its number of tokens."""
        raw = self.plain(text)
        if raw is not None:
            data, offsets = latin.join([raw])
            starts, ends, _ = latin.byte_spans(data, offsets)
            return starts, self._counts(data, starts, ends)
        found = self.tokenizer.encode(text, add_special_tokens=False)
        begins = np.array([a for a, _ in found.offsets], np.int64)
        of = found.word_ids
        # A special string has no word; its neighbours count words from 0 again.
        new = [i for i in range(len(of)) if not i or of[i] is None or of[i] != of[i - 1] or begins[i] < begins[i - 1]]
        return begins[new], np.diff([*new, len(of)])

    def totals(self, texts: list[str]) -> np.ndarray:
        """Token counts of texts that are encoded whole."""
        out = np.zeros(len(texts), np.int64)
        raws = [self.plain(t) for t in texts]
        easy = [i for i, r in enumerate(raws) if r is not None]
        data, offsets = latin.join([raws[i] for i in easy])
        starts, ends, first = latin.byte_spans(data, offsets)
        sums = np.concatenate([[0], np.cumsum(self._counts(data, starts, ends))])
        out[easy] = sums[first[1:]] - sums[first[:-1]]
        hard = [i for i, r in enumerate(raws) if r is None]
        for i, found in zip(hard, self.tokenizer.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False)):
            out[i] = len(found.ids)
        return out


def splice(encoder: Encoder, text: str, chunk: int, overlap: int) -> tuple[int, int]:
    """Tokens of a huge text, and how often an overlap had to be widened.

    Chunk k begins at k * chunk and reaches ``overlap`` code points into the next one.
    Cuts of the left chunk are proven up to ``encoder.reach`` before its end. If the
    two sides share none there, the left chunk is encoded again with twice the overlap.
    """
    n, total, widened = len(text), 0, 0
    begin, end = 0, min(chunk + overlap, n)
    at, counts = encoder.cuts(text[:end])
    for k in range(1, -(-n // chunk)):
        start = k * chunk
        if end == n:
            break
        stop = min(start + chunk + overlap, n)
        right, right_counts = encoder.cuts(text[start:stop])
        right = right + start
        wide = overlap
        while True:
            proven = at[(at >= start) & ((at <= end - encoder.reach) if end < n else (at < n))]
            shared = np.intersect1d(proven, right, assume_unique=True)
            if len(shared) or end == n:
                break
            wide, widened = 2 * wide, widened + 1
            if end >= stop:
                # the left side has passed the right chunk, which has to grow with it
                stop = min(max(stop, start + wide + overlap), n)
                right, right_counts = encoder.cuts(text[start:stop])
                right = right + start
            end = min(start + wide, n)
            at, counts = encoder.cuts(text[begin:end])
            at = at + begin
        if not len(shared):
            break
        begin = int(shared[0])
        total += int(counts[at < begin].sum())
        at, counts = right[right >= begin], right_counts[right >= begin]
        end = stop
    return total + int(counts.sum()), widened


def count_tokens(
    df: DataFrame, path: str, text: str = "text", limit: int = 1024, chunk: int = 65_536, overlap: int = 512,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    Texts longer than ``chunk`` code points are encoded in overlapping chunks, so that no
    task holds the tokens of a whole huge text. NULL counts as an empty text: 0 bytes, 0
    tokens. Rows are independent: ties and repeated rows get equal counts, an empty table
    stays empty, and input columns named like an output are replaced.
    """
    outputs = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]

    def make():
        encoder = Encoder(path)

        def work(texts: pa.Array) -> list:
            given = [t or "" for t in texts.to_pylist()]
            tokens = np.zeros(len(given), np.int64)
            small = [i for i, t in enumerate(given) if len(t) <= chunk]
            tokens[small] = encoder.totals([given[i] for i in small])
            for i, t in enumerate(given):
                if len(t) > chunk:
                    tokens[i] = splice(encoder, t, chunk, overlap)[0]
            return [np.fromiter((len(t.encode()) for t in given), np.int64, len(given)), tokens, tokens > limit]

        return work

    return map_texts(df, text, outputs, make, keep)
