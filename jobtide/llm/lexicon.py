"""Word-level BPE through a minimal acyclic transducer of frequent words.

Frequent words of the corpus are merged once and compiled into an automaton that
shares their prefixes and suffixes; the outputs along a path add up to the number of
the word, which finds its token ids. Tasks map the compiled file into memory. Words
that it lacks are merged exactly, pair by pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
from array import array
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from jobtide.llm import latin
from jobtide.llm.bytetext import column, hash_spans, map_texts, release, slices, tidy
from jobtide.llm.components import written

#: Words outside the lexicon that a task remembers, before they are forgotten; words of one partial count.
MEMORY, COUNTED = 30_000, 50_000
#: Letters of the longest word that is merged without a heap.
SHORT = 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordSplitter:
    """Words of a text, by a vocabulary file with word ends. The vocabulary itself is not held."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        if not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or spec["decoder"]:
            raise ValueError("a vocabulary with word ends and without a decoder is needed")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The library's normaliser and splitter, without tokens.
        bare = {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        self.reader = Tokenizer.from_str(json.dumps(spec | bare))
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        strings = sorted(self.special, key=len, reverse=True)
        self.apart = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        self._read(model)

    def _read(self, model: dict) -> None:
        """Takes what more is needed of the vocabulary."""

    def plain(self, text: str) -> bytes | None:
        """The text in one byte per code point, or None if the tokenizer's own normaliser has to read it."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if self.apart and self.apart.search(text) else raw

    def pieces(self, text: str) -> Iterator[bytes | int]:
        """Words in UTF-8, and ids of special strings, of any text."""
        for i, part in enumerate(self.apart.split(text) if self.apart else [text]):
            if i % 2:
                yield self.special[part]
            elif part:
                shown = self.reader.pre_tokenizer.pre_tokenize_str(self.reader.normalizer.normalize_str(part))
                for word, _ in shown:
                    yield bytes(self.bytes[c] for c in word)


class WordBpe(WordSplitter):
    """Words of a text and their merges."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path

    def _read(self, model: dict) -> None:
        self.suffix: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        # Parts of pairs are the vocabulary's strings, not further copies.
        own = {t: t for t in self.vocab}
        self.ranks = {(own.get(a, a), own.get(b, b)): i for i, (a, b) in enumerate(model["merges"])}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}

    @cached_property
    def tokenizer(self):
        """The library's whole tokenizer; tasks don't need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def merge(self, word: bytes) -> list[int]:
        """Token ids of a word: the pair of lowest rank, leftmost first, is joined until none is left."""
        parts = [self.letters[b] for b in word]
        if not parts:
            return []
        parts[-1] += self.suffix
        joined = self._joined(parts) if len(parts) <= SHORT else self._joined_by_heap(parts)
        # Symbols that the vocabulary lacks have no id and no unknown token stands for them.
        return [self.vocab[p] for p in joined if p in self.vocab]

    def _joined(self, parts: list[str]) -> list[str]:
        rank, none = self.ranks.get, len(self.ranks)
        order = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while order and (least := min(order)) < none:
            i = order.index(least)
            parts[i] += parts.pop(i + 1)
            del order[i]
            if i:
                order[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(order):
                order[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def _joined_by_heap(self, parts: list[str | None]) -> list[str]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (r := ranks.get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
        return [p for p in parts if p is not None]


# --- the automaton ---------------------------------------------------------


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The words as a minimal acyclic transducer, with the ids of each, as one file.

    Words are added in order; what lies behind the common prefix with the word before is
    final and is replaced by an equal state, if there is one (a register of states). The
    output of an arc is the number of words that come before those behind it.
    """
    register: dict[bytes, int] = {}
    sizes = array("q")
    path: list[tuple[bool, list[int]]] = [(False, [])]  # open states along the last word; an arc is target << 8 | label
    last = b""

    def packed(final: bool, arcs: list[int]) -> bytes:
        return array("q", [final, *arcs]).tobytes()

    def close(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, arcs = path.pop()
            key = packed(final, arcs)
            state = register.get(key)
            if state is None:
                state = register[key] = len(register)
                sizes.append(final + sum(sizes[arc >> 8] for arc in arcs))
            path[-1][1][-1] |= state << 8

    ordered = sorted(entries)
    for word in ordered:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        for label in word[common:]:
            path[-1][1].append(label)
            path.append((False, []))
        path[-1] = (True, path[-1][1])
        last = word
    close(0)
    root = len(register)
    states = [*register, packed(*path[0])]
    lengths = np.fromiter(map(len, states), np.int64, len(states)) // 8
    whole = np.frombuffer(b"".join(states), np.int64)
    heads = np.cumsum(lengths) - lengths
    final, arcs = whole[heads], np.delete(whole, heads)
    state = np.repeat(np.arange(len(states)), lengths - 1)
    keys, targets = state << 8 | arcs & 255, arcs >> 8
    # Words behind the arcs before this one, of the same state.
    passed = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64)[targets])]).astype(np.int64)
    outputs = passed[:-1] - passed[heads - np.arange(len(states))][state] + final[state]
    ids = [entries[w] for w in ordered]
    arrays = [
        np.array([root], np.int64), keys, targets, outputs, final, np.cumsum([0, *map(len, ids)], dtype=np.int64),
        np.array([i for x in ids for i in x], np.int64),
    ]
    head = np.array([len(arrays), *map(len, arrays)], np.int64)
    return head.tobytes() + b"".join(a.astype("<i8").tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, mapped into memory from a file of the task's own, which is gone with the mapping."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        whole = np.frombuffer(self.map, "<i8")
        ends = 1 + whole[0] + np.cumsum(whole[1 : 1 + whole[0]])
        starts = [1 + whole[0], *ends[:-1]]
        root, self.keys, self.targets, self.outputs, self.final, self.where, self.ids = (
            whole[a:b] for a, b in zip(starts, ends)
        )
        self.root = int(root[0])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if it isn't in the lexicon. All words take each step together."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes) - sizes
        number = np.zeros(len(words), np.int64)
        state = np.full(len(words), self.root)
        alive = np.arange(len(words)) if len(self.keys) else np.zeros(0, np.int64)
        if not len(self.keys):
            number[:] = -1
        step = 0
        while len(alive):
            done = sizes[alive] == step
            ended = alive[done]
            number[ended[self.final[state[ended]] == 0]] = -1
            alive = alive[~done]
            key = state[alive] << 8 | data[begins[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            number[alive[~there]] = -1
            alive, arc = alive[there], arc[there]
            number[alive] += self.outputs[arc]
            state[alive] = self.targets[arc]
            step += 1
        return number

    def of(self, number: int) -> list[int]:
        return self.ids[self.where[number] : self.where[number + 1]].tolist()


# --- over the corpus -------------------------------------------------------


def _spans(bpe: WordSplitter, texts: list[str]):
    """Codes of the words of plain texts: distinct hashes, a function that gives a word, codes, each text's first; the other texts."""
    raws = [bpe.plain(t) for t in texts]
    easy = [i for i, r in enumerate(raws) if r is not None]
    data, offsets = latin.join([raws[i] for i in easy])
    data = latin.LOWER[data]
    starts, ends, first = latin.word_spans(data, offsets)
    # By Arrow: Pandas isn't loaded into the workers for this alone.
    coded = pa.array(hash_spans(data, starts, ends, None)).dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    where = np.empty(len(distinct), np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]

    def word(i: int) -> bytes:
        at = where[i]
        return data[starts[at] : ends[at]].tobytes().decode("latin-1").encode()

    return distinct, word, codes, first, easy, [i for i, r in enumerate(raws) if r is None]


def count_words(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word in UTF-8, n) over all texts, summed within tasks first."""
    given = df.select(column(text).cast("string").alias("__text")).where(F.col("__text") != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, counts = WordSplitter(path), {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch, "__text"):
                texts = part.column(0).to_pylist()
                distinct, word, codes, _, _, hard = _spans(bpe, texts)
                for i, n in enumerate(np.bincount(codes, minlength=len(distinct)).tolist()):
                    w = word(i)
                    counts[w] = counts.get(w, 0) + n
                for i in hard:
                    for w in bpe.pieces(texts[i]):
                        if isinstance(w, bytes):
                            counts[w] = counts.get(w, 0) + 1
                if len(counts) > COUNTED:
                    yield flush()
        yield flush()

    return given.mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, path: str, text: str = "text", size: int = 65_536) -> bytes:
    """Compiled lexicon of the most frequent words of the whole corpus, ``size`` at most.

    Words that are as frequent as each other are in or out together, so that no task has to
    rank them. Only the chosen ones reach the driver: what is compiled and sent to the
    tasks is bounded by the parameter.
    """
    counts = written(count_words(df, path, text), "words")
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(size).collect()
    least, room = None, size
    for step in steps:
        room -= step["words"]
        if room < 0:
            break
        least = step["n"]
    top = counts.where(F.lit(False) if least is None else F.col("n") >= least).select("word").toArrow()
    bpe = WordBpe(path)
    entries = {w: bpe.merge(w) for w in top.column(0).to_pylist()}
    # The vocabulary is not held beside the states of the automaton.
    del bpe, top
    compiled = compile_lexicon(entries)
    del entries
    release()
    return compiled


def encode(
    df: DataFrame, path: str, text: str = "text", size: int = 65_536, keep: list[str] | None = None,
    full: bool = False,
) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; with ``full`` also ``ids`` and ``decoded``.

    Ids are little-endian unsigned 32-bit integers. The decoded text has the tokens with
    blanks between them, as a vocabulary without a decoder gives it; special strings in a
    text become their ids and come back. NULL counts as an empty text. Rows are
    independent; an empty table stays empty; input columns named like an output are
    replaced.
    """
    lexicon = df.sparkSession.sparkContext.broadcast(build_lexicon(df, path, text, size))
    outputs = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if full:
        outputs += [StructField("ids", BinaryType()), StructField("decoded", StringType())]

    def make():
        bpe, known = WordBpe(path), Lexicon(lexicon.value)
        # What reading the vocabulary took.
        release()
        often: dict[int | bytes, tuple[bytes, str]] = {}  # words of the lexicon, which bounds them
        rare: dict[int | bytes, tuple[bytes, str]] = {}

        def entry(ids: list[int]) -> tuple[bytes, str]:
            return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(bpe.names.__getitem__, ids))

        def learn(keys: list, words: list[bytes]) -> None:
            for key, word, number in zip(keys, words, known.numbers(words).tolist()):
                if number >= 0:
                    often[key] = entry(known.of(number))
                else:
                    rare[key] = entry(bpe.merge(word))

        def whole(parts: list[tuple[bytes, str]]) -> tuple:
            ids, shown = b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[0]])
            row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
            return (*row, ids, shown) if full else row

        def work(texts: pa.Array) -> list:
            # Few of these words come again, the less so the more texts there are.
            if len(rare) > MEMORY:
                rare.clear()
            given = [t or "" for t in texts.to_pylist()]
            rows: list = [None] * len(given)
            distinct, word, codes, first, easy, hard = _spans(bpe, given)
            keys = distinct.tolist()
            new = [i for i, k in enumerate(keys) if k not in often and k not in rare]
            learn([keys[i] for i in new], [word(i) for i in new])
            parts = [often.get(k) or rare[k] for k in keys]
            for i, a, b in zip(easy, first[:-1].tolist(), first[1:].tolist()):
                rows[i] = whole([parts[c] for c in codes[a:b].tolist()])
            for i in hard:
                pieces = list(bpe.pieces(given[i]))
                new = list({p for p in pieces if isinstance(p, bytes) and p not in often and p not in rare})
                learn(new, new)
                rows[i] = whole([(often.get(p) or rare[p]) if isinstance(p, bytes) else entry([p]) for p in pieces])
            return [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()])]

        return work

    return map_texts(df, text, outputs, make, keep)
