"""Toxicity: a linear classifier of sentences that is kept from reacting to identity terms.

A text is as toxic as its worst sentence. Labelled texts teach the weights of words and
word beginnings by logistic loss on the worst sentence. In every labelled sentence with an
identity term the term is swapped for another of its kind, and for nothing, and the change
of the score is penalised, so that neutral mentions of a group don't count as toxic. (Swaps
among the terms alone would allow all of them to count.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from jobtide.llm.bytetext import column, flat, hash_spans, map_texts, release, slices, tidy

#: Kinds of identity terms; within a kind each term is swapped for the next one.
IDENTITY_TERMS = {
    "faith": "muslim christian jewish hindu buddhist sikh atheist catholic",
    "faiths": "muslims christians jews hindus buddhists sikhs atheists catholics",
    "person": "woman man girl boy",
    "people": "women men girls boys",
    "orientation": "gay lesbian bisexual straight heterosexual homosexual transgender queer",
    "ethnicity": "black white asian latino african european arab indigenous",
    "origin": "immigrant refugee foreigner native",
    "origins": "immigrants refugees foreigners natives",
    "ability": "disabled blind deaf autistic",
    "age": "old young elderly teenage",
}
#: Bits of a feature's number; bytes of the word beginnings that count as features; words of the longest sentence.
BITS, BEGINNINGS, SENTENCE = 18, (4, 5, 6), 48
#: Labelled texts per class that are learned from; features that are looked at together while learning.
PER_CLASS, BLOCK = 2_000, 1 << 18

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


def sentence_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each sentence: (features, sentence of each, text of each sentence, its bytes' begin and end)."""
    data, offsets = flat(texts)
    n = len(data)
    inside = _WORD[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    stop[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty((0, 2), np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    passed = np.cumsum(_END[data])[starts]
    new = np.concatenate([[True], (passed[1:] != passed[:-1]) | (text[1:] != text[:-1])])
    place = np.arange(len(starts)) - np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
    new |= place % SENTENCE == 0
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    spans = np.stack([starts[first], ends[np.append(first[1:], len(starts)) - 1]], 1)
    keys = [sentence << BITS | (hash_spans(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)]
    for size in BEGINNINGS:
        long = ends - starts > size
        h = hash_spans(data, starts[long], starts[long] + size) + np.uint64(size)
        keys.append(sentence[long] << BITS | ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64))
    found = np.unique(np.concatenate(keys))
    return found & ((1 << BITS) - 1), found >> BITS, text[first], spans


def swapper(terms: dict[str, str]) -> tuple[re.Pattern | None, dict[str, str]]:
    """Pattern of the identity terms, and the term that replaces each."""
    other = {}
    for line in terms.values():
        words = line.split()
        other |= dict(zip(words, words[1:] + words[:1]))
    pattern = r"\b(" + "|".join(sorted(map(re.escape, other), key=len, reverse=True)) + r")\b"
    return (re.compile(pattern, re.IGNORECASE) if other else None), other


def _training_sets(rows: DataFrame, terms: dict[str, str]) -> DataFrame:
    """(label, features, sizes of sentences, differences between sentences and their changed forms) of each text."""
    schema = "label int, features array<int>, sizes array<int>, changed array<int>, signs array<int>, pairs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, other = swapper(terms)
        for batch in batches:
            for part in slices(batch, "__text"):
                texts, out = part.column(0), []
                features, of, text_of, spans = sentence_features(texts)
                data, _ = flat(texts)
                parts = np.split(features, np.searchsorted(of, np.arange(1, len(text_of))))
                for t in range(part.num_rows):
                    own = np.flatnonzero(text_of == t) if len(text_of) else []
                    changed, signs, pairs = [], [], []
                    for s in own if pattern else []:
                        sentence = data[spans[s, 0] : spans[s, 1]].tobytes().decode("utf-8", "replace")
                        if not pattern.search(sentence):
                            continue
                        before = sentence_features(pa.array([sentence]))[0]
                        for form in (lambda m: other[m[0].lower()], ""):
                            after = sentence_features(pa.array([pattern.sub(form, sentence)]))[0]
                            gone, come = np.setdiff1d(before, after), np.setdiff1d(after, before)
                            changed += [*gone, *come]
                            signs += [1] * len(gone) + [-1] * len(come)
                            pairs.append(len(gone) + len(come))
                    mine = [parts[s] for s in own]
                    out.append((np.concatenate(mine) if mine else [], [len(x) for x in mine], changed, signs, pairs))
                lists = [pa.array([list(row[i]) for row in out], pa.list_(pa.int32())) for i in range(5)]
                yield pa.RecordBatch.from_arrays([part.column(1), *lists], schema.replace(",", "").split()[::2])

    return rows.select(F.col("text").alias("__text"), F.col("label")).mapInArrow(tidy(run), schema)


def fit(
    labelled: DataFrame, text: str = "text", label: str = "toxic", terms: dict[str, str] | None = None, strength: float = 1.0,
    steps: int = 80, rate: float = 0.15, decay: float = 1e-4,
) -> np.ndarray:
    """Weights of the features, and the bias behind them.

    ``labelled`` is a bounded table of texts with labels 0 and 1 (see ``sample_labels``);
    its features are computed by the tasks and learned on the driver. Rows without a label
    are left out; without rows of both classes all scores are 0.5.
    """
    rows = labelled.select(column(text).cast("string").alias("text"), column(label).cast("int").alias("label")).where("label IN (0, 1)")
    # The table goes as soon as its columns are copied.
    found = _descend(_training_sets(rows, IDENTITY_TERMS if terms is None else terms).toArrow(), strength, steps, rate, decay)
    release()
    return found


def _lists(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int32), *[c.flatten().to_numpy() for c in table.column(name).chunks]])


def _cuts(edges: np.ndarray) -> list[int]:
    """Places that cut consecutive groups, of which ``edges`` has the limits, into blocks of about BLOCK features, a group at least."""
    cuts = [0]
    while cuts[-1] < len(edges) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(edges, edges[cuts[-1]] + BLOCK, "right")) - 1))
    return cuts


def _texts_with(features: np.ndarray, edges: np.ndarray, texts: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of each feature the number of texts with label 0 that have it, and of those with label 1."""
    limits, many = edges[texts], [np.zeros(1 << BITS, np.int64) for _ in (0, 1)]
    cuts = _cuts(limits)
    for a, b in zip(cuts[:-1], cuts[1:]):
        text = np.repeat(np.arange(a, b), np.diff(limits[a : b + 1]))
        at = np.unique(text << BITS | features[limits[a] : limits[b]])
        for k in (0, 1):
            many[k] += np.bincount(at[labels[at >> BITS] == k] & ((1 << BITS) - 1), minlength=1 << BITS)
    return many


def _logits(weights: np.ndarray, features: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The sum of the weights of each sentence's features."""
    out, cuts = np.empty(len(edges) - 1), _cuts(edges)
    for a, b in zip(cuts[:-1], cuts[1:]):
        of = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
        out[a:b] = np.bincount(of, weights[features[edges[a] : edges[b]]], b - a)
    return out


def _descend(got: pa.Table, strength: float, steps: int, rate: float, decay: float) -> np.ndarray:
    weights = np.zeros((1 << BITS) + 1)
    labels = got.column("label").to_numpy().astype(float)
    if not 0 < labels.sum() < len(labels):
        return weights
    features, sizes = _lists(got, "features").astype(np.int32, copy=False), _lists(got, "sizes")
    changed, signs, pairs = (_lists(got, n) for n in ("changed", "signs", "pairs"))
    counts = pc.list_value_length(got.column("sizes")).to_numpy()
    del got
    full = np.flatnonzero(counts)
    labels, counts = labels[full], counts[full]
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    many = _texts_with(features, edges, np.append(begins, len(sizes)), labels)
    # Words of one or two texts say more about these texts than about toxicity.
    use = (many[0] + many[1] >= 3)[features]
    edges = np.concatenate([[0], np.cumsum(use)])[edges]
    features = features[use]
    del use
    pair = np.repeat(np.arange(len(pairs)), pairs)
    share = np.where(labels > 0, 0.5 / max(labels.sum(), 1), 0.5 / max(len(labels) - labels.sum(), 1))
    # Starting point: how much more often a feature comes with the label.
    odds = np.log((many[1] + 0.5) / (labels.sum() + 1)) - np.log((many[0] + 0.5) / (len(labels) - labels.sum() + 1))
    weights[:-1] = np.where((many[1] >= 3) & (odds > 1.5), odds, 0)
    weights[-1] = -2.0
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        logits = _logits(weights, features, edges)
        worst = np.maximum.reduceat(logits, begins)
        chosen = begins + np.array([np.argmax(x) for x in np.split(logits, begins[1:])])
        error = (1 / (1 + np.exp(-np.clip(worst + weights[-1], -30, 30))) - labels) * share
        gradient = decay * weights
        lengths = edges[chosen + 1] - edges[chosen]
        take = np.repeat(edges[chosen] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        gradient[:-1] += np.bincount(features[take], np.repeat(error, lengths), 1 << BITS)
        gradient[-1] = error.sum()
        if len(pairs):
            change = np.bincount(pair, weights[changed] * signs, len(pairs))
            gradient[:-1] += np.bincount(changed, 2 * strength / len(pairs) * change[pair] * signs, 1 << BITS)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return weights


def sample_labels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """(text, label) of at most ``per_class`` labelled documents of each class, drawn by the hash of their key.

    Labels without a document are left out before the draw.
    """
    given = labels.select(column(key).alias("key"), column(label).cast("int").alias("label")).where("key IS NOT NULL")
    given = given.join(documents.select(column(key).alias("key")), "key", "left_semi")
    parts = [given.where(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(per_class) for k in (0, 1)]
    drawn = parts[0].unionByName(parts[1])
    texts = documents.select(column(key).alias("key"), column(text).cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "key").groupBy("key", "label").agg(F.min("text").alias("text")).select("text", F.col("label").alias(label))


def score(df: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1, that of the worst sentence) and ``predicted`` (1 from ``threshold`` on).

    NULL, empty and wordless texts get the score of the bias alone. Rows are independent;
    an empty table stays empty; input columns named like an output are replaced.
    """
    known = df.sparkSession.sparkContext.broadcast(weights)
    outputs = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]

    def make():
        w = known.value

        def work(texts: pa.Array) -> list:
            features, of, text_of, _ = sentence_features(texts)
            worst = np.full(len(texts), -np.inf)
            np.maximum.at(worst, text_of, np.bincount(of, w[features], len(text_of)))
            found = 1 / (1 + np.exp(-np.clip(np.where(np.isfinite(worst), worst, 0) + w[-1], -30, 30)))
            return [found, (found >= threshold).astype(np.int32)]

        return work

    return map_texts(df, text, outputs, make, keep)
