"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch keeps the k smallest hashes of a set (and its exact size while it is not full).
Sketches of parts merge into that of the whole, and estimate how alike two sets are, how
far one contains the other, and how many distinct shingles there are.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from jobtide.llm.bytetext import column, map_texts, shingle_sets
from jobtide.llm.ordered import with_next

#: Hashes kept, and words of a shingle.
K, WORDS = 128, 5
_TOP = float(1 << 64)


def to_text(kept: np.ndarray) -> str:
    """A sketch as text: its hashes in ascending order, big-endian, in base64."""
    return base64.b64encode(kept.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def bottom(values: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of a set of hashes."""
    return np.unique(values)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union."""
    return np.unique(np.concatenate([a, b]))[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated size of the set; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[k - 1]) + 1) / _TOP)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that both have. Two empty sets are alike."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(union, a, True), b, True)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's elements that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, shared / distinct(a, k))


def fingerprint(df: DataFrame, text: str = "text", k: int = K, n: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """Adds ``fingerprint`` and ``n_distinct`` (estimated distinct shingles) of whole texts.

    NULL and wordless texts have the empty fingerprint, and 0 shingles. Equal texts have
    equal fingerprints; rows are independent; an empty table stays empty; input columns
    named like an output are replaced.
    """
    outputs = [StructField("fingerprint", StringType()), StructField("n_distinct", DoubleType())]

    def make():
        def work(texts: pa.Array) -> list:
            found = [s[:k] for s in shingle_sets(texts, n)]
            return [pa.array([to_text(x) for x in found], pa.string()), pa.array([distinct(x, k) for x in found], pa.float64())]

        return work

    return map_texts(df, text, outputs, make, keep)


def merge_fingerprints(df: DataFrame, by: list[str], name: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint per group: the k smallest distinct hashes of the group's fingerprints.

    Fingerprints are merged within tasks first, so that a hot group moves one partial
    sketch per task and group, not its rows. Rows without a fingerprint add nothing.
    """
    keys = [column(c) for c in by]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple, np.ndarray] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for *key, text in zip(*[c.to_pylist() for c in batch.columns]):
                got = from_text(text or "")
                before = parts.get(tuple(key))
                parts[tuple(key)] = got[:k] if before is None else merge(before, got, k)
            if len(parts) > 10_000:
                yield _table(parts, schema)
                parts = {}
        if parts:
            yield _table(parts, schema)

    def _table(parts: dict, schema: pa.Schema) -> pa.RecordBatch:
        columns = [*zip(*parts)] if len(schema) > 1 else []
        return pa.RecordBatch.from_arrays(
            [*[pa.array(list(c), f.type) for c, f in zip(columns, schema)], pa.array([to_text(x) for x in parts.values()], pa.string())],
            schema=pa.schema([*list(schema)[:-1], pa.field(schema[-1].name, pa.string())]),
        )

    given = df.select(*keys, column(name).alias("__sketch"))
    folded = given.mapInArrow(fold, given.schema)
    schema = StructType([*given.schema.fields[:-1], StructField(name, StringType())])
    return folded.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_fold_sorted(len(by), k, name), schema)


def _fold_sorted(n_keys: int, k: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, schema, out = None, None, None, []
        for batch in batches:
            schema = batch.schema
            for *key, text in zip(*[c.to_pylist() for c in batch.columns]):
                if held is not None and key == held:
                    kept = merge(kept, from_text(text), k)
                    continue
                if held is not None:
                    out.append((*held, to_text(kept)))
                held, kept = key, from_text(text)[:k]
            if len(out) >= 10_000:
                yield _rows(out, schema, name)
                out = []
        if held is not None:
            yield _rows([*out, (*held, to_text(kept))], schema, name)

    def _rows(rows: list, schema: pa.Schema, name: str) -> pa.RecordBatch:
        fields = [*list(schema)[:n_keys], pa.field(name, pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields))

    return run


def edited_likeness(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, n: int = WORDS) -> DataFrame:
    """Fingerprints of each text and of an edited form of it, and how alike they are.

    The edited form ends with the beginning of the next text in key order instead of its
    own last quarter. Columns: key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    NULL texts are empty; texts without words have empty fingerprints, which are alike
    (1.0) with each other and 0.0 with others. Rows of one key follow the hash of their
    texts; repeated rows are each other's next; NULL keys come first; one row is its own
    next. Other columns are not read, so that their names don't matter; no rows give none.
    """
    text_type, real = StringType(), DoubleType()
    outputs = [
        StructField("n_chars", LongType()), StructField("edited_sha256", text_type), StructField("fingerprint", text_type),
        StructField("edited_fingerprint", text_type), StructField("near_edited", real), StructField("near_next", real),
    ]

    def work(texts: pa.Array, at: np.ndarray) -> list:
        given = [t or "" for t in texts.to_pylist()]
        edited = []
        for i in at.tolist():
            cut = len(given[i]) // 4
            edited.append(given[i][: len(given[i]) - cut] + given[i + 1][:cut])
        own = [s[:k] for s in shingle_sets(texts, n)]
        new = [s[:k] for s in shingle_sets(pa.array(edited, pa.string()), n)]
        shown = [to_text(x) for x in own]
        return [
            pa.array([len(given[i]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([shown[i] for i in at], pa.string()),
            pa.array([to_text(x) for x in new], pa.string()),
            pa.array([resemblance(own[i], x, k) for i, x in zip(at, new)], pa.float64()),
            pa.array([resemblance(own[i], own[i + 1], k) for i in at], pa.float64()),
        ]

    return with_next(df, key, text, outputs, work)
