"""Large JSON arrays read in parallel: one file in as many tasks as it has splits.

Spark's text reader cuts a file by bytes and gives each task the stretches between commas,
wherever these are. A first pass sums up each split without knowing where it begins: the
parity of its quotes, how much deeper it ends than it began, and the least depth at
which it has a comma, each for a beginning inside and outside of a string. These sums are
associative; one after the other they give the true state at the beginning of each
split, and a second pass cuts the splits into records. A record that crosses splits is put
together from its fragments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTE, _BACKSLASH, _COMMA = 34, 92, 44
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_FAR = 1 << 40


def _inside(data: np.ndarray) -> np.ndarray:
    """Parity of the quotes up to each byte (its own included) that no backslash escapes."""
    quote = data == _QUOTE
    slash = data == _BACKSLASH
    if slash.any():
        # A quote is escaped behind an odd number of backslashes.
        at = np.arange(len(data))
        last_other = np.maximum.accumulate(np.where(slash, -1, at))
        before = np.concatenate([[0], (at - last_other)[:-1]])
        quote &= before % 2 == 0
    return np.cumsum(quote) & 1


@dataclass
class Summary:
    """Of a stretch of text: quote parity, and for a beginning outside and inside of a string the depth added and the least depth at a comma."""

    parity: int = 0
    added: list[int] = field(default_factory=lambda: [0, 0])
    least: list[int] = field(default_factory=lambda: [_FAR, _FAR])

    def then(self, other: Summary) -> Summary:
        added, least = [], []
        for state in (0, 1):
            later = state ^ self.parity
            added.append(self.added[state] + other.added[later])
            least.append(min(self.least[state], self.added[state] + other.least[later]))
        return Summary(self.parity ^ other.parity, added, least)


def summary(data: np.ndarray) -> Summary:
    """Summary of bytes that do not begin behind a backslash."""
    if not len(data):
        return Summary()
    inside, step, comma = _inside(data), _STEP[data], data == _COMMA
    out = Summary(int(inside[-1]))
    for state in (0, 1):
        outside = inside == state
        depth = np.cumsum(np.where(outside, step, 0))
        out.added[state] = int(depth[-1])
        commas = depth[outside & comma]
        out.least[state] = int(commas.min()) if len(commas) else _FAR
    return out


class Cutter:
    """Cuts the text of one split into records, from the state and depth at its beginning."""

    def __init__(self, state: int, depth: int, first: bool = False):
        self.state, self.depth, self.may_open = state, depth, first
        self.parts: list[bytes] = []
        #: Whether the open piece began in this split, and whether a record of the array is there already.
        self.begun, self.seen = False, False

    def read(self, text: bytes) -> Iterator[tuple[bool, bytes]]:
        """(whether it is whole, text) of the pieces that end here; a piece that is not whole began in an earlier split."""
        data = np.frombuffer(text, np.uint8)
        if not len(data):
            return
        inside = _inside(data) ^ self.state
        step = np.where(inside == 0, _STEP[data], 0)
        depth = self.depth + np.cumsum(step)
        outside = inside == 0
        opens, closes = outside & (step > 0) & (depth == 1), outside & (step < 0) & (depth == 0)
        cuts = np.flatnonzero(opens | closes | (outside & (data == _COMMA) & (depth == 1)))
        if (depth < 0).any() or np.count_nonzero(opens & (data != ord("["))):
            raise ValueError("not a JSON array")
        start = 0
        for at in cuts.tolist():
            self.parts.append(text[start:at])
            piece, begun = b"".join(self.parts), self.begun
            self.parts, start = [], at + 1
            if opens[at]:
                if not self.may_open or piece.strip(b" \t\r\n\xef\xbb\xbf"):
                    raise ValueError("text beside the array")
                self.may_open = False
            elif piece.strip() or not begun:
                yield begun, piece
            elif self.seen or not closes[at]:
                raise ValueError("an empty element in the array")
            self.seen = not opens[at]
            self.begun = not closes[at]
        self.parts.append(text[start:])
        self.state, self.depth = int(inside[-1]), int(depth[-1])

    def rest(self) -> bytes:
        """The piece that is open at the end."""
        return b"".join(self.parts)


def write_array(df: DataFrame, path: str) -> None:
    """Write rows as JSON arrays: each task writes the rows that it has, in their order, as one file that holds one array. NULLs are written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            if batch.num_rows:
                leads = pa.array([lead] + [","] * (batch.num_rows - 1))
                yield lines(pc.binary_join_element_wise(leads, batch.column(0).cast(pa.string()), ""))
                lead = ","
        yield lines(pa.array(["]" if lead == "," else "[]"]))

    def lines(texts: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([texts], ["line"])

    records = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("record"))
    records.mapInArrow(run, "line string").write.text(path)


def _stretches(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", ",").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, bytes]]:
    """((file, start), whether it begins, text) of stretches of one split; each row but a file's first is led by its comma."""
    last = None
    for batch in batches:
        values, files, starts = (batch.column(i).to_pylist() for i in range(3))
        a = 0
        while a < len(values):
            b = a + 1
            while b < len(values) and (files[b], starts[b]) == (files[a], starts[a]):
                b += 1
            now = files[a], starts[a]
            joined = ",".join(values[a:b]).encode()
            yield now, now != last, joined if now != last and starts[a] == 0 else b"," + joined
            last, a = now, b


def splits(spark: SparkSession, path: str) -> list[dict]:
    """File, start, and the state, depth and open record at the beginning of each split: one small row per split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, Summary()
        for split, begins, text in _by_split(batches):
            if begins and now is not None:
                yield row(now, total)
            now, total = split, (Summary() if begins else total).then(summary(np.frombuffer(text, np.uint8)))
        if now is not None:
            yield row(now, total)

    def row(split: tuple[str, int], s: Summary) -> pa.RecordBatch:
        names = ["file", "start", "parity", "added0", "added1", "least0", "least1"]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*split, s.parity, *s.added, *s.least)], names)

    found = _stretches(spark, path).mapInArrow(run, "file string, start long, parity long, added0 long, added1 long, least0 long, least1 long")
    out, file, state, depth = [], None, 0, 0
    for r in sorted(found.collect(), key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            _complete(file, state, depth)
            file, state, depth, owner = r["file"], 0, 0, r["start"]
        out.append({"file": file, "start": r["start"], "state": state, "depth": depth, "owner": owner})
        # A comma at depth 1 begins a record; so does the array itself, in the first split.
        if depth + r[f"least{state}"] == 1:
            owner = r["start"]
        state, depth = state ^ r["parity"], depth + r[f"added{state}"]
    _complete(file, state, depth)
    return out


def _complete(file: str | None, state: int, depth: int) -> None:
    if state or depth:
        raise ValueError(f"{file} ends within its array")


def array_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text) of each element of the JSON arrays in the files of a path, cut by ``spark.sql.files.maxPartitionBytes``.

    A file that holds anything but one array fails.
    """
    begin = spark.sparkContext.broadcast({(s["file"], s["start"]): (s["state"], s["depth"], s["owner"]) for s in splits(spark, path)})
    names = ["whole", "file", "owner", "start", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = cutter = None
        for split, begins, text in _by_split(batches):
            if begins:
                if now is not None:
                    yield from left(now, cutter)
                if split not in begin.value:
                    raise RuntimeError("the file was cut elsewhere in the first pass: set spark.sql.files.minPartitionNum")
                now, cutter = split, Cutter(*begin.value[split][:2], first=split[1] == 0)
            made = list(cutter.read(text))
            yield rows([(whole, *now, piece) for whole, piece in made])
        if now is not None:
            yield from left(now, cutter)

    def left(now: tuple[str, int], cutter: Cutter) -> Iterator[pa.RecordBatch]:
        rest = cutter.rest()
        if cutter.depth > 0:
            yield rows([(False, now[0], now[1], rest, cutter.begun)])
        elif rest.strip():
            raise ValueError("text beside the array")

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        """A piece that ends here belongs to the record that was open when the split began; one left open may be this split's own."""
        out = []
        for whole, file, start, text, *own in pieces:
            owner = start if whole or (own and own[0]) else begin.value[file, start][2]
            out.append((whole, file, owner, start, text.decode()))
        kinds = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    pieces = _stretches(spark, path).mapInArrow(run, "whole boolean, file string, owner long, start long, text string")
    # One record per group: what a split left open, and what the next ones have of it.
    parts = pieces.where("NOT whole").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    empty = F.raise_error(F.lit("an empty element in the array")).cast("string")
    joined = parts.select(text.alias("text")).select(F.when(F.trim("text") == "", empty).otherwise(F.col("text")).alias("text"))
    return pieces.where("whole").select("text").unionByName(joined)


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of JSON arrays, each file in as many tasks as it has splits. What does not fit the schema fails."""
    return array_texts(spark, path).select(F.inline(F.array(F.from_json("text", schema, {"mode": "FAILFAST"}))))
