"""Conversation structure repair: depth-first branch-and-bound over the edits of each conversation.

A repaired conversation has role initials ``(s?(ua)+)?``. States: nothing yet, after the
system's turn, after the user's, after the assistant's. A row is kept, given another role
or deleted; empty turns are inserted. Of the cheapest repairs the one with the least audit
(the initials of its edits) counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from jobtide.llm.bytetext import column

#: Costs of a new role, a deletion, an insertion, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows that one search covers. Longer conversations are searched part by part, from each state to each.
PART = 32

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind an inserted (or renamed) turn, by the state before it.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: The state behind a kept turn, by the state before it and the turn's initial.
_KEPT = {(START, "s"): SYSTEM, (USER, "a"): ASSISTANT, **{(s, "u"): USER for s in (START, SYSTEM, ASSISTANT)}}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_BLANK, _ENDED = "[^\\x20\\x09-\\x0D]", "[.!?][\\x20\\x09-\\x0D]*\\z"


def _least(symbol: str) -> int:
    """What a row costs at least, but for a system's turn, which may be kept at the beginning."""
    if symbol == "x" or symbol.isupper():
        return DELETE
    return 0 if symbol in "ua" else REROLE


@lru_cache(maxsize=1 << 16)
def search(rows: str, entry: int, exits: frozenset[int]) -> tuple[int, str, int] | None:
    """(cost, audit, exit) of the best way through the rows from a state to one of the exits.

    ``rows`` has a letter for each row: its initial (s, u, a; others: o), a capital if it is
    truncated, x if it has to go. The stack holds open prefixes. One is left out if it
    costs more, together with the suffix's lower bound, than the incumbent (or as much
    with a larger audit), or if its node (rows read, state) was reached by a better
    prefix: cost and audit of a node order all its continuations, since audits of one
    node and one cost have equally many letters and none begins another.
    """
    n = len(rows)
    bound, systems = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        bound[i] = bound[i + 1] + _least(rows[i])
        systems[i] = systems[i + 1] or rows[i] == "s"
    best: tuple[int, str, int] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        seen = table.get((i, state))
        if seen is not None and seen <= (cost, audit):
            continue
        if best is not None:
            least = cost + bound[i] - (REROLE if state == START and systems[i] else 0)
            if least > best[0] or least == best[0] and audit > best[1][: len(audit)]:
                continue
        table[i, state] = cost, audit
        if i == n and state in exits and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, state
        moves = [(INSERT, "I", i, _NEXT[state])]
        if i < n:
            symbol = rows[i]
            moves.append((DELETE, "D", i + 1, state))
            if symbol != "x":
                extra = TRUNCATED if symbol.isupper() else 0
                moves.append((REROLE + extra, "R", i + 1, _NEXT[state]))
                after = _KEPT.get((state, symbol.lower()))
                if after is not None:
                    moves.append((extra, "K", i + 1, after))
        # The most promising one is taken from the stack first.
        moves.sort(key=lambda m: (m[0] + bound[m[2]], m[1]), reverse=True)
        for more, letter, at, to in moves:
            known = table.get((at, to))
            if known is None or (cost + more, audit + letter) < known:
                stack.append((at, to, cost + more, audit + letter))
    return best


class Repairs:
    """Best prefixes of a conversation that is read part by part: one for each state."""

    def __init__(self):
        self.sure: list[str] = []
        self.open = {START: (0, "")}
        self.rows = ""

    def read(self, rows: str) -> None:
        self.rows += rows
        while len(self.rows) > PART:
            part, self.rows = self.rows[:PART], self.rows[PART:]
            self.open = self._through(part, [frozenset([s]) for s in range(4)])
            # What all open prefixes begin with is settled.
            begin = commonprefix([audit for _, audit in self.open.values()])
            self.sure.append(begin)
            self.open = {s: (cost, audit[len(begin):]) for s, (cost, audit) in self.open.items()}

    def _through(self, part: str, exits: list[frozenset[int]]) -> dict[int, tuple[int, str]]:
        found: dict[int, tuple[int, str]] = {}
        for entry, (cost, audit) in self.open.items():
            for to in exits:
                way = search(part, entry, to)
                if way is not None:
                    whole = cost + way[0], audit + way[1]
                    found[way[2]] = min(found.get(way[2], whole), whole)
        return found

    def finish(self) -> tuple[int, str]:
        """(cost, audit) of the best repair of all rows read."""
        cost, audit = min(self._through(self.rows, [frozenset([START, ASSISTANT])]).values())
        return cost, "".join(self.sure) + audit


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) after damage chosen by crc32 of ``conv:turn`` modulo 20 (NULL: one space).

    0 drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    rows = df.select(
        column(conv).alias("conv"), column(turn).cast("long").alias("turn"),
        F.coalesce(column(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(column(text).cast("string"), F.lit(" ")).alias("text"),
    )
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    kind = F.crc32(F.concat_ws(":", *name).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind != 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
    )


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, name): NULL roles and texts as one space; ``name`` is a digest of both."""
    rows = df.select(
        column(conv).alias("conv"), column(turn).cast("long").alias("turn"),
        F.coalesce(column(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(column(text).cast("string"), F.lit(" ")).alias("text"),
    )
    return rows.withColumn("name", F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256)))


def _in_order(rows: DataFrame, *first: str, last: tuple = ()) -> DataFrame:
    """Rows of each conversation in one task, in order of the turn; those of one turn by their digest."""
    return rows.repartition("conv").sortWithinPartitions("conv", *first, F.col("turn").asc_nulls_first(), "name", *last)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, list[list]]]:
    """(conversation, whether it begins, columns behind the first) of each stretch of rows of one conversation."""
    last, some = None, False
    for batch in batches:
        convs = batch.column(0).to_pylist()
        rest = [c.to_pylist() for c in batch.columns[1:]]
        a = 0
        while a < len(convs):
            b = a + 1
            while b < len(convs) and convs[b] == convs[a]:
                b += 1
            yield convs[a], not some or convs[a] != last, [c[a:b] for c in rest]
            last, some, a = convs[a], True, b


def _long(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def plan_repairs(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows.

    Rows stand in order of the turn, NULL first; rows of one turn in order of a digest of
    role and text, so that repeated rows stand side by side. NULL roles and texts are one
    space; the NULL conversation is one like others; other columns are not read. The
    first fault of a row counts: blank (no character outside ``[\\x20\\x09-\\x0D]``),
    duplicate (an earlier row of the conversation has its role and text) or truncated (the
    last such character is none of ``.!?``). ``gaps`` is the number of turns missing
    between the least and the greatest, ``illegal`` counts neighbours whose initials are not
    su, ua or au. No rows give no rows.

    Texts don't move for this, only digests do. Duplicates are found by (conversation,
    digest). A conversation is streamed through one task, part by part, in bounded
    memory but for its audit (its digest, at last, is sequential by definition).
    """
    rows = _rows(df, conv, turn, role, text)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    slim = rows.select(
        "conv", "turn", "name", letter.alias("letter"),
        F.when(~F.col("text").rlike(_BLANK), "b").when(F.col("text").rlike(_ENDED), "").otherwise("t").alias("fault"),
    )
    first = Window.partitionBy("conv", "name").orderBy(F.col("turn").asc_nulls_first())
    slim = slim.withColumn("again", (F.row_number().over(first) > 1).cast("int"))
    schema = StructType([slim.schema["conv"], *[StructField(c, LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], StructField("audit", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now = None
        for name, begins, (turns, letters, faults, again) in _parts(batches):
            if begins:
                if now is not None:
                    out.append(summary(*now))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, _arrow(schema))
                    out = []
                now = name, Repairs(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None, "last": ""}
            _, repairs, seen = now
            symbols = []
            for t, letter, fault, repeated in zip(turns, letters, faults, again):
                if t is not None:
                    seen["turns"] += t != seen["high"]
                    seen["low"] = t if seen["low"] is None else seen["low"]
                    seen["high"] = t
                seen["illegal"] += seen["last"] != "" and seen["last"] + letter not in ("su", "ua", "au")
                seen["last"] = letter
                if fault == "b" or repeated:
                    seen["blank" if fault == "b" else "duplicate"] += 1
                    symbols.append("x")
                elif fault:
                    seen["truncated"] += 1
                    symbols.append(letter.upper())
                else:
                    symbols.append(letter)
            repairs.read("".join(symbols))
        if now is not None:
            out.append(summary(*now))
        yield pa.RecordBatch.from_pylist(out, _arrow(schema))

    def summary(name: object, repairs: Repairs, seen: dict) -> dict:
        cost, audit = repairs.finish()
        gaps = 0 if seen["low"] is None else _long(seen["high"] - seen["low"] + 1 - seen["turns"])
        return {"conv": name, "gaps": gaps, **{c: seen[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}

    ordered = _in_order(slim, last=("again",)).select("conv", "turn", "letter", "fault", "again")
    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _applied(df: DataFrame, plans: DataFrame, conv: str, turn: str, role: str, text: str, digest: bool) -> DataFrame:
    """The repaired rows, or one digest for each conversation. Its audit comes before its rows."""
    rows = _rows(df, conv, turn, role, text).select("conv", F.lit(1).alias("kind"), "turn", "name", "role", "text")
    heads = plans.select(
        column(conv).alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("name"),
        F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"),
    )
    ordered = _in_order(heads.unionByName(rows), "kind").select("conv", "kind", "role", "text")
    key = ordered.schema["conv"]
    fields = [StructField("repaired_sha256", StringType())] if digest else [StructField("place", IntegerType()), StructField("role", StringType()), StructField("text", StringType())]
    schema = StructType([key, *fields])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conversation, role, text) of each repaired turn, and (conversation, None, None) at the end of each."""
        now, audit, at, state = None, None, 0, START
        for name, begins, (kinds, roles, texts) in _parts(batches):
            if begins:
                if audit is not None:
                    yield from inserted(now, audit, at, state)
                    yield now, None, None
                now, at, state = name, 0, START
                audit, roles, texts = texts[0], roles[1:], texts[1:]
            for r, t in zip(roles, texts):
                while audit[at] == "I":
                    state, at = _NEXT[state], at + 1
                    yield name, _ROLES[state], ""
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = _KEPT[state, r[:1]] if edit == "K" else _NEXT[state]
                    yield name, r if edit == "K" else _ROLES[state], t
        if audit is not None:
            yield from inserted(now, audit, at, state)
            yield now, None, None

    def inserted(name: object, audit: str, at: int, state: int) -> Iterator[tuple]:
        for _ in audit[at:]:
            state = _NEXT[state]
            yield name, _ROLES[state], ""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        digest, some = hashlib.sha256(), False
        for name, r, t in turns(batches):
            if r is None:
                yield {"conv": name, "repaired_sha256": digest.hexdigest()}
                digest, some = hashlib.sha256(), False
            else:
                digest.update((("\n" if some else "") + r + ":" + t).encode())
                some = True

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        place = 0
        for name, r, t in turns(batches):
            if r is not None:
                yield {"conv": name, "place": place, "role": r, "text": t}
            place = 0 if r is None else place + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0
        for row in (hashed if digest else listed)(batches):
            out.append(row)
            size += 100 + len(row.get("text", ""))
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, _arrow(schema))
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, _arrow(schema))

    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def repaired_rows(
    df: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv, place, role, text) of the repaired conversations, by ``plan_repairs`` of the same rows."""
    return _applied(df, plans, conv, turn, role, text, False)


def repaired_digests(
    df: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of the repaired ``role:text``, joined by newlines, of each conversation with a plan."""
    return _applied(df, plans, conv, turn, role, text, True)


def report(df: DataFrame, of: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plan and digest for every conversation of ``of``; those without rows in ``df`` have zeros, an empty audit and the digest of nothing.

    NULL, empty and repeated rows: see ``plan_repairs``. Of other columns none is read, so that their names don't matter.
    """
    from jobtide.llm.components import written

    plans = written(plan_repairs(df, conv, turn, role, text), "repairs").withColumnRenamed(conv, "conv")
    digests = repaired_digests(df, plans.withColumnRenamed("conv", conv), conv, turn, role, text).withColumnRenamed(conv, "conv")
    ids = of.select(column(conv).alias("id")).distinct()
    found = ids.join(plans, F.col("id").eqNullSafe(plans["conv"]), "left").drop("conv")
    found = found.join(digests, F.col("id").eqNullSafe(digests["conv"]), "left").drop("conv")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        F.col("id").alias(conv), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
