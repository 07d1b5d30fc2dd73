import hashlib
import heapq
import random
import re
import zlib

import pytest

from jobtide.llm import repair
from tests.llm.helpers import SF

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit, repaired) by uniform-cost search: prefixes in order of (cost, audit), each as its list of turns."""
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        state = "".join(r[:1] for r, _ in made)
        node = (i, "" if not state else state[-1])
        if (node, "end") in done:
            continue
        if i == len(rows) and GRAMMAR.match(state):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in made)
        # Prefixes of one node that come later cost more, or as much with a larger audit.
        if node in done:
            continue
        done.add(node)
        options = []
        for role in ("user", "assistant"):
            options.append((5, "I", i, (*made, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            options.append((2, "D", i + 1, made))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                options.append((extra, "K", i + 1, (*made, (role, text))))
                options += [(1 + extra, "R", i + 1, (*made, (new, text))) for new in ("user", "assistant")]
        for more, letter, at, turns in options:
            initials = "".join(r[:1] for r, _ in turns)
            if len(initials) == sum(len(r[:1]) for r, _ in turns) == len(turns) and re.match(r"(s?(ua)*u?)\Z", initials):
                heapq.heappush(heap, (cost + more, audit + letter, at, turns))
    raise AssertionError


def fault_of(role, text, seen):
    body = re.sub(r"[\x20\x09-\x0D]+", "", text)
    if not body:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return None if body[-1] in ".!?" else "truncated"


def brute(rows):
    """Expected columns of one conversation from (turn, role, text) after damage, in order."""
    turns = [t for t, _, _ in rows if t is not None]
    out = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": 0, "duplicate": 0, "truncated": 0}
    seen, judged = set(), []
    for _, role, text in rows:
        fault = fault_of(role, text, seen)
        seen.add((role, text))
        if fault:
            out[fault] += 1
        judged.append((role, text, fault))
    out["illegal"] = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    out["cost"], out["audit"], made = cheapest(judged)
    out["repaired_sha256"] = hashlib.sha256(made.encode()).hexdigest()
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def grouped(rows):
    found = {}
    for conv, turn, role, text in rows:
        name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        found.setdefault(conv, []).append(((turn is not None, turn or 0, name), turn, role, text))
    return {k: [r[1:] for r in sorted(v, key=lambda r: r[0])] for k, v in found.items()}


def random_rows(rnd, convs, most):
    rows = []
    for conv in range(convs):
        for turn in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rnd.choice(["", None, " \n", "Yes.", "No", "Why? ", "a\tb", "ok!", f"text {rnd.randint(0, 99)}."])
            rows.append((conv if rnd.random() < 0.95 else None, rnd.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("part", [32, 3, 1])
def test_search_finds_the_least_repair(monkeypatch, part):
    monkeypatch.setattr(repair, "PART", part)
    rnd = random.Random(part)
    letters = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(600):
        symbols = "".join(rnd.choice("ssuuaauaxoSUAO") for _ in range(rnd.randint(0, 14)))
        rows = [(letters.get(x.lower(), "user"), "t.", "blank" if x == "x" else "truncated" if x.isupper() else None) for x in symbols]
        repairs = repair.Repairs()
        for i in range(0, len(symbols), 5):
            repairs.read(symbols[i:i + 5])
        assert repairs.finish() == cheapest(rows)[:2], symbols


def test_report_equals_brute_force(spark):
    rnd = random.Random(8)
    rows = random_rows(rnd, 150, 9)
    rnd.shuffle(rows)
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], schema + ", audit string, kind int, name string").repartition(4)
    done = damaged(rows)
    given = spark.createDataFrame([(*r, "x", "y") for r in done], schema + ", conv string, copy string").repartition(4)
    want = {k: brute(v) for k, v in grouped(done).items()}
    nothing = {**dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0), "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    for source in (repair.damage(df).withColumnRenamed("conv", "conv_id"), given):
        got = [r.asDict() for r in repair.report(source, df).collect()]
        assert len(got) == len({r[0] for r in rows})
        assert {r.pop("conv_id"): r for r in got} == {k: want.get(k, nothing) for k in {r[0] for r in rows}}


def test_a_long_conversation(spark):
    rnd = random.Random(2)
    rows = [(7, i, rnd.choice(["user", "assistant"]), f"t {i % 1500}" + rnd.choice(["", ".", "."])) for i in range(3_000)]
    got = repair.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.range(7, 8).toDF("conv_id")).first().asDict()
    assert got.pop("conv_id") == 7 and got == brute([r[1:] for r in rows])


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why"), (2, 0, "user", "Hm."), (3, 0, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plans = repair.plan_repairs(df)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in plans.collect()} == {1: (3, "RKD"), 2: (2, "D"), 3: (2, "D")}
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "You?"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "So.")], df.schema)
    got = repair.repaired_rows(df, repair.plan_repairs(df)).orderBy("place").collect()
    assert [(r["role"], r["text"]) for r in got] == [("user", "Hi."), ("assistant", "You?"), ("user", "Yes."), ("assistant", "So.")]


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(df, df).count() == 0
    assert repair.plan_repairs(df).count() == 0


def test_query_equals_brute_force(spark):
    from jobtide.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {k: brute(v) for k, v in grouped(damaged(rows)).items()}
    got = {r["conv_id"]: r.asDict() for r in QUERIES["op12_conversation_repair"](spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, v in want.items():
        assert got[k] == {"conv_id": k, **v}
