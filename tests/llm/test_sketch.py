import hashlib
import random

import numpy as np
import pytest

from jobtide.llm import sketch
from tests.llm.helpers import SF, shingles


def test_estimates_and_merging():
    rnd = np.random.default_rng(10)
    whole = rnd.integers(0, 1 << 63, 6_000, dtype=np.uint64) * np.uint64(2)
    a, b = sketch.bottom(whole[:4_000]), sketch.bottom(whole[2_000:])
    assert (sketch.merge(a, b) == sketch.bottom(whole)).all()
    assert abs(sketch.resemblance(a, b) - 1 / 3) < 0.13
    assert abs(sketch.containment(a, b) - 0.5) < 0.2
    assert abs(sketch.distinct(a) / 4_000 - 1) < 0.35
    few = sketch.bottom(whole[:5])
    assert sketch.distinct(few) == 5 and sketch.resemblance(few, few) == 1 and (sketch.from_text(sketch.to_text(few)) == few).all()
    none = sketch.bottom(whole[:0])
    assert sketch.resemblance(none, none) == 1 and sketch.resemblance(none, few) == 0 and sketch.containment(none, few) == 1


def test_edge_rows(spark):
    rows = [(1, None, "o"), (2, "", "o"), (3, "one", "o"), (3, "one", "o"), (4, "ONE", None), (None, "w " * 50_000, "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sketch.fingerprint(df).collect()
    assert [r["n_distinct"] for r in got] == [0, 0, 1, 1, 1, 1]
    assert got[0]["fingerprint"] == got[1]["fingerprint"] == "" and got[2] == got[3] and got[3]["fingerprint"] == got[4]["fingerprint"]
    assert sketch.fingerprint(df.limit(0)).count() == 0


def test_merged_per_group(spark):
    rnd = random.Random(11)
    rows = [(f"g{i % 3}" if i % 50 else None, " ".join(rnd.choice("abcdefgh") for _ in range(60))) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, text string").repartition(7)
    got = {r["source"]: sketch.from_text(r["fingerprint"]) for r in sketch.merge_fingerprints(sketch.fingerprint(df), ["source"]).collect()}
    single = {r["source"]: [] for r in df.collect()}
    for r in sketch.fingerprint(df).collect():
        single[r["source"]].append(sketch.from_text(r["fingerprint"]))
    assert set(got) == set(single)
    for k, parts in single.items():
        assert (got[k] == sketch.bottom(np.concatenate(parts))).all()


def expected(rows):
    out = {}
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        out[key] = (len(text), text[: len(text) - cut] + after[:cut], text, after)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 400])
def test_next_text_in_key_order(spark, n):
    rnd = random.Random(n)
    rows = sorted((k, "".join(rnd.choice("ab é日") for _ in range(rnd.randint(0, 40))) if k % 7 else None) for k in rnd.sample(range(-500, 100_000), n))
    shuffled = rnd.sample(rows, n)
    df = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5)
    got = sketch.edited_likeness(df).collect()
    want = expected(rows)
    assert len(got) == n
    for r in got:
        size, edited, text, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (size, hashlib.sha256(edited.encode()).hexdigest())
        if shingles(text, 5) == shingles(after, 5):
            assert r["near_next"] == 1.0


def test_odd_keys(spark):
    rows = [(None, "a b c d e f"), (3, "x"), (3, "y"), (3, "x"), (None, None), (7, "z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in sketch.edited_likeness(df).collect()) == sorted(str(k) for k, _ in rows)
    assert sketch.edited_likeness(df.limit(0)).count() == 0
    assert sketch.edited_likeness(df.where("doc_id IS NULL")).count() == 2


def test_query_against_exact_sets(spark):
    from jobtide.llm.queries import QUERIES

    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, errors = expected(rows), []
    for r in QUERIES["op6_fingerprints"](spark, SF).collect():
        size, edited, text, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (size, hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text, 5), shingles(edited, 5)
        errors.append(abs(len(a & b) / max(1, len(a | b)) - r["near_edited"]) if a | b else 0)
    assert len(errors) == len(rows) and np.mean(errors) < 0.05 and max(errors) < 0.2


def test_near_next_against_exact_sets(spark):
    """Exact where both sets fit a sketch, an estimate otherwise."""
    rnd = random.Random(21)
    rows, w = [], []
    for i in range(300):
        if i % 3 or not w:
            w = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([0, 3, 8, 40, 60, 400]))]
        else:
            w = [x if rnd.random() < 0.97 else "new" for x in w]
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["near_next"] for r in sketch.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    errors, whole = [], 0
    for i, text in rows:
        a, b = shingles(text, sketch.WORDS), shingles(rows[(i + 1) % len(rows)][1], sketch.WORDS)
        exact = len(a & b) / len(a | b) if a | b else 1.0
        if len(a | b) <= sketch.K:
            assert got[i] == pytest.approx(exact)
            whole += 1
        else:
            errors.append(abs(got[i] - exact))
    assert whole > 100 and len(errors) > 50 and max(errors) < 0.2 and sum(errors) / len(errors) < 0.03


def test_no_worker_is_needed_to_deal_the_rows(spark):
    rows = spark.createDataFrame([(i if i % 7 else None, f"text {i}") for i in range(100)], "doc_id long, text string")
    plan = sketch.edited_likeness(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "PythonUDF" not in plan and "EvalPython" not in plan
