import random
from collections import defaultdict

import numpy as np
import pytest

from jobtide.llm import mixing
from tests.llm.helpers import SF, words


def test_targets_are_reshared_until_none_is_above():
    got = mixing.targets({"b": 100, "a": 10, None: 500, "c": 1_000}, [5.0, 2.0, 1.0])
    # a and b are capped at three times their size; c has weight 1, the NULL source weight 5.
    assert got["a"] == 30 and got["b"] == 300
    assert got["c"] == pytest.approx(1_280 / 6) and got[None] == pytest.approx(1_280 * 5 / 6)
    assert mixing.targets({}, [1.0]) == {} and mixing.targets({"a": 0}, [1.0]) == {"a": 0.0}


def test_rounding_keeps_words_and_expectations():
    rnd = np.random.default_rng(12)
    sizes = np.sort(rnd.integers(1, 500, 40))[::-1]
    taken = np.zeros(40)
    for _ in range(3_000):
        p, left = mixing.pivotal(np.full(40, 0.3), sizes, rnd.random(40))
        assert ((p == 0) | (p == 1) | (np.arange(40) == left)).all()
        assert (p * sizes).sum() == pytest.approx(0.3 * sizes.sum())
        taken += p
    assert np.abs(taken / 3_000 - 0.3).max() < 0.06


def documents(rnd, n):
    sources = ["s1", "s2", "s3", None]
    return [
        (i if i % 31 else None, "w " * rnd.randint(0, 60) if i % 13 else None, rnd.choice(sources) if i % 3 else "s1", "old") for i in range(n)
    ]


@pytest.mark.parametrize("options", [{}, {"leaf": 16, "fanout": 2}])
def test_report(spark, options):
    rows = documents(random.Random(13), 2_000)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.report(df, [5.0, 2.0, 1.0], **options).collect()
    again = mixing.report(df.repartition(7), [5.0, 2.0, 1.0], **options).collect()
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len(words(text))
    want = mixing.targets(dict(sizes), [5.0, 2.0, 1.0])
    by_size = {n: s for s, n in sizes.items()}
    for r in got:
        source = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(want[source]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60


def test_mixed_rows_repeat(spark):
    rows = documents(random.Random(14), 400)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mixed(df, [5.0, 2.0, 1.0])
    assert out.columns == df.columns and set(map(tuple, out.collect())) <= set(rows)
    total = sum(len(words(t)) for _, t, _, _ in rows)
    assert abs(sum(len(words(r["text"])) for r in out.collect()) - total) < 250


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b", "s")] * 5 + [(2, "a b c", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r["taken"] for r in mixing.report(df, [1.0]).collect()]
    assert sorted(got) == [2] * 5 + [3]
    assert mixing.report(df.limit(0), [1.0]).count() == 0 and mixing.mixed(df.limit(0), [1.0]).count() == 0


def test_query_counts_all_words(spark):
    from jobtide.llm.queries import QUERIES, WEIGHTS

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_mixing"](spark, SF).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {k: len(words(r["text"])) for k, r in docs.items()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[docs[r["doc_id"]]["source"]] += r["size"]
        taken[docs[r["doc_id"]]["source"]] += r["taken"]
    want = mixing.targets(dict(sizes), WEIGHTS)
    largest = max(r["size"] for r in got)
    assert all(r["target"] == pytest.approx(want[docs[r["doc_id"]]["source"]]) for r in got)
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in sizes)


def plain_targets(sizes):
    """Targets of the query, by handing out what is cut off again until nothing is."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    target, rest, free = dict.fromkeys(order, 0.0), float(sum(sizes.values())), list(order)
    while rest > 1e-9 * sum(sizes.values()) and free:
        scale, given = sum(weight[s] for s in free), 0.0
        for s in free:
            more = min(rest * weight[s] / scale, 3 * sizes[s] - target[s])
            target[s] += more
            given += more
        rest -= given
        free = [s for s in free if target[s] < 3 * sizes[s] - 1e-9]
    return target


def test_query_against_plain_targets(spark):
    from jobtide.llm.queries import QUERIES

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), 0
    for r in docs.values():
        sizes[r["source"]] += len(words(r["text"]))
        largest = max(largest, len(words(r["text"])))
    want = plain_targets(sizes)
    got = QUERIES["op8_mixing"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == len(words(docs[r["doc_id"]]["text"])) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in sizes)
