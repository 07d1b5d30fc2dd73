import math
import random

import pytest

from jobtide.llm.topk import integer_vectors, top_k


def expected(rows, k):
    out = []
    for q, x in sorted(set((i, tuple(v)) for i, v in rows if i % 20 == 0)):
        scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("shard", [16_384, 40])
def test_equals_brute_force_with_ties(spark, shard):
    rnd = random.Random(6)
    rows = [(i, [rnd.randint(-3, 3) for _ in range(5)]) for i in range(260)]
    rows += [(300 + i, [1, 1, 1, 1, 1]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = sorted(tuple(r) for r in top_k(df, "id % 20 = 0", 20, shard, 7).collect())
    assert got == expected(rows, 20)


def test_few_candidates_and_none(spark):
    rows = [(0, [1, 2]), (1, [3, 4]), (20, [-1, 0])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    assert sorted(tuple(r) for r in top_k(df, "id % 20 = 0").collect()) == expected(rows, 20)
    assert top_k(df.where("id = 1"), "id % 20 = 0").count() == 0
    assert top_k(df.limit(0), "id % 20 = 0").count() == 0
    assert top_k(df.where("id = 0"), "id % 20 = 0").count() == 0


def test_unsound_vectors_take_no_part(spark):
    rows = [(1, None, "x"), (2, [1.0, None], "x"), (3, [float("nan"), 1.0], "x"), (4, [math.inf, 0.0], "x"), (5, [0.5, -0.01], "x"), (None, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    assert [tuple(r) for r in integer_vectors(df).collect()] == [(5, [32, -1])]


@pytest.mark.parametrize("shard", [16_384, 30])
@pytest.mark.parametrize("largest", [3e6, 1e9, 1e15])
def test_large_components(spark, shard, largest):
    """Nothing is refused: ranks are exact, a score that doesn't fit a long is the nearest long."""
    rnd = random.Random(int(largest))
    rows = [(i, [rnd.choice([rnd.uniform(-1, 1), rnd.uniform(-largest, largest), float(rnd.randint(-2, 2))]) for _ in range(3)]) for i in range(150)]
    rows += [(200 + i, [largest, -largest, 0.3]) for i in range(30)] + [(240, [0.01, 0.02, 0.03])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(integer_vectors(df), "id % 20 = 0", 10, shard, 7).collect())
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    assert got == [(*r[:3], max(-(2**63 - 1), min(2**63 - 1, r[3]))) for r in expected(whole, 10)]


def test_huge_components_count_as_the_widest(spark):
    rows = [(0, [1e308, 1.0]), (1, [-1e308, 2.0]), (2, [1e30, 3.0]), (3, [0.0, 4.0]), (4, [-5e-324, 0.0])]
    vectors = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r["id"]: r["v"] for r in vectors.collect()} == {0: [2.0**62, 64], 1: [-(2.0**62), 128], 2: [2.0**62, 192], 3: [0, 256], 4: [-1, 0]}
    got = [tuple(r) for r in top_k(vectors, "id = 0").orderBy("rank").collect()]
    assert [r[2] for r in got] == [2, 3, 4, 1] and got[0][3] == 2**63 - 1 and got[3][3] == -(2**63 - 1)


def test_queries_go_where_the_box_may_hold_as_much(spark, monkeypatch):
    """Clustered vectors: a query visits few of the shards."""
    from jobtide.llm import topk

    rnd = random.Random(4)
    centres = [[rnd.randint(-300, 300) for _ in range(6)] for _ in range(16)]
    rows = [(i, [c + rnd.randint(-4, 4) for c in centres[i % 16]]) for i in range(1_600)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    seen = {}
    real = topk._routed

    def watched(*given):
        seen["pairs"] = real(*given).count()
        seen["shards"] = int(given[3].sum())
        return real(*given)

    monkeypatch.setattr(topk, "_routed", watched)
    got = sorted(tuple(r) for r in top_k(df, "id % 20 = 0", 20, 50, 16).collect())
    assert got == expected(rows, 20)
    assert seen["shards"] >= 32 and seen["pairs"] < 80 * seen["shards"] / 3


def test_regions_hold_each_vector_once():
    import numpy as np

    from jobtide.llm.topk import Regions

    rnd = np.random.default_rng(1)
    x = rnd.integers(-3, 4, (500, 4)).astype(float)
    regions = Regions.of(x, 16)
    place = regions.place(x)
    assert len(regions) == 16 and place.min() >= 0 and place.max() < 16 and len(np.unique(place)) > 8
    assert (Regions.of(np.zeros((0, 4)), 8).place(x) < 8).all()
    assert (Regions.of(x, 1).place(x) == 0).all() and len(Regions.of(np.ones((50, 2)), 4).place(np.ones((7, 2)))) == 7


def test_one_vector_that_is_very_common(spark):
    rows = [(i, [1, 2]) for i in range(400)] + [(400 + i, [i % 7, -(i % 5)]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = sorted(tuple(r) for r in top_k(df, "id % 20 = 0", 20, 40, 16).collect())
    assert got == expected(rows, 20)
