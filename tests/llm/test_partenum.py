import random

import numpy as np
import pyarrow as pa
import pytest

from jobtide.llm import partenum
from jobtide.llm.components import components as spark_components
from jobtide.llm.partenum import Scheme, jaccard_components, signatures
from tests.llm.helpers import SF, components


@pytest.mark.parametrize("options", [{}, {"parts": 3, "spare": 1}, {"parts": 4, "spare": 2}])
def test_similar_sets_share_a_signature(options):
    rnd, scheme = np.random.default_rng(5), Scheme(85, 100, **options)
    for _ in range(1_500):
        size = int(rnd.integers(1, 400))
        base = rnd.integers(1, 1 << 63, size, dtype=np.uint64)
        drop, new = int(rnd.integers(0, size // 8 + 1)), int(rnd.integers(0, size // 8 + 1))
        other = np.concatenate([base[drop:], rnd.integers(1, 1 << 63, new, dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        if not len(b):
            continue
        shared = len(np.intersect1d(a, b))
        sigs, of = signatures([a, b], scheme)
        if 100 * shared >= 85 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(sigs[of == 0], sigs[of == 1])), (len(a), len(b), shared)


def near_copies(rnd, n):
    texts = []
    for i in range(n):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 2)):
                if w:
                    w[rnd.randrange(len(w))] = f"new{rnd.randint(0, 999)}"
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 20, 60, 150]))))
    return texts


@pytest.mark.parametrize("n,num,den,scheme", [
    (4, 85, 100, None), (5, 80, 100, {"slack": 0.3, "rounds": 2}), (2, 60, 100, None), (4, 85, 100, {"band": 1.25, "rounds": 3}),
])
def test_components_equal_all_pairs(spark, n, num, den, scheme):
    texts = near_copies(random.Random(n), 160) + [None, "", " \n", "A b C d e", "a B c D E"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, n=n, num=num, den=den, scheme=scheme).collect()}
    assert got == dict(enumerate(components(texts, n, num, den)))


def test_chain_whose_ends_differ(spark):
    """Each text is linked with the next only; the bucket's first isn't linked with the last."""
    w = [f"w{i}" for i in range(300)]
    texts = []
    for step in range(12):
        texts.append(" ".join(w))
        for i in range(3):
            w[20 * step + i] = f"x{step}-{i}"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["component_id"] for r in jaccard_components(df, n=4, num=85, den=100).orderBy("doc_id").collect()]
    assert got == [x for _, x in components(texts, 4, 85, 100)]


def test_edge_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (7, text), (7, text), (9, text + " " + text), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (9, 9), (None, None), (3, 3)], key=str)
    assert jaccard_components(df.limit(0)).count() == 0
    only = jaccard_components(df.where("doc_id IS NULL")).collect()
    assert [r["component_id"] for r in only] == [None, None]


def test_query_equals_all_pairs(spark):
    from jobtide.llm.queries import QUERIES

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = components([t for _, t in docs], 4, 85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op10_jaccard_components"](spark, SF).collect()}
    assert got == {k: (n, docs[x][0]) for (k, _), (n, x) in zip(docs, want)}


def test_component_labels(spark):
    edges = [(5, 4), (4, 9), (9, 2), (7, 7), (11, 12), (12, 11), (None, 3)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r["id"]: r["component"] for r in spark_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 2, 4: 2, 9: 2, 2: 2, 11: 11, 12: 11, **{100 + i: 100 for i in range(21)}}
    assert spark_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    from jobtide.llm import partenum

    monkeypatch.setattr(partenum, "BUCKET", 2)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(40):
        w = list(base)
        for j in range(3):
            w[(17 * i + 41 * j) % 200] = f"x{i}-{j}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["component_id"] for r in jaccard_components(df, n=4, num=85, den=100).orderBy("doc_id").collect()]
    assert got == [x for _, x in components(texts, 4, 85, 100)]


def test_large_sets_that_differ_are_told_apart_by_sketches(spark, monkeypatch):
    """Sets far larger than a short sketch that share a passage: only the near ones are compared exactly."""
    rnd, passed, links = random.Random(8), [], partenum._links
    common = [f"c{i}" for i in range(1_500)]
    texts = [" ".join(common + [f"d{d}-{rnd.randrange(10**9)}" for _ in range(5_500)]) for d in range(10)]
    texts.append(texts[3] + " and a few more words at its end")
    monkeypatch.setattr(partenum, "_links", lambda near, *more: (passed.append(near.count()), links(near, *more))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(df, n=5, num=80, den=100).collect()}
    assert got == {i: 3 if i == 10 else i for i in range(11)}
    assert sum(passed) == 1


@pytest.mark.parametrize("n,num,den,scheme", [(4, 85, 100, None), (5, 80, 100, {"slack": 0.3, "rounds": 2})])
def test_sets_and_members_move_in_rounds(spark, monkeypatch, n, num, den, scheme):
    """However many near copies there are, their sets stand on disk a part at a time; the results are the same."""
    texts = near_copies(random.Random(n + 20), 120)
    wanted, apart, contents, compared = [], [], partenum._contents, partenum._apart
    monkeypatch.setattr(partenum, "ROUND_BYTES", 2_000)
    monkeypatch.setattr(partenum, "ROUND_PART", 1 << 40)
    monkeypatch.setattr(partenum, "MEMBER_BYTES", 1_000)

    def read(some, *more):
        if more[-1] is np.ndarray.tobytes:
            wanted.append(some.count())
        return contents(some, *more)

    monkeypatch.setattr(partenum, "_contents", read)
    monkeypatch.setattr(partenum, "_apart", lambda some, *more: (apart.append(some.count()), compared(some, *more))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(df, n=n, num=num, den=den, scheme=scheme).collect()}
    assert got == {i: c for i, (_, c) in enumerate(components(texts, n, num, den))}
    assert len(wanted) > 3 and max(wanted) < len(texts) / 2
    assert len(apart) > 2


def test_sketches_of_several_lengths_bound_the_difference():
    rnd = np.random.default_rng(3)
    sets = [rnd.integers(1, 1 << 63, int(size), dtype=np.uint64) for size in (1, 40, 700, 800, 1_500, 1_700, 6_000, 7_000)]
    sets += [np.concatenate([s[: len(s) * 9 // 10], rnd.integers(1, 1 << 63, len(s) // 12, dtype=np.uint64)]) for s in sets]
    sketches = partenum._Sketches(pa.array([partenum._parity(np.unique(s)) for s in sets], pa.binary()))
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    both = np.array([len(sets[a]) + len(sets[b]) for a, b in zip(i, j)])
    near = partenum._close(sketches, i, sketches, j, both, 80, 100)
    for a, b, close in zip(i, j, near):
        shared = len(np.intersect1d(sets[a], sets[b]))
        assert close or 100 * shared < 80 * (len(sets[a]) + len(sets[b]) - shared)
    assert not near[(i == 6) & (j == 7)].any() and not near[(i == 4) & (j == 5)].any()
