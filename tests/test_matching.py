import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtide.operators import embeddings as emb
from jobtide.operators import matching, pivots, reports


def unit(n, d, seed):
    m = np.random.default_rng(seed).normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def frame(spark, matrix, key, prefix=None):
    rows = [(f"{prefix}{i:04d}" if prefix else i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} {'string' if prefix else 'long'}, embedding array<float>")


def brute(a, b, k, minimum):
    """Top-k per row over all pairs, ties by item."""
    scores = np.round(a.astype(np.float32).astype(float) @ b.astype(np.float32).astype(float).T, matching.SCORE_DIGITS)
    out = set()
    for i, row in enumerate(scores):
        for j in sorted(range(len(row)), key=lambda j: (-row[j], j))[:k]:
            if row[j] >= minimum:
                out.add((i, f"t{j:04d}"))
    return out


@pytest.mark.parametrize("blocks", [{}, {"skill_block": 17, "item_block": 11, "slice_rows": 4}])
@pytest.mark.parametrize("k, minimum", [(3, 0.1), (1, -1.0), (500, 0.2)])
def test_top_matches_equal_brute_force(spark, blocks, k, minimum):
    a, b = unit(60, 8, 1), unit(45, 8, 2)
    b[10:15] = b[3]  # equal items: ties
    got = matching.top_matches(frame(spark, a, "skill_id"), frame(spark, b, "tks_id", "t"), k, minimum, **blocks)
    assert {(r["skill_id"], r["tks_id"]) for r in got.collect()} == brute(a, b, k, minimum)


def clustered(n, clusters, spread, seed, width=16):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(clusters, width))
    m = centres[rnd.integers(0, clusters, n)] + spread * rnd.normal(size=(n, width))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("k, minimum", [(3, 0.1), (1, -1.0), (200, 0.9), (None, 0.85)])
def test_partitions_around_pivots_equal_brute_force(spark, k, minimum):
    """Clusters, equal items, a partition larger than a block, opposite vectors, and vectors without a direction."""
    b = np.concatenate([clustered(150, 6, 0.1, 5), np.repeat(clustered(1, 1, 0, 6), 40, 0), np.zeros((2, 16))])
    a = np.concatenate([clustered(90, 6, 0.1, 5), -clustered(20, 6, 0.1, 5), np.zeros((1, 16)), b[150:152]])
    blocks = {"item_bytes": 0, "item_block": 16, "skill_block": 20}
    left, right = frame(spark, a, "skill_id"), frame(spark, b, "tks_id", "t")
    if k is None:
        got = matching.score_pairs(left, right, None, minimum, **blocks)
    else:
        got = matching.top_matches(left, right, k, minimum, **blocks)
    rows = [(r["skill_id"], r["tks_id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(a, b, 10**6 if k is None else k, minimum)


def test_blocks_that_cannot_hold_a_match_are_skipped(spark):
    a, b = clustered(400, 10, 0.05, 7), clustered(400, 10, 0.05, 7)
    left = frame(spark, a, "skill_id").select(F.col("skill_id").alias("row"), F.col("embedding").cast("array<double>").alias("embedding"))
    right = frame(spark, b, "tks_id", "t").withColumn("embedding", F.col("embedding").cast("array<double>"))
    parts = pivots.partitions(right, 40, "tks_id")
    every = left.count() * len(parts.pivots)
    met = sum(pivots.routed(left.withColumn("floor", F.lit(float("-inf"))), parts, 0.8, first).count() for first in (True, False))
    assert len(parts.pivots) == 40 and left.count() <= met < every / 4
    # With the k-th score of the first partition as a floor fewer are met still.
    floors = left.withColumn("floor", F.lit(0.97))
    assert pivots.routed(floors, parts, 0.8, False).count() < met - left.count()


def test_bounds_hold():
    rnd = np.random.default_rng(9)
    items, vectors = rnd.normal(size=(300, 5)) * rnd.uniform(0, 3, (300, 1)), rnd.normal(size=(80, 5)) * rnd.uniform(0, 2, (80, 1))
    chosen = pivots.farthest_first(items, 12)
    units, lengths = pivots._directions(items)
    home = (units @ chosen.T).argmax(1)
    angle = np.array([np.arccos(np.clip(units[home == p] @ chosen[p], -1, 1)).max(initial=0) for p in range(12)])
    least, most = (np.array([f(lengths[home == p], initial=i) for p in range(12)]) for f, i in ((np.min, 9), (np.max, 0)))
    bound = pivots.Partitions(chosen, angle, least, most, np.bincount(home, minlength=12)).bounds(vectors)
    scores = vectors @ items.T
    for p in range(12):
        if (home == p).any():
            assert (scores[:, home == p].max(1) <= bound[:, p] + pivots.SLACK * 10).all()


def test_large_catalogue_without_directions(spark):
    a, b = frame(spark, unit(5, 4, 1), "skill_id"), frame(spark, np.zeros((9, 4)), "tks_id", "t")
    got = matching.top_matches(a, b, 2, -0.5, item_bytes=0, item_block=4)
    assert {(r["skill_id"], r["tks_id"]) for r in got.collect()} == {(i, f"t000{j}") for i in range(5) for j in range(2)}
    assert matching.top_matches(a, b.limit(0), 2, -0.5, item_bytes=0).count() == 0
    assert matching.top_matches(a.limit(0), b, 2, -0.5, item_bytes=0, item_block=4).count() == 0


def test_small_case(spark):
    s = spark.createDataFrame([(1, [1.0, 0.0])], "skill_id long, embedding array<double>")
    t = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.6, 0.8]), ("C", [0.8, 0.6])], "tks_id string, embedding array<double>")
    two = matching.top_matches(s, t, 2).orderBy(F.desc("similarity")).collect()
    assert [(r["tks_id"], r["similarity"]) for r in two] == [("A", 1.0), ("C", 0.8)]
    assert matching.top_matches(s, t, 10).count() == 3
    assert matching.top_matches(s.limit(0), t).count() == 0 and matching.top_matches(s, t.limit(0)).count() == 0


def test_small_catalogue_moves_no_skill(spark):
    a, b = frame(spark, unit(90, 8, 1), "skill_id"), frame(spark, unit(20, 8, 2), "tks_id", "t")
    one = matching.score_pairs(a, b, 3, 0.1)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    many = matching.score_pairs(a, b, 3, 0.1, item_bytes=0)
    key = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    assert key(one) == key(many)


def test_all_pairs_need_a_minimum(spark):
    a, b = frame(spark, unit(3, 4, 1), "skill_id"), frame(spark, unit(3, 4, 2), "tks_id", "t")
    with pytest.raises(ValueError):
        matching.score_pairs(a, b, None)


def test_no_pair_leaves_a_block_below_the_limits(spark):
    a = frame(spark, unit(200, 6, 3), "skill_id")
    b = frame(spark, unit(100, 6, 4), "tks_id", "t")
    scores = matching.score_pairs(a, b, 3, -1.0, item_block=25, skill_block=50)
    assert scores.groupBy("skill_id").count().agg(F.max("count")).first()[0] <= 3 * 4


def similarity(spark, rows):
    return spark.createDataFrame(rows, "skill_id long, tks_id string, model_name string, similarity double")


def test_bands(spark):
    from jobtide.operators.records import band_limits, in_band

    df = spark.createDataFrame([(0.65,), (1.0,), (1.0000001,)], "s double")
    inside = lambda at: [r[0] for r in df.where(in_band(F.col("s"), at)).collect()]
    assert inside(0.55) == [] and inside(0.65) == [0.65] and inside(0.75) == [1.0]
    assert band_limits(0.6) == band_limits(0.55)


def test_pages(spark):
    sim = similarity(spark, [(i, "a", "m", 0.56) for i in range(12)])
    names = spark.createDataFrame([(i, f"s{i:02d}") for i in range(12)], "id long, normalized_skill string")
    items = spark.createDataFrame([("a", "d")], "id string, description string")
    rows = reports.mapping_rows(reports.mapping_view(sim, names, items), "m")
    assert [r["normalized_skill"] for r in reports.mapping_page(rows, 2, 10).collect()] == ["s10", "s11"]
    assert reports.mapping_page(rows, 5, 10).count() == 0
    assert tuple(reports.page_summary(rows, 5, 10).first()) == (12, 2, 2)
    assert tuple(reports.page_summary(rows.limit(0), 1, 10).first()) == (0, 1, 1)
    assert reports.mapping_rows(reports.mapping_view(sim, names, items), "m", skill_query="S1").count() == 2


def test_coverage(spark):
    sim = similarity(spark, [(1, "a", "m", 0.8), (1, "b", "m", 0.6), (2, "a", "m", 0.6), (3, "a", "x", 0.9)])
    names = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    rows = {r["threshold"]: r["coverage"] for r in reports.coverage(sim, names, "m").collect()}
    assert rows == {0.55: 0.5, 0.65: 0.25, 0.75: 0.25}
    assert reports.mean_similarity(sim, "m").first()[0] == pytest.approx(0.7)
    assert reports.mean_similarity(sim, "none").first()[0] == 0.0
    assert reports.coverage(sim, names.limit(0), "m").count() == 0
    assert tuple(reports.match_counts(sim, names, "m").first()) == (4, 2)


def test_encode_pending_and_store(spark):
    dim = spark.createDataFrame([(1, "abc"), (2, None), (3, "xyz")], "id long, t string")
    empty = spark.createDataFrame([], "skill_id long, model_name string, embedding array<double>")
    todo = emb.pending(dim, empty, "m", "id", "skill_id", 2)
    assert [r["id"] for r in todo.collect()] == [1, 2]
    vectors = emb.normalise_vectors(emb.encode(todo, "t", lambda: emb.ngram_encoder(8), batch_size=1))
    rows = {r["id"]: r["embedding"] for r in vectors.collect()}
    assert rows[2] is None and sum(x * x for x in rows[1]) == pytest.approx(1.0)
    stored = emb.store_vectors(vectors.withColumnRenamed("id", "skill_id"), empty, "m", "skill_id")
    assert [r["id"] for r in emb.pending(dim, stored, "m", "id", "skill_id").collect()] == [3]
    assert emb.pending(dim, stored, "other", "id", "skill_id").count() == 3


def test_normalise_keeps_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "embedding array<double>")
    assert [r[0] for r in emb.normalise_vectors(df).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_dimension_check(spark):
    df = spark.createDataFrame([([0.0],), ([3.0, 4.0],)], "embedding array<double>")
    assert tuple(emb.dimension_check(df).first()) == (2, 2, False)
    assert tuple(emb.dimension_check(df.limit(0)).first()) == (0, 0, False)


def test_ngram_counts_equal_plain_python():
    import hashlib
    import random

    rnd = random.Random(1)
    texts = ["", "a", "ab", "abc", "日本語テキスト", "é\U0001F600xyz"] + ["".join(rnd.choices("abcdef é日\x00", k=rnd.randint(0, 60))) for _ in range(100)]
    for dim, n in ((64, 3), (8, 1), (16, 2)):
        want = np.zeros((len(texts), dim))
        for row, t in enumerate(texts):
            for i in range(len(t) - n + 1):
                want[row, int(hashlib.md5(t[i:i + n].encode()).hexdigest()[:7], 16) % dim] += 1
        assert (emb.ngram_encoder(dim, n)(texts) == want).all()
    assert emb.ngram_encoder()([]).shape == (0, 64)


@pytest.mark.parametrize("most", [1, 7, 40, 1000])
def test_cells_hold_partitions_up_to_a_size(most):
    rnd = np.random.default_rng(most)
    count = rnd.integers(0, 30, 50)
    parts = pivots.Partitions(*[np.zeros(50)] * 4, -(-count // 4), count)
    cell, subs = parts.cells(most)
    assert (np.diff(cell) >= 0).all() and set(cell) == set(range(len(subs)))
    for c, n in enumerate(subs):
        held = count[cell == c]
        assert n == -(-held.sum() // most) and (n <= 1 or len(held[held > 0]) == 1)


def test_a_vector_moves_once_to_a_cell(spark, monkeypatch):
    """However many partitions it has to meet there; results do not depend on the size of the cells."""
    rnd = np.random.default_rng(5)
    items = [(f"i{i}", v.tolist()) for i, v in enumerate(rnd.normal(size=(400, 6)))]
    skills = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(90, 6)))] + [(90, [0.0] * 6)]
    left = spark.createDataFrame(skills, "skill_id long, embedding array<double>")
    right = spark.createDataFrame(items, "tks_id string, embedding array<float>")
    parts = pivots.partitions(right, 8, "tks_id")
    rows = left.withColumnRenamed("skill_id", "row")
    cell, subs = parts.cells(200)
    assert len(parts.count) > 20 * len(subs)
    alone, together = (pivots.routed(rows, parts, -99.0, None, c).collect() for c in (None, cell))
    assert len(alone) == 91 * np.count_nonzero(parts.count) and len(together) == 91 * len(subs)
    assert all(len(r["wanted"]) == np.count_nonzero(parts.count[cell == r["cell"]]) for r in together)
    got = []
    for size in (1, 3000, 1 << 24):
        monkeypatch.setattr(matching, "CELL_BYTES", size)
        for k, minimum in ((3, -99.0), (None, 0.3)):
            found = matching.score_pairs(left, right, k, minimum, item_bytes=0, item_block=8, skill_block=16)
            got.append(sorted((r["skill_id"], r["tks_id"], r["similarity"]) for r in found.collect()))
    scores = np.array([v for _, v in skills]) @ np.array([v for _, v in items], np.float32).astype(float).T
    assert got[0] == got[2] == got[4] and got[1] == got[3] == got[5]
    assert len(got[0]) == 91 * 3 and len(got[1]) == np.count_nonzero(np.round(scores, 10) >= 0.3)


def test_a_norm_is_computed_once(spark, monkeypatch):
    """Not in the body of the lambda over the vector, where it would be computed for every element."""
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0, None],), (None,), ([],)], "embedding array<double>")
    unit = emb.normalise_vectors(df)
    assert [r["embedding"] for r in unit.collect()] == [[0.6, 0.8], [0.0, 0.0], [1.0, None], None, []]
    plan = unit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_names_to_encode_are_spread(spark, tmp_path):
    """Few bytes of names would be put into one task."""
    from bindings.vectors import named_vectors

    spark.range(500).selectExpr("id AS p_partkey", "concat('name ', id) AS p_name").write.parquet(str(tmp_path / "part.parquet"))
    dealt = named_vectors(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 1 and sum(r["count"] for r in dealt) == 500


def test_no_score_below_the_kth_leaves_a_cell(spark, monkeypatch):
    """A vector that has k scores from its own partition takes no lower one from the others."""
    b, a = unit(300, 16, 31), unit(40, 16, 32)
    b[200:220] = b[7]  # equal items: ties
    ranked, top_items = [], matching.top_items
    monkeypatch.setattr(matching, "CELL_BYTES", 8 * 16 * 30)
    monkeypatch.setattr(matching, "top_items", lambda scores, *more: (ranked.append(scores.collect()), top_items(scores, *more))[1])
    left, right = frame(spark, a, "skill_id"), frame(spark, b, "tks_id", "t")
    got = matching.score_pairs(left, right, 3, -1.0, item_bytes=0, item_block=8, skill_block=20).collect()
    assert {(r["skill_id"], r["tks_id"]) for r in got} == brute(a, b, 3, -1.0)
    first, found = ranked
    own = {}
    for r in first:
        own.setdefault(r["skill_id"], []).append(r["similarity"])
    floors = {i: sorted(v)[-3] for i, v in own.items() if len(v) >= 3}
    assert len(floors) > 20 and len(found) > len(first)
    assert all(r["similarity"] >= floors.get(r["skill_id"], -2) for r in found)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e20])
def test_pairs_above_a_limit_equal_all_pairs(scale):
    """Equal and almost equal scores at the limit, and lengths that single precision can't multiply."""
    a, b = unit(40, 64, 33) * scale, unit(300, 64, 34) * scale
    b[100:140] = b[50] * (1 + np.arange(40)[:, None] * 1e-9)
    scores = np.round(np.einsum("ik,jk->ij", a, b), matching.SCORE_DIGITS)
    for k, least in ((3, np.full(40, -np.inf)), (300, scores[:, 120]), (5, np.sort(scores, 1)[:, -5])):
        left, right, rows = matching._Side(a), matching._Side(b), np.arange(40)
        parts = [x for j in range(0, 300, 100) for x in matching._above(left, rows, right, j, j + 100, least, k, 16)]
        got = [np.concatenate(x) for x in zip(*parts)]
        found = set(zip(got[0].tolist(), got[1].tolist()))
        for i in range(40):
            kth = np.sort(scores[i])[-k]
            must = np.flatnonzero((scores[i] >= least[i] + 1e-9 * scale**2) & (scores[i] > kth))
            assert {(i, j) for j in must.tolist()} <= found
            assert all(scores[i, j] >= least[i] - 1e-9 * scale**2 for r, j in found if r == i)
