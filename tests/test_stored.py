"""Stored pages, posting bitmaps and bucketed targets."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobtide.operators import reports, stored
from jobtide.sources import tables

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- pages ------------------------------------------------------------------
@pytest.fixture(scope="module")
def listing(spark):
    return spark.range(1_000).select(
        (F.pmod(F.xxhash64("id"), F.lit(7)) / 10).alias("similarity"), F.concat(F.lit("s"), (F.col("id") % 90).cast("string")).alias("normalized_skill"),
        F.col("id").alias("skill_id"), F.concat(F.lit("t"), (F.col("id") % 13).cast("string")).alias("tks_id"), F.lit("block").alias("block"),
    ).repartition(5)


@pytest.fixture(scope="module")
def path(listing, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "listing")
    stored.write_pages(listing, path, rows_per_block=40)
    return path


@pytest.mark.parametrize("page, size", [(1, 50), (2, 50), (20, 50), (21, 50), (334, 3), (1, 1_000), (1, 5_000), (3, 333), (500, 2)])
def test_pages_equal_the_ordered_listing(spark, listing, path, page, size):
    everything = [tuple(r) for r in reports.ordered_mapping(listing).collect()]
    assert [tuple(r) for r in stored.stored_page(spark, path, page, size).collect()] == everything[(page - 1) * size:page * size]


def test_a_page_opens_its_own_blocks_only(spark, path):
    index = stored.page_index(spark, path)
    assert index.count() >= 25 and index.agg(F.max("rows")).first()[0] <= 40 and index.agg(F.sum("rows")).first()[0] == 1_000
    page = stored.stored_page(spark, path, 9, 50)
    held = [r["block"] for r in index.where("before < 450 AND before + rows > 400").collect()]
    assert page.count() == 50 and len(held) <= 3
    # The scan is limited to these blocks; what is sorted is the page.
    plan = plan_of(page)
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert plan.count("FileScan parquet") == 1 and filters and all(str(b) in filters for b in held)


def test_no_rows_are_a_listing_too(spark, listing, tmp_path):
    stored.write_pages(listing.limit(0), str(tmp_path / "none"))
    assert stored.stored_page(spark, str(tmp_path / "none")).collect() == []
    assert stored.stored_page(spark, str(tmp_path / "none")).columns == listing.columns
    assert tuple(stored.stored_summary(spark, str(tmp_path / "none"), 4).first()) == (0, 1, 1)
    with pytest.raises(ValueError):
        stored.stored_page(spark, str(tmp_path / "none"), 0)


def test_summary(spark, path):
    assert tuple(stored.stored_summary(spark, path, 99, 300).first()) == (1_000, 4, 4)


# --- distinct postings -----------------------------------------------------
def test_bitmaps_count_distinct_postings_of_any_list(spark):
    rows = [(i % 70_000, f"k{i % 5}") for i in range(0, 140_000, 7)] + [(3, "k1"), (3, "k1"), (None, "k1"), (4, None)]
    bridge = spark.createDataFrame(rows, "job_posting_id long, normalized_skill string")
    places = [(i, "abc"[i % 3]) for i in range(70_000)] + [(3, "b"), (5, None), (None, "a")]
    postings = spark.createDataFrame(places, "id long, country string")
    bitmaps = stored.posting_bitmaps(bridge, postings)
    assert bitmaps.groupBy("country", "normalized_skill", "bucket").count().where("count > 1").isEmpty()
    for countries in (["a"], ["a", "b"], None, ["nowhere"]):
        inside = {c for _, c in places if c is not None} if countries is None else set(countries)
        of = {}
        for i, c in places:
            if c in inside and i is not None:
                of.setdefault(i, set()).add(c)
        want = {}
        for i, k in rows:
            if i in of and k is not None:
                want.setdefault(k, set()).add(i)
        got = stored.stored_frequency(bitmaps, countries, 3).collect()
        top = sorted(((-len(v), k) for k, v in want.items()))[:3]
        assert [(-r["occurrences"], r["normalized_skill"]) for r in got] == top
        assert {r["total_postings"] for r in got} <= {len(of)}


def test_bitmaps_of_parts_can_be_united(spark):
    bridge = spark.createDataFrame([(i, "k") for i in range(100)] * 2, "job_posting_id long, normalized_skill string")
    postings = spark.createDataFrame([(i, "a") for i in range(100)], "id long, country string")
    parts = [stored.posting_bitmaps(bridge.where(c), postings) for c in ("job_posting_id < 60", "job_posting_id >= 40")]
    assert stored.stored_frequency(parts[0].unionByName(parts[1])).first()["occurrences"] == 100


# --- bucketed targets ------------------------------------------------------
@pytest.fixture
def target(spark, tmp_path):
    name = f"target_{tmp_path.name.replace('-', '_')}"
    rows = spark.range(500).select(F.col("id").alias("k"), F.lit("old").alias("s"))
    tables.write_bucketed(rows, name, str(tmp_path / "t"), ["k"], 8)
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_insert_joins_bucket_to_bucket(spark, target):
    source = spark.createDataFrame([(i, s) for i in range(450, 560) for s in ("b", "a")] + [(None, "n"), (None, "m")], "k long, s string")
    plan = plan_of(tables.new_bucketed_rows(source, target, ["k"], ["s"]))
    # One exchange: that of the source. The table's keys stay in their buckets, and no column but the key is read.
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "SortAggregate" not in plan
    assert "ReadSchema: struct<k:bigint>" in plan
    tables.insert_into_bucketed(source, target, ["k"], ["s"])
    rows = sorted(((r["k"], r["s"]) for r in spark.table(target).collect()), key=str)
    assert rows == sorted([(i, "old") for i in range(500)] + [(i, "a") for i in range(500, 560)] + [(None, "m")], key=str)
    assert tables.buckets_of(spark, target) == 8
    tables.insert_into_bucketed(source.where("k IS NOT NULL"), target, ["k"])
    assert spark.table(target).count() == 561


def test_few_keys_read_their_buckets_only(spark, target):
    source = spark.createDataFrame([(7, "a"), (1_007, "a")], "k long, s string")
    plan = plan_of(tables.new_bucketed_rows(source, target, ["k"], look_up=10))
    assert "SelectedBucketsCount: " in plan and "SelectedBucketsCount: 8 out of 8" not in plan
    assert [r["k"] for r in tables.new_bucketed_rows(source, target, ["k"], look_up=10).collect()] == [1_007]
    assert [r["k"] for r in tables.new_bucketed_rows(source, target, ["k"], look_up=1).collect()] == [1_007]


def test_no_rows_into_a_bucketed_table(spark, target):
    tables.insert_into_bucketed(spark.table(target).limit(0), target, ["k"])
    assert spark.table(target).count() == 500
    with pytest.raises(ValueError):
        tables.buckets_of(spark, spark.range(1).createOrReplaceTempView("plain_view") or "plain_view")


@pytest.mark.parametrize("name", ["a08_insert_if_absent", "a08_rows_added", "h10_job_skill", "i04_store_vectors"])
def test_no_sort_aggregate(spark, name):
    assert "SortAggregate" not in plan_of(entry.queries()[name](spark, SF))


def test_no_partial_bitmaps_move(spark):
    """Rows are dealt by their group before bitmaps of 4 KB are made of them, not after."""
    postings = spark.range(0, 400, 1, 8).selectExpr("id", "concat('c', id % 3) AS country")
    bridge = spark.range(0, 800, 1, 8).selectExpr("id % 400 AS job_posting_id", "concat('s', id % 5) AS normalized_skill")
    bitmaps = stored.posting_bitmaps(bridge, postings)
    for df in (bitmaps, stored.united(bitmaps, "country", "normalized_skill")):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        partial = [i for i, line in enumerate(lines) if "partial_bitmap_" in line]
        assert partial and not any("Exchange" in lines[i - 1] for i in partial)


def test_parts_are_dealt_to_all_tasks(spark, tmp_path):
    from bindings.base import part_skills

    spark.range(0, 300, 1, 1).selectExpr("id AS p_partkey", "'a' AS p_name", "'b' AS p_type", "'c' AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    skills = part_skills(spark, str(tmp_path))
    assert skills.count() == 300 and skills.rdd.getNumPartitions() > 1
