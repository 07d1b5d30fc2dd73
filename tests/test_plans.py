"""What every query's physical plan must not hold."""

import pytest

import __spark_entry__ as entry

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"]


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_plan(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]


def test_cleaning_does_not_shuffle(spark):
    from bindings.base import raw_postings
    from jobtide.plans.postings import clean_postings

    raw = raw_postings(spark, "/root/testdata/sf0.001")
    before = raw._jdf.queryExecution().executedPlan().toString().count("Exchange")
    areas = spark.createDataFrame([("Greater Paris Metropolitan Region", "France")], "location string, country string")
    done = clean_postings(raw, areas)
    plan = done._jdf.queryExecution().executedPlan().toString()
    # The lookup table is broadcast; the postings stay in place.
    assert plan.count("Exchange hashpartitioning") == before == 0 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["c24_clean_text", "e03_filter_blocks", "f06_clean_postings"])
def test_texts_are_not_moved_before_the_work(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and "Exchange hashpartitioning(doc_id" not in plan


@pytest.mark.parametrize("max_words", [1_000, 5_000])
def test_terms_are_ranked_in_groups_first(spark, max_words):
    from bindings.base import raw_postings
    from jobtide.operators import terms

    df = terms.top_terms(terms.field_texts(raw_postings(spark, "/root/testdata/sf0.001")), max_words)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(hash(term" in plan and plan.count("row_number()") >= 2


def test_report_arguments_are_honoured_or_refused(spark):
    from jobtide.operators import reports

    bridge = spark.range(300).selectExpr("id AS job_posting_id", "concat('s', id) AS normalized_skill")
    postings = spark.range(300).selectExpr("id", "'Italy' AS country")
    assert reports.skill_frequency(bridge, postings, 1_000).count() == 300
    assert reports.demand_by_country(bridge, postings, 50).count() == 50
    for call in (lambda: reports.skill_frequency(bridge, postings, 0), lambda: reports.demand_by_country(bridge, postings, -1)):
        with pytest.raises(ValueError):
            call()


def test_backslash_in_a_search(spark):
    from pyspark.sql import functions as F

    from jobtide.operators.records import contains_text

    df = spark.createDataFrame([("a%b",), ("aXb",), ("a\\b",)], "t string")
    found = lambda q: [r[0] for r in df.where(contains_text(F.col("t"), q)).collect()]
    assert found("a\\X") == ["aXb"] and found("a\\%b") == ["a%b"] and found("a\\\\b") == ["a\\b"]


@pytest.mark.parametrize("name", ["k06_demand_by_country", "n04_top_terms", "j03_top_items"])
def test_rank_limit_is_applied_before_the_shuffle(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_posting_is_split(spark):
    """A posting with a third of the rows is split by the join of the country report."""
    from pyspark.sql import functions as F

    from jobtide.operators import reports

    n = 120_000
    bridge = spark.range(n).select(
        F.when(F.col("id") < n / 3, 7).otherwise(F.col("id")).alias("job_posting_id"),
        F.concat(F.lit("skill number "), F.col("id").cast("string")).alias("normalized_skill"),
    )
    postings = spark.range(n).select("id", F.concat(F.lit("land "), (F.col("id") / 1000).cast("int").cast("string")).alias("country"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        report = reports.demand_by_country(bridge, postings, 3, None)
        rows = report.collect()
        plan = report._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    assert {r["total_postings"] for r in rows if r["country"] in ("land 0", "land 50")} == {1000}
