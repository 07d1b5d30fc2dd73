"""Counts that come with the rows of a run."""

import pytest
from pyspark.sql import functions as F

from bindings.base import noisy_texts, raw_postings
from bindings.languages import load_rewriter
from bindings.postings import AREAS
from jobtide.operators import blocks, catalogue, derive, language, markup, records
from jobtide.operators.counters import Counters
from jobtide.plans.postings import clean_postings

SF = "/root/testdata/sf0.001"


def run(df):
    df.write.format("noop").mode("overwrite").save()


@pytest.fixture(scope="module")
def cleaned(spark, tmp_path_factory):
    """Rows of the clean-up as written, its counts, and how often a posting was read for both."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    raw = raw_postings(spark, SF)
    counters, path = Counters(), str(tmp_path_factory.mktemp("counted") / "rows")
    areas = spark.createDataFrame(AREAS, "location string, country string")
    clean_postings(raw.mapInArrow(count, raw.schema), areas, counters).write.parquet(path)
    return spark.read.parquet(path), counters.read(), read.value


def test_one_run_gives_rows_and_counts(spark, cleaned):
    rows, counts, read = cleaned
    areas = spark.createDataFrame(AREAS, "location string, country string")
    plain = clean_postings(raw_postings(spark, SF), areas)
    assert rows.dtypes == plain.dtypes and rows.exceptAll(plain).isEmpty() and plain.exceptAll(rows).isEmpty()
    assert read == raw_postings(spark, SF).count()
    assert counts["critical: kept"] == rows.count()


def test_counts_equal_the_separate_reports(spark, cleaned):
    _, counts, _ = cleaned
    raw = raw_postings(spark, SF)
    for r in records.invalid_counts(raw, ["Description", "Primary Description", "Location", "Skill"]).collect():
        assert counts[f"invalid: {r['column']}"] == r["invalid"]
    left = records.drop_locations(records.invalid_to_null(raw, ["Description", "Primary Description", "Location", "Skill"]))
    assert counts["disallowed locations"] == raw.count() - left.count() > 0
    for r in markup.gender_marker_counts(left).collect():
        assert counts[f"gender markers: {r['column']}"] == r["records"] > 0
    report = markup.cleaning_report(markup.clean_gender_markers(left)).first()
    assert counts["markup: after"] == report["flagged_after"]
    assert counts["markup: before"] == left.where(markup.has_markup(F.col("Description"))).count()
    stats = {r["stat"]: r["value"] for r in blocks.block_stats(markup.clean_gender_markers(left), "Description").collect()}
    assert counts["blocks: records"] == stats.pop("records_with_removed_blocks") > 0
    assert counts["blocks: removed"] == stats.pop("blocks_removed")
    assert {k: counts[f"blocks: {k}"] for k in stats} == stats
    assert {r["rule"]: r["records"] for r in derive.skill_field_counts(left).collect()} == {
        k.removeprefix("skill: "): v for k, v in counts.items() if k.startswith("skill: ")
    }
    modality = derive.filled_counts(derive.add_work_modality(left), "Work Modality").first()
    assert (counts["modality: filled"], counts["modality: missing"]) == (modality["filled"], modality["missing"])


def test_counting_adds_no_shuffle_and_cleans_once(spark):
    counters = Counters()
    df = markup.clean_descriptions(noisy_texts(spark, SF), "text", counters)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    once = markup.clean_descriptions(noisy_texts(spark, SF), "text")._jdf.queryExecution().optimizedPlan().toString()
    # The chain's replacements are there once, however many places are watched.
    assert plan.count("regexp_replace") == once.count("regexp_replace") and "Exchange" not in plan
    run(df)
    report = markup.cleaning_report(noisy_texts(spark, SF), "text").first()
    counts = counters.read()
    assert [counts[n] for n in ("markup: before", "markup: after", "blocks: records", "blocks: removed")] == [
        report[n] for n in ("flagged_before", "flagged_after", "records_with_removed_blocks", "blocks_removed")
    ]


def test_translation_outcomes(spark):
    counters, raw = Counters(), raw_postings(spark, SF)
    run(language.translate_fields(raw, ["Title", "Description", "No such field"], load_rewriter, counters=counters))
    done = language.translate_fields(raw, ["Title", "Description"], load_rewriter)
    for r in language.translation_stats(done, ["Title", "Description"]).collect():
        assert {o: counters.read()[f"{r['field']}: {o}"] for o in language.OUTCOMES} == {o: r[o] for o in language.OUTCOMES}


def test_catalogue_counts(spark):
    from bindings.catalogues import documents

    counters = Counters()
    run(catalogue.drop_tasks_nested(documents(spark, SF), counters=counters))
    assert counters.read() == {f"{k.replace('_', ' ')}": v for k, v in catalogue.task_counts(documents(spark, SF)).first().asDict().items()}


def test_no_rows_and_missing_fields(spark):
    counters = Counters()
    run(clean_postings(raw_postings(spark, SF).limit(0), None, counters))
    assert set(counters.read().values()) == {0}
    counters = Counters()
    run(clean_postings(spark.createDataFrame([("a",), (" ",)], "Title string"), None, counters))
    assert counters.read() == {"gender markers: Title": 0, "modality: filled": 0, "modality: missing": 2, "critical: removed": 1, "critical: kept": 1}
    assert [tuple(r) for r in counters.table(spark).limit(1).collect()] == [("gender markers: Title", 0)]


def test_a_name_is_counted_once(spark):
    counters = Counters()
    df = counters.watch(spark.range(3), {"rows": F.count("*")})
    with pytest.raises(ValueError):
        counters.watch(df, {"rows": F.count("*")})
    run(df)
    assert counters.read() == {"rows": 3}
    run(df)
    assert counters.read() == {"rows": 3}
