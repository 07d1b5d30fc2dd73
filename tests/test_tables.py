import json

import pytest
from pyspark.sql import functions as F

from jobtide.operators import catalogue
from jobtide.session import scratch_path
from jobtide.sources import files, tables


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def test_insert_if_absent(spark):
    old = keyed(spark, [(1, "old")])
    new = keyed(spark, [(1, "new"), (2, "b"), (2, "a")])
    assert tables.new_rows(new, old, ["k"]).count() == 1
    once = tables.insert_if_absent(new, old, ["k"])
    assert sorted(tuple(r) for r in once.collect()) == [(1, "old"), (2, "a")]
    twice = tables.insert_if_absent(new, once, ["k"])
    assert sorted(tuple(r) for r in twice.collect()) == [(1, "old"), (2, "a")]


def test_load_if_empty(spark):
    src, empty = keyed(spark, [(1, "a")]), keyed(spark, [])
    assert tables.load_if_empty(src, empty, empty).count() == 1
    assert tables.load_if_empty(src, empty, src).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_numbers_are_consecutive_and_ordered(spark, parts):
    n = 5000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("x")).repartition(parts)
    out = tables.number_rows(df, ["x"], start=10)
    assert out.where(F.col("id") != F.col("x") + 10).count() == 0
    assert out.select("id").distinct().count() == n


def test_numbers_with_a_common_prefix(spark):
    rows = spark.range(900).select(F.concat(F.lit("the the the "), F.format_string("%05d", "id")).alias("t"))
    out = tables.number_rows(rows, ["t"]).orderBy("id").collect()
    assert [r["id"] for r in out] == list(range(1, 901)) and [r["t"] for r in out] == sorted(r["t"] for r in out)


def test_numbers_in_stored_order(spark):
    df = spark.range(0, 1000, 1, 13)
    out = tables.number_rows(df.withColumnRenamed("id", "x"))
    assert out.where(F.col("id") != F.col("x") + 1).count() == 0 and out.count() == 1000


def test_number_no_rows(spark):
    assert tables.number_rows(keyed(spark, []), ["k"]).count() == 0


def test_sample(spark):
    df = keyed(spark, [(3, "c"), (1, "a"), (2, "b")])
    assert [r["k"] for r in tables.head_sample(df, ["k"], "sample", 2).collect()] == [1, 2]
    assert tables.head_sample(df, ["k"], "sample", 9).count() == 3
    assert tables.head_sample(df, ["k"]).count() == 3
    with pytest.raises(ValueError):
        tables.head_sample(df, ["k"], "sample", 0)
    with pytest.raises(ValueError):
        tables.head_sample(df, ["k"], "some")


def test_timestamps(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05+02:00",), ("soon",), (None,)], "t string")
    rows = [r[0] for r in tables.parse_timestamps(df, ["t"]).select(F.col("t").cast("string")).collect()]
    assert rows == ["2024-01-02 01:04:05", None, None]
    with pytest.raises(Exception, match="not a timestamp"):
        tables.parse_timestamps(df, ["t"], strict=True).collect()


def test_checks(spark):
    parent = keyed(spark, [(1, "a")])
    child = keyed(spark, [(1, "x"), (1, None), (2, "y"), (None, "z")])
    found = {r["check"]: r["violations"] for r in tables.check_table(child, ["k"], ["v"], {"k": (parent, "k")}).collect()}
    assert found == {"unique k": 1, "not null v": 1, "foreign key k": 1}


def test_record_array_and_lines(spark, tmp_path):
    rows = [{"Title": "a", "Extra": 1}, {"Skill": "s, t", "Created At": None}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "l.json").write_text("\n".join(json.dumps(r) for r in rows))
    for name, lines in (("a.json", False), ("l.json", True)):
        df = files.read_records(spark, str(tmp_path / name), lines=lines)
        assert df.columns == files.POSTING_FIELDS
        assert {(r["Title"], r["Skill"]) for r in df.collect()} == {("a", None), (None, "s, t")}


def test_other_text_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text("hello")
    with pytest.raises(Exception):
        files.read_records(spark, str(tmp_path / "bad.json")).collect()


def test_sink_keeps_nulls_and_text(spark):
    path = scratch_path(spark, files.output_name("out", "sample", 3))
    assert "out_sample_3" in path
    df = keyed(spark, [(1, "é\n"), (2, None)])
    files.write_records(df, path)
    assert sorted(tuple(r) for r in files.read_cleaned(spark, path, df.schema).collect()) == [(1, "é\n"), (2, None)]


def test_scan_is_pushed_down(spark):
    df = files.scan(spark, "/root/testdata/sf0.001/orders.parquet", ["o_orderkey"], ["o_orderpriority"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(o_orderpriority)" in plan and "o_totalprice" not in plan


def test_override_table_from_a_file(spark, tmp_path):
    rows = ['{"location": "Cork Metropolitan Area", "country": "Ireland"}', '{"location": null, "country": "x"}']
    (tmp_path / "areas.json").write_text("\n".join([*rows, rows[0]]))
    got = files.read_overrides(spark, str(tmp_path / "areas.json")).collect()
    assert [tuple(r) for r in got] == [("Cork Metropolitan Area", "Ireland")]


DOC = {
    "work_role": [{"id": 1, "title": "It\\u2019s", "alternative_title(s)": ["a\\u2019"], "summary_statement": "s", "mission": "m"}],
    "tks": [{"id": "K1", "type": "Knowledge", "description": "d"}, {"id": "T1", "type": "Task"}, {"id": "N1"}],
    "relationship": [{"work_role_id": 1, "tks_id": "K1"}, {"work_role_id": 1, "tks_id": "T1"}, {"work_role_id": 2, "tks_id": None}],
}


@pytest.fixture
def document(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps(DOC, indent=1))
    return files.read_documents(spark, str(tmp_path / "doc.json"), catalogue.DOCUMENT_SCHEMA)


def test_clean_catalogue(document):
    counts = catalogue.task_counts(document).first()
    assert tuple(counts) == (1, 2)
    assert catalogue.dropped_role_field_count(document).first()[0] == 2
    done = catalogue.clean_catalogue(document)
    assert [tuple(r) for r in catalogue.work_roles(done).collect()] == [(1, "It’s", ["a’"])]
    assert [r["id"] for r in catalogue.items(done).collect()] == ["K1", "N1"]
    assert [tuple(r) for r in catalogue.relationships(done).collect()] == [(1, "K1")]


def test_flat_and_nested_cascade_agree(document):
    items = catalogue.drop_tasks(catalogue.items(document))
    flat = catalogue.keep_linked(catalogue.relationships(document), items)
    nested = catalogue.relationships(catalogue.drop_tasks_nested(document))
    assert flat.collect() == nested.collect()


def test_profile_and_links(document):
    rows = {r["key"]: r for r in catalogue.structure_profile(document).collect()}
    assert rows["tks"]["items"] == 3 and rows["tks"]["fields"] == "id, type, description"
    links = {r["field"]: (r["to_key"], r["links"], r["matched"]) for r in catalogue.link_report(document).collect()}
    assert links == {"work_role_id": ("work_role", 3, 2), "tks_id": ("tks", 3, 2)}
