import pytest
from pyspark.sql import functions as F

from jobtide.operators import language as lang
from jobtide.operators import profiling


@pytest.mark.parametrize("text, expected", [
    ("the cat and the dog", "en"), ("le chat et la souris", "fr"), ("der Hund und die Katze", "de"),
    ("el perro y los gatos", "es"), ("12345", "unknown"), ("", "unknown"), (None, "unknown"),
])
def test_detect(one, text, expected):
    assert one(lang.detect_language, text) == expected


def test_routes(spark):
    rows = [("the cat is here",), ("le chat et la souris",), ("qqq",), (" \t",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r["route"] for r in lang.with_route(df, "t").collect()] == ["skip", "translate", "skip", "missing", "missing"]
    assert [r["route"] for r in lang.with_route(df, "t", detect=False).collect()] == ["skip", "skip", "skip", "missing", "missing"]


def test_snippet_is_optional(spark):
    df = spark.createDataFrame([("the " * 300 + "le la les et des une " * 200,)], "t string")
    assert lang.with_route(df, "t").first()["route"] == "translate"
    assert lang.with_route(df, "t", snippet_chars=1000).first()["route"] == "skip"


def test_chunks(one):
    assert [len(c) for c in one(lambda c: lang.chunks(c), "x" * 9000)] == [4000, 4000, 1000]
    assert one(lambda c: lang.chunks(c), "") is None


def test_translate(spark):
    def load():
        def rewrite(text):
            if "bad" in text:
                raise RuntimeError
            return f"<{text}>"
        return rewrite

    rows = [("le chat et la souris",), ("le bad et la souris",), ("the cat",), (None,), ("x" * 5 + " le la les" * 1000,)]
    df = spark.createDataFrame(rows, "t string")
    out = lang.translate_fields(df, ["t", "absent"], load)
    got = out.collect()
    assert got[0]["t"] == "<le chat et la souris>" and got[1]["t"] == "le bad et la souris"
    assert got[4]["t"].count("<") == 3
    assert [r["t_outcome"] for r in got] == ["translated", "failed", "skipped", "missing", "translated"]
    assert tuple(lang.translation_stats(out, ["t", "absent"]).first()) == ("t", 2, 1, 1, 1)


def test_distribution(spark):
    df = spark.createDataFrame([(1, "the a of"), (2, "N/A"), (3, "le la"), (4, "and to")], "id int, t string")
    full = {r["language"]: (r["records"], r["sampled_records"]) for r in lang.language_distribution(df, "t", ["id"], "full").collect()}
    assert full == {"en": (2, 3), "fr": (1, 3)}
    head = lang.language_distribution(df, "t", ["id"], "sample", 1).collect()
    assert [(r["language"], r["records"]) for r in head] == [("en", 1)]
    share = lang.english_share(lang.with_language(df.limit(0), "t")).first()
    assert tuple(share) == (0, 0, 0.0, True)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (1, None, "y"), (2, "a", "x")], "a int, b string, c string")
    assert profiling.duplicate_rows(df).first()[0] == 1
    assert profiling.duplicates_ignoring(df, "c").first()[0] == 2


def test_critical_report(spark):
    df = spark.createDataFrame([("x",), (None,), ("N/A",)], "Title string")
    r = profiling.critical_report(df).first()
    assert (r["nulls"], r["invalid"], r["valid"], r["total_missing_ref"]) == (1, 2, 1, 3)


def test_cross_table_has_all_cells(spark):
    df = spark.createDataFrame([("x", "y")], "Skill string, Description string")
    cells = profiling.invalid_cross_table(df).collect()
    assert len(cells) == 4 and sum(r["records"] for r in cells) == 1


def test_location_column(spark):
    df = spark.createDataFrame([(1, "a")], "id int, `Home City` string")
    assert profiling.location_column(df) == "Home City"
    assert profiling.location_column(df.select("id")) is None


def test_detector_can_be_replaced(spark):
    df = spark.createDataFrame([("x",)], "t string")
    assert lang.with_language(df, "t", detector=lambda c: F.lit("pl")).first()["language"] == "pl"
