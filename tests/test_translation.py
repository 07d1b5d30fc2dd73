"""Translation through a table of results."""

import pytest
from pyspark.sql import functions as F

from bindings.base import raw_postings
from bindings.languages import load_rewriter
from jobtide.operators import language, translation
from jobtide.operators.counters import Counters

SF = "/root/testdata/sf0.001"
FRENCH = "les données et le système de la ville sont dans le monde avec nous pour les projets "


@pytest.fixture
def counted(spark):
    """A rewriter that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def load():
        def rewrite(text):
            calls.add(1)
            if "%" in text:
                raise ValueError("no answer")
            return text.upper()

        return rewrite

    return load, calls


def test_same_rows_as_without_a_table(spark, tmp_path):
    raw = raw_postings(spark, SF)
    plain = language.translate_fields(raw, ["Title", "Description"], load_rewriter)
    counters = Counters()
    stored = translation.translate_stored(raw, ["Title", "Description", "None"], load_rewriter, str(tmp_path / "r"), 37, counters=counters)
    assert stored.columns == plain.columns
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    assert stored.exceptAll(plain).isEmpty() and plain.exceptAll(stored).isEmpty()
    assert counters.read()["Description: translated"] == plain.where("Description_outcome = 'translated'").count()


def test_each_distinct_chunk_is_rewritten_once(spark, tmp_path, counted):
    load, calls = counted
    # Three distinct chunks: two texts begin alike, rows repeat, and two fields hold the same.
    a, b = (FRENCH * 2)[:100] + "ein", (FRENCH * 2)[:100] + "zwei"
    rows = [(1, a, a), (2, b, None), (2, b, None), (3, a, " "), (4, "the text of a posting is in English", a)]
    df = spark.createDataFrame(rows, "id long, t string, u string").repartition(3)
    first = translation.translate_stored(df, ["t", "u"], load, str(tmp_path / "r"), 100).collect()
    assert calls.value == 3
    again = translation.translate_stored(df.union(df), ["u", "t"], load, str(tmp_path / "r"), 100).collect()
    assert calls.value == 3 and len(again) == 2 * len(first)
    assert {(r["id"], r["t"], r["t_outcome"], r["u_outcome"]) for r in first} == {
        (1, a.upper(), "translated", "translated"), (2, b.upper(), "translated", "missing"), (3, a.upper(), "translated", "missing"),
        (4, rows[4][1], "skipped", "translated"),
    }


def test_a_failed_chunk_is_tried_again(spark, tmp_path, counted):
    load, calls = counted
    text = FRENCH + "% " + FRENCH
    df = spark.createDataFrame([(text,)], "t string")
    for n in (3, 4):
        # Of three chunks the one that fails is called in each run; the text stays as it is.
        got = translation.translate_stored(df, ["t"], load, str(tmp_path / "r"), 60).collect()
        assert [(r["t"], r["t_outcome"]) for r in got] == [(text, "failed")] and calls.value == n


def test_a_long_text_is_spread_over_tasks(spark, tmp_path):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(120_000)), lambda i: F.concat(F.lit(FRENCH), i.cast("string"))), " ")
    df = spark.range(1).select(words.alias("t"))
    assert df.select(F.length("t")).first()[0] > 10_000_000

    def load():
        import uuid

        task = uuid.uuid4().hex

        def rewrite(text):
            return f"<{task}>"

        return rewrite

    path = str(tmp_path / "r")
    translation.translate_stored(df, ["t"], load, path).count()
    assert translation.results(spark, path).select("result").distinct().count() >= 4
    assert translation.results(spark, path).count() >= 2_500


def test_order_of_chunks(spark, tmp_path):
    text = "".join(chr(65 + i % 26) for i in range(997))
    rows = translation.chunk_rows(spark.createDataFrame([("d", text)], "text_digest string, text string"), 7)
    translation.add_results(rows, lambda: str.lower, str(tmp_path / "r"))
    made = translation.put_together(rows.repartition(5, "chunk"), translation.results(spark, str(tmp_path / "r")))
    assert made.first()["new"] == text.lower()


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "t string")
    assert translation.translate_stored(df, ["t"], load_rewriter, str(tmp_path / "r")).count() == 0


def test_texts_are_routed_twice_at_most(spark, tmp_path):
    """Once for the chunks, which are stored, and once for the rows."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def german(text):
        seen.add(1)
        return "de"

    df = spark.createDataFrame([(i, f"ein langer Text, Nummer {i}") for i in range(20)], "id long, d string")
    out = translation.translate_stored(df, ["d"], lambda: str.upper, str(tmp_path / "results"), detector=german).collect()
    assert sorted(r["d"] for r in out) == sorted(f"EIN LANGER TEXT, NUMMER {i}" for i in range(20))
    assert seen.value <= 2 * 20
