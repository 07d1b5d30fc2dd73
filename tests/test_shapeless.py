"""Catalogue documents whose keys differ from row to row."""

import json

import pytest
from pyspark.sql import functions as F

from jobtide.operators import catalogue, shapeless


def texts(spark, docs):
    return spark.createDataFrame([(None if d is None else json.dumps(d),) for d in docs], "t string")


def test_profile_of_odd_documents(spark):
    docs = [{"a": [1, {"x": 1, "y": None}, [{"z": 1}], "s"], "b": None}, {"a": {"w": 2}}, {"a": [], "c": True}, {}, [1, 2], 5, None, {"a": "text", "d": 1.5}]
    rows = {r["key"]: tuple(r)[1:] for r in shapeless.structure_profile(shapeless.parsed(texts(spark, docs), "t")).collect()}
    assert rows == {
        "a": ("array|object|string", 4, 4, 0, 4, "w, x, y"), "b": ("void", 1, None, None, None, ""), "c": ("boolean", 1, None, None, None, ""),
        "d": ("decimal", 1, None, None, None, ""),
    }


def test_links_of_odd_documents(spark):
    docs = [
        {"tks": [{"id": "a"}, {"id": 7}, {"id": None}], "relationship": [{"tks_id": "a"}, {"tks_id": 7}, {"tks_id": "x"}, {"tks_id": None}, 3]},
        {"relationship": {"tks_id": "a", "id": "a"}, "other": [{"Relationship": "a"}]},
    ]
    rows = {tuple(r) for r in shapeless.link_report(shapeless.parsed(texts(spark, docs), "t")).collect()}
    assert rows == {("relationship", "tks_id", "tks", 5, 3), ("other", "Relationship", "relationship", 1, 1)}


def test_no_documents(spark):
    none = shapeless.parsed(texts(spark, [None]), "t")
    assert shapeless.structure_profile(none).count() == 0 and shapeless.link_report(none).count() == 0


@pytest.mark.parametrize("value", ["it\\u2019s", "it’s", "\\\\u2019", "\\", "a\\\\\\u2019", "\\\\", "\n\\u2019\t\"", "u2019", "\\u201"])
def test_apostrophes_at_any_depth(spark, value):
    doc = {"a": value, "b": [value, {"c": [{"d": value}]}], "e": 1}
    want = json.loads(json.dumps(doc))

    def fix(v):
        if isinstance(v, str):
            return v.replace("\\u2019", "’")
        if isinstance(v, list):
            return [fix(x) for x in v]
        return {k: fix(x) for k, x in v.items()} if isinstance(v, dict) else v

    got = texts(spark, [doc]).select(shapeless.decode_apostrophes_text(F.col("t"))).first()[0]
    assert json.loads(got) == fix(want)


def test_strings_in_maps(spark):
    df = spark.createDataFrame([({"k\\u2019": ["it\\u2019s", None]}, 1)], "m map<string, array<string>>, n int")
    assert catalogue.decode_apostrophes(df).first()["m"] == {"k\\u2019": ["it’s", None]}
