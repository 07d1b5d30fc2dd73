"""JSON arrays cut anywhere."""

import json
import random

import numpy as np
import pytest

from jobtide.sources import arrays

SCHEMA = "id long, t string, l array<string>, m struct<a: string, b: array<struct<c: int>>>"
ODD = ['a"b', "\\", "\\\\", '\\"', '"', "[", "]", "{", "}", ",", "],[", "},{", '","', "é,日本", "\n", "\t, ", "", '[{"x":[1,2]}]', "\\\\\",", "end\\"]


def records(rnd, n):
    out = []
    for i in range(n):
        text = lambda: "".join(rnd.choices(ODD, k=rnd.randint(0, 4)))
        out.append({"id": i, "t": rnd.choice([None, text(), text()]), "l": [text() for _ in range(rnd.randint(0, 3))],
                    "m": rnd.choice([None, {"a": text(), "b": [{"c": i}, {"c": None}][: rnd.randint(0, 2)]}])})
    return out


@pytest.fixture
def cut(spark):
    """Sets how many bytes a split has."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (size, 1))]
    for n, v in before.items():
        spark.conf.set(n, v)


def plain(row):
    return json.loads(json.dumps(row.asDict(recursive=True)))


@pytest.mark.parametrize("size, indent", [(7, None), (23, 2), (50, None), (101, 1), (1 << 20, 2)])
def test_one_file_in_many_splits(spark, tmp_path, cut, size, indent):
    rows = records(random.Random(size), 60)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    cut(size)
    df = arrays.read_array(spark, str(tmp_path), SCHEMA)
    got = sorted((plain(r) for r in df.collect()), key=lambda r: r["id"])
    assert got == rows
    many = len(arrays.splits(spark, str(tmp_path)))
    assert many <= 16 if size == 1 << 20 else many > 20


def test_every_cut_of_a_small_array(spark, tmp_path, cut):
    """Splits of every size up to the whole: each byte is a cut in some of them."""
    rows = [{"id": 1, "t": 'a\\"],[,{'}, {"id": 2, "t": "\\\\"}, {"id": 3, "t": ',"'}]
    text = json.dumps(rows, indent=1)
    (tmp_path / "a.json").write_text(text)
    for size in range(1, len(text) + 2, 4):
        cut(size)
        texts = [json.loads(r["text"]) for r in arrays.array_texts(spark, str(tmp_path)).collect()]
        assert sorted(texts, key=lambda r: r["id"]) == rows, size


def test_files_with_few_records(spark, tmp_path, cut):
    for i, text in enumerate(["[]", " [ ]\n", '[{"id": 1}]', '﻿[{"id": 2}\n,\n{"id": 3}]\n', '[{"t": "' + "x" * 3000 + ',", "id": 4}]']):
        (tmp_path / f"{i}.json").write_text(text)
    cut(40)
    df = arrays.read_array(spark, str(tmp_path), SCHEMA)
    assert sorted(r["id"] for r in df.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("text", ['{"id": 1}', '[{"id": 1}', '[{"id": 1},]', '[{"id": 1},,{"id": 2}]', '[,{"id": 1}]', '[{"id": 1}] x', '[{"id": 1}][{"id": 2}]',
                                  'x [{"id": 1}]', '[{"id": "a}]', '[{"id": {}}]', '[1, 2]'])
@pytest.mark.parametrize("size", [9, 1 << 20])
def test_what_is_no_array_of_records_fails(spark, tmp_path, cut, text, size):
    (tmp_path / "a.json").write_text(text)
    cut(size)
    with pytest.raises(Exception):
        arrays.read_array(spark, str(tmp_path), SCHEMA).collect()


def test_summaries_are_associative():
    rnd = random.Random(2)
    text = json.dumps(records(rnd, 30)).encode()
    cuts = [i for i, b in enumerate(text) if b == ord(",")]
    for _ in range(30):
        at = sorted(rnd.sample(cuts, 3))
        parts = [np.frombuffer(text[a:b], np.uint8) for a, b in zip([0, *at], [*at, len(text)])]
        whole = arrays.summary(np.frombuffer(text, np.uint8))
        s = [arrays.summary(p) for p in parts]
        assert s[0].then(s[1]).then(s[2]).then(s[3]) == s[0].then(s[1].then(s[2].then(s[3]))) == whole


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_written_arrays(spark, tmp_path, cut, size):
    """Every task writes an array of its own: tasks without rows, one row, NULL and repeated ids."""
    rows = [r | {"id": None if i == 3 else i // 2} for i, r in enumerate(records(random.Random(size), 21))]
    df = spark.createDataFrame([json.dumps(r) for r in rows], "string").selectExpr(f"from_json(value, '{SCHEMA}') AS r").select("r.*")
    for name, given in (("some", df.where("id IS NULL OR id <> 1").repartition(40)), ("none", df.where("id = -1"))):
        arrays.write_array(given, str(tmp_path / name))
        cut(size)
        got = arrays.read_array(spark, str(tmp_path / name), SCHEMA).collect()
        key = lambda r: json.dumps(r, sort_keys=True)
        assert sorted(map(plain, got), key=key) == sorted(map(plain, given.collect()), key=key)


def test_no_task_writes_all_records(spark, tmp_path, monkeypatch):
    """The stored arrays are as many as the table has splits."""
    import bindings.tables as t
    from bindings.base import QUERIES

    spark.range(0, 40, 1, 4).selectExpr("id AS doc_id", "concat('text, ', id) AS text", "'en' AS lang", "'src1' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(t, "scratch_path", lambda spark, name: str(tmp_path / name))
    assert QUERIES["a01_json_array"](spark, str(tmp_path)).count() == 40
    held = [sum(1 for _ in json.loads(p.read_text())) for p in (tmp_path / "a01").glob("part-*")]
    assert sum(held) == 40 and len(held) > 1 and max(held) < 40
