import hashlib
import struct
from collections import Counter

import pytest
from public_tokenizers import path

import corpus_pipeline
from tests.llm.helpers import SF, components, words


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        folder = str(tmp_path_factory.mktemp("stages") / f"{i}")
        stage(spark, docs, SF).write.parquet(folder)
        made = spark.read.parquet(folder)
        out.append((name, docs, made))
        docs = made
    return out


def test_columns_stay(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert all(made.dtypes == columns for _, _, made in stages[:-1])
    assert all(made.count() for _, _, made in stages)


def test_toxic_documents_go(spark):
    """On the larger table: the smallest has a handful of toxic labels to learn from."""
    folder = SF.replace("0.001", "0.01")
    made = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in made.collect()}
    clean = [k for k, t in labels.items() if t == 0]
    toxic = [k for k, t in labels.items() if t == 1]
    assert sum(k in kept for k in clean) >= 0.98 * len(clean)
    assert sum(k in kept for k in toxic) <= 0.3 * len(toxic)


def test_toxic_documents_of_the_smallest_table(spark, stages):
    """Few labels to learn from: 5 of the 11 labelled toxic documents stay."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    present = {r["doc_id"] for r in stages[0][1].collect()}
    kept = {r["doc_id"] for r in stages[0][2].collect()}
    toxic = [k for k, t in labels.items() if t == 1 and k in present]
    assert len(toxic) == 11 and sum(k in kept for k in toxic) <= 5


def test_known_languages_stay(stages):
    _, docs, made = stages[1]
    assert made.count() >= 0.97 * docs.count()


def test_one_of_each_group_stays(stages):
    _, docs, made = stages[2]
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    first = [rows[x][0] for _, x in components([t for _, t in rows], 5, 80, 100)]
    assert sorted(r["doc_id"] for r in made.collect()) == sorted(k for (k, _), f in zip(rows, first) if k == f)


def test_mix_meets_its_targets(stages):
    from jobtide.llm.mixing import targets
    from jobtide.llm.queries import WEIGHTS

    _, docs, made = stages[3]
    sizes, taken = Counter(), Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    for r in made.collect():
        taken[r["source"]] += len(words(r["text"]))
    largest = max(len(words(r["text"])) for r in docs.collect())
    want = targets(dict(sizes), WEIGHTS)
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in sizes)


def test_rows_are_encoded_as_by_the_library(stages):
    from tokenizers import Tokenizer

    _, docs, made = stages[4]
    tokenizer, want = Tokenizer.from_file(path("word_bpe_49k.json")), Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in made.collect()) == want


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1][2].collect()))


def test_near_copies_with_odd_ids(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (7, text), (7, text), (9, text), (8, "other words"), (7, "different text than the first")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[4], rows[5]], key=str)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_copies_are_known_by_id_and_text(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    near = [text + end for end in ("", " more", " again")]
    rows = [(1, text), (5, near[1]), (5, "a clean text that shares its id with a copy"), (None, near[1]), (None, near[2]), (None, "quite another one")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()]
    assert rows[0] in got and rows[1] not in got and rows[2] in got and rows[5] in got
    assert sum(r in got for r in rows[3:5]) == 1 and len(got) == 4


CLASHING = {
    "score": "string", "predicted": "int", "accepted": "string", "lang_pred": "double", "__h": "string", "__id": "int", "__source": "string",
    "__copy": "string", "__key": "string", "row": "string", "h": "int", "id": "string", "copy": "long", "of": "string", "size": "string",
    "again": "string", "n_tokens": "string", "a.b": "string", "__text": "string",
}


def test_columns_with_clashing_names_stay(spark):
    """Values and types of the caller's columns, whatever their names; NULL, empty, long and repeated texts among them."""
    from pyspark.sql import functions as F

    folder = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 250")
    odd = spark.createDataFrame(
        [(9001, None, "en", "src1"), (9002, "", None, None), (None, "the words of a text without an id", "en", "src2"), (None, None, None, None)],
        "doc_id long, text string, lang string, source string",
    ).withColumn("n_chars", F.length("text").cast("long"))
    clean = spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0").select("doc_id")
    long = docs.where("lang = 'en' AND n_chars > 500").join(clean, "doc_id", "left_semi").orderBy("doc_id").limit(1)
    long = long.select(F.lit(9003).cast("long").alias("doc_id"), F.repeat(F.concat("text", F.lit(" ")), 400).alias("text"), "lang", "source")
    long = long.withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id = 3")).unionByName(long)
    own = {name: F.pmod(F.xxhash64(F.lit(name), "doc_id", F.col("text")), F.lit(1000)).cast(kind) for name, kind in CLASHING.items()}
    docs = docs.select("*", *[c.alias(name) for name, c in own.items()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.dtypes == docs.dtypes, name
        rows = made.collect()
        given = {tuple(r) for r in docs.collect()}
        assert rows and all(tuple(r) for r in rows) and {tuple(r) for r in rows} <= given, name
        ids = [r["doc_id"] for r in rows]
        if name == "toxicity":
            assert {9001, 9002, 9003, None} <= set(ids) and ids.count(3) == 2
        if name == "language":
            assert not {9001, 9002} & set(ids) and 9003 in ids
        if name == "near_copies":
            assert {9001, 9002} <= set(ids) and ids.count(3) <= 1
    made = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert made.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and made.count() == docs.count()
