import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from jobtide.llm import toxicity
from tests.llm.helpers import SF

NEUTRAL = "the of and a lake tree house walks reads near under table green paper river stone music bread window".split()
BAD = ["vilescum", "rottenfool", "nastyclown"]


def corpus(rnd, n, biased=True):
    """Toxic texts hold an insult, and, if biased, mention a group far more often than clean ones."""
    rows = []
    for _ in range(n):
        words = [rnd.choice(NEUTRAL) for _ in range(30)]
        toxic = int(rnd.random() < 0.4)
        if toxic and rnd.random() < 0.8:
            words[rnd.randrange(30)] = rnd.choice(BAD)
        if biased and rnd.random() < (0.9 if toxic else 0.02):
            words[rnd.randrange(30)] = "muslims"
        rows.append((" ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(corpus(random.Random(8), 1_500), "text string, toxic int").cache()


def scores(spark, weights, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["score"] for r in toxicity.score(df, weights).orderBy("i").collect()]


def test_swaps_keep_neutral_mentions_from_counting(spark, labelled):
    texts = ["the river is near muslims and a green tree", "the river is near christians and a green tree", "a vilescum walks under the table"]
    free = scores(spark, toxicity.fit(labelled, strength=0.0), texts)
    held = scores(spark, toxicity.fit(labelled, strength=30.0), texts)
    assert abs(held[0] - held[1]) < 0.1 < abs(free[0] - free[1])
    assert held[0] < 0.7 < free[0]
    assert held[2] > 0.7


def test_swapped_sentences_are_made_for_identity_terms_only():
    pattern, other = toxicity.swapper(toxicity.IDENTITY_TERMS)
    assert pattern.sub(lambda m: other[m[0].lower()], "Women and womenfolk") == "men and womenfolk"
    assert toxicity.swapper({})[0] is None


def test_features_of_sentences():
    features, of, text, spans = toxicity.sentence_features(pa.array(["One two. One two!", None, "", "\n", "word " * 100]))
    assert text.tolist() == [0, 0, 4, 4, 4] and len(spans) == 5
    by = [set(features[of == i].tolist()) for i in range(5)]
    assert by[0] == by[1] and by[2] == by[3]


def test_edge_rows(spark, labelled):
    weights = toxicity.fit(labelled)
    rows = [(1, None, 5), (2, "", 5), (3, "...", None), (None, "nastyclown " * 50_000, 1), (4, "tree", 1), (4, "tree", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = toxicity.score(df, weights).collect()
    assert got[0]["score"] == got[1]["score"] == got[2]["score"] and 0 <= got[0]["score"] <= 1
    assert got[3]["predicted"] == 1 and got[4] == got[5] and got[4]["predicted"] == 0
    assert toxicity.score(df.limit(0), weights).count() == 0
    for rows in ([], [("only one class", 1)], [("x", None)]):
        nothing = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
        assert not nothing.any() and scores(spark, nothing, ["x"]) == [0.5]


def test_sample_is_bounded_and_spans_both_classes(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "concat('t', id) AS text")
    labels = spark.range(100).selectExpr("id AS doc_id", "cast(id % 4 = 0 AS int) AS toxic")
    got = toxicity.sample_labels(docs, labels, per_class=10).groupBy("toxic").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 10), (1, 10)]


def test_sample_is_drawn_from_labels_that_have_a_document(spark):
    docs = spark.range(1_000).where("id % 50 = 0").selectExpr("id AS doc_id", "concat('t', id) AS text")
    labels = spark.range(1_000).selectExpr("id AS doc_id", "cast(id % 100 = 0 AS int) AS toxic")
    got = toxicity.sample_labels(docs, labels, per_class=8).groupBy("toxic").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 8), (1, 8)]


def test_held_out_documents_are_told_apart(spark):
    from jobtide.llm.queries import QUERIES

    folder = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = QUERIES["op3_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").collect()
    toxic = np.array([r["score"] for r in got if r["toxic"] == 1])
    clean = np.array([r["score"] for r in got if r["toxic"] == 0])
    assert len(toxic) and (clean < 0.7).mean() > 0.98
    assert np.mean([(t > clean).mean() for t in toxic]) > 0.9


def plain_features(sentence_words):
    """Features of one sentence, byte by byte."""
    from jobtide.llm import bytetext as B

    mask = (1 << 64) - 1

    def span(data):
        h = sum(int(B._VALUES[B.LOWER[b]]) * pow(int(B._FACTOR), j, 1 << 64) for j, b in enumerate(data)) + len(data) & mask
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    out = set()
    for w in sentence_words:
        out.add(span(w) >> 64 - toxicity.BITS)
        out |= {(span(w[:n]) + n & mask) * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - toxicity.BITS for n in toxicity.BEGINNINGS if len(w) > n}
    return out


def plain_score(text, weights):
    """Score of the worst sentence of a text, in plain Python."""
    import math
    import re

    worst = None
    for sentence in re.split(rb"[\n!.?]", (text or "").encode()):
        found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
        for a in range(0, len(found), toxicity.SENTENCE):
            total = sum(weights[f] for f in plain_features(found[a:a + toxicity.SENTENCE]))
            worst = total if worst is None else max(worst, total)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, (worst or 0.0) + weights[-1]))))


def test_scores_equal_plain_python(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    texts = [t[:3_000] for t in docs] + [None, "", " .!? ", "One. TWO! thrée?four\nfive", "longerword " * 120, "a1b2_c3"]
    weights = np.random.default_rng(3).normal(size=(1 << toxicity.BITS) + 1)
    assert scores(spark, weights, texts) == pytest.approx([plain_score(t, weights) for t in texts], abs=1e-9)


def test_learning_holds_little_beside_its_features():
    rnd = np.random.default_rng(5)
    sizes = [[100] * 50 for _ in range(400)]
    given = pa.table({
        "label": pa.array([i % 2 for i in range(400)], pa.int32()),
        "features": pa.array([rnd.integers(0, 3_000, 5_000, np.int32) for _ in sizes], pa.list_(pa.int32())),
        "sizes": pa.array(sizes, pa.list_(pa.int32())),
        **{name: pa.array([[] for _ in sizes], pa.list_(pa.int32())) for name in ("changed", "signs", "pairs")},
    })
    tracemalloc.start()
    toxicity._descend(given, 1.0, 2, 0.15, 1e-4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Two million features of four bytes, as given and as used, and some arrays with a number for each feature of the model.
    assert most < 60e6
