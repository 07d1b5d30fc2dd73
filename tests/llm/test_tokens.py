import random

import pytest
from public_tokenizers import path

from jobtide.llm.tokens import Encoder, count_tokens, splice
from tests.llm.helpers import SF

FILE = path("byte_bpe_50k.json")
LATIN = "ab'stremvld  \n\t\x0b\x85\xa0\x1c019\u00b2\u00bc.,!?\u00e9\u00d7\u00f7\u00df\u00c0\u00aa\u00b5'\"<|>"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(FILE)


def size(encoder, text):
    return len(encoder.tokenizer.encode(text, add_special_tokens=False).ids)


def test_plain_texts_equal_the_library(encoder):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(LATIN) for _ in range(rnd.randint(0, 14))) for _ in range(6_000)]
    assert encoder.totals(texts).tolist() == [size(encoder, t) for t in texts]


def test_spliced_chunks_equal_the_library(encoder):
    rnd, widened = random.Random(2), 0
    parts = [*LATIN, "\u65e5\u672c", " \u044e", "<|endoftext|>", "   ", "a" * 30, "\n" * 20]
    for i in range(1_500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 200)))
        if i % 2:
            text = text.encode("latin-1", "ignore").decode("latin-1")
        got, more = splice(encoder, text, rnd.choice([5, 20, 60]), rnd.choice([1, 4, 16]))
        assert got == size(encoder, text), repr(text)
        widened += more
    assert widened


def test_one_word_longer_than_every_overlap(encoder):
    text = "x" * 5_000 + " end"
    assert splice(encoder, text, 100, 10)[0] == size(encoder, text)


def test_edge_rows(spark, encoder):
    long = "many words here, " * 9_000
    rows = [(1, None, 7), (2, "", 7), (3, "h\u00e9 \u65e5<|endoftext|>", None), (3, "h\u00e9 \u65e5<|endoftext|>", None), (None, long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = count_tokens(df, FILE).collect()
    assert got[0].asDict() == {"doc_id": 1, "text": None, "n_bytes": 0, "n_tokens": 0, "over_limit": False}
    assert got[1]["n_tokens"] == 0 and got[2] == got[3]
    assert got[2]["n_tokens"] == size(encoder, rows[2][1]) and got[2]["n_bytes"] == len(rows[2][1].encode())
    assert got[4]["n_tokens"] == size(encoder, long) and got[4]["over_limit"]
    assert count_tokens(df.limit(0), FILE).count() == 0


def test_query_equals_the_library(spark, encoder):
    from jobtide.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op2_token_counts"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {
        k: (len(t.encode()), size(encoder, t), size(encoder, t) > 1024) for k, t in texts.items()
    }


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        Encoder(path("word_bpe_49k.json"))
