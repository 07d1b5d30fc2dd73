import hashlib
import itertools
import random
import struct
import tracemalloc

import pyarrow as pa
import pytest
from public_tokenizers import path

from jobtide.llm import lexicon
from jobtide.llm.lexicon import Lexicon, WordBpe, build_lexicon, compile_lexicon, encode
from tests.llm.helpers import SF

FILE = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(FILE)


def expected(bpe, text):
    ids = bpe.tokenizer.encode(text or "", add_special_tokens=False).ids
    shown = bpe.tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


def test_automaton_finds_its_words_only_and_shares_suffixes():
    rnd = random.Random(3)
    words = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 6))): [rnd.randint(0, 9)] * rnd.randint(0, 3) for _ in range(300)}
    lexicon = Lexicon(compile_lexicon(words))
    asked = [*words, b"", *(bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(1, 8))) for _ in range(300))]
    for word, number in zip(asked, lexicon.numbers(asked).tolist()):
        assert (lexicon.of(number) if number >= 0 else None) == words.get(word)
    ended = Lexicon(compile_lexicon({w + b"ing": [1] for w in (b"go", b"see", b"read")}))
    # A tree without shared endings would have 19 states.
    assert len(ended.final) == 11
    assert Lexicon(compile_lexicon({})).numbers([b"a", b""]).tolist() == [-1, -1]


def test_merges_equal_the_library(bpe):
    rnd = random.Random(4)
    for _ in range(2_000):
        word = "".join(rnd.choice(["th", "er", "a", "z", "\u00f6", "ing", "q", "\u65e5"]) for _ in range(rnd.randint(1, 9)))
        want = [bpe.tokenizer.encode(word, add_special_tokens=False).ids]
        got = [i for piece in bpe.pieces(word) for i in bpe.merge(piece)]
        assert got == want[0], word


def test_both_ways_of_merging_agree(bpe):
    rnd = random.Random(6)
    for _ in range(500):
        word = [bpe.letters[rnd.choice(b"aabeehilnorst")] for _ in range(rnd.randint(1, 80))]
        word[-1] += bpe.suffix
        assert bpe._joined(list(word)) == bpe._joined_by_heap(list(word))


def test_tasks_hold_little_beside_the_lexicon(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "build_lexicon", lambda *given: compile_lexicon({}))
    monkeypatch.setattr(lexicon, "map_texts", lambda df, text, outputs, make, keep: make)
    work = lexicon.encode(spark.createDataFrame([("a",)], "text string"), FILE)()
    words = ["".join(w) for w in itertools.product("abcdefghijklmnopqrst", "aeiouy", "bcdfghjklmnpqrst", "bcdfghjklmnpqrstvwxz")]
    texts = [pa.array([" ".join(words[i : i + 2_000])]) for i in range(0, len(words), 2_000)]
    work(texts[0])
    tracemalloc.start()
    try:
        for text in texts:
            work(text)
        # 38,400 words; of those that the lexicon lacks, the last ones are remembered.
        many, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert many < 6 << 20
    tracemalloc.start()
    try:
        splitter = lexicon.WordSplitter(FILE)
        small, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert small < 1 << 20 and splitter.plain("a") == b"a"


def test_edge_rows_equal_the_library(spark, bpe):
    texts = [
        None, "", "Hello w\u00f6rld's 42 <|endoftext|> x", "\u03a3\u03a3 \u0130 e\u0301 \u65e5\u672c", "''s 's 'll \x85\xa0 \u00b2\u00bd", "x" * 3_000,
        "the " * 30_000, "the the", "the the", " \n\t",
    ]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids_sha256 string")
    for size in (65_536, 1):
        got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encode(df, FILE, size=size).collect()}
        assert got == {i: expected(bpe, t) for i, t in enumerate(texts)}
    assert encode(df.limit(0), FILE).count() == 0
    row = encode(df.where("doc_id = 2"), FILE, full=True).first()
    assert list(struct.unpack(f"<{row['n_tokens']}I", row["ids"])) == bpe.tokenizer.encode(texts[2], add_special_tokens=False).ids


def test_lexicon_size_is_a_bound(spark):
    df = spark.createDataFrame([("b b b a a c d",)], "text string")
    known = lambda size: [w for w, n in zip("abcd", Lexicon(build_lexicon(df, FILE, size=size)).numbers([b"a", b"b", b"c", b"d"])) if n >= 0]
    # c and d are as frequent as each other: both or none.
    assert known(1) == ["b"] and known(3) == ["a", "b"] and known(4) == ["a", "b", "c", "d"]


def test_query_equals_the_library(spark, bpe):
    from jobtide.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op5_word_bpe"](spark, SF).collect()}
    assert got == {k: expected(bpe, t) for k, t in texts.items()}


def test_states_of_the_automaton_are_small():
    rnd = random.Random(4)
    entries = {"".join(rnd.choices("abcdefgh", k=rnd.randint(4, 12))).encode(): [1] for _ in range(10_000)}
    tracemalloc.start()
    compiled = compile_lexicon(entries)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    words = sorted(entries)
    assert Lexicon(compiled).numbers([*words, b"abc"]).tolist() == [*range(len(words)), -1]
    assert most < 7.5e6
