import random
import re

import pytest

from jobtide.llm import rlz
from tests.llm.helpers import SF


def brute(rows, window):
    """(words, removed, kept) of each (key, text), by the first key of every window."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (key, _), w in zip(rows, split):
        for i in range(len(w) - window + 1 if key is not None else 0):
            seq = tuple(w[i:i + window])
            least[seq] = min(least.get(seq, key), key)
    out = []
    for (key, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1 if key is not None else 0):
            if least[tuple(w[i:i + window])] < key:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(rnd, n):
    """Copies, shifted and edited passages, repeats within a text, and a passage that many share."""
    texts, shared = [], [f"s{i}" for i in range(40)]
    for _ in range(n):
        w = []
        for _ in range(rnd.randint(0, 4)):
            kind = rnd.random()
            if kind < 0.3 and texts:
                other = rnd.choice(texts).split()
                a = rnd.randint(0, max(0, len(other) - 1))
                w += other[a:a + rnd.randint(1, 60)]
            elif kind < 0.5:
                w += shared[rnd.randint(0, 5):rnd.randint(10, 40)]
            elif kind < 0.6 and w:
                w += w[-30:]
            else:
                w += [f"w{rnd.randint(0, 3 if rnd.random() < 0.3 else 5000)}" for _ in range(rnd.randint(0, 40))]
        if w and rnd.random() < 0.3:
            w[rnd.randrange(len(w))] = "édité"
        texts.append(rnd.choice([" ", "\n", " \t "]).join(w))
    return texts


@pytest.mark.parametrize("window,anchor,hot,block,slice_bytes", [
    (13, 7, 1 << 16, 1 << 16, 2 << 20), (13, 7, 3, 16, 300), (5, 2, 8, 7, 1), (4, 4, 1 << 16, 16, 2000), (3, 1, 20, 64, 2 << 20),
])
def test_spans_equal_brute_force(spark, monkeypatch, window, anchor, hot, block, slice_bytes):
    monkeypatch.setattr(rlz, "BLOCK", block)
    cut = rlz.slices
    monkeypatch.setattr(rlz, "slices", lambda batch, name: cut(batch, name, slice_bytes))
    rnd = random.Random(window * 100 + hot)
    texts = corpus(rnd, 150)
    rows = [(rnd.choice([i, i, i, 5, None]), t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, " \n"), (203, texts[7]), (203, texts[7])]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, doc_id long, text string").repartition(5)
    got = {r["place"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rlz.without_repeats(df, window=window, anchor=anchor, hot=hot).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, window)


def test_windows_across_a_factor_boundary(spark):
    """The factor from the first source ends inside a window that only the second source has."""
    w = [f"w{i}" for i in range(40)]
    texts = [" ".join(w[:22] + ["x"] * 3), " ".join(["y"] * 2 + w[12:40]), " ".join(w)]
    got = rlz.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == [0, 0, 40]
    assert [tuple(r)[2:] for r in got] == brute(list(enumerate(texts)), 13)


def test_columns_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, "a", 7, "b", 0.5, "c"), (2, text + " end", "a", 8, "b", 0.5, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, doc int, spans string, row double, `n_words` string")
    got = rlz.without_repeats(df).orderBy("doc_id").collect()
    assert [(r["h"], r["doc"], r["spans"], r["row"], r["n_words"], r["n_removed"], r["kept"]) for r in got] == [
        ("a", 7, "b", 0.5, 20, 0, text), ("a", 8, "b", 0.5, 21, 20, "end"),
    ]
    assert rlz.without_repeats(df.limit(0)).count() == 0
    assert rlz.without_repeats(df, keep=[]).columns == ["n_words", "n_removed", "kept"]


def test_a_very_long_text(spark):
    rnd = random.Random(3)
    long = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(200_000))
    rows = [(1, "a " + long + " b"), (2, long), (3, long[1000:2_000] + " z")]
    got = rlz.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == brute(rows, 13)


def test_query_equals_brute_force(spark):
    import hashlib

    from jobtide.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op11_substring_dedup"](spark, SF).collect()}
    want = brute(docs, 13)
    assert got == {k: (n, m, hashlib.sha256(kept.encode()).hexdigest()) for (k, _), (n, m, kept) in zip(docs, want)}
