import random

from jobtide.llm.langid import UNKNOWN, identify, learn
from tests.llm.helpers import SF

SYLLABLES = {"x": "ba bo bi".split(), "y": "sch ung lich".split(), "z": "ción que ño".split()}


def text(rnd, lang, n=40):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_tells_languages_apart_and_rejects_narrow_margins(spark):
    rnd = random.Random(9)
    rows = [(text(rnd, lang), lang) for lang in SYLLABLES for _ in range(80)] + [(None, "x"), ("1234", "y"), ("what", None)]
    known = learn(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(known) == sorted(SYLLABLES)
    asked = [(i, text(rnd, "xyz"[i % 3], 1 + i % 30), "old") for i in range(90)]
    got = identify(spark.createDataFrame(asked, "doc_id long, text string, lang_pred string"), known).collect()
    assert sum(r["lang_pred"] == "xyz"[r["doc_id"] % 3] for r in got) >= 86
    assert all(0 <= r["score"] <= 1 for r in got)
    strict = identify(spark.createDataFrame(asked, "doc_id long, text string, lang_pred string"), known, min_margin=0.99)
    assert not strict.where("accepted").count()


def test_edge_rows(spark):
    known = {"x": b" ba bo bi " * 50, "y": b" sch ung lich " * 50}
    rows = [(1, None), (2, ""), (3, "12 %"), (4, "ba bo " * 100_000), (5, "sch"), (5, "sch"), (None, "ba")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = identify(df, known).collect()
    assert [(r["lang_pred"], r["score"], r["accepted"]) for r in got[:3]] == [(UNKNOWN, 0.0, False)] * 3
    assert got[3]["lang_pred"] == "x" and got[4] == got[5] and got[4]["lang_pred"] == "y"
    assert identify(df.limit(0), known).count() == 0
    assert {r["lang_pred"] for r in identify(df, {}).collect()} == {UNKNOWN}
    assert identify(df, {"x": b" ba "}).where("doc_id = 4").first()["score"] == 1.0
    assert learn(spark.createDataFrame([], "text string, lang string")) == {}


def test_equal_texts_count_once(spark):
    rows = [("ba bo", "x")] * 500 + [("bi", "x"), ("sch", "y")]
    assert learn(spark.createDataFrame(rows, "text string, lang string"), sample=1_000)["x"] in (b" ba bo bi ", b" bi ba bo ")


def test_held_out_accuracy(spark):
    from jobtide.llm.queries import QUERIES

    folder = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op4_language"](spark, folder).where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95


def test_repeated_passages_count_by_their_length(spark):
    """Four fifths of each text are one repeated passage, the rest is another language."""
    rnd = random.Random(5)
    rows = [(text(rnd, lang), lang) for lang in SYLLABLES for _ in range(80)]
    known = learn(spark.createDataFrame(rows, "text string, lang string"))
    asked = []
    for i in range(40):
        passage, other = text(rnd, "y", 20), text(rnd, "z", 600)
        asked.append((i, passage * (4 * len(other) // len(passage) + 1) + " " + other))
    got = identify(spark.createDataFrame(asked, "doc_id long, text string"), known).collect()
    assert [r["lang_pred"] for r in got] == ["y"] * 40


def test_default_margin_rejects_mixed_and_random_texts(spark):
    rnd = random.Random(6)
    folder = SF.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    known = learn(docs.where("doc_id % 3 <> 0"))
    rest = [r for r in docs.where("doc_id % 15 = 0").collect() if len(r["text"]) > 400]
    by = {k: [r["text"] for r in rest if r["lang"] == k] for k in ("de", "fr")}
    letters = "abcdefghijklmnopqrstuvwxyz"
    asked = [("clean", r["text"]) for r in rest]
    for i in range(100):
        parts = []
        for _ in range(4):
            for k in by:
                t = rnd.choice(by[k])
                at = rnd.randrange(len(t) - 200)
                parts.append(t[at : at + 200])
        asked.append(("mixed", " ".join(parts)))
        asked.append(("random", " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(100))))
    got = identify(spark.createDataFrame(asked, "kind string, text string"), known).collect()
    share = {k: sum(r["accepted"] for r in got if r["kind"] == k) / sum(r["kind"] == k for r in got) for k in ("clean", "mixed", "random")}
    assert share["clean"] >= 0.99 and share["mixed"] <= 0.2 and share["random"] == 0, share


def test_copies_do_not_shrink_the_sample(spark):
    rnd = random.Random(7)
    rows = [(text(rnd, "x", 5), "x")] * 3_000 + [(text(rnd, "x", 5), "x") for _ in range(29)] + [(text(rnd, "y", 5), "y")]
    known = learn(spark.createDataFrame(rows, "text string, lang string"), sample=30)
    assert all(t.encode() in known["x"] for t, lang in rows if lang == "x") and rows[-1][0].encode() in known["y"]
    few = learn(spark.createDataFrame(rows, "text string, lang string"), sample=7)
    assert sum(t.encode() in few["x"] for t in {t for t, lang in rows if lang == "x"}) == 7


def test_long_texts_are_cut_at_hashed_places(spark):
    rows = [("ba " * 20_000 + f"bi{'o' * i} " * 20_000, "x") for i in range(1, 30)]
    known = learn(spark.createDataFrame(rows, "text string, lang string"))
    assert b" ba " in known["x"] and b" bio" in known["x"]


def test_predictions_equal_plain_compression(spark):
    """Language and margin of whole texts, by compressing each block on its own with a compressor made for it."""
    import zstandard

    from jobtide.llm import langid
    from tests.llm.helpers import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    known = langid.learn(docs)
    assert set(known) == {"de", "en", "es", "fr"} and all(len(v) <= langid.DICTIONARY for v in known.values())

    def size(lang, data):
        content = zstandard.ZstdCompressionDict(known[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(packer.compress(known[lang][-langid.LEAD:] + data))

    def plain(text):
        words = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
        if not words:
            return "und", 0.0
        data, totals = f" {words} ".encode(), dict.fromkeys(sorted(known), 0.0)
        for i in range(0, len(data), langid.BLOCK):
            block = data[i:i + langid.BLOCK]
            sizes = {lang: size(lang, block) for lang in totals}
            for lang, n in sizes.items():
                totals[lang] += len(block) * n / sum(sizes.values())
        first, second = sorted((n, lang) for lang, n in totals.items())[:2]
        return first[1], 1 - first[0] / second[0]

    rows = [(i, r["text"]) for i, r in enumerate(docs.where("length(text) < 1500").orderBy("doc_id").limit(40).collect())]
    rows += [(100, None), (101, ""), (102, "12 !?"), (103, "ab"), (104, "the house and die Katze")]
    found = langid.identify(spark.createDataFrame(rows, "i int, text string"), known).collect()
    for r, (_, text) in zip(sorted(found, key=lambda r: r["i"]), rows):
        lang, margin = plain(text)
        assert r["lang_pred"] == lang and abs(r["score"] - margin) < 1e-9 and r["accepted"] == (lang != "und" and margin >= langid.MARGIN)
