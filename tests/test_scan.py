"""Regular expressions on the body of a text find what they find in the whole text."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from jobtide.functions import cleaning as C
from jobtide.functions import patterns as P
from jobtide.functions import scan
from jobtide.functions.blocks import _any_category, _first_category, block_category
from jobtide.functions.text import decode_entities, settle
from jobtide.operators import markup

PLAIN = ["We build", "tools", "for people", "l'eau", "et déjà", "Ärger", "a", "The end", "naïve", "B", "of the", "Python", "I", "man", "deal"]
ENDS = [". ", ".\n", "! ", "? ", "\n", " ", "  ", ", ", "; ", ": ", ".", "...\n", "\n\n", " \n ", "\t", "!?", ".\t", "\r\n", ".\r"]
MARKED = [
    "<b>", "</b>", "< a", "a > b", "&amp;", "&lt;i&gt;", "[x](y)", "[", "](", ")", "**", "*", "***", "__", "_", "`", "`c`", "jo.b@x.example.org", "@", "@y",
    "http", "https://a.b/c", "http :", "//", "/", "www.", "WWW. x", "www.a.b", ".io", "node.js.org", "v1.2", "1", "12", "+49", "(743) 555-3824", "12345",
    "6789 0", "-", "--", "-----", "- x", "#", "###", "~~~", "—", "⸻", "m/f/d", "(m/w/d)", "HD", "m f", "f", "M", "w|m", "( )", "[ ]", "{}", "(",
    "'", "'q'", "\"", "\\\"", "don't", "\U0001F600", "☀️", "‍", "Join us", "join  us today", "jo<b>in us", "jo__in__ us", "Why join us?", "Apply now",
    "apply\nhere", "contact us at", "Contact", "we apply", "joınus", "join uſ", "ſ", "K", " ", "　", "日本", "…", "é'", "'é", "º", "%", "a.@b.cd",
    "x.-y@z.de", "\\", "|", "H F", "d h", "xx", "mfd", "mfdx", "m1", "é m é", "HD×", "×HD", "m÷f", "hÿ", "Àm", "&nbsp;", "&#39;", "&lt;", "&gt;",
]


def random_texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        share = rnd.choice([0, 0.02, 0.1, 0.3, 0.6])
        for _ in range(rnd.choice([0, 1, 2, 5, 12, 30])):
            parts.append(rnd.choice(MARKED) if rnd.random() < share else rnd.choice(PLAIN))
            parts.append(rnd.choice(ENDS) if rnd.random() < 0.6 else rnd.choice([" ", "", " "]))
        out.append("".join(parts))
    return [None, "", " ", ".", "m", "."] + out


def test_cleaning_the_body_equals_cleaning_the_whole(spark):
    texts = random_texts(30_000, 1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8).cache()
    try:
        whole = settle(C.chain(df.withColumn("c", decode_entities(F.col("t"))), "c", C.STEPS), "c")
        both = whole.withColumnRenamed("c", "want").join(C.clean_text(df, "t", "got").select("i", "got"), "i")
        wrong = both.where("NOT want <=> got").limit(5).collect()
        assert not wrong, [(r["t"], r["want"], r["got"]) for r in wrong]
    finally:
        df.unpersist()


def test_flags_of_the_body_equal_flags_of_the_whole(spark):
    df = spark.createDataFrame([(t,) for t in random_texts(30_000, 2)], "t string").repartition(8)
    text = F.coalesce(F.col("t"), F.lit(""))
    whole = F.struct(*[text.rlike(p).alias(markup.FIELDS[label]) for label, p in P.MARKUP_LABELS.items()])
    found = df.select("t", whole.alias("want"), markup.markup_flags(F.col("t")).alias("got"), markup.has_markup(F.col("t")).alias("some"))
    wrong = found.where((F.col("want") != F.col("got")) | (F.col("some") != markup.any_markup(F.col("want")))).limit(5).collect()
    assert not wrong, wrong


def test_one_pattern_stands_for_all_categories(spark):
    rnd = random.Random(3)
    bits = PLAIN + MARKED + [
        "About us", "who are we", "equal opportunity", "all qualified", "GDPR", "data protection", "cookies", "art. 13", "how to apply", "thank you",
        "your contact", "phone", "cv", "our mission", "founded in 1999", "with over 200", "employees", "we are a leading", "join our team", "2016 / 679",
    ]
    texts = [" ".join(rnd.choices(bits, k=rnd.randint(0, 25))) for _ in range(20_000)] + ["About us:", "who are we?", "x " * 70 + "great place to work"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    c = F.col("t")
    assert df.where(~block_category(c).eqNullSafe(_first_category(c))).isEmpty()
    assert df.where(c.rlike(_any_category())).count() > 1000 and not df.where(~c.rlike(_any_category())).isEmpty()


def test_plain_text_has_no_body(spark):
    texts = ["Plain prose, déjà vu. It's fine.\nReally! Yes? No", "", None, "One sentence. Another one <b>here</b> now. It ends. The rest stays. So it is."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["b"] for r in df.select(scan.body(F.col("t")).alias("b")).collect()]
    assert got == ["", "", None, ". Another one <b>here</b> now. It ends."]


def test_slices_and_offsets():
    texts = ["é. Ü <x> ö. Ende. ", None, "plain", "[" + "ä" * 50, ""] * 40
    whole = scan.located(pa.array(texts)).to_pylist()
    before, scan.SLICE = scan.SLICE, 64
    try:
        assert scan.located(pa.array(texts)).to_pylist() == whole
        assert scan.located(pa.array(["x", *texts, "y"]).slice(1, len(texts))).to_pylist() == whole
        assert scan.located(pa.array(texts, pa.large_string())).to_pylist() == whole
        assert scan.located(pa.array([], pa.string())).to_pylist() == []
    finally:
        scan.SLICE = before
