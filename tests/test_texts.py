"""Literal edge rows for predicates, cleaning steps, blocks and derived fields."""

import re

import pytest
from pyspark.sql import functions as F

from jobtide.functions import cleaning as C
from jobtide.functions import patterns as P
from jobtide.functions.blocks import block_category, split_blocks
from jobtide.functions.text import fold_accents, is_invalid, settle, strip
from jobtide.operators import blocks, derive, markup, records, terms


@pytest.mark.parametrize("text, expected", [
    (None, True), ("N/A", True), (" none ", True), ("\t", True), ("NULL", True), (" ", True),
    ("NONE", False), ("Null", False), ("nan", False), ("x", False),
])
def test_invalid_text(one, text, expected):
    assert one(is_invalid, text) is expected


def test_strip_takes_every_white_space(one):
    assert one(strip, "  \x1c a b \x1f　\n") == "a b"


def test_disallowed_location_keeps_null(spark):
    df = spark.createDataFrame([("Mexico",), (None,), ("mexico",)], "Location string")
    kept = {r[0] for r in records.drop_locations(df).collect()}
    assert kept == {None, "mexico"}


@pytest.mark.parametrize("text, expected", [(None, True), ("CLOSED", True), ("LISTED", False)])
def test_status_differs(one, text, expected):
    assert one(lambda c: records.not_equal_or_null(c, "LISTED"), text) is expected


@pytest.mark.parametrize("step, text, expected", [
    (C.drop_urls, "see http - //x.y/z now", "see   now"),
    (C.drop_phones, "+1 (743) 555-3824", " "),
    (C.drop_phones, "193.195.198.107", " "),
    (C.drop_phones, "123456789", " "),
    (C.drop_phones, "12345678", "12345678"),
    (C.drop_phones, "x123456789", "x123456789"),
    (C.drop_phones, "é123456789", "é123456789"),
    (C.drop_partial_urls, "node.js.org", "node "),
    (C.drop_partial_urls, "v1.2.3", "v1 "),
    (C.drop_partial_urls, "1.2", "1.2"),
    (C.drop_gender_markers, "Engineer (m/f/d)", "Engineer  "),
    (C.drop_gender_markers, "HD video", "  video"),
    (C.drop_gender_markers, "woman", "woman"),
    (C.drop_quotes, "don't 'q' \"x\"", "don't q x"),
    (C.drop_redacted, "a**** ****", "a*   "),
    (C.drop_emoji, "a\U0001F600✨b", "a b"),
    (C.drop_call_to_action, "Great role. Join us today! Use SQL.", "Great role. Use SQL."),
    (C.drop_call_to_action, "Join us. Apply now. Use SQL.", " Apply now. Use SQL."),
    (C.drop_call_to_action, "We reply. Nothing here.", "We reply. Nothing here."),
    (C.newline_to_period, "a\nb", "a. b"),
    (C.newline_to_period, "a.\nb", "a.\nb"),
    (C.empty_separator_lines, "a\n-----\nb", "a\n\nb"),
    (C.empty_separator_lines, "a\n — \nb", "a\n\nb"),
])
def test_step(one, step, text, expected):
    assert one(step, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("see http - //x.y/z now", "see now"),
    ("[a](u) **b** __c__ `d`", "a b c d"),
    ("node.js.org", "node"), ("v1.2.3", "v1"), ("1.2", "1.2"),
    ("Engineer (m/f/d)", "Engineer"), ("HD video", "video"),
    ("don't 'q' \"x\"", "don't q x"),
    ("a\n-----\nb", "a. b"),
    ("Great role. Join us today! Use SQL.", "Great role. Use SQL."),
    ("Join us. Apply now. Use SQL.", "Apply now. Use SQL."),
    ("a &lt;b&gt; c &amp;amp; d", "a c &amp; d"),
    (None, None),
])
def test_clean_text(spark, text, expected):
    df = C.clean_text(spark.createDataFrame([(text,)], "t string"), "t", "c")
    assert df.first()["c"] == expected


def test_clean_text_reads_long_texts(spark):
    text = "word " * 200_000 + "Join us now. jo@x.example.org end"
    cleaned = C.clean_text(spark.createDataFrame([(text,)], "t string"), "t").first()[0]
    assert cleaned.endswith("end") and "@" not in cleaned


def test_guards_change_nothing(spark):
    """A guarded step equals its bare pattern."""
    texts = ["a  b\t c", " \n x \n\n y", "a](b", "[a](b)", "__a__ `b` **c** ***", "( ) [] {x}", "'a' \"b\"", "<i>", "a@b.cd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = [
        (C.collapse_blanks, P.BLANKS, " "), (C.tighten_newlines, P.NEWLINE_SPACING, "\n"),
        (C.collapse_newlines, P.NEWLINES, "\n"), (C.newline_to_period, P.OPEN_NEWLINE, ". "),
        (C.unlink_markdown, P.MARKDOWN_LINK, "$1"), (C.drop_tags, P.HTML_TAG, " "), (C.unwrap_bold, P.MARKDOWN_BOLD, "$1"),
        (C.unwrap_underscore, P.MARKDOWN_UNDERSCORE, "$1"), (C.unwrap_code, P.INLINE_CODE, "$1"), (C.drop_emails, P.EMAIL, " "),
        (C.drop_asterisks, P.ASTERISKS, " "), (C.drop_redacted, P.REDACTED, " "),
        (C.drop_empty_wrappers, P.EMPTY_WRAPPER, " "), (C.drop_quotes, P.QUOTE, ""),
    ]
    t = F.col("t")
    for step, pattern, to in pairs:
        bad = df.where(~step(t).eqNullSafe(F.regexp_replace(t, pattern, to)))
        assert bad.count() == 0, pattern


def test_lookaheads_change_nothing(spark):
    """Patterns match the same with and without the lookahead for a first character."""
    texts = [
        "Why join us? x. So join us! apply today.", "equal opportunity", "Diversity and inclusion", "regardless of age",
        "both sexes", "non discrimination", "protected veteran", "all qualified applicants", "GDPR", "art. 13", "cookies",
        "data protection", "processing of personal data", "our selection process", "thank you!", "click the apply",
        "if you are interested", "what are you waiting for? join us", "reach out to cv", "your contact phone",
        "recruiting partner cv", "make an impact", "join our team", "we are a leading firm", "with over 500 people",
        "Founded in 1999", "great place to work", "desired profile: x", "qualifications: y", "www.a.b", "HTTP://a.b", ".a.b",
        "+1234567890", "(m/w/d)", " f h ", "****", "'a'", "\\\"b\\\"", "{ }", "\U0001F680",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [*P.MARKUP_LABELS.values(), *P.BLOCK_CATEGORIES.values(), P.EMOJI, P.EMPTY_WRAPPER, P.CALL_TO_ACTION, P.SECTION_HEADING]
    for pattern in patterns:
        bare = re.sub(r"\(\?=(\\\*|\[(?:\\.|[^\]\\])*\])\)", "", pattern, count=1)
        t = F.col("t")
        bad = df.where(F.regexp_replace(t, pattern, "#") != F.regexp_replace(t, bare, "#"))
        assert bad.count() == 0, pattern


@pytest.mark.parametrize("text, expected", [
    ("Responsibilities: build\n- test • deploy", ["Responsibilities: build", "test", "deploy"]),
    ("We do X. Benefits: lunch", ["We do X.", "Benefits: lunch"]),
    ("a\r\nb\rc", ["a", "b", "c"]), ("", []), (" \n ", []), ("-", ["-"]),
])
def test_split_blocks(one, text, expected):
    assert one(split_blocks, text) == expected


@pytest.mark.parametrize("block, expected", [
    ("About us:", "Company intro heading"),
    ("We are an equal opportunity employer", "Equal opportunity / anti-discrimination"),
    ("Our privacy policy applies", "GDPR/privacy/legal disclaimer"),
    ("Please contact us by phone +49 1234567", "Recruiter contact block"),
    ("How to apply", "Application process boilerplate"),
    ("We value our mission", None),
    ("We value our mission " + "x" * 120, "Company marketing paragraph"),
])
def test_block_category(one, block, expected):
    assert one(block_category, block) == expected


def test_block_counts_add_up(spark):
    texts = [("a\nAbout us:\nb",), ("Our privacy policy applies",), (None,), (" ",)]
    df = spark.createDataFrame(texts, "t string")
    stats = {r["stat"]: r["value"] for r in blocks.block_stats(df, "t").collect()}
    assert stats["records_with_removed_blocks"] == 2 and stats["blocks_removed"] == 2
    assert sum(v for k, v in stats.items() if k in P.BLOCK_CATEGORIES) == 2
    assert [r[0] for r in blocks.filter_blocks(df, "t").collect()] == ["a\nb", "", None, " "]


def test_markup_types_in_report_order(spark):
    df = spark.createDataFrame([("<b> a@b.cd \"q\"",), ("plain",), (None,)], "t string")
    rows = markup.flagged_records(df, "t").collect()
    assert [r["markup_types"] for r in rows] == [["HTML tags", "Email addresses", "Quote characters"]]


def test_settled_column_stops_filters(spark):
    df = spark.range(5).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), "id")
    plan = settle(df, "v").where("v = 'v1'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
    assert [tuple(r) for r in settle(df, "v").where("v = 'v1'").collect()] == [("v1", 1)]


def test_location_override_and_country(spark):
    rows = [
        ("Greater Munich Metropolitan Area",), ("Milan, Lombardy, Italy",), ("Germany",), ("Berlin,",), ("DACH (Remote)",), (None,),
    ]
    df = spark.createDataFrame(rows, "Location string")
    areas = spark.createDataFrame([("Greater Munich Metropolitan Area", "Germany")], "location string, country string")
    out = derive.add_country(df, areas)
    assert [tuple(r) for r in out.collect()] == [
        ("Germany", "Germany"), ("Milan, Lombardy, Italy", "Italy"), ("Germany", "Germany"), ("Berlin,", ""),
        ("DACH (Remote)", None), (None, None),
    ]
    kept = derive.add_country(df, areas, keep_location=True)
    assert tuple(kept.first()) == ("Greater Munich Metropolitan Area", "Germany")


def test_exact_location_table(spark):
    table = spark.createDataFrame([("Florence, Italy Metropolitan Area", "Italy")], "location string, country string")
    df = spark.createDataFrame([("Florence, Italy Metropolitan Area",)], "Location string")
    assert derive.add_country(df, table).first()["Country"] == "Italy"


@pytest.mark.parametrize("text, expected", [
    ("Acme · Paris (Hybrid)", "hybrid"), ("A · P (Remote) (On-site)", "on-site"), ("A (Hybrid or Remote)", "remote"),
    ("A (Full-time)", None), ("A (onsite) ", "on-site"), (None, None),
])
def test_work_modality(spark, text, expected):
    df = spark.createDataFrame([(text,)], "`Primary Description` string")
    assert derive.add_work_modality(df).first()["Work Modality"] == expected


@pytest.mark.parametrize("text, expected", [("Acme · Paris", "Acme"), ("Acme", None), (" · Paris", None), (None, None)])
def test_company(one, text, expected):
    assert one(derive.company_of, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("Skills: Python, SQL, +5 more", "Python, SQL"),
    ("3 of 10 skills match your profile - you may be a good fit", None), ("Skills: ", None), (None, None),
])
def test_skill_field(one, text, expected):
    assert one(derive.clean_skill_field, text) == expected


def test_fold_accents(one):
    assert one(fold_accents, "Café Malmø ﬁ") == "Cafe Malmø fi"


def test_plain_text(one):
    assert one(terms.plain_text, "Héllo, World 2") == "h llo world 2"
    assert one(terms.plain_skills, "a, B/c ,,") == "a b c"


def test_critical_split_is_a_partition(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "N/A", ""), (3, None, "y")], "id int, Title string, Skill string")
    kept, lost = records.split_by_critical(df)
    assert {r["id"] for r in kept.collect()} == {1, 3} and {r["id"] for r in lost.collect()} == {2}
    none, _ = records.split_by_critical(df.select("id"))
    assert none.count() == 3


def test_pick_field(spark):
    df = spark.createDataFrame([("", "b"), (None, None), ("a", "c")], "Title string, title2 string")
    assert [r[0] for r in df.select(records.pick_field(df, ["None", "Title", "title2"])).collect()] == ["b", None, "a"]


def test_terms(spark):
    texts = [("t", "skill skills 12 the class"), ("t", "skills cats"), ("d", "")]
    rows = terms.top_terms(spark.createDataFrame(texts, "field string, text string"), 2).collect()
    assert [(r["term"], r["occurrences"], r["weight"]) for r in sorted(rows, key=lambda r: r["rank"])] == [
        ("skill", 3, 1.0), ("cats", 1, 1 / 3),
    ]


def test_list_skills(spark):
    df = spark.createDataFrame([(["Big Data", "", "C++"], "x")], "Skill array<string>, Title string")
    rows = {r["field"]: r["text"] for r in terms.field_texts(df).collect()}
    assert rows == {"skill": "big data c", "title": "x"}


def test_only_shown_examples_are_cleaned(spark):
    """The limit stands below the cleaning, so the first records are taken as a top list."""
    from jobtide.operators import markup

    df = spark.range(0, 90, 1, 6).selectExpr("id", "concat('see **', id, '** &amp; <b>x</b>') AS text")
    examples = markup.cleaning_examples(df, "text", "id", 4)
    assert [(r["id"], r["after"]) for r in examples.orderBy("id").collect()] == [(i, f"see {i} & x") for i in range(4)]
    lines = examples._jdf.queryExecution().executedPlan().toString().splitlines()
    top = next(i for i, line in enumerate(lines) if "TakeOrderedAndProject" in line)
    assert any("_unescape" in line for line in lines[:top]) and not any("_unescape" in line for line in lines[top:])
