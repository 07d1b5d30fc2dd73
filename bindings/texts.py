"""Predicates, cleaning steps, markup reports and blocks on document and page texts."""

from pyspark.sql import functions as F

from bindings import sqltext as S
from bindings.base import (
    NOISY_CTE, POSTINGS_CTE, add, lit, noisy_texts, query, raw_postings, texts,
)
from jobtide.functions import cleaning as C
from jobtide.functions.text import decode_entities, is_invalid, strip
from jobtide.lookups import CRITICAL_FIELDS
from jobtide.operators import blocks as blk
from jobtide.operators import markup, records

# --- B: columns, rows and predicates on derived postings --------------------
INVALID = "('', 'N/A', 'n/a', 'None', 'none', 'null', 'NULL')"


def invalid_sql(c: str) -> str:
    return f"({S.strip(f'coalesce({c}, {lit(str())})')} IN {INVALID})"


@query("b01_drop_fields", f"WITH {POSTINGS_CTE} SELECT id, \"Title\", \"Location\", \"Skill\" FROM p")
def _(spark, d):
    df, _ = records.drop_fields(raw_postings(spark, d))
    return df.drop("Description", "Primary Description", "Created At", "Scraped At")


@query("b02_place_after", f"WITH {POSTINGS_CTE} SELECT id, \"Location\", upper(\"Location\") AS place FROM p")
def _(spark, d):
    df = raw_postings(spark, d).select("id", "Location").withColumn("place", F.upper("Location"))
    return records.place_after(df, "place", "id")


@query(
    "b03_invalid_text",
    f"WITH {POSTINGS_CTE} SELECT id, {invalid_sql('\"Title\"')} AS title_invalid,"
    f" {invalid_sql('\"Description\"')} AS description_invalid, {invalid_sql('\"Skill\"')} AS skill_invalid FROM p",
)
def _(spark, d):
    return raw_postings(spark, d).select(
        "id", is_invalid(F.col("Title")).alias("title_invalid"),
        is_invalid(F.col("Description")).alias("description_invalid"),
        is_invalid(F.col("Skill")).alias("skill_invalid"),
    )


@query("b04_valid_texts", f"WITH {POSTINGS_CTE} SELECT id, \"Title\" FROM p WHERE NOT {invalid_sql('\"Title\"')}")
def _(spark, d):
    return records.keep_valid(raw_postings(spark, d), "Title").select("id", "Title")


@query(
    "b05_invalid_to_null",
    f"WITH {POSTINGS_CTE} SELECT id, CASE WHEN NOT {invalid_sql('\"Skill\"')} THEN \"Skill\" END AS \"Skill\","
    f" CASE WHEN NOT {invalid_sql('\"Description\"')} THEN \"Description\" END AS \"Description\" FROM p",
)
def _(spark, d):
    return records.invalid_to_null(raw_postings(spark, d), ["Skill", "Description"]).select("id", "Skill", "Description")


CRITICAL = CRITICAL_FIELDS


def _invalid_count_sql(name: str) -> str:
    return f"SELECT {lit(name)} AS \"column\", count(*) FILTER ({invalid_sql(chr(34) + name + chr(34))}) AS invalid FROM p"


@query(
    "b05_invalid_counts",
    f"WITH {POSTINGS_CTE} " + " UNION ALL ".join(_invalid_count_sql(n) for n in CRITICAL),
)
def _(spark, d):
    return records.invalid_counts(raw_postings(spark, d), CRITICAL)


ALL_INVALID_SQL = "(" + " AND ".join(invalid_sql(f'"{n}"') for n in CRITICAL) + ")"


@query(
    "b06_critical_split",
    f"WITH {POSTINGS_CTE} SELECT id, NOT {ALL_INVALID_SQL} AS kept FROM p",
)
def _(spark, d):
    kept, lost = records.split_by_critical(raw_postings(spark, d))
    return kept.select("id", F.lit(True).alias("kept")).unionByName(lost.select("id", F.lit(False).alias("kept")))


@query(
    "b07_disallowed_locations",
    f"WITH {POSTINGS_CTE} SELECT id, \"Location\" FROM p WHERE \"Location\" IS NULL OR \"Location\" NOT IN"
    " ('Middle East', 'Washington DC-Baltimore Area', 'Mexico')",
)
def _(spark, d):
    return records.drop_locations(raw_postings(spark, d)).select("id", "Location")


@query(
    "b08_blank_to_null",
    "SELECT page_id, CASE WHEN trim(replace(url, 'http', ' ')) <> '' THEN replace(url, 'http', ' ') END AS url,"
    " CASE WHEN contains(html, 'lang=\"en\"') THEN html END AS html FROM pages",
)
def _(spark, d):
    from jobtide.functions.text import blank_to_null

    return texts(spark, d, "pages").select(
        "page_id", blank_to_null(F.expr("replace(url, 'http', ' ')")).alias("url"),
        blank_to_null(F.expr("if(contains(html, 'lang=\"en\"'), html, ' \t ')")).alias("html"),
    )


@query(
    "b12_contains_text",
    "SELECT doc_id, source FROM documents WHERE source ILIKE '%C1_%'",
)
def _(spark, d):
    return texts(spark, d).where(records.contains_text(F.col("source"), "C1_")).select("doc_id", "source")


@query(
    "b12_contains_backslash",
    "SELECT doc_id, source FROM documents WHERE source ILIKE '%Src1_%'",
)
def _(spark, d):
    return texts(spark, d).where(records.contains_text(F.col("source"), "S\\rc1_")).select("doc_id", "source")


@query(
    "b15_pick_field",
    f"WITH {POSTINGS_CTE} SELECT id, coalesce(nullif(\"Skill\", 'NULL'), nullif(\"Job State\", '')) AS picked FROM"
    " (SELECT id, nullif(\"Skill\", 'NULL') AS \"Skill\", \"Job State\" FROM p)",
)
def _(spark, d):
    df = raw_postings(spark, d).select("id", F.expr("replace(Skill, 'NULL', '')").alias("Skill"), "Job State")
    return df.select("id", records.pick_field(df, ["Missing", "Skill", "Job State"]).alias("picked"))


@query(
    "b16_status_differs",
    f"WITH {POSTINGS_CTE} SELECT id, \"Job State\" AS state FROM p WHERE \"Job State\" IS DISTINCT FROM 'LISTED'",
)
def _(spark, d):
    df = raw_postings(spark, d)
    return df.where(records.not_equal_or_null(F.col("Job State"), "LISTED")).select("id", F.col("Job State").alias("state"))


# --- C: cleaning steps ------------------------------------------------------
@query(
    "c01_entities",
    f"SELECT page_id, {S.unescape('html')} AS text FROM pages",
)
def _(spark, d):
    return texts(spark, d, "pages").select("page_id", decode_entities(F.col("html")).alias("text"))


STEP_FUNCTIONS = dict(zip(S.STEPS, C.STEPS))
# Document texts hold neither tags nor URLs of their own; pages hold many.
PAGE_STEPS = ("c03_urls", "c04_html_tags", "c10_partial_urls")


def _step(name, step):
    def run(spark, d):
        if name in PAGE_STEPS:
            return texts(spark, d, "pages").select(
                "page_id", step(F.concat("html", F.lit(" "), "url")).alias("text")
            )
        return noisy_texts(spark, d).select("doc_id", step(F.col("text")).alias("text"))
    return run


for _name, _fn in STEP_FUNCTIONS.items():
    if _name in PAGE_STEPS:
        _sql = f"SELECT page_id, {S.STEPS[_name]('html || chr(32) || url')} AS text FROM pages"
    else:
        _sql = f"WITH {NOISY_CTE} SELECT doc_id, {S.STEPS[_name]('text')} AS text FROM t"
    add(_name, _step(_name, _fn), _sql)


@query(
    "c24_clean_text",
    f"WITH {NOISY_CTE}, {S.clean('t', 'text', 'doc_id')} SELECT doc_id, x AS text FROM c{S.LAST}",
)
def _(spark, d):
    return C.clean_text(noisy_texts(spark, d), "text")


@query(
    "c24_clean_pages",
    f"WITH {S.clean('pages', 'html', 'page_id')} SELECT page_id, x AS text FROM c{S.LAST}",
)
def _(spark, d):
    return C.clean_text(texts(spark, d, "pages").select("page_id", F.col("html").alias("text")), "text")


# --- D: markup reports ------------------------------------------------------
FLAGS_CTE = f"{NOISY_CTE}, f AS MATERIALIZED (SELECT doc_id, text, {S.flag_columns('text')} FROM t)"
DOC_FLAGS_CTE = f"f AS MATERIALIZED (SELECT doc_id, text, {S.flag_columns('text')} FROM documents)"
TYPES_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {f} THEN {lit(label)} END" for f, label in S.FLAG_LABELS.items()
) + "], lambda l: l IS NOT NULL)"


@query(
    "d01_markup_flags",
    f"WITH {FLAGS_CTE} SELECT doc_id, {', '.join(S.FLAGS)}, {S.ANY_FLAG} AS any_markup FROM f",
)
def _(spark, d):
    df = markup.with_markup(noisy_texts(spark, d), "text")
    return df.select("doc_id", "markup.*", markup.any_markup(F.col("markup")).alias("any_markup"))


@query("d02_records_with_markup", f"WITH {DOC_FLAGS_CTE} SELECT doc_id, text FROM f WHERE {S.ANY_FLAG}")
def _(spark, d):
    return markup.records_with_markup(texts(spark, d), "text").select("doc_id", "text")


@query(
    "d03_markup_types",
    f"WITH {DOC_FLAGS_CTE} SELECT doc_id, array_to_string({TYPES_SQL}, ', ') AS types FROM f WHERE {S.ANY_FLAG}",
)
def _(spark, d):
    df = markup.flagged_records(texts(spark, d), "text")
    return df.select("doc_id", F.array_join("markup_types", ", ").alias("types"))


@query(
    "d04_markup_counts",
    f"WITH {FLAGS_CTE} " + " UNION ALL ".join(
        f"SELECT {lit(label)} AS label, count(*) FILTER ({f}) AS records FROM f" for f, label in S.FLAG_LABELS.items()
    ),
)
def _(spark, d):
    return markup.markup_counts(noisy_texts(spark, d), "text")


@query(
    "d05_markup_share",
    f"WITH {DOC_FLAGS_CTE} SELECT count(*) AS records, count(*) FILTER {S.ANY_FLAG} AS with_markup,"
    f" count(*) FILTER {S.ANY_FLAG} * 100.0::DOUBLE / count(*) AS markup_pct FROM f",
)
def _(spark, d):
    return markup.markup_share(texts(spark, d), "text")


@query(
    "d05_markup_previews",
    f"WITH {DOC_FLAGS_CTE} SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END"
    f" AS preview, array_to_string({TYPES_SQL}, ', ') AS types FROM f WHERE {S.ANY_FLAG} ORDER BY doc_id LIMIT 3",
)
def _(spark, d):
    df = markup.markup_previews(texts(spark, d), "text", "doc_id")
    return df.select("doc_id", "preview", F.array_join("markup_types", ", ").alias("types"))


KEPT_SQL = (
    "CASE WHEN len(b) = 0 THEN text ELSE array_to_string(list_filter(b, lambda z: "
    f"{S.category('z')} IS NULL), chr(10)) END"
)
BLOCKS_CTE = f"{NOISY_CTE}, b AS MATERIALIZED (SELECT doc_id, text, {S.blocks('text')} AS b FROM t)"
LABELS_CTE = (
    f"{BLOCKS_CTE}, e AS MATERIALIZED (SELECT doc_id, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS pos FROM b),"
    f" g AS MATERIALIZED (SELECT doc_id, pos, block, {S.category('block')} AS category FROM e)"
)
KEPT_CTE = (
    f"{LABELS_CTE}, k AS MATERIALIZED (SELECT b.doc_id, CASE WHEN len(any_value(b.b)) = 0 THEN any_value(b.text) ELSE"
    " coalesce(string_agg(g.block, chr(10) ORDER BY g.pos) FILTER (g.category IS NULL), '') END AS text"
    " FROM b LEFT JOIN g ON g.doc_id = b.doc_id GROUP BY b.doc_id)"
)
AFTER_CTE = f"{KEPT_CTE}, {S.clean('k', 'text', 'doc_id')}"


@query(
    "d06_cleaning_report",
    f"WITH {AFTER_CTE}, fb AS MATERIALIZED (SELECT {S.flag_columns('text')} FROM t),"
    f" fa AS MATERIALIZED (SELECT {S.flag_columns('x')} FROM c{S.LAST})"
    f" SELECT (SELECT count(*) FROM t) AS records, (SELECT count(*) FROM fb WHERE {S.ANY_FLAG}) AS flagged_before,"
    f" (SELECT count(*) FROM fa WHERE {S.ANY_FLAG}) AS flagged_after,"
    " (SELECT count(DISTINCT doc_id) FROM g WHERE category IS NOT NULL) AS records_with_removed_blocks,"
    " (SELECT count(category) FROM g) AS blocks_removed",
)
def _(spark, d):
    return markup.cleaning_report(noisy_texts(spark, d), "text")


@query(
    "d06_clean_descriptions",
    f"WITH {AFTER_CTE} SELECT doc_id, x AS text FROM c{S.LAST}",
)
def _(spark, d):
    return markup.clean_descriptions(noisy_texts(spark, d), "text")


@query(
    "d07_cleaning_examples",
    f"WITH {AFTER_CTE}, f AS MATERIALIZED (SELECT doc_id, text, {S.flag_columns('text')} FROM t)"
    f" SELECT f.doc_id, f.text AS before, c.x AS after, array_to_string({TYPES_SQL}, ', ') AS types"
    f" FROM f JOIN c{S.LAST} c ON c.doc_id = f.doc_id WHERE {S.ANY_FLAG} ORDER BY f.doc_id LIMIT 20",
)
def _(spark, d):
    df = markup.cleaning_examples(noisy_texts(spark, d), "text", "doc_id")
    return df.select("doc_id", "before", "after", F.array_join("markup_types", ", ").alias("types"))


def _gender_sql(c: str) -> str:
    cleaned = S.strip(S.sub(S.fenced(c, S.GENDER, " "), r"[ \t]+", " "))
    return f"CASE WHEN regexp_matches({S.fence(c)}, {lit(S.GENDER)}) THEN {cleaned} ELSE {c} END"


@query(
    "d08_gender_markers",
    f"WITH {POSTINGS_CTE} SELECT id, {_gender_sql('\"Title\"')} AS \"Title\","
    f" {_gender_sql('\"Description\"')} AS \"Description\" FROM p",
)
def _(spark, d):
    return markup.clean_gender_markers(raw_postings(spark, d)).select("id", "Title", "Description")


@query(
    "d08_gender_marker_counts",
    f"WITH {POSTINGS_CTE} " + " UNION ALL ".join(
        f"SELECT {lit(n)} AS \"column\", count(*) FILTER (regexp_matches({S.fence(chr(34) + n + chr(34))},"
        f" {lit(S.GENDER)})) AS records FROM p" for n in ("Title", "Description")
    ),
)
def _(spark, d):
    return markup.gender_marker_counts(raw_postings(spark, d))


# --- E: blocks --------------------------------------------------------------
@query("e01_split_blocks", f"WITH {LABELS_CTE} SELECT doc_id, pos::INTEGER AS pos, block FROM g")
def _(spark, d):
    return blk.explode_blocks(noisy_texts(spark, d), "doc_id", "text")


@query("e02_block_category", f"WITH {LABELS_CTE} SELECT doc_id, pos::INTEGER AS pos, category FROM g")
def _(spark, d):
    return blk.explode_categories(noisy_texts(spark, d), "doc_id", "text")


@query("e03_filter_blocks", f"WITH {KEPT_CTE} SELECT doc_id, text FROM k")
def _(spark, d):
    return blk.filter_blocks(noisy_texts(spark, d), "text")


@query(
    "e04_block_stats",
    f"WITH {LABELS_CTE} SELECT 'records_with_removed_blocks' AS stat, count(DISTINCT doc_id) AS value FROM g"
    " WHERE category IS NOT NULL UNION ALL SELECT 'blocks_removed', count(category) FROM g UNION ALL "
    + " UNION ALL ".join(
        f"SELECT {lit(c)}, count(*) FILTER (category = {lit(c)}) FROM g" for c in S.CATEGORY_PATTERNS
    ),
)
def _(spark, d):
    return blk.block_stats(noisy_texts(spark, d), "text")
