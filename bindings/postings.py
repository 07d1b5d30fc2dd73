"""Derived fields, the whole posting clean-up, and profiles."""

from pyspark.sql import functions as F

from bindings import sqltext as S
from bindings.base import POSTINGS_CTE, lit, query, raw_postings, table
from bindings.texts import ALL_INVALID_SQL, invalid_sql
from jobtide.lookups import CRITICAL_FIELDS
from jobtide.operators import derive, profiling
from jobtide.operators.counters import Counters
from jobtide.plans.postings import clean_postings

# --- F: derived fields ------------------------------------------------------
# Customers' area names, and an override table formed from the nations by rule.
AREA_EXPR = (
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'Greater ' || n_name || ' Metropolitan Area'"
    " WHEN 'MACHINERY' THEN n_name || ' Region' WHEN 'HOUSEHOLD' THEN c_name || ', ' || n_name"
    " WHEN 'FURNITURE' THEN n_name || ',' ELSE 'Benelux ' || n_name END"
)
# (location, country) pairs in both dialects; a name may stand for one country only.
OVERRIDE_ROWS = " UNION ALL ".join(
    f"SELECT {form} AS location, r_name AS country FROM nation JOIN region ON r_regionkey = n_regionkey"
    for form in ("'Greater ' || n_name || ' Metropolitan Area'", "n_name || ' Region'", "'Greater ' || n_name || ' Area'")
)
OVERRIDE_CTE = (
    f"c AS (SELECT c_custkey, {AREA_EXPR} AS location FROM customer JOIN nation ON n_nationkey = c_nationkey),"
    f" o AS ({OVERRIDE_ROWS}), l AS (SELECT c_custkey, coalesce(o.country, c.location) AS location FROM c"
    " LEFT JOIN o ON o.location = c.location)"
)
# The override table of the whole clean-up.
AREAS = [
    ("Greater Paris Metropolitan Region", "France"), ("Stuttgart Region", "Germany"), ("Rotterdam and The Hague", "Netherlands"),
]


def _customers(spark, d):
    nation = table(spark, d, "nation")
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.selectExpr("c_custkey", f"{AREA_EXPR} AS location")


def _overrides(spark, d):
    named = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    forms = [
        F.concat(F.lit("Greater "), "n_name", F.lit(" Metropolitan Area")), F.concat("n_name", F.lit(" Region")),
        F.concat(F.lit("Greater "), "n_name", F.lit(" Area")),
    ]
    return named.select(F.explode(F.array(*forms)).alias("location"), F.col("r_name").alias("country"))


@query("f01_location_override", f"WITH {OVERRIDE_CTE} SELECT c_custkey, location FROM l")
def _(spark, d):
    return derive.override_location(_customers(spark, d), _overrides(spark, d), "location")


WIDE = "(?i)EMEA|European Union|European Economic Area|Schengen Area|DACH|Benelux|Nordics"


def country_sql(c: str) -> str:
    return f"CASE WHEN NOT regexp_matches({c}, {lit(WIDE)}) THEN {S.strip(f'string_split({c}, {lit(chr(44))})[-1]')} END"


@query("f02_country", f"WITH {OVERRIDE_CTE} SELECT c_custkey, location, {country_sql('location')} AS country FROM l")
def _(spark, d):
    return derive.add_country(_customers(spark, d), _overrides(spark, d), "location", "country")


def modality_sql(c: str) -> str:
    inside = f"lower(regexp_extract({S.strip(c)}, '\\(([^)]*)\\)\\s*$', 1))"
    return (
        f"CASE WHEN {inside} LIKE '%remote%' THEN 'remote' WHEN {inside} LIKE '%hybrid%' THEN 'hybrid'"
        f" WHEN {inside} LIKE '%on-site%' OR {inside} LIKE '%on site%' OR {inside} LIKE '%onsite%' THEN 'on-site' END"
    )


@query("f03_work_modality", f"WITH {POSTINGS_CTE} SELECT id, {modality_sql('\"Primary Description\"')} AS modality FROM p")
def _(spark, d):
    df = derive.add_work_modality(raw_postings(spark, d))
    return df.select("id", F.col("Work Modality").alias("modality"))


@query(
    "f03_modality_counts",
    f"WITH {POSTINGS_CTE}, m AS (SELECT {modality_sql('\"Primary Description\"')} AS m FROM p)"
    " SELECT count(m) AS filled, count(*) - count(m) AS missing FROM m",
)
def _(spark, d):
    return derive.filled_counts(derive.add_work_modality(raw_postings(spark, d)), "Work Modality")


def company_sql(c: str) -> str:
    return f"CASE WHEN contains({c}, '·') THEN nullif({S.strip(f'string_split({c}, {lit(chr(183))})[1]')}, '') END"


@query("f04_company", f"WITH {POSTINGS_CTE} SELECT id, {company_sql('\"Primary Description\"')} AS company FROM p")
def _(spark, d):
    return derive.add_company(raw_postings(spark, d)).select("id", F.col("Company").alias("company"))


MATCH = r"(?i)^\s*\d+\s+of\s+\d+\s+skills\s+match\s+your\s+profile\s*-\s*you\s+may\s+be\s+a\s+good\s+fit\s*$"
PREFIX = r"(?i)^\s*skills:\s*"
MORE = r"(?i)\s*,\s*\+\s*\d+\s+more\s*$"


def skill_sql(c: str) -> str:
    text = S.strip(c)
    cleaned = S.strip(S.sub(S.sub(S.sub(text, PREFIX, ""), MORE, ""), r"[ \t]+", " "))
    return f"CASE WHEN NOT regexp_matches({text}, {lit(MATCH)}) THEN nullif({cleaned}, '') END"


@query("f05_skill_field", f"WITH {POSTINGS_CTE} SELECT id, {skill_sql('\"Skill\"')} AS skill FROM p")
def _(spark, d):
    df = raw_postings(spark, d)
    return df.select("id", derive.clean_skill_field(F.col("Skill")).alias("skill"))


@query(
    "f05_skill_rule_counts",
    f"WITH {POSTINGS_CTE} " + " UNION ALL ".join(
        f"SELECT {lit(n)} AS rule, count(*) FILTER (regexp_matches(\"Skill\", {lit(p)})) AS records FROM p"
        for n, p in (("prefix_removed", PREFIX), ("suffix_removed", MORE), ("profile_match_cleared", MATCH))
    ),
)
def _(spark, d):
    return derive.skill_field_counts(raw_postings(spark, d))


# --- F06: the whole clean-up ------------------------------------------------
def _null_invalid(c: str) -> str:
    return f"CASE WHEN NOT {invalid_sql(c)} THEN {c} END"


def _gender(c: str) -> str:
    cleaned = S.strip(S.sub(S.fenced(c, S.GENDER, " "), r"[ \t]+", " "))
    return f"CASE WHEN regexp_matches({S.fence(c)}, {lit(S.GENDER)}) THEN {cleaned} ELSE {c} END"


CLEAN_SQL = (
    f"WITH {POSTINGS_CTE}, n AS MATERIALIZED (SELECT id, \"Title\" AS title, {_null_invalid('\"Description\"')} AS descr,"
    f" {_null_invalid('\"Primary Description\"')} AS prim, {_null_invalid('\"Location\"')} AS loc,"
    f" {_null_invalid('\"Skill\"')} AS skill FROM p),"
    " d AS MATERIALIZED (SELECT * FROM n WHERE loc IS NULL OR loc NOT IN ('Middle East',"
    " 'Washington DC-Baltimore Area', 'Mexico')),"
    f" gm AS MATERIALIZED (SELECT id, {_gender('title')} AS title, {_gender('descr')} AS text FROM d),"
    f" b AS MATERIALIZED (SELECT id, text, {S.blocks('text')} AS b FROM gm),"
    " e AS MATERIALIZED (SELECT id, unnest(b) AS block, generate_subscripts(b, 1) AS pos FROM b),"
    f" g AS MATERIALIZED (SELECT id, pos, block, {S.category('block')} AS category FROM e),"
    " k AS MATERIALIZED (SELECT b.id, CASE WHEN any_value(b.text) IS NULL THEN NULL WHEN len(any_value(b.b)) = 0"
    " THEN any_value(b.text) ELSE coalesce(string_agg(g.block, chr(10) ORDER BY g.pos)"
    " FILTER (g.category IS NULL), '') END AS text FROM b LEFT JOIN g ON g.id = b.id GROUP BY b.id),"
    f" {S.clean('k', 'text', 'id')},"
    f" r AS MATERIALIZED (SELECT d.id, gm.title, CASE WHEN {S.strip('c.x')} <> '' THEN c.x END AS description,"
    f" {company_sql('d.prim')} AS company, d.prim AS primary_description, {modality_sql('d.prim')} AS work_modality,"
    " CASE d.loc WHEN 'Greater Paris Metropolitan Region' THEN 'France' ELSE d.loc END AS location,"
    f" {skill_sql('d.skill')} AS skill FROM d JOIN gm ON gm.id = d.id JOIN c{S.LAST} c ON c.id = d.id)"
    f" SELECT *, {country_sql('location')} AS country FROM r WHERE NOT ({invalid_sql('title')} AND"
    f" {invalid_sql('description')} AND {invalid_sql('primary_description')} AND {invalid_sql('skill')})"
)


@query("f06_clean_postings", CLEAN_SQL)
def _(spark, d):
    overrides = spark.createDataFrame(AREAS, "location string, country string")
    cleaned = clean_postings(raw_postings(spark, d), overrides)
    return cleaned.select(
        "id", F.col("Title").alias("title"), F.col("Description").alias("description"),
        F.col("Company").alias("company"), F.col("Primary Description").alias("primary_description"),
        F.col("Work Modality").alias("work_modality"), F.col("Location").alias("location"),
        F.col("Country").alias("country"), F.col("Skill").alias("skill"),
    )


def _counter_sql(name: str, value: str) -> str:
    return f"SELECT {lit(name)} AS counter, CAST({value} AS BIGINT) AS value"


_AFTER = f"c{S.LAST}"
COUNTERS_SQL = CLEAN_SQL[: CLEAN_SQL.index(" SELECT *, ")] + (
    f", fb AS MATERIALIZED (SELECT {S.flag_columns('descr')} FROM d), fa AS MATERIALIZED (SELECT {S.flag_columns('x')} FROM {_AFTER})"
    f", cr AS (SELECT {invalid_sql('title')} AND {invalid_sql('description')} AND {invalid_sql('primary_description')}"
    f" AND {invalid_sql('skill')} AS lost FROM r) "
) + " UNION ALL ".join([
    *[_counter_sql(f"invalid: {n}", f"(SELECT count(*) - count({c}) FROM n)")
      for n, c in (("Description", "descr"), ("Primary Description", "prim"), ("Location", "loc"), ("Skill", "skill"))],
    _counter_sql("disallowed locations", "(SELECT count(*) FROM n) - (SELECT count(*) FROM d)"),
    _counter_sql("markup: before", f"(SELECT count(*) FROM fb WHERE {S.ANY_FLAG})"),
    *[_counter_sql(f"gender markers: {n}", f"(SELECT count(*) FROM d WHERE regexp_matches({S.fence(c)}, {lit(S.GENDER)}))")
      for n, c in (("Title", "title"), ("Description", "descr"))],
    _counter_sql("blocks: records", "(SELECT count(DISTINCT id) FROM g WHERE category IS NOT NULL)"),
    _counter_sql("blocks: removed", "(SELECT count(category) FROM g)"),
    *[_counter_sql(f"blocks: {c}", f"(SELECT count(*) FROM g WHERE category = {lit(c)})") for c in S.CATEGORY_PATTERNS],
    _counter_sql("markup: after", f"(SELECT count(*) FROM fa WHERE {S.ANY_FLAG})"),
    _counter_sql("descriptions without text", "(SELECT count(*) - count(description) FROM r)"),
    *[_counter_sql(f"skill: {n}", f"(SELECT count(*) FROM d WHERE regexp_matches(skill, {lit(p)}))")
      for n, p in (("prefix_removed", PREFIX), ("suffix_removed", MORE), ("profile_match_cleared", MATCH))],
    _counter_sql("modality: filled", "(SELECT count(work_modality) FROM r)"),
    _counter_sql("modality: missing", "(SELECT count(*) - count(work_modality) FROM r)"),
    _counter_sql("critical: removed", "(SELECT count(*) FROM cr WHERE lost)"),
    _counter_sql("critical: kept", "(SELECT count(*) FROM cr WHERE NOT lost)"),
])


@query("f06_counters", COUNTERS_SQL)
def _(spark, d):
    """What every step of the clean-up changed or removed, counted in the run that writes its rows."""
    counters = Counters()
    overrides = spark.createDataFrame(AREAS, "location string, country string")
    clean_postings(raw_postings(spark, d), overrides, counters).write.format("noop").mode("overwrite").save()
    return counters.table(spark)


# --- L: profiles ------------------------------------------------------------
@query(
    "l01_shape",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, (SELECT count(*) FROM documents) AS row_count"
        for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
    ),
)
def _(spark, d):
    return profiling.shape(table(spark, d, "documents"))


TEXT_NAMES = [
    "Title", "Description", "Primary Description", "Location", "Skill", "Created At", "Scraped At", "Job State", "Industry",
]


def _q(name: str) -> str:
    return f'"{name}"'


@query(
    "l02_invalid_profile",
    f"WITH {POSTINGS_CTE} " + " UNION ALL ".join(
        f"SELECT {lit(n)} AS \"column\", count(*) FILTER {invalid_sql(_q(n))} AS invalid,"
        f" count(*) FILTER {invalid_sql(_q(n))} * 100.0::DOUBLE / count(*) AS invalid_pct FROM p" for n in TEXT_NAMES
    ),
)
def _(spark, d):
    return profiling.invalid_profile(raw_postings(spark, d))


@query("l03_duplicate_rows", "SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates")
def _(spark, d):
    return profiling.duplicate_rows(table(spark, d, "documents").select("text", "lang"))


@query(
    "l04_duplicates_ignoring",
    "SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicates",
)
def _(spark, d):
    return profiling.duplicates_ignoring(table(spark, d, "documents"), "doc_id")


@query(
    "l05_mean_lengths",
    f"WITH {POSTINGS_CTE} " + " UNION ALL ".join(
        f"SELECT {lit(n)} AS \"column\", avg(length({_q(n)})) AS avg_length FROM p" for n in TEXT_NAMES
    ),
)
def _(spark, d):
    return profiling.mean_lengths(raw_postings(spark, d))


@query(
    "l06_top_values",
    f"WITH {POSTINGS_CTE} SELECT \"Location\" AS value, count(*) AS records FROM p WHERE \"Location\" IS NOT NULL"
    " GROUP BY 1 ORDER BY records DESC, value LIMIT 10",
)
def _(spark, d):
    df = raw_postings(spark, d)
    return profiling.top_values(df, profiling.location_column(df))


@query(
    "l07_status_distribution",
    f"WITH {POSTINGS_CTE} SELECT \"Job State\" AS status, count(*) AS records FROM p WHERE \"Job State\" IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    return profiling.status_distribution(raw_postings(spark, d), "Job State")


@query(
    "l07_status_unlisted",
    f"WITH {POSTINGS_CTE} SELECT \"Job State\" AS status, count(*) AS records FROM p WHERE \"Job State\" <> 'LISTED' GROUP BY 1",
)
def _(spark, d):
    return profiling.status_distribution(raw_postings(spark, d), "Job State", "LISTED")


@query(
    "l07_status_samples",
    f"WITH {POSTINGS_CTE} SELECT id, \"Job State\" AS status FROM p WHERE \"Job State\" IS DISTINCT FROM 'LISTED' ORDER BY id LIMIT 3",
)
def _(spark, d):
    return profiling.status_samples(raw_postings(spark, d), "Job State", "LISTED", "id")


@query(
    "l08_critical_report",
    f"WITH {POSTINGS_CTE} " + " UNION ALL ".join(
        f"SELECT {lit(n)} AS field, count(*) AS records, count(*) FILTER (NOT {invalid_sql(_q(n))}) AS valid,"
        f" count(*) FILTER ({_q(n)} IS NULL) AS nulls, count(*) FILTER {invalid_sql(_q(n))} AS invalid,"
        f" count(*) FILTER ({_q(n)} IS NULL) + count(*) FILTER {invalid_sql(_q(n))} AS total_missing_ref FROM p"
        for n in CRITICAL_FIELDS
    ),
)
def _(spark, d):
    return profiling.critical_report(raw_postings(spark, d))


@query(
    "l09_all_invalid_share",
    f"WITH {POSTINGS_CTE} SELECT count(*) AS records, count(*) FILTER {ALL_INVALID_SQL} AS all_invalid,"
    f" count(*) FILTER {ALL_INVALID_SQL} * 100.0::DOUBLE / count(*) AS all_invalid_pct FROM p",
)
def _(spark, d):
    return profiling.all_invalid_share(raw_postings(spark, d))


@query(
    "l10_invalid_cross_table",
    f"WITH {POSTINGS_CTE} " + " UNION ALL ".join(
        f"SELECT {a} AS first_invalid, {b} AS second_invalid,"
        f" count(*) FILTER ({invalid_sql(_q('Skill'))} = {a} AND {invalid_sql(_q('Description'))} = {b}) AS records,"
        f" count(*) FILTER ({invalid_sql(_q('Skill'))} = {a} AND {invalid_sql(_q('Description'))} = {b}) * 100.0::DOUBLE"
        " / count(*) AS pct FROM p" for a in ("true", "false") for b in ("true", "false")
    ),
)
def _(spark, d):
    return profiling.invalid_cross_table(raw_postings(spark, d))


@query(
    "l11_null_profile",
    f"WITH {POSTINGS_CTE} " + " UNION ALL ".join(
        f"SELECT {lit(n)} AS \"column\", count(*) - count({_q(n)}) AS nulls FROM p" for n in ["id", *TEXT_NAMES]
    ),
)
def _(spark, d):
    return profiling.null_profile(raw_postings(spark, d))


@query("l11_distinct_values", "SELECT count(DISTINCT p_name) AS distinct_values FROM part")
def _(spark, d):
    return profiling.distinct_values(table(spark, d, "part"), "p_name")


@query("l11_value_counts", "SELECT event_type AS value, count(*) AS records FROM events GROUP BY 1")
def _(spark, d):
    return profiling.value_counts(table(spark, d, "events"), "event_type")
