"""Registry, table access and inputs derived from the given tables.

Derived inputs are written as SQL expressions that both engines understand, so
that a query and its counterpart start from the same rows. The operators
themselves never appear in these expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def add(name: str, fn: Query, sql: str | None = None) -> None:
    query(name, sql)(fn)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of long texts, read as its files are cut."""
    return table(spark, sf_dir, name)


def lit(text: str) -> str:
    """SQL string literal for DuckDB."""
    return "'" + text.replace("'", "''") + "'"


# --- a text that gives every cleaning step something to do ------------------
NOISE = (
    " see http - //x.example/z now [a](u) **b** __c__ `d` jo.b@mail.example.org"
    " +1 (743) 555-3824 node.js.org v1.2.3 ******* ( ) Engineer (m/f/d) HD <i>t</i>"
    " don~t ~q~ \"x\" \\\"y\\\""
)
NOISE_LINES = [
    "-----", " \U0001F600 Great role. Join us today! Apply now. Use SQL", "Benefits: lunch \u2022 gym",
    "- About us:", "We are an equal opportunity employer", "please contact us by phone +49 1234567",
    "end \t of  text ",
]


def noisy(text: str = "text") -> str:
    """The document text with markup, contact details and boilerplate behind it."""
    parts = [text, "'" + NOISE.replace("\\", "\\\\") + "'"]
    for line in NOISE_LINES:
        parts += ["chr(10)", "'" + line + "'"]
    return "translate(" + " || ".join(parts) + ", '~', chr(39))"


NOISY_SPARK = noisy()
# DuckDB reads backslashes in literals as they are.
NOISY_SQL = noisy().replace("\\\\", "\\")


def noisy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).selectExpr("doc_id", f"{NOISY_SPARK} AS text")


NOISY_CTE = f"t AS (SELECT doc_id, {NOISY_SQL} AS text FROM documents)"

# --- raw postings derived from documents -----------------------------------
POSTING_EXPRS = {
    "id": "doc_id",
    "Title": (
        "CASE lang WHEN 'en' THEN source || ' engineer (m/f/d)' WHEN 'fr' THEN source || ' analyste H/F'"
        " WHEN 'de' THEN 'N/A' ELSE source || ' HD tecnico' END"
    ),
    "Description": (
        "CASE source WHEN 'src3' THEN ' none ' WHEN 'src4' THEN NULL ELSE text || chr(10) || 'About us:'"
        " || chr(10) || '- We are an equal opportunity employer' || chr(10) || source ||"
        " ' &lt;b&gt;great&lt;/b&gt; R&amp;D role (m/w/d). Join us today! Requirements: SQL' || chr(10)"
        " || 'Mail jobs@x.example.org' END"
    ),
    "Primary Description": (
        "CASE lang WHEN 'en' THEN source || ' \u00b7 Dublin (Remote)' WHEN 'fr' THEN source || ' \u00b7 Paris (Hybrid)'"
        " WHEN 'de' THEN source || ' \u00b7 Berlin (Acme) (On-site)' ELSE 'null' END"
    ),
    "Location": (
        "CASE lang WHEN 'en' THEN 'Dublin, Ireland' WHEN 'fr' THEN 'Greater Paris Metropolitan Region'"
        " WHEN 'de' THEN CASE source WHEN 'src5' THEN 'Mexico' WHEN 'src6' THEN 'Berlin,' ELSE 'Germany' END"
        " ELSE CASE source WHEN 'src7' THEN NULL ELSE 'EMEA' END END"
    ),
    "Skill": (
        "CASE lang WHEN 'en' THEN 'Skills: Python,  ' || source || ', SQL, +5 more'"
        " WHEN 'fr' THEN '3 of 10 skills match your profile - you may be a good fit'"
        " WHEN 'de' THEN 'Cyber Security, TCP/IP, R&D, ' || source ELSE 'NULL' END"
    ),
    "Created At": "CASE source WHEN 'src8' THEN 'soon' ELSE '2024-03-05 10:20:30' END",
    "Scraped At": "CASE lang WHEN 'en' THEN '2024-03-06T01:02:03Z' ELSE '2024-03-06 00:00:00' END",
    "Job State": "CASE source WHEN 'src1' THEN 'CLOSED' WHEN 'src2' THEN NULL ELSE 'LISTED' END",
    "Industry": "source",
}


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = [f"{e} AS `{n}`" for n, e in POSTING_EXPRS.items()]
    return texts(spark, sf_dir).selectExpr(*exprs)


POSTINGS_CTE = "p AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in POSTING_EXPRS.items()) + " FROM documents)"

# --- skill texts derived from part -----------------------------------------
SKILL_EXPR = (
    "p_name || ', ' || p_type || ' ,, ' || p_brand || ' (SQL), Cyber Security, Caf\u00e9 & R&D/Ops - ' || p_type"
    " || ', Amazon Web Services (AWS), 1 of 8 skill matches your profile'"
)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, dealt to all tasks: few bytes in few splits, but much work on each name."""
    return table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism, "p_partkey")


def part_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).selectExpr("p_partkey AS id", f"{SKILL_EXPR} AS skill")


PART_SKILLS_CTE = f"s AS (SELECT p_partkey AS id, {SKILL_EXPR} AS skill FROM part)"
