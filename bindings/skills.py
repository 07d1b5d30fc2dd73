"""Skill extraction on part names, and demand reports on orders.

A posting is an order; its skills are those of the parts on its lines. Skill
texts are split and normalised once per part, before the parts meet the lines.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings import sqltext as S
from bindings.base import PART_SKILLS_CTE, lit, part_skills, parts, query, table, texts
from jobtide.functions.text import fold_accents
from jobtide.lookups import CANONICAL_TERMS, PRODUCT_ALIASES
from jobtide.operators import records, reports, skills, stored
from jobtide.session import scratch_path
from jobtide.sources.tables import number_rows

NOISE_TOKEN = r"(?i)\b\d+\s+of\s+\d+\s+skill\s+matches\s+your\s+profile\b|\byou\s+may\s+be\s+a\s+good\s+fit\b"


def split_sql(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, ','), lambda x: {S.strip('x')}), lambda x: x <> '')"


def tidy_sql(c: str) -> str:
    text = f"replace(strip_accents({S.strip(c)}), '&', ' and ')"
    return S.strip(S.sub(S.sub(text, r"[\x{2010}-\x{2015}]", "-"), r"\s+", " "))


def main_sql(c: str) -> str:
    pattern = lit(r"^(.+?)\s*\(([^()]+)\)\s*$")
    return f"CASE WHEN regexp_matches({c}, {pattern}) THEN {S.strip(f'regexp_extract({c}, {pattern}, 1)')} ELSE {c} END"


def alias_sql(c: str) -> str:
    pattern = lit(r"^(.+?)\s*\(([^()]+)\)\s*$")
    inside = S.strip(S.sub(S.strip(f"regexp_extract({c}, {pattern}, 2)"), r"[^A-Za-z0-9/+.\-]", " "))
    return f"CASE WHEN regexp_matches({inside}, '^[A-Za-z0-9/+.\\-]{{2,12}}$') THEN lower({inside}) END"


def plain_sql(c: str) -> str:
    text = S.sub(f"translate(lower({c}), '/-', '  ')", r"[^a-z0-9+.# ]", " ")
    text = f"trim({S.sub(text, r' +', ' ')})"
    return S.sub(S.sub(text, r"\bops\b", "operations"), r"\bsecops\b", "security operations")


def lookup_sql(c: str, table_: dict) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table_.items())
    return f"CASE {c} {whens} ELSE {c} END"


TOKENS_CTE = (
    f"{PART_SKILLS_CTE}, x AS MATERIALIZED (SELECT id, unnest({split_sql('skill')}) AS raw_skill,"
    f" generate_subscripts({split_sql('skill')}, 1) - 1 AS pos FROM s),"
    f" y AS MATERIALIZED (SELECT *, {tidy_sql('raw_skill')} AS tidy FROM x WHERE NOT regexp_matches(raw_skill, {lit(NOISE_TOKEN)})),"
    f" z AS MATERIALIZED (SELECT *, {plain_sql(main_sql('tidy'))} AS plain FROM y),"
    f" a AS MATERIALIZED (SELECT *, {lookup_sql('plain', PRODUCT_ALIASES)} AS aliased FROM z),"
    f" tok AS MATERIALIZED (SELECT id AS job_posting_id, pos::INTEGER AS pos, raw_skill, {lookup_sql('aliased', CANONICAL_TERMS)}"
    " AS normalized_skill FROM a WHERE normalized_skill NOT IN ('', 'english', 'cybersecurity')),"
    " dim AS (SELECT row_number() OVER (ORDER BY normalized_skill) AS id, normalized_skill FROM"
    " (SELECT DISTINCT normalized_skill FROM tok))"
)


def part_tokens(spark, d):
    return skills.explode_skills(part_skills(spark, d))


@query("h01_split_skills", f"WITH {PART_SKILLS_CTE} SELECT id, array_to_string({split_sql('skill')}, '|') AS parts FROM s")
def _(spark, d):
    return part_skills(spark, d).select("id", F.array_join(skills.split_skills(F.col("skill")), "|").alias("parts"))


@query(
    "b09_noise_tokens",
    f"WITH {PART_SKILLS_CTE}, x AS (SELECT id, unnest(string_split(skill, ',')) AS token FROM s)"
    f" SELECT id, token FROM x WHERE {S.strip('token')} = '' OR regexp_matches(token, {lit(NOISE_TOKEN)})",
)
def _(spark, d):
    tokens = part_skills(spark, d).select("id", F.explode(F.split("skill", ",", -1)).alias("token"))
    return tokens.where(records.is_noise_token(F.col("token")))


@query("h02_fold_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def _(spark, d):
    return texts(spark, d).select("doc_id", fold_accents(F.col("text")).alias("text"))


@query("h03_basic_clean", f"WITH {PART_SKILLS_CTE} SELECT id, {tidy_sql('skill')} AS text FROM s")
def _(spark, d):
    return part_skills(spark, d).select("id", skills.basic_clean(F.col("skill")).alias("text"))


@query(
    "h04_trailing_parenthetical",
    f"WITH {PART_SKILLS_CTE}, x AS (SELECT id, unnest({split_sql('skill')}) AS raw FROM s)"
    f" SELECT id, raw, {main_sql('raw')} AS main FROM x",
)
def _(spark, d):
    raw = part_skills(spark, d).select("id", F.explode(skills.split_skills(F.col("skill"))).alias("raw"))
    return raw.withColumn("main", skills.main_part(F.col("raw")))


@query("h05_normalise_tokens", f"WITH {TOKENS_CTE} SELECT job_posting_id, pos, raw_skill, normalized_skill FROM tok")
def _(spark, d):
    return part_tokens(spark, d)


@query(
    "h06_synonyms",
    f"WITH {TOKENS_CTE} SELECT plain, {lookup_sql('aliased', CANONICAL_TERMS)} AS canonical, count(*) AS n"
    " FROM a GROUP BY ALL",
)
def _(spark, d):
    raw = part_skills(spark, d).select(F.explode(skills.split_skills(F.col("skill"))).alias("raw"))
    raw = raw.where(~records.is_noise_token(F.col("raw")))
    plain = raw.select(skills.plain_words(skills.main_part(skills.basic_clean(F.col("raw")))).alias("plain"))
    return plain.groupBy("plain", skills.canonical(F.col("plain")).alias("canonical")).agg(F.count("*").alias("n"))


@query(
    "h07_aliases",
    f"WITH {PART_SKILLS_CTE}, x AS (SELECT id, unnest({split_sql('skill')}) AS raw FROM s),"
    f" y AS (SELECT id, raw, {tidy_sql('raw')} AS tidy FROM x)"
    f" SELECT id, raw, {alias_sql('tidy')} AS alias FROM y",
)
def _(spark, d):
    raw = part_skills(spark, d).select("id", F.explode(skills.split_skills(F.col("skill"))).alias("raw"))
    return raw.withColumn("alias", skills.token_alias(F.col("raw")))


@query(
    "h08_excluded_terms",
    f"WITH {TOKENS_CTE}, n AS (SELECT id, {lookup_sql('aliased', CANONICAL_TERMS)} AS skill FROM a)"
    " SELECT skill, skill NOT IN ('', 'english', 'cybersecurity') AS included, count(*) AS n FROM n GROUP BY ALL",
)
def _(spark, d):
    raw = part_skills(spark, d).select(F.explode(skills.split_skills(F.col("skill"))).alias("raw"))
    raw = raw.where(~records.is_noise_token(F.col("raw")))
    found = raw.select(skills.normalise_token(F.col("raw")).alias("skill"))
    return found.groupBy("skill", skills.included(F.col("skill")).alias("included")).agg(F.count("*").alias("n"))


@query("h09_skill_dim", f"WITH {TOKENS_CTE} SELECT id, normalized_skill FROM dim")
def _(spark, d):
    return skills.skill_dim(part_tokens(spark, d))


@query(
    "h09_extend_skill_dim",
    f"WITH {TOKENS_CTE}, old AS (SELECT row_number() OVER (ORDER BY p_name) AS id, p_name AS normalized_skill FROM"
    " (SELECT DISTINCT p_name FROM part)) SELECT id, normalized_skill FROM old UNION ALL"
    " SELECT row_number() OVER (ORDER BY normalized_skill) + (SELECT max(id) FROM old), normalized_skill FROM"
    " (SELECT normalized_skill FROM dim WHERE normalized_skill NOT IN (SELECT normalized_skill FROM old))",
)
def _(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("normalized_skill")).distinct()
    return skills.extend_skill_dim(number_rows(names, ["normalized_skill"]), part_tokens(spark, d))


@query(
    "h10_job_skill",
    f"WITH {TOKENS_CTE} SELECT job_posting_id, dim.id AS skill_id, arg_min(raw_skill, pos) AS raw_skill"
    " FROM tok JOIN dim USING (normalized_skill) GROUP BY 1, 2",
)
def _(spark, d):
    tokens = part_tokens(spark, d)
    return skills.job_skill(tokens, skills.skill_dim(tokens))


ITEM_TYPE = "CASE p_type WHEN 'ECONOMY' THEN 'Task' WHEN 'PROMO' THEN 'Knowledge' ELSE 'Skill' END AS type"
ITEM_TEXT = "CASE WHEN p_brand <> 'Brand#7' THEN p_name || ' ' || p_brand END AS description"


def part_items(spark, d):
    return table(spark, d, "part").selectExpr("cast(p_partkey AS string) AS id", ITEM_TYPE, ITEM_TEXT)


ITEMS_CTE = f"i AS (SELECT p_partkey::VARCHAR AS id, {ITEM_TYPE}, {ITEM_TEXT} FROM part)"


@query("b14_catalogue_texts", f"WITH {ITEMS_CTE} SELECT * FROM i WHERE type IN ('Knowledge', 'Skill') AND description IS NOT NULL")
def _(spark, d):
    return records.catalogue_texts(part_items(spark, d))


@query(
    "h11_framework_texts",
    f"WITH {ITEMS_CTE} SELECT id AS tks_id, description AS embedding_text FROM i"
    " WHERE type IN ('Knowledge', 'Skill') AND description IS NOT NULL",
)
def _(spark, d):
    return skills.framework_texts(part_items(spark, d))


@query("h12_raw_token_total", f"WITH {PART_SKILLS_CTE} SELECT sum(len(string_split(skill, ',')))::BIGINT AS raw_tokens FROM s")
def _(spark, d):
    return skills.raw_token_total(part_skills(spark, d))


@query(
    "h13_distinct_raw_tokens",
    f"WITH {PART_SKILLS_CTE}, x AS (SELECT unnest(string_split(skill, ',')) AS t FROM s)"
    " SELECT count(DISTINCT lower(trim(t))) AS distinct_tokens FROM x WHERE trim(t) <> ''",
)
def _(spark, d):
    return skills.distinct_raw_tokens(part_skills(spark, d))


# --- K05 to K09: demand -----------------------------------------------------
NAMES_CTE = (
    "n AS (SELECT p_partkey, unnest(string_split(p_name || ', ' || p_type, ',')) AS raw FROM part),"
    f" u AS (SELECT p_partkey, {plain_sql(main_sql(tidy_sql('raw')))} AS normalized_skill FROM n),"
    " br AS (SELECT DISTINCT l_orderkey AS job_posting_id, normalized_skill FROM lineitem"
    " JOIN u ON p_partkey = l_partkey),"
    " po AS (SELECT o_orderkey AS id, n_name AS country FROM orders JOIN customer ON c_custkey = o_custkey"
    " JOIN nation ON n_nationkey = c_nationkey)"
)


def order_tokens(spark, d):
    """(job_posting_id, normalized_skill) per line and skill; not yet unique."""
    named_parts = parts(spark, d).select("p_partkey", F.concat_ws(", ", "p_name", "p_type").alias("skill"))
    named = skills.explode_skills(named_parts, "p_partkey", "skill").select(
        F.col("job_posting_id").alias("l_partkey"), "normalized_skill"
    )
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    lines = lines.select(F.col("l_orderkey").alias("job_posting_id"), "l_partkey")
    return lines.join(named, "l_partkey").select("job_posting_id", "normalized_skill")


def order_postings(spark, d):
    """(id, country): an order and its customer's nation."""
    places = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.col("n_name").alias("country"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return orders.join(places, F.col("o_custkey") == F.col("c_custkey")).select("id", "country")


COUNTRIES = [f"NATION_{i}" for i in (1, 3, 5, 7, 11, 13, 17, 19, 23)]
COUNTRIES_SQL = "(" + ", ".join(f"'{c}'" for c in COUNTRIES) + ")"


@query(
    "b10_country_allowlist",
    f"WITH {NAMES_CTE} SELECT id, country FROM po WHERE country IN {COUNTRIES_SQL}",
)
def _(spark, d):
    return records.in_countries(order_postings(spark, d), "country", COUNTRIES)


@query(
    "k05_skill_frequency",
    f"WITH {NAMES_CTE}, t AS (SELECT normalized_skill, count(*) AS occurrences FROM br GROUP BY 1"
    " ORDER BY occurrences DESC, normalized_skill LIMIT 30)"
    " SELECT normalized_skill, occurrences, occurrences / (SELECT count(*) FROM orders) AS frequency,"
    " occurrences / (SELECT count(*) FROM orders) * 100 AS frequency_pct,"
    " round(occurrences / (SELECT count(*) FROM orders) * 100, 2) AS label_suffix FROM t",
)
def _(spark, d):
    return reports.skill_frequency(order_tokens(spark, d), table(spark, d, "orders"))


@query(
    "k05_frequency_wide",
    f"WITH {NAMES_CTE}, t AS (SELECT normalized_skill, count(*) AS occurrences FROM br GROUP BY 1"
    " ORDER BY occurrences DESC, normalized_skill LIMIT 500)"
    " SELECT normalized_skill, occurrences, round(occurrences / (SELECT count(*) FROM orders) * 100, 2) AS label_suffix FROM t",
)
def _(spark, d):
    wide = reports.skill_frequency(order_tokens(spark, d), table(spark, d, "orders"), 500)
    return wide.select("normalized_skill", "occurrences", "label_suffix")


DEMAND_CTE = (
    f"{NAMES_CTE}, tot AS (SELECT country, count(*) AS total_postings FROM po GROUP BY 1),"
    " cs AS (SELECT country, normalized_skill AS skill, count(*) AS n FROM br JOIN po ON po.id = br.job_posting_id GROUP BY 1, 2),"
    " rk AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, skill) AS rank FROM cs),"
    " dem AS (SELECT country, total_postings, rank::INTEGER AS rank, skill, n AS count, round(n / total_postings, 4) AS frequency,"
    " round(n / total_postings * 100, 2) AS frequency_pct FROM rk JOIN tot USING (country) WHERE rank <= 5)"
)


@query("k06_demand_wide", f"WITH {DEMAND_CTE.replace('rank <= 5', 'rank <= 50')} SELECT * FROM dem")
def _(spark, d):
    return reports.demand_by_country(order_tokens(spark, d), order_postings(spark, d), 50, None)


def demand(spark, d, countries=None):
    return reports.demand_by_country(order_tokens(spark, d), order_postings(spark, d), 5, countries)


@query("k06_demand_by_country", f"WITH {DEMAND_CTE} SELECT * FROM dem")
def _(spark, d):
    return demand(spark, d)


@query("k06_demand_listed_countries", f"WITH {DEMAND_CTE} SELECT * FROM dem WHERE country IN {COUNTRIES_SQL}")
def _(spark, d):
    return demand(spark, d, COUNTRIES)


@query(
    "k06_country_summaries",
    f"WITH {DEMAND_CTE} SELECT country, total_postings, string_agg(skill || ':' || count, '|' ORDER BY rank) AS skills"
    " FROM dem GROUP BY 1, 2",
)
def _(spark, d):
    rows = reports.country_summaries(demand(spark, d))
    pairs = F.transform("top_skills", lambda s: F.concat(s["skill"], F.lit(":"), s["count"].cast("string")))
    return rows.select("country", "total_postings", F.array_join(pairs, "|").alias("skills"))


# Two lists of countries, answered from one stored table of bitmaps.
LISTS = {"listed": COUNTRIES, "two": ["NATION_3", "NATION_7"], "all": None}


def _list_sql(name, countries):
    inside = "" if countries is None else f" WHERE country IN ({', '.join(lit(c) for c in countries)})"
    return (
        f"(SELECT {lit(name)} AS list, normalized_skill, count(DISTINCT id) AS occurrences,"
        f" (SELECT count(DISTINCT id) FROM po{inside}) AS total_postings FROM br JOIN po ON po.id = br.job_posting_id{inside}"
        " GROUP BY normalized_skill ORDER BY occurrences DESC, normalized_skill LIMIT 12)"
    )


def _bitmaps(spark, d):
    path = scratch_path(spark, "bitmaps")
    stored.posting_bitmaps(order_tokens(spark, d), order_postings(spark, d)).write.parquet(path)
    return spark.read.parquet(path)


@query("k05_stored_frequencies", f"WITH {NAMES_CTE} " + " UNION ALL ".join(_list_sql(n, c) for n, c in LISTS.items()))
def _(spark, d):
    bitmaps = _bitmaps(spark, d)
    parts = [stored.stored_frequency(bitmaps, c, 12).select(F.lit(n).alias("list"), "normalized_skill", "occurrences", "total_postings") for n, c in LISTS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("k06_stored_demand", f"WITH {DEMAND_CTE} SELECT country, total_postings, rank, skill, count FROM dem")
def _(spark, d):
    return stored.stored_demand(_bitmaps(spark, d), 5)


@query("k07_postings_per_country", f"WITH {NAMES_CTE} SELECT country, count(*) AS total_postings FROM po GROUP BY 1")
def _(spark, d):
    return reports.postings_per_country(order_postings(spark, d), None)


@query("k08_top_skill", f"WITH {DEMAND_CTE} SELECT country, skill, count, frequency_pct FROM dem WHERE rank = 1")
def _(spark, d):
    return reports.top_skill(demand(spark, d))


@query(
    "k09_map_classes",
    f"WITH {NAMES_CTE}, tot AS (SELECT country, count(*) AS total_postings FROM po GROUP BY 1),"
    " m AS (SELECT max(total_postings) AS m FROM tot)"
    " SELECT n_name AS map_name, n_name AS country, coalesce(total_postings, 0) AS total_postings,"
    " (CASE WHEN coalesce(total_postings, 0) / m > 0.66 THEN 3 WHEN coalesce(total_postings, 0) / m > 0.33 THEN 2 ELSE 1 END)::INTEGER AS level"
    " FROM nation LEFT JOIN tot ON country = n_name CROSS JOIN m",
)
def _(spark, d):
    totals = reports.postings_per_country(order_postings(spark, d), None)
    return reports.map_classes(totals, table(spark, d, "nation").select(F.col("n_name").alias("map_name")))


@query(
    "k09_legend_bounds",
    f"WITH {NAMES_CTE}, tot AS (SELECT country, count(*) AS n FROM po GROUP BY 1)"
    " SELECT floor(max(n) * 0.33::DOUBLE + 0.5)::BIGINT AS low, floor(max(n) * 0.66::DOUBLE + 0.5)::BIGINT AS middle,"
    " floor(max(n) + 0.5)::BIGINT AS high FROM tot",
)
def _(spark, d):
    return reports.legend_bounds(reports.postings_per_country(order_postings(spark, d), None))
