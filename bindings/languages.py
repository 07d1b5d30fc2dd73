"""Language, translation and term queries on documents and postings."""

from pyspark.sql import functions as F

from bindings import sqltext as S
from bindings.base import POSTINGS_CTE, lit, query, raw_postings, table, texts
from bindings.texts import invalid_sql
from jobtide.lookups import FUNCTION_WORDS
from jobtide.operators import langmodel, translation
from jobtide.operators import language as lang
from jobtide.operators import terms
from jobtide.session import scratch_path


def detect_sql(c: str) -> str:
    """Language with most hits; the first listed wins a tie."""
    hits = ", ".join(
        f"[len(list_filter(w, lambda x: x IN ({', '.join(lit(v) for v in vs)}))), {-i}]"
        for i, vs in enumerate(FUNCTION_WORDS.values())
    )
    codes = "[" + ", ".join(lit(k) for k in FUNCTION_WORDS) + "]"
    return f"CASE WHEN list_max([{hits}])[1] > 0 THEN {codes}[1 - list_max([{hits}])[2]] ELSE 'unknown' END"


def detected(cte_in: str, c: str, keep: str) -> str:
    words = f"string_split_regex(lower({c}), '[^\\p{{L}}]+')"
    return (
        f"w AS MATERIALIZED (SELECT {keep}, {words} AS w FROM {cte_in}),"
        f" l AS MATERIALIZED (SELECT {keep}, {detect_sql('w')} AS language FROM w)"
    )


@query("m01_language", f"WITH {detected('documents', 'text', 'doc_id, lang')} SELECT doc_id, lang, language FROM l")
def _(spark, d):
    return lang.with_language(texts(spark, d).select("doc_id", "lang", "text"), "text").drop("text")


@query(
    "m02_language_distribution",
    f"WITH {POSTINGS_CTE}, v AS (SELECT * FROM p WHERE NOT {invalid_sql('\"Description\"')}),"
    f" {detected('v', '\"Description\"', 'id')}"
    " SELECT language, count(*) AS records, (SELECT count(*) FROM v) AS sampled_records FROM l GROUP BY 1",
)
def _(spark, d):
    return lang.language_distribution(raw_postings(spark, d), "Description", ["id"], "full")


@query(
    "m02_language_sample",
    f"WITH v AS (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 150), {detected('v', 'text', 'doc_id')}"
    " SELECT language, count(*) AS records, (SELECT count(*) FROM v) AS sampled_records FROM l GROUP BY 1",
)
def _(spark, d):
    return lang.language_distribution(table(spark, d, "documents"), "text", ["doc_id"], "sample", 150)


@query(
    "m03_english_share",
    f"WITH {detected('documents', 'text', 'doc_id')} SELECT count(*) AS records, count(*) FILTER (language = 'en') AS english,"
    " count(*) FILTER (language = 'en') * 100.0::DOUBLE / count(*) AS english_pct,"
    " count(*) FILTER (language = 'en') * 100.0::DOUBLE / count(*) < 90 AS below_floor FROM l",
)
def _(spark, d):
    return lang.english_share(lang.with_language(texts(spark, d), "text"))


ROUTE_SQL = (
    f"CASE WHEN d IS NULL OR {S.strip('d')} = '' THEN 'missing' WHEN language NOT IN ('en', 'unknown') THEN 'translate' ELSE 'skip' END"
)
ROUTED = (
    f"{POSTINGS_CTE}, pd AS (SELECT id, \"Description\" AS d FROM p),"
    " w AS MATERIALIZED (SELECT id, d, string_split_regex(lower(coalesce(d, '')), '[^\\p{L}]+') AS w FROM pd),"
    f" l AS MATERIALIZED (SELECT id, d, {detect_sql('w')} AS language FROM w),"
    f" ro AS MATERIALIZED (SELECT id, d, {ROUTE_SQL} AS route FROM l)"
)


@query("m04_route", f"WITH {ROUTED} SELECT id, route FROM ro")
def _(spark, d):
    return lang.with_route(raw_postings(spark, d), "Description").select("id", "route")


CHUNK_SQL = (
    "SELECT doc_id, (pos / 4000)::INTEGER AS pos, substr(text, pos + 1, 4000) AS chunk FROM"
    " (SELECT doc_id, text, unnest(range(0, length(text), 4000)) AS pos FROM documents)"
)


@query("m05_chunks", CHUNK_SQL)
def _(spark, d):
    df = table(spark, d, "documents")
    return df.select("doc_id", F.posexplode(lang.chunks(F.col("text"))).alias("pos", "chunk"))


def load_rewriter():
    """Stands in for a translator: upper case, and no answer for texts with a percent sign."""
    def rewrite(text: str) -> str:
        if "%" in text:
            raise ValueError("no answer")
        return text.upper()

    return rewrite


OUTCOME_SQL = (
    "CASE route WHEN 'missing' THEN 'missing' WHEN 'skip' THEN 'skipped'"
    " ELSE CASE WHEN contains(d, '%') THEN 'failed' ELSE 'translated' END END"
)


M06_SQL = (
    f"WITH {ROUTED} SELECT id, CASE WHEN {OUTCOME_SQL} = 'translated' THEN replace(upper(replace(d, 'ß', '<sz>')), '<SZ>', 'SS')"
    f" ELSE d END AS description, {OUTCOME_SQL} AS outcome FROM ro"
)


@query("m06_translate_stored", M06_SQL)
def _(spark, d):
    """Every distinct chunk once, through a table of results."""
    df = translation.translate_stored(raw_postings(spark, d), ["Description"], load_rewriter, scratch_path(spark, "translated"), 500)
    return df.select("id", F.col("Description").alias("description"), F.col("Description_outcome").alias("outcome"))


@query(
    "m06_translate",
    f"WITH {ROUTED} SELECT id, CASE WHEN {OUTCOME_SQL} = 'translated' THEN replace(upper(replace(d, 'ß', '<sz>')), '<SZ>', 'SS')"
    f" ELSE d END AS description, {OUTCOME_SQL} AS outcome FROM ro",
)
def _(spark, d):
    df = lang.translate_fields(raw_postings(spark, d), ["Description"], load_rewriter)
    return df.select("id", F.col("Description").alias("description"), F.col("Description_outcome").alias("outcome"))


@query(
    "m07_translation_stats",
    f"WITH {ROUTED}, o AS (SELECT {OUTCOME_SQL} AS o FROM ro) SELECT 'Description' AS field,"
    " count(*) FILTER (o = 'translated') AS translated, count(*) FILTER (o = 'skipped') AS skipped,"
    " count(*) FILTER (o = 'missing') AS missing, count(*) FILTER (o = 'failed') AS failed FROM o",
)
def _(spark, d):
    df = lang.translate_fields(raw_postings(spark, d), ["Description"], load_rewriter)
    return lang.translation_stats(df, ["Description"])


# --- M with a detector that is learned from the labelled documents ------------
def _grams(texts: str, keep: str) -> str:
    """(keep, b, k): buckets of the letters of ``texts`` (a CTE with a column text) and how often each is there."""
    p1, p2, p3 = langmodel._FACTORS
    pairs = f"list_transform(range(1, len(o)), lambda i: (o[i] * {p1} + o[i + 1] * {p2}) % {langmodel.BUCKETS})"
    triples = f"list_transform(range(1, len(o) - 1), lambda i: (o[i] * {p1} + o[i + 1] * {p2} + o[i + 2] * {p3} + 1) % {langmodel.BUCKETS})"
    spaced = "' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')) || ' '"
    return (
        f"SELECT {keep}, b, count(*) AS k FROM (SELECT {keep}, unnest(list_concat({pairs}, {triples})) AS b FROM"
        f" (SELECT {keep}, list_transform(string_split({spaced}, ''), lambda x: CAST(ord(x) AS BIGINT)) AS o FROM {texts}) WHERE len(o) > 2) GROUP BY ALL"
    )


def _weight(count: str, total: str) -> str:
    return f"CAST(floor({langmodel.UNIT} * ln(({count} + {langmodel.PRIOR}) / ({total} + {langmodel.PRIOR} * {langmodel.BUCKETS}))) AS BIGINT)"


def _judged(name: str, grams: str, count: str, total: str, keep: str) -> str:
    """CTE (keep, lang, margin, fit): the likeliest language of each text of ``grams``."""
    return (
        f"{name}_s AS (SELECT {keep}, mt.lang, CAST(sum(k * coalesce({_weight(f'mc.{count}', f'mt.{total}')}, {_weight('0', f'mt.{total}')})) AS BIGINT) AS s,"
        f" CAST(sum(k) AS BIGINT) AS n FROM {grams} g JOIN mt ON true LEFT JOIN mc ON mc.lang = mt.lang AND mc.b = g.b GROUP BY ALL),"
        f" {name}_r AS (SELECT *, row_number() OVER w AS place, lead(s) OVER w AS next FROM {name}_s WINDOW w AS (PARTITION BY {keep} ORDER BY s DESC, lang)),"
        f" {name} AS (SELECT {keep}, lang AS found, CAST(floor((s - next)::DOUBLE / n) AS BIGINT) AS margin, CAST(floor(s::DOUBLE / n) AS BIGINT) AS fit FROM {name}_r WHERE place = 1)"
    )


LEARNED = (
    "ld AS (SELECT doc_id, lang AS label, substr(md5(text), 1, 1) IN ('0', '1', '2') AS held, text FROM documents),"
    f" lg AS MATERIALIZED ({_grams('ld', 'doc_id, label, held')}),"
    " mc AS MATERIALIZED (SELECT label AS lang, b, sum(k) AS c, coalesce(sum(k) FILTER (NOT held), 0) AS c0 FROM lg WHERE label IS NOT NULL GROUP BY ALL),"
    " mt AS MATERIALIZED (SELECT lang, sum(c) AS t, sum(c0) AS t0 FROM mc GROUP BY lang),"
    f" {_judged('tr', '(SELECT * FROM lg WHERE held AND label IS NOT NULL)', 'c0', 't0', 'doc_id, label')},"
    " tg AS (SELECT margin, fit FROM tr WHERE found = label),"
    " lm AS MATERIALIZED (SELECT " + ", ".join(
        f"coalesce((SELECT min({c}) FROM (SELECT {c}, count(*) OVER (ORDER BY {c}) AS upto, count(*) OVER () AS n FROM tg)"
        f" WHERE upto > {langmodel.SHARE} * n), {usual}) AS least_{c}" for c, usual in (("margin", 0), ("fit", -langmodel._FAR))
    ) + ")"
)


def learned(grams: str, rows: str, keep: str) -> str:
    """CTE ``le`` (keep, language) of all ``rows``; those without a letter are unknown."""
    return (
        f"{_judged('ju', grams, 'c', 't', 'doc_id')}, le AS MATERIALIZED (SELECT {', '.join(f'x.{c}' for c in keep.split(', '))},"
        f" coalesce(CASE WHEN margin >= least_margin AND fit >= least_fit THEN found END, 'unknown') AS language"
        f" FROM {rows} x LEFT JOIN ju ON ju.doc_id = x.doc_id JOIN lm ON true)"
    )


DOCUMENTS_LEARNED = f"{LEARNED}, {learned('lg', 'ld', 'doc_id, label')}"


def learned_detector(spark, d):
    return langmodel.learn(texts(spark, d)).detector(spark)


@query("m01_learned_language", f"WITH {DOCUMENTS_LEARNED} SELECT doc_id, label AS lang, language FROM le")
def _(spark, d):
    return lang.with_language(texts(spark, d).select("doc_id", "lang", "text"), "text", detector=learned_detector(spark, d)).drop("text")


POSTINGS_LEARNED = (
    f"{POSTINGS_CTE}, {LEARNED}, pt AS (SELECT id AS doc_id, \"Description\" AS text, \"Description\" AS d FROM p),"
    f" pg AS MATERIALIZED ({_grams('pt', 'doc_id')}), {learned('pg', 'pt', 'doc_id, d')}"
)


@query(
    "m02_learned_distribution",
    f"WITH {POSTINGS_LEARNED}, v AS (SELECT language FROM le WHERE NOT {invalid_sql('d')})"
    " SELECT language, count(*) AS records, (SELECT count(*) FROM v) AS sampled_records FROM v GROUP BY 1",
)
def _(spark, d):
    return lang.language_distribution(raw_postings(spark, d), "Description", ["id"], detector=learned_detector(spark, d))


@query(
    "m03_learned_english_share",
    f"WITH {DOCUMENTS_LEARNED} SELECT count(*) AS records, count(*) FILTER (language = 'en') AS english,"
    " count(*) FILTER (language = 'en') * 100.0::DOUBLE / count(*) AS english_pct,"
    " count(*) FILTER (language = 'en') * 100.0::DOUBLE / count(*) < 90 AS below_floor FROM le",
)
def _(spark, d):
    return lang.english_share(lang.with_language(texts(spark, d), "text", detector=learned_detector(spark, d)))


@query("m04_learned_route", f"WITH {POSTINGS_LEARNED} SELECT doc_id AS id, {ROUTE_SQL} AS route FROM le")
def _(spark, d):
    return lang.with_route(raw_postings(spark, d), "Description", detector=learned_detector(spark, d)).select("id", "route")


# --- N: terms ---------------------------------------------------------------
def plain_sql(c: str) -> str:
    return S.strip(S.sub(S.sub(f"lower({c})", r"[^a-z0-9\s]", " "), r"\s+", " "))


def plain_skills_sql(c: str) -> str:
    parts = f"list_filter(list_transform(string_split({c}, ','), lambda x: {S.strip('x')}), lambda x: x <> '')"
    return f"coalesce(array_to_string(list_transform({parts}, lambda x: {plain_sql('x')}), ' '), '')"


FIELDS_CTE = (
    f"{POSTINGS_CTE}, ft AS MATERIALIZED ("
    f"SELECT 'title' AS field, {plain_sql('\"Title\"')} AS text FROM p WHERE \"Title\" <> '' UNION ALL"
    f" SELECT 'description', {plain_sql('\"Description\"')} FROM p WHERE \"Description\" <> '' UNION ALL"
    f" SELECT 'skill', {plain_skills_sql('\"Skill\"')} FROM p WHERE \"Skill\" <> '')"
)
STOP = "(" + ", ".join(lit(w) for w in FUNCTION_WORDS["en"]) + ")"
TERMS_CTE = (
    f"{FIELDS_CTE}, tw AS MATERIALIZED (SELECT field, unnest(string_split(text, ' ')) AS word FROM ft),"
    f" wc AS MATERIALIZED (SELECT field, word, count(*) AS n FROM tw WHERE word <> '' AND word NOT IN {STOP}"
    " AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY 1, 2),"
    " mg AS MATERIALIZED (SELECT a.field, coalesce(b.word, a.word) AS term, sum(a.n)::BIGINT AS occurrences FROM wc a"
    " LEFT JOIN wc b ON b.field = a.field AND a.word LIKE '_%s' AND a.word NOT LIKE '%ss' AND b.word || 's' = a.word GROUP BY 1, 2)"
)


@query("n01_plain_text", f"SELECT doc_id, {plain_sql('text')} AS text FROM documents")
def _(spark, d):
    return texts(spark, d).select("doc_id", terms.plain_text(F.col("text")).alias("text"))


@query("n02_plain_skills", f"WITH {POSTINGS_CTE} SELECT id, {plain_skills_sql('\"Skill\"')} AS text FROM p")
def _(spark, d):
    return raw_postings(spark, d).select("id", terms.plain_skills(F.col("Skill")).alias("text"))


@query("n03_field_texts", f"WITH {FIELDS_CTE} SELECT field, text FROM ft")
def _(spark, d):
    return terms.field_texts(raw_postings(spark, d))


@query(
    "n04_top_terms",
    f"WITH {TERMS_CTE}, rk AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY occurrences DESC, term) AS rank FROM mg)"
    " SELECT field, rank::INTEGER AS rank, term, occurrences, occurrences / max(occurrences) OVER (PARTITION BY field) AS weight"
    " FROM rk WHERE rank <= 150",
)
def _(spark, d):
    return terms.top_terms(terms.field_texts(raw_postings(spark, d)))


@query(
    "n04_top_terms_wide",
    f"WITH {TERMS_CTE}, rk AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY occurrences DESC, term) AS rank FROM mg)"
    " SELECT field, rank::INTEGER AS rank, term, occurrences FROM rk WHERE rank <= 5000",
)
def _(spark, d):
    return terms.top_terms(terms.field_texts(raw_postings(spark, d)), 5_000).drop("weight")
