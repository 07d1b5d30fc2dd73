"""The queries of this subpackage over the given tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import colloc, langid, lexicon, mixing, partenum, repair, rlz, sketch, tokens, topk, toxicity, urls, warc
from jobtide.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def tokenizer_path(name: str) -> str:
    """Path of a vocabulary file. The package that has them is needed by the queries that tokenize only."""
    from public_tokenizers import path

    return path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Host, beginning of the path, verdict.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def _op1_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{h}{p}', '{v}')" for h, p, v in RULES)
    return f"""
    WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    r(h, s, rule, v) AS (VALUES {rules}),
    u AS (SELECT host, path, count(*) AS n FROM p GROUP BY ALL),
    b AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM u
        JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY ALL)
    SELECT page_id, p.host, p.path, rule, coalesce(v, CASE WHEN n > 1 THEN 'block' ELSE 'allow' END) AS verdict
    FROM p JOIN u ON p.host = u.host AND p.path = u.path LEFT JOIN b ON p.host = b.host AND p.path = b.path"""


@query("op1_url_filter", _op1_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL. Listed are the canonical URLs that several pages have."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = urls.canonical(pages).groupBy("host", "path").count().where("count > 1")
    return urls.judge(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict")


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level vocabulary."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep=["doc_id"])


def held_out() -> F.Column:
    """Whether a document is kept from learning. Rows without an id are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(spark: SparkSession, sf_dir: str):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.fit(toxicity.sample_labels(documents, labels))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of two thirds of the ids."""
    weights = fit_toxicity(spark, sf_dir)
    documents = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    return toxicity.score(documents, weights, keep=["doc_id", "held_out"])


def learn_languages(spark: SparkSession, sf_dir: str):
    return langid.learn(table(spark, sf_dir, "documents").where(~held_out()))


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the ids."""
    known = learn_languages(spark, sf_dir)
    documents = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    return langid.identify(documents, known, keep=["doc_id", "held_out"])


@query("op5_word_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document by the word-level vocabulary."""
    return lexicon.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep=["doc_id"])


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of every document and of its edited text, and their likeness."""
    return sketch.edited_likeness(table(spark, sf_dir, "documents"))


#: Weights of the sources, in turn.
WEIGHTS = [5.0, 2.0, 1.0]


_OP7_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 20"""


@query("op7_top_k", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, by integer inner product."""
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, "id % 20 = 0").withColumnRenamed("id", "vec_id")


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by a mix of all sources."""
    return mixing.report(table(spark, sf_dir, "documents"), WEIGHTS)


_OP9_SQL = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS k, sha1(body) AS h, min(page_id) OVER (PARTITION BY sha256(body)) AS first FROM p),
    b AS (SELECT *, list_aggregate(list_transform(range(4), lambda g: list_aggregate(list_transform(range(8), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(h, 1 + 10 * g, 10)) AS BIGINT) >> CAST(35 - 5 * i AS BIGINT)) & 31 AS BIGINT), 1)),
        'string_agg', '')), 'string_agg', '') AS digest FROM d)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""


@query("op9_warc", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed archive and read back."""
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.parsed(warc.read_archive(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_jaccard_components")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a similarity of 0.85 or more."""
    return partenum.jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


_OP11_SQL = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT r, doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS s
        FROM (SELECT r, doc_id, w, unnest(range(len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
    f AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id),
    c AS (SELECT DISTINCT r, i + k AS j FROM f, range(13) t(k)),
    k AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS kept
        FROM (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS j FROM d) ANTI JOIN c USING (r, j) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (r)"""


@query("op11_substring_dedup", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat 13 consecutive words of one with a smaller id."""
    found = rlz.without_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def _op12_sql() -> str:
    """Damage, faults and, over the rows of a conversation, the best prefix of each of four states."""
    def best(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda x: x.c IS NOT NULL))[1]"

    def step(state: str, cost: str, letter: str, text: str = "''", test: str = "true") -> str:
        return (
            f"{{'c': CASE WHEN {test} THEN {state}.c + {cost} END, 'a': {state}.a || '{letter}', "
            f"'t': {state}.t || {text}, 'n': {state}.n}}"
        )

    def taken(state: str, role: str, cost: str, letter: str, test: str) -> str:
        return (
            f"{{'c': CASE WHEN {test} THEN {state}.c + {cost} END, 'a': {state}.a || '{letter}', "
            f"'t': {state}.t || CASE WHEN {state}.n > 0 THEN chr(10) ELSE '' END || {role} || ':' || text, 'n': {state}.n + 1}}"
        )

    def added(state: str, role: str) -> str:
        return (
            f"{{'c': {state}.c + 5, 'a': {state}.a || 'I', 't': {state}.t || CASE WHEN {state}.n > 0 THEN chr(10) ELSE '' END || '{role}:', "
            f"'n': {state}.n + 1}}"
        )

    def kept(state: str, initial: str) -> str:
        return taken(state, "role", "extra", "K", f"NOT gone AND initial = '{initial}'")

    def named(state: str, role: str) -> str:
        return taken(state, f"'{role}'", "1 + extra", "R", "NOT gone")

    user = [f(s, x) for s in ("i0", "i1", "i3") for f, x in ((kept, "u"), (named, "user"))]
    to = [
        step("i0", "2", "D"), best(step("i1", "2", "D"), kept("i0", "s")), best(step("i2", "2", "D"), *user),
        best(step("i3", "2", "D"), kept("i2", "a"), named("i2", "assistant")),
    ]
    name = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(range(length(s)), lambda i: CAST(ord(s[i + 1]) AS BIGINT))), lambda c, b: "
        "list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 20"
    )
    return f"""
    WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} AS kind
        FROM (SELECT *, {name} AS s FROM conversations)),
    x AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM m WHERE kind <> 0),
    o AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w AS before,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
        regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS body
        FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy)),
    f AS (SELECT conv_id, i, turn, role, text, initial, body = '' AS blank, body <> '' AND nth > 1 AS again, body = '' OR nth > 1 AS gone,
        body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
        i > 1 AND before || initial NOT IN ('su', 'ua', 'au') AS illegal FROM o),
    r(conv_id, i, s0, s1, s2, s3) AS (
        SELECT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'a': '', 't': '', 'n': 0}}, {{'c': CAST(NULL AS INT), 'a': '', 't': '', 'n': 0}},
            {{'c': CAST(NULL AS INT), 'a': '', 't': '', 'n': 0}}, {{'c': CAST(NULL AS INT), 'a': '', 't': '', 'n': 0}} FROM f GROUP BY conv_id
        UNION ALL
        SELECT conv_id, i, {to[0]}, {to[1]}, {to[2]}, {to[3]} FROM (
            SELECT r.conv_id, f.i, role, text, initial, gone, CASE WHEN cut THEN 5 ELSE 0 END AS extra, s0 AS i0, s1 AS i1,
                {best("s2", added("s0", "user"), added("s1", "user"), added("s3", "user"))} AS i2, {best("s3", added("s2", "assistant"))} AS i3
            FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1)),
    e AS (SELECT conv_id, {best("s0", "s3", added("s2", "assistant"))} AS b FROM r
        WHERE i = (SELECT max(i) FROM f WHERE f.conv_id IS NOT DISTINCT FROM r.conv_id)),
    g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id)
    SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
        CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
        CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit,
        sha256(coalesce(b.t, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op12_conversation_repair", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    given = table(spark, sf_dir, "conversations")
    return repair.report(repair.damage(given).withColumnRenamed("conv", "conv_id"), given)


_OP13_SQL = """
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents),
    p AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w
        FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS x FROM d)),
    g AS (SELECT lang, w, m, unnest(range(len(w) - m + 1)) AS i FROM (SELECT lang, w, unnest(range(1, 6)) AS m FROM p) WHERE len(w) >= m),
    f AS (SELECT lang, m, array_to_string(w[i + 1 : i + m], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 100),
    x AS (SELECT DISTINCT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, f
        FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM c))),
    q AS (SELECT c.*, unnest(range(1, m)) AS k FROM c WHERE NOT EXISTS
        (SELECT 1 FROM x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.f >= 100 * c.f)),
    s AS (SELECT q.lang, q.phrase, q.f AS a, q.k, l.f AS l, r.f AS r, n.n,
            CAST(1000 AS HUGEINT) * q.f * n.n // (CAST(l.f AS HUGEINT) * r.f) AS score
        FROM q JOIN n ON n.lang = q.lang JOIN f l ON l.lang = q.lang AND l.phrase = array_to_string(q.w[1 : q.k], ' ')
        JOIN f r ON r.lang = q.lang AND r.phrase = array_to_string(q.w[q.k + 1 : q.m], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
        CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM b QUALIFY rank <= 2000"""


@query("op13_collocations", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of every language."""
    return colloc.collocations(table(spark, sf_dir, "documents"))
