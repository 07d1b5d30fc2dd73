"""Embeddings, matching, the mapping view and its evaluation.

Skills are all vectors. Catalogue items are the unit centroids of the labels, or
again all vectors where a query asks for the nearest of a whole table.
"""

from pyspark.sql import functions as F

from bindings.base import query, table
from jobtide.operators import embeddings as emb
from jobtide.operators import matching, reports, stored
from jobtide.operators.records import at_least, in_band
from jobtide.session import scratch_path

MODEL = "given"
STEPS = [0.15, 0.25, 0.35]


def skill_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("skill_id"), "embedding")


def centroids(spark, d):
    """Unit mean vector per label."""
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("v"))
    vectors = rows.select(
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("tks_id"),
        F.transform("v", lambda s: s["m"]).alias("embedding"),
    )
    return emb.normalise_vectors(vectors)


def matches(spark, d, top_k=3, minimum=0.15):
    return matching.top_matches(skill_vectors(spark, d), centroids(spark, d), top_k, minimum)


def similarity(spark, d):
    return matching.similarity_rows(matches(spark, d), MODEL)


def skill_names(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("skill "), F.col("vec_id").cast("string")).alias("normalized_skill")
    )


def item_names(spark, d):
    labels = table(spark, d, "embeddings").select("label").distinct()
    name = F.col("label").cast("string")
    return labels.select(F.concat(F.lit("L"), name).alias("id"), F.concat(F.lit("cluster "), name).alias("description"))


def view(spark, d):
    return reports.mapping_view(similarity(spark, d), skill_names(spark, d), item_names(spark, d))


E_CTE = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
SIM_CTE = (
    f"{E_CTE}, u AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM e),"
    " m AS (SELECT label, pos, avg(x) AS m FROM u GROUP BY 1, 2),"
    " cv AS (SELECT label, list(m ORDER BY pos) AS v FROM m GROUP BY 1),"
    " ct AS (SELECT 'L' || label AS tks_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM cv),"
    " ap AS (SELECT vec_id AS skill_id, tks_id, list_dot_product(e.v, ct.v) AS s FROM e, ct),"
    " rk AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY round(s, 10) DESC, tks_id) AS r FROM ap),"
    " sim AS (SELECT skill_id, tks_id, 'given' AS model_name, s AS similarity FROM rk WHERE r <= 3 AND s >= 0.15)"
)
SELF_CTE = (
    f"{E_CTE}, ap AS (SELECT a.vec_id AS skill_id, b.vec_id AS tks_id, list_dot_product(a.v, b.v) AS s FROM e a, e b)"
)


def rounded(df):
    return df.withColumn("similarity", F.round("similarity", 6))


# --- I: embeddings ----------------------------------------------------------
HASHED_SQL = (
    "g AS (SELECT p_name AS t, substr(p_name, unnest(range(1, length(p_name) - 1)), 3) AS gram FROM (SELECT DISTINCT p_name FROM part)),"
    " c AS (SELECT t, ('0x' || substr(md5(gram), 1, 7))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n FROM g GROUP BY 1, 2)"
)


def named_vectors(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    # Few bytes, but much work: adaptive execution would put them into one task, unless the number of parts is named.
    names = names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("p_name"))
    return emb.encode(names, "p_name", lambda: emb.ngram_encoder(64))


@query(
    "i01_pending",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')",
)
def _(spark, d):
    stored = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("skill_id"), F.col("l_linestatus").alias("model_name")
    )
    dim = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return emb.pending(dim, stored, "F", "o_orderkey", "skill_id")


@query("i02_encode", f"WITH {HASHED_SQL} SELECT t AS p_name, bucket::INTEGER AS bucket, n FROM c")
def _(spark, d):
    rows = named_vectors(spark, d).select("p_name", F.posexplode("embedding").alias("bucket", "n"))
    return rows.where("n > 0")


@query(
    "i03_l2_normalise",
    f"WITH {HASHED_SQL}, q AS (SELECT t, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1)"
    " SELECT t AS p_name, bucket::INTEGER AS bucket, round(n / norm, 9) AS x FROM c JOIN q USING (t)",
)
def _(spark, d):
    unit = emb.normalise_vectors(named_vectors(spark, d))
    rows = unit.select("p_name", F.posexplode("embedding").alias("bucket", "n")).where("n > 0")
    return rows.select("p_name", "bucket", F.round("n", 9).alias("x"))


@query(
    "i04_store_vectors",
    "WITH s AS (SELECT vec_id AS skill_id, 'a' AS model_name, list_transform(embedding, lambda x: 2 * x::DOUBLE) AS v FROM embeddings"
    " WHERE label < 5 UNION ALL SELECT vec_id, 'b', embedding::DOUBLE[] FROM embeddings UNION ALL"
    " SELECT vec_id, 'a', embedding::DOUBLE[] FROM embeddings WHERE label >= 5)"
    " SELECT skill_id, model_name, (generate_subscripts(v, 1) - 1)::INTEGER AS pos, unnest(v) AS x FROM s",
)
def _(spark, d):
    rows = skill_vectors(spark, d)
    old = table(spark, d, "embeddings").where("label < 5").select(
        F.col("vec_id").alias("skill_id"), F.lit("a").alias("model_name"),
        F.transform("embedding", lambda x: 2 * x.cast("double")).alias("embedding"),
    )
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    stored = emb.store_vectors(rows, emb.store_vectors(rows, old, "b", "skill_id"), "a", "skill_id")
    return stored.select("skill_id", "model_name", F.posexplode("embedding").alias("pos", "x"))


@query(
    "i05_length_profile",
    "SELECT max(length(text))::INTEGER AS max_chars, quantile_cont(length(text), 0.95) AS p95_chars FROM documents",
)
def _(spark, d):
    return emb.length_profile(table(spark, d, "documents"), "text")


# --- J: matching ------------------------------------------------------------
@query("j01_model_vectors", "SELECT vec_id AS skill_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label = 3")
def _(spark, d):
    rows = table(spark, d, "embeddings").withColumn("model_name", F.concat(F.lit("m"), F.col("label").cast("string")))
    found = emb.of_model(rows, "m3", "vec_id")
    return found.select(F.col("vec_id").alias("skill_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))


def _all_items(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("tks_id"), "embedding")


@query("j02_pairs_at_least", f"WITH {SELF_CTE} SELECT skill_id, tks_id, round(s, 6) AS similarity FROM ap WHERE s >= 0.35")
def _(spark, d):
    return rounded(matching.score_pairs(skill_vectors(spark, d), _all_items(spark, d), None, 0.35))


#: Bounds that make the given catalogue a large one, which is cut into partitions around pivots.
LARGE = {"item_bytes": 0, "item_block": 256, "skill_block": 512}


@query("j02_pairs_large", f"WITH {SELF_CTE} SELECT skill_id, tks_id, round(s, 6) AS similarity FROM ap WHERE s >= 0.35")
def _(spark, d):
    return rounded(matching.score_pairs(skill_vectors(spark, d), _all_items(spark, d), None, 0.35, **LARGE))


@query(
    "j03_top_items_large",
    f"WITH {SELF_CTE}, rk AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY round(s, 10) DESC, tks_id) AS r FROM ap)"
    " SELECT skill_id, tks_id, round(s, 6) AS similarity FROM rk WHERE r <= 4",
)
def _(spark, d):
    return rounded(matching.top_matches(skill_vectors(spark, d), _all_items(spark, d), 4, -1.0, **LARGE))


@query(
    "j03_top_items",
    f"WITH {SELF_CTE}, rk AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY round(s, 10) DESC, tks_id) AS r FROM ap)"
    " SELECT skill_id, tks_id, round(s, 6) AS similarity FROM rk WHERE r <= 4",
)
def _(spark, d):
    return rounded(matching.top_matches(skill_vectors(spark, d), _all_items(spark, d), 4, -1.0))


@query("j04_top_matches", f"WITH {SIM_CTE} SELECT skill_id, tks_id, model_name, round(similarity, 6) AS similarity FROM sim")
def _(spark, d):
    return rounded(similarity(spark, d))


@query("b13_minimum_similarity", f"WITH {SIM_CTE} SELECT skill_id, tks_id, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.3")
def _(spark, d):
    return rounded(at_least(similarity(spark, d), "similarity", 0.3)).select("skill_id", "tks_id", "similarity")


@query("j05_dimension_check", "SELECT count(*) AS vectors, count(DISTINCT len(embedding)) AS widths, count(*) > 0 AND count(DISTINCT len(embedding)) = 1 AS usable FROM embeddings")
def _(spark, d):
    return emb.dimension_check(table(spark, d, "embeddings"))


# --- K: mapping view and evaluation -----------------------------------------
VIEW_CTE = (
    f"{SIM_CTE}, vw AS (SELECT skill_id, 'skill ' || skill_id AS normalized_skill, tks_id,"
    " 'cluster ' || substr(tks_id, 2) AS tks_description, similarity, model_name,"
    " row_number() OVER (PARTITION BY skill_id, model_name ORDER BY round(similarity, 10) DESC, tks_id)::INTEGER AS rank FROM sim)"
)
BAND = "similarity >= 0.25 AND similarity < 0.35"
COLS = "skill_id, normalized_skill, tks_id, tks_description, round(similarity, 6) AS similarity, rank"


@query("k01_mapping_view", f"WITH {VIEW_CTE} SELECT {COLS}, model_name FROM vw")
def _(spark, d):
    return rounded(view(spark, d))


@query("b11_similarity_band", f"WITH {SIM_CTE} SELECT skill_id, tks_id, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.35 AND similarity <= 1.0")
def _(spark, d):
    rows = similarity(spark, d)
    rows = rows.where(in_band(F.col("similarity"), 0.35, STEPS))
    return rounded(rows).select("skill_id", "tks_id", "similarity")


@query("k02_mapping_rows", f"WITH {VIEW_CTE} SELECT {COLS} FROM vw WHERE {BAND} AND rank <= 2 AND normalized_skill ILIKE '%SKILL 1%'")
def _(spark, d):
    rows = reports.mapping_rows(view(spark, d), MODEL, 0.25, 2, " SKILL 1", STEPS)
    return rounded(reports.ordered_mapping(rows))


@query("k03_row_total", f"WITH {VIEW_CTE} SELECT count(*) AS total FROM vw WHERE {BAND} AND rank <= 3")
def _(spark, d):
    return reports.row_total(reports.mapping_rows(view(spark, d), MODEL, 0.25, 3, "", STEPS))


@query(
    "k04_mapping_page",
    f"WITH {VIEW_CTE} SELECT {COLS} FROM vw WHERE {BAND} AND rank <= 3"
    " ORDER BY vw.similarity, normalized_skill, skill_id, tks_id LIMIT 50 OFFSET 50",
)
def _(spark, d):
    rows = reports.mapping_rows(view(spark, d), MODEL, 0.25, 3, "", STEPS)
    return rounded(reports.mapping_page(rows, 2, 50))


@query(
    "k04_far_page",
    f"WITH {VIEW_CTE} SELECT {COLS} FROM vw WHERE {BAND} AND rank <= 3"
    " ORDER BY vw.similarity, normalized_skill, skill_id, tks_id LIMIT 3 OFFSET 120",
)
def _(spark, d):
    rows = reports.mapping_rows(view(spark, d), MODEL, 0.25, 3, "", STEPS)
    return rounded(reports.mapping_page(rows, 41, 3))


def _stored_mapping(spark, d):
    path = scratch_path(spark, "mapping")
    stored.write_pages(reports.mapping_rows(view(spark, d), MODEL, 0.25, 3, "", STEPS), path, rows_per_block=32)
    return path


@query(
    "k04_stored_far_page",
    f"WITH {VIEW_CTE} SELECT {COLS} FROM vw WHERE {BAND} AND rank <= 3"
    " ORDER BY vw.similarity, normalized_skill, skill_id, tks_id LIMIT 3 OFFSET 120",
)
def _(spark, d):
    return rounded(stored.stored_page(spark, _stored_mapping(spark, d), 41, 3))


@query(
    "k04_stored_summary",
    f"WITH {VIEW_CTE} SELECT count(*) AS total, greatest(ceil(count(*) / 50), 1)::BIGINT AS total_pages,"
    f" least(99, greatest(ceil(count(*) / 50), 1))::BIGINT AS page FROM vw WHERE {BAND} AND rank <= 3",
)
def _(spark, d):
    return stored.stored_summary(spark, _stored_mapping(spark, d), 99, 50)


@query(
    "k04_page_summary",
    f"WITH {VIEW_CTE} SELECT count(*) AS total, greatest(ceil(count(*) / 50), 1)::BIGINT AS total_pages,"
    f" least(99, greatest(ceil(count(*) / 50), 1))::BIGINT AS page FROM vw WHERE {BAND} AND rank <= 3",
)
def _(spark, d):
    return reports.page_summary(reports.mapping_rows(view(spark, d), MODEL, 0.25, 3, "", STEPS), 99, 50)


@query("k10_best_similarity", f"WITH {SIM_CTE} SELECT skill_id, round(max(similarity), 6) AS best_similarity FROM sim GROUP BY 1")
def _(spark, d):
    return reports.best_similarity(similarity(spark, d), MODEL).withColumn("best_similarity", F.round("best_similarity", 6))


@query(
    "k11_mean_similarity",
    f"WITH {SIM_CTE} SELECT round(avg(b), 6) AS mean_similarity FROM (SELECT max(similarity) AS b FROM sim GROUP BY skill_id)",
)
def _(spark, d):
    return reports.mean_similarity(similarity(spark, d), MODEL).select(F.round("mean_similarity", 6).alias("mean_similarity"))


@query(
    "k12_coverage",
    f"WITH {SIM_CTE}, b AS (SELECT max(similarity) AS b FROM sim GROUP BY skill_id), n AS (SELECT count(*) AS n FROM embeddings)"
    + " UNION ALL ".join(
        f" SELECT {t}::DOUBLE AS threshold, count(*) FILTER (b >= {t}) AS covered, any_value(n.n) AS total_skills,"
        f" count(*) FILTER (b >= {t}) / any_value(n.n) AS coverage FROM b, n" for t in STEPS
    ),
)
def _(spark, d):
    return reports.coverage(similarity(spark, d), skill_names(spark, d), MODEL, STEPS)


@query(
    "k13_match_counts",
    f"WITH {SIM_CTE} SELECT (SELECT count(*) FROM embeddings) AS total_skills, count(DISTINCT skill_id) AS matched_skills FROM sim",
)
def _(spark, d):
    return reports.match_counts(similarity(spark, d), skill_names(spark, d), MODEL)
