"""Catalogue operators. Each part row is read as a small catalogue document."""

from pyspark.sql import functions as F

from bindings.base import query, table
from bindings.skills import ITEMS_CTE, part_items
from jobtide.operators import catalogue, shapeless

QUOTE = "\\u2019"


def documents(spark, d):
    """One document per part: two roles, three items, four links (one of them without item)."""
    part = table(spark, d, "part")
    key = F.col("p_partkey").cast("string")
    title = F.concat("p_name", F.lit(f" it{QUOTE}s"))
    role = lambda i, t: F.struct(
        i.cast("int").alias("id"), t.alias("title"), F.split("p_name", " ").alias("alternative_title(s)"),
        F.col("p_type").alias("summary_statement"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("mission"),
    )
    item = lambda suffix, kind, text: F.struct(
        F.concat(key, F.lit(suffix)).alias("id"), kind.alias("type"), text.alias("description")
    )
    link = lambda i, k: F.struct(i.cast("int").alias("work_role_id"), k.alias("tks_id"))
    kind = F.when(F.col("p_type") == "ECONOMY", "Task").when(F.col("p_type") != "PROMO", "Skill")
    return part.select(
        "p_partkey",
        F.array(role(F.col("p_size"), title), role(F.col("p_size") + 100, F.col("p_brand"))).alias("work_role"),
        F.array(
            item("-a", F.lit("Knowledge"), title), item("-b", kind, F.col("p_brand")), item("-t", F.lit("Task"), F.col("p_type")),
        ).alias("tks"),
        F.array(
            link(F.col("p_size"), F.concat(key, F.lit("-a"))), link(F.col("p_size"), F.concat(key, F.lit("-b"))),
            link(F.col("p_size") + 100, F.concat(key, F.lit("-t"))), link(F.col("p_size") + 100, F.lit(None).cast("string")),
        ).alias("relationship"),
    )


DOC_CTE = (
    "k AS (SELECT *, CASE WHEN p_type = 'ECONOMY' THEN 'Task' WHEN p_type <> 'PROMO' THEN 'Skill' END AS kind,"
    " p_name || ' it\\u2019s' AS t FROM part)"
)
ROLES_SQL = (
    "SELECT p_partkey, p_size AS id, t AS title, string_split(p_name, ' ') AS alts, p_type AS summary_statement,"
    " CASE WHEN p_size > 25 THEN p_brand END AS mission FROM k UNION ALL SELECT p_partkey, p_size + 100, p_brand,"
    " string_split(p_name, ' '), p_type, CASE WHEN p_size > 25 THEN p_brand END FROM k"
)
ITEMS_SQL = (
    "SELECT p_partkey, p_partkey || '-a' AS id, 'Knowledge' AS type, t AS description FROM k UNION ALL"
    " SELECT p_partkey, p_partkey || '-b', kind, p_brand FROM k UNION ALL"
    " SELECT p_partkey, p_partkey || '-t', 'Task', p_type FROM k"
)
LINKS_SQL = (
    "SELECT p_partkey, p_size AS work_role_id, p_partkey || '-a' AS tks_id FROM k UNION ALL"
    " SELECT p_partkey, p_size, p_partkey || '-b' FROM k UNION ALL"
    " SELECT p_partkey, p_size + 100, p_partkey || '-t' FROM k UNION ALL SELECT p_partkey, p_size + 100, NULL FROM k"
)
CTE = f"{DOC_CTE}, r AS ({ROLES_SQL}), i AS ({ITEMS_SQL}), l AS ({LINKS_SQL})"
KEPT = "i2 AS (SELECT * FROM i WHERE type IS DISTINCT FROM 'Task')"


@query("g01_apostrophes", f"WITH {CTE} SELECT id, replace(title, '\\u2019', '’') AS title FROM r")
def _(spark, d):
    return catalogue.work_roles(catalogue.decode_apostrophes(documents(spark, d))).select("id", "title")


@query(
    "g02_drop_role_fields",
    f"WITH {CTE} SELECT p_partkey, id, title, array_to_string(alts, '|') AS alternatives FROM r",
)
def _(spark, d):
    df = catalogue.drop_role_fields(documents(spark, d))
    assert df.schema["work_role"].dataType.elementType.names == ["id", "title", "alternative_title(s)"]
    roles = df.select("p_partkey", F.inline("work_role"))
    return roles.select("p_partkey", "id", "title", F.array_join("alternative_title(s)", "|").alias("alternatives"))


@query("g02_dropped_field_count", f"WITH {CTE} SELECT (count(summary_statement) + count(mission))::BIGINT AS removed_fields FROM r")
def _(spark, d):
    return catalogue.dropped_role_field_count(documents(spark, d))


@query("g03_drop_tasks", f"WITH {ITEMS_CTE} SELECT * FROM i WHERE type IS DISTINCT FROM 'Task'")
def _(spark, d):
    return catalogue.drop_tasks(part_items(spark, d))


@query(
    "g03_task_counts",
    f"WITH {CTE}, {KEPT} SELECT (SELECT count(*) FROM i WHERE type = 'Task') AS tasks_removed,"
    " (SELECT count(*) FROM l) - (SELECT count(*) FROM l WHERE tks_id IN (SELECT id FROM i2)) AS links_removed",
)
def _(spark, d):
    return catalogue.task_counts(documents(spark, d))


@query(
    "g04_keep_linked",
    f"WITH {ITEMS_CTE}, e AS (SELECT DISTINCT l_suppkey AS work_role_id, l_partkey::VARCHAR AS tks_id FROM lineitem)"
    " SELECT * FROM e WHERE tks_id IN (SELECT id FROM i WHERE type IS DISTINCT FROM 'Task')",
)
def _(spark, d):
    edges = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("work_role_id"), F.col("l_partkey").cast("string").alias("tks_id")
    ).distinct()
    return catalogue.keep_linked(edges, catalogue.drop_tasks(part_items(spark, d)))


@query(
    "g05_work_roles",
    f"WITH {CTE} SELECT id, title, array_to_string(alts, '|') AS alternative_titles FROM r",
)
def _(spark, d):
    roles = catalogue.work_roles(documents(spark, d))
    return roles.withColumn("alternative_titles", F.array_join("alternative_titles", "|"))


@query("g05_items", f"WITH {CTE} SELECT id, type, description FROM i")
def _(spark, d):
    return catalogue.items(documents(spark, d))


@query("g05_relationships", f"WITH {CTE} SELECT work_role_id, tks_id FROM l")
def _(spark, d):
    return catalogue.relationships(documents(spark, d))


@query(
    "g06_structure_profile",
    "SELECT 'p_partkey' AS key, 'long' AS type, count(*) AS documents, NULL::BIGINT AS items, NULL::INTEGER AS min_items,"
    " NULL::INTEGER AS max_items, '' AS fields FROM part UNION ALL"
    " SELECT 'work_role', 'array', count(*), 2 * count(*), 2, 2,"
    " 'id, title, alternative_title(s), summary_statement, mission' FROM part UNION ALL"
    " SELECT 'tks', 'array', count(*), 3 * count(*), 3, 3, 'id, type, description' FROM part UNION ALL"
    " SELECT 'relationship', 'array', count(*), 4 * count(*), 4, 4, 'work_role_id, tks_id' FROM part",
)
def _(spark, d):
    return catalogue.structure_profile(documents(spark, d))


@query(
    "g07_link_report",
    f"WITH {CTE} SELECT 'relationship' AS from_key, 'work_role_id' AS field, 'work_role' AS to_key, count(*) AS links,"
    " count(*) FILTER (work_role_id IN (SELECT id FROM r)) AS matched FROM l UNION ALL"
    " SELECT 'relationship', 'tks_id', 'tks', count(*), count(*) FILTER (tks_id IN (SELECT id FROM i)) FROM l",
)
def _(spark, d):
    return catalogue.link_report(documents(spark, d))


# Documents whose keys and types differ from row to row, as JSON texts.
SHAPELESS = (
    "CASE p_partkey % 3 WHEN 0 THEN '{\"tks\":[{\"id\":\"k' || p_partkey || '\",\"type\":\"Skill\"}],\"work_role\":[{\"id\":1},{\"id\":' || p_size || '}],\"note\":\"it~s ' || p_name || '\"}'"
    " WHEN 1 THEN '{\"tks\":[{\"id\":\"k' || (p_partkey - 1) || '\",\"description\":null},7],\"relationship\":[{\"tks_id\":\"k' || (p_partkey - 1) || '\",\"Work_Role_id\":' || p_size || '},{\"tks_id\":\"none\"}]}'"
    " ELSE '{\"version\":' || p_size || ',\"tks\":\"' || p_brand || '\",\"relationship\":[],\"owner\":{\"name\":\"x\",\"it~s\":[1]}}' END"
)


def shapeless_texts(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{SHAPELESS} AS text")


_N = "(SELECT count(*) FROM part WHERE p_partkey % 3 = {})::BIGINT"


@query(
    "g06_variant_profile",
    " UNION ALL ".join([
        f"SELECT 'tks' AS key, 'array|string' AS types, (SELECT count(*) FROM part) AS documents, {_N.format(0)} + 2 * {_N.format(1)} AS items,"
        " 1 AS min_items, 2 AS max_items, 'description, id, type' AS fields",
        f"SELECT 'work_role', 'array', {_N.format(0)}, 2 * {_N.format(0)}, 2, 2, 'id'",
        f"SELECT 'note', 'string', {_N.format(0)}, NULL, NULL, NULL, ''",
        f"SELECT 'relationship', 'array', {_N.format(1)} + {_N.format(2)}, 2 * {_N.format(1)}, 0, 2, 'Work_Role_id, tks_id'",
        f"SELECT 'version', 'bigint', {_N.format(2)}, NULL, NULL, NULL, ''",
        f"SELECT 'owner', 'object', {_N.format(2)}, NULL, NULL, NULL, 'it~s, name'",
    ]),
)
def _(spark, d):
    return shapeless.structure_profile(shapeless.parsed(shapeless_texts(spark, d), "text"))


@query(
    "g07_variant_links",
    "WITH k AS (SELECT 'k' || p_partkey AS v FROM part WHERE p_partkey % 3 = 0 UNION SELECT 'k' || (p_partkey - 1) FROM part WHERE p_partkey % 3 = 1),"
    " r AS (SELECT 1 AS v UNION SELECT p_size FROM part WHERE p_partkey % 3 = 0), l AS (SELECT * FROM part WHERE p_partkey % 3 = 1)"
    " SELECT 'relationship' AS from_key, 'tks_id' AS field, 'tks' AS to_key, 2 * count(*) AS links,"
    " count(*) FILTER ('k' || (p_partkey - 1) IN (SELECT v FROM k)) AS matched FROM l UNION ALL"
    " SELECT 'relationship', 'Work_Role_id', 'work_role', count(*), count(*) FILTER (p_size IN (SELECT v FROM r)) FROM l",
)
def _(spark, d):
    return shapeless.link_report(shapeless.parsed(shapeless_texts(spark, d), "text"))


@query(
    "g01_variant_apostrophes",
    f"SELECT p_partkey, json_extract_string(replace({SHAPELESS}, '~', '’'), '$.note') AS note FROM part",
)
def _(spark, d):
    """The written-out escape in strings of any document, whatever its keys."""
    texts = shapeless_texts(spark, d).withColumn("text", F.replace("text", F.lit("~"), F.lit("\\\\u2019")))
    fixed = texts.select("p_partkey", shapeless.decode_apostrophes_text(F.col("text")).alias("text"))
    return fixed.select("p_partkey", F.get_json_object("text", "$.note").alias("note"))


@query(
    "g08_clean_catalogue",
    f"WITH {CTE}, {KEPT}, ra AS (SELECT p_partkey, string_agg(id || ':' || replace(title, '\\u2019', '’'), '|' ORDER BY id) AS roles"
    " FROM r GROUP BY 1), ia AS (SELECT p_partkey, string_agg(id || ':' || coalesce(type, '-') || ':' ||"
    " replace(description, '\\u2019', '’'), '|' ORDER BY id) AS items FROM i2 GROUP BY 1),"
    " la AS (SELECT p_partkey, string_agg(work_role_id || ':' || tks_id, '|' ORDER BY tks_id) AS links FROM l"
    " WHERE tks_id IN (SELECT id FROM i2) GROUP BY 1) SELECT p_partkey, roles, items, links FROM ra JOIN ia USING (p_partkey)"
    " JOIN la USING (p_partkey)",
)
def _(spark, d):
    df = catalogue.clean_catalogue(documents(spark, d))
    text = lambda c, f: F.array_join(F.transform(c, f), "|")
    return df.select(
        "p_partkey",
        text("work_role", lambda r: F.concat(r["id"].cast("string"), F.lit(":"), r["title"])).alias("roles"),
        text("tks", lambda t: F.concat_ws(":", t["id"], F.coalesce(t["type"], F.lit("-")), t["description"])).alias("items"),
        text("relationship", lambda r: F.concat_ws(":", r["work_role_id"].cast("string"), r["tks_id"])).alias("links"),
    )


@query(
    "g08_sample_item",
    f"WITH {CTE} SELECT p_partkey, '{{\"id\":\"' || id || '\",\"type\":\"Knowledge\",\"description\":\"' ||"
    " replace(description, '\\u2019', '’') || '\"}' AS sample FROM i WHERE id = p_partkey || '-a' ORDER BY p_partkey LIMIT 1",
)
def _(spark, d):
    return catalogue.first_items(catalogue.clean_catalogue(documents(spark, d)), "tks", "p_partkey")
