"""The competence-framework catalogue: documents of roles, items and their links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions.text import settle
from jobtide.operators.counters import Counters
from jobtide.operators.records import col, to_long

DROPPED_ROLE_FIELDS = ["summary_statement", "mission"]

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("work_role", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("alternative_title(s)", T.ArrayType(T.StringType())),
        T.StructField("summary_statement", T.StringType()),
        T.StructField("mission", T.StringType()),
    ]))),
    T.StructField("tks", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("description", T.StringType()),
    ]))),
    T.StructField("relationship", T.ArrayType(T.StructType([
        T.StructField("work_role_id", T.IntegerType()),
        T.StructField("tks_id", T.StringType()),
    ]))),
])


def replace_in_strings(c: Column, dtype: T.DataType, old: str, new: str) -> Column:
    """Replace a text in every string of a nested value, guided by its type."""
    if isinstance(dtype, T.StringType):
        return F.replace(c, F.lit(old), F.lit(new))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: replace_in_strings(x, dtype.elementType, old, new))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: replace_in_strings(v, dtype.valueType, old, new))
    if isinstance(dtype, T.StructType):
        fields = [
            replace_in_strings(c.getField(f.name), f.dataType, old, new).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def decode_apostrophes(df: DataFrame) -> DataFrame:
    """Turn the written-out escape of the right quote into the character, in all strings."""
    return df.select(*[
        replace_in_strings(col(f.name), f.dataType, "\\u2019", "’").alias(f.name)
        for f in df.schema.fields
    ])


def drop_role_fields(
    df: DataFrame, fields: Sequence[str] = DROPPED_ROLE_FIELDS, column: str = "work_role"
) -> DataFrame:
    """Drop fields of the role structs."""
    present = _element_fields(df, column)
    names = [f for f in fields if f in present]
    if not names:
        return df
    return df.withColumn(column, F.transform(col(column), lambda r: r.dropFields(*names)))


def dropped_role_field_count(
    df: DataFrame, fields: Sequence[str] = DROPPED_ROLE_FIELDS, column: str = "work_role"
) -> DataFrame:
    """Number of role fields that dropping removes; an absent field reads as NULL."""
    present = _element_fields(df, column)

    def filled(name: str) -> Column:
        return F.size(F.filter(col(column), lambda r: r.getField(name).isNotNull()))

    total = reduce(lambda a, b: a + b, [filled(f) for f in fields if f in present], F.lit(0))
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("removed_fields"))


def _element_fields(df: DataFrame, column: str) -> list[str]:
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return dtype.elementType.names
    return []


def drop_tasks(items: DataFrame, type_column: str = "type", dropped: str = "Task") -> DataFrame:
    """Items that are not tasks; an item without a type stays."""
    return items.where(~col(type_column).eqNullSafe(dropped))


def keep_linked(edges: DataFrame, items: DataFrame, edge_key: str = "tks_id", item_key: str = "id") -> DataFrame:
    """Edges whose item survives; edges without an item id go."""
    ids = items.select(col(item_key).alias(edge_key))
    return edges.join(ids, edge_key, "left_semi").select(*[col(c) for c in edges.columns])


def drop_tasks_nested(df: DataFrame, dropped: str = "Task", counters: Counters | None = None) -> DataFrame:
    """The same within each document: tasks go, then the links to them.

    Counts ``tasks removed`` and ``links removed``.
    """
    if counters is not None:
        df = df.withColumns({"_items": F.size("tks"), "_links": F.size("relationship")})
    df = df.withColumn("tks", F.filter("tks", lambda t: ~t["type"].eqNullSafe(dropped)))
    df = df.withColumn("relationship", _surviving_links())
    if counters is None:
        return df
    lost = {"tasks removed": ("_items", "tks"), "links removed": ("_links", "relationship")}
    df = counters.watch(settle(df, "tks", "relationship"), {
        name: F.coalesce(F.sum(F.col(before) - F.size(after)), F.lit(0)).cast("long") for name, (before, after) in lost.items()
    })
    return df.drop("_items", "_links")


def _surviving_links() -> Column:
    # Set operations hash their sides; the list searched per link holds only ids that don't survive.
    ids = F.array_compact(F.array_distinct(F.transform(F.col("tks"), lambda t: t["id"])))
    linked = F.array_except(F.array_compact(F.array_distinct(F.transform("relationship", lambda r: r["tks_id"]))), ids)
    return F.filter("relationship", lambda r: r["tks_id"].isNotNull() & ~F.array_contains(linked, r["tks_id"]))


def task_counts(df: DataFrame, dropped: str = "Task") -> DataFrame:
    """One row: tasks and links that dropping tasks removes."""
    after = drop_tasks_nested(
        df.withColumns({"_items": F.size("tks"), "_links": F.size("relationship")}), dropped
    )
    return after.agg(
        F.coalesce(F.sum(F.col("_items") - F.size("tks")), F.lit(0)).cast("long").alias("tasks_removed"),
        F.coalesce(F.sum(F.col("_links") - F.size("relationship")), F.lit(0)).cast("long").alias("links_removed"),
    )


def work_roles(df: DataFrame) -> DataFrame:
    roles = df.select(F.inline("work_role"))
    return roles.select("id", "title", col("alternative_title(s)").alias("alternative_titles"))


def items(df: DataFrame) -> DataFrame:
    return df.select(F.inline("tks")).select("id", "type", "description")


def relationships(df: DataFrame) -> DataFrame:
    return df.select(F.inline("relationship")).select("work_role_id", "tks_id")


def clean_catalogue(df: DataFrame) -> DataFrame:
    """Apostrophes, then role fields, then tasks and their links, all within the document."""
    return drop_tasks_nested(drop_role_fields(decode_apostrophes(df)))


def structure_profile(df: DataFrame) -> DataFrame:
    """(key, type, documents, items, min_items, max_items, fields) per top-level key.

    Types and fields come from the schema, the rest from one aggregation.
    """
    aggs, rows = [], []
    for i, f in enumerate(df.schema.fields):
        is_array = isinstance(f.dataType, T.ArrayType)
        size = F.size(col(f.name)) if is_array else F.lit(None).cast("int")
        aggs += [
            F.count(col(f.name)).alias(f"n{i}"),
            F.sum(F.when(col(f.name).isNotNull(), size)).alias(f"s{i}"),
            F.min(F.when(col(f.name).isNotNull(), size)).alias(f"lo{i}"),
            F.max(F.when(col(f.name).isNotNull(), size)).alias(f"hi{i}"),
        ]
        names = _element_fields(df, f.name) if is_array else getattr(f.dataType, "names", [])
        rows.append(F.struct(
            F.lit(f.name).alias("key"),
            F.lit(f.dataType.typeName()).alias("type"),
            F.col(f"n{i}").alias("documents"),
            F.col(f"s{i}").alias("items"),
            F.col(f"lo{i}").alias("min_items"),
            F.col(f"hi{i}").alias("max_items"),
            F.lit(", ".join(names)).alias("fields"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def first_items(df: DataFrame, column: str, key: str, count: int = 1) -> DataFrame:
    """A few sample items of one array, from the first documents by key."""
    picked = df.where(F.size(col(column)) > 0).orderBy(key).limit(count)
    return picked.select(col(key), F.to_json(F.get(col(column), F.lit(0))).alias("sample"))


def link_candidates(df: DataFrame) -> list[tuple[str, str, str]]:
    """(array, field, other array) where the field name holds the other array's name."""
    names = df.columns
    return [
        (key, field, other)
        for key in names
        for field in _element_fields(df, key)
        for other in names
        if other != key and other in field.lower()
    ]


def link_report(df: DataFrame, item_key: str = "id") -> DataFrame:
    """(from_key, field, to_key, links, matched) per inferred link.

    A link matches when its value exists among the other array's keys. The keys
    are made unique first, so each link joins at most one of them.
    """
    parts = []
    for key, field, other in link_candidates(df):
        values = df.select(F.inline(col(key))).select(col(field).cast("string").alias("v"))
        values = values.groupBy("v").agg(F.count("*").alias("n"))
        keys = df.select(F.inline(col(other))).select(col(item_key).cast("string").alias("v"))
        keys = keys.where("v IS NOT NULL").distinct().withColumn("hit", F.lit(1))
        joined = values.join(keys, "v", "left")
        parts.append(joined.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("links"),
            F.coalesce(F.sum(F.when(F.col("hit").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("matched"),
        ).select(
            F.lit(key).alias("from_key"), F.lit(field).alias("field"),
            F.lit(other).alias("to_key"), "links", "matched",
        ))
    if not parts:
        schema = "from_key string, field string, to_key string, links long, matched long"
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)
