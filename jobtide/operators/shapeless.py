"""Catalogue documents of unknown shape: keys, types and links are found in the data, document by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.operators.records import col

ESCAPE, QUOTE = "\\u2019", "’"
#: Arrays whose names are compared with field names.
NAMES = 10_000


def parsed(df: DataFrame, column: str) -> DataFrame:
    """(doc) as VARIANT, from a column of JSON texts; NULL texts are left out, malformed ones fail."""
    return df.where(col(column).isNotNull()).select(F.parse_json(col(column)).alias("doc"))


def decode_apostrophes_text(c: Column) -> Column:
    """The JSON text with the written-out escape of the right quote as the character, in strings at any depth.

    The text is written anew first: then a backslash within a string is always two, and none begins an escape of the quote.
    """
    plain = F.to_json(F.parse_json(c))
    return F.replace(plain, F.lit("\\" + ESCAPE), F.lit(QUOTE))


def _exploded(df: DataFrame, column: str, name: str, value: str) -> DataFrame:
    """The rows with (name, value) of each key or element of a VARIANT column; others have none."""
    parts = df.sparkSession.tvf.variant_explode(F.col(column).outer())
    return df.lateralJoin(parts).select(*[col(c) for c in df.columns], F.col("key").alias(name), F.col("value").alias(value))


def kind_of(c: Column) -> Column:
    """Type of a VARIANT in lower case: object, array, string, bigint, boolean, void, ..."""
    return F.lower(F.regexp_extract(F.schema_of_variant(c), "^[A-Z]+", 0))


def top_level(docs: DataFrame) -> DataFrame:
    """(name, content) of every top-level key of every document; documents that are no objects have none."""
    return _exploded(docs, "doc", "name", "content").where("name IS NOT NULL").drop("doc")


def element_fields(top: DataFrame) -> DataFrame:
    """(name, field, value) of the fields of the objects within top-level arrays, and of top-level objects."""
    kinds = top.withColumn("kind", kind_of(F.col("content")))
    objects = kinds.where("kind = 'object'").select("name", F.col("content").alias("item"))
    items = _exploded(kinds.where("kind = 'array'").select("name", "content"), "content", "_", "item").select("name", "item")
    return _exploded(objects.unionByName(items).where(kind_of(F.col("item")) == "object"), "item", "field", "value").drop("item")


def structure_profile(docs: DataFrame) -> DataFrame:
    """(key, types, documents, items, min_items, max_items, fields) per top-level key that some document has.

    ``types`` are all that occur, ``items`` count array elements, ``fields`` are those of the
    objects within, each sorted and joined. Documents may have any keys, of any types.
    """
    top = top_level(docs).withColumn("kind", kind_of(F.col("content")))
    size = F.when(F.col("kind") == "array", F.size(F.col("content").cast("array<variant>")))
    counts = top.groupBy("name").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("types"), F.count("*").alias("documents"),
        F.sum(size).cast("long").alias("items"), F.min(size).alias("min_items"), F.max(size).alias("max_items"),
    )
    fields = element_fields(top.drop("kind")).groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("fields"))
    return counts.join(fields, "name", "left").select(
        F.col("name").alias("key"), "types", "documents", "items", "min_items", "max_items", F.coalesce("fields", F.lit("")).alias("fields"),
    )


def link_report(docs: DataFrame, item_key: str = "id") -> DataFrame:
    """(from_key, field, to_key, links, matched): fields whose name holds the name of another top-level key with items.

    A link matches when its value, as text, is among the other's ``item_key`` values. One
    pass over the values serves all pairs. More than ``NAMES`` distinct keys with items raise ``ValueError``.
    """
    spark = docs.sparkSession
    cells = element_fields(top_level(docs)).select("name", "field", F.col("value").cast("string").alias("v"))
    shapes = [(r["name"], r["field"]) for r in cells.select("name", "field").distinct().limit(NAMES + 1).collect()]
    if len(shapes) > NAMES:
        raise ValueError(f"more than {NAMES} fields")
    names = {name for name, _ in shapes}
    pairs = [(name, field, other) for name, field in shapes for other in names if other != name and other in field.lower()]
    wanted = F.broadcast(spark.createDataFrame(pairs, "name string, field string, other string"))
    # Counted before they move: one value may stand in very many links.
    links = cells.join(wanted, ["name", "field"]).groupBy("name", "field", "other", "v").agg(F.count("*").alias("n"))
    keys = cells.where((F.col("field") == item_key) & F.col("v").isNotNull()).select(F.col("name").alias("other"), "v").distinct()
    joined = links.join(keys.withColumn("hit", F.lit(True)), ["other", "v"], "left")
    return joined.groupBy(F.col("name").alias("from_key"), "field", F.col("other").alias("to_key")).agg(
        F.sum("n").alias("links"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).cast("long").alias("matched"),
    )
