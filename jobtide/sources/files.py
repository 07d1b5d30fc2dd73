"""Reading and writing record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.lookups import UNUSED_FIELDS

POSTING_FIELDS = [
    "Title", "Description", "Primary Description", "Location", "Skill", "Created At", "Scraped At",
]
POSTING_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in POSTING_FIELDS])
RAW_POSTING_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in POSTING_FIELDS + UNUSED_FIELDS]
)


def read_records(
    spark: SparkSession, path: str, schema: T.StructType = POSTING_SCHEMA, lines: bool = False
) -> DataFrame:
    """Flat JSON records.

    A JSON array is parsed as a whole here, so each such file is one task;
    ``arrays.read_array`` reads a large one in many. JSON Lines (``lines=True``) split.
    Text that is neither an array nor an object is an error.
    """
    return spark.read.schema(schema).json(path, multiLine=not lines, mode="FAILFAST")


def read_documents(
    spark: SparkSession, path: str, schema: T.StructType, lines: bool = False
) -> DataFrame:
    """JSON objects, one row per document: one file each, or one line each."""
    return spark.read.schema(schema).json(path, multiLine=not lines, mode="FAILFAST")


def read_cleaned(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Cleaned records written as parquet, or as JSON Lines when a schema is given."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def output_name(stem: str, mode: str = "full", sample_size: int | None = None) -> str:
    return f"{stem}_sample_{sample_size}" if mode == "sample" else stem


def write_records(df: DataFrame, path: str, format: str = "json", mode: str = "overwrite") -> None:
    """One file per task. JSON leaves out NULL fields unless told otherwise."""
    writer = df.write.mode(mode)
    if format == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.format(format).save(path)


def export_flagged(df: DataFrame, path: str) -> None:
    """Write flagged records with the labels that fired."""
    write_records(df, path)


def scan(
    spark: SparkSession, path: str, columns: list[str], not_null: list[str] | None = None
) -> DataFrame:
    """Table scan with projection and NOT NULL filters, both pushed into the reader."""
    df = spark.read.parquet(path)
    for name in not_null or []:
        df = df.where(F.col(f"`{name}`").isNotNull())
    return df.select(*[F.col(f"`{c}`") for c in columns])


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parallel append; the committer makes all files visible together."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(location, country) from a JSON file with one object per line; of a repeated location the smaller country counts."""
    rows = spark.read.schema("location string, country string").json(path).where("location IS NOT NULL AND country IS NOT NULL")
    return rows.groupBy("location").agg(F.min("country").alias("country"))
