"""Table semantics: mapping, keys, inserts, checks and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtide.operators.records import col
from jobtide.session import cut_lineage

POSTING_COLUMNS = {
    "Title": "title",
    "Description": "description",
    "Company": "company",
    "Primary Description": "primary_description",
    "Work Modality": "work_modality",
    "Location": "location",
    "Country": "country",
    "Skill": "skill",
    "Created At": "created_at",
    "Scraped At": "scraped_at",
}


def map_fields(df: DataFrame, names: Mapping[str, str] = POSTING_COLUMNS) -> DataFrame:
    """Select and rename; a missing field becomes NULL and extra fields are ignored."""
    return df.select(*[
        (col(old) if old in df.columns else F.lit(None).cast("string")).alias(new)
        for old, new in names.items()
    ])


def parse_timestamps(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Text to timestamp. A bad value becomes NULL, or fails the job when strict."""
    def parse(c: Column) -> Column:
        parsed = F.try_to_timestamp(c)
        if not strict:
            return parsed
        bad = c.isNotNull() & parsed.isNull()
        message = F.concat(F.lit("not a timestamp: "), c)
        return F.when(bad, F.raise_error(message).cast("timestamp")).otherwise(parsed)

    return df.withColumns({n: parse(col(n)) for n in columns})


def load_if_empty(source: DataFrame, *targets: DataFrame) -> DataFrame:
    """The source rows if every target is empty, else none.

    The emptiness test is a scalar subquery that stops at the first row found.
    """
    for target in targets:
        rows = target.limit(1).agg(F.count("*")).scalar()
        source = source.where(rows == 0)
    return source


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in the order; the other columns break its ties.

    Each task keeps one row per key before the shuffle, so a key that holds a large share
    of the rows costs no more than any other.
    """
    named = [c for c in order if c not in key]
    fields = [*named, *[c for c in df.columns if c not in key and c not in named]]
    if not fields:
        return df.select(*[col(c) for c in df.columns]).distinct()
    first = Window.partitionBy(*[col(k) for k in key]).orderBy(*[col(c) for c in fields])
    ranked = df.withColumn("_first", F.row_number().over(first)).where("_first = 1")
    return ranked.select(*[col(c) for c in df.columns])


def new_rows(
    source: DataFrame, target: DataFrame, key: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Rows an insert-if-absent adds: first per key, and only keys the target lacks."""
    fresh = first_per_key(source, key, order or source.columns)
    known = target.select(*[col(k) for k in key])
    return fresh.join(known, list(key), "left_anti").select(*[col(c) for c in source.columns])


def insert_if_absent(
    source: DataFrame, target: DataFrame, key: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """The target after the insert; existing rows win."""
    return target.unionByName(new_rows(source, target, key, order))


def write_bucketed(df: DataFrame, table: str, path: str, key: Sequence[str], buckets: int) -> None:
    """Store a table bucketed and sorted by its key, under a name of the session's catalogue; replaces one of that name.

    ``insert_into_bucketed`` then joins bucket to bucket: the stored rows are not moved again.
    """
    dealt = df.repartition(buckets, *[col(k) for k in key])
    dealt.write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).option("path", path).saveAsTable(table)


def buckets_of(spark: SparkSession, table: str) -> int:
    """Number of buckets of a stored table."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Num Buckets'").collect()
    if not rows:
        raise ValueError(f"{table} is not bucketed")
    return int(rows[0]["data_type"])


def new_bucketed_rows(
    source: DataFrame, table: str, key: Sequence[str], order: Sequence[str] | None = None, look_up: int = 0
) -> DataFrame:
    """Rows that an insert-if-absent adds to a bucketed table (keys must not be NULL there).

    Only the source is dealt, into as many parts as the table has buckets. Of the table
    the key columns are read, in place. If its key is one column, and the source has
    at most ``look_up`` keys, these become a filter, so that only their buckets are read; the
    source is then read twice.
    """
    spark = source.sparkSession
    keys = [col(k) for k in key]
    fresh = first_per_key(source.repartition(buckets_of(spark, table), *keys), key, order or source.columns)
    known = spark.table(table).select(*keys)
    if look_up and len(key) == 1:
        wanted = [r[0] for r in source.select(*keys).where(keys[0].isNotNull()).distinct().limit(look_up + 1).collect()]
        if len(wanted) <= look_up:
            known = known.where(keys[0].isin(wanted))
    # A hint keeps the join from sending the table's keys elsewhere.
    return fresh.join(known.hint("merge"), list(key), "left_anti").select(*[col(c) for c in source.columns])


def insert_into_bucketed(
    source: DataFrame, table: str, key: Sequence[str], order: Sequence[str] | None = None, look_up: int = 0
) -> None:
    """Add the rows whose key a bucketed table lacks; stored rows win. They are written into its buckets."""
    rows = new_bucketed_rows(source, table, key, order, look_up)
    rows.select(*[col(c) for c in source.sparkSession.table(table).columns]).write.insertInto(table)


def number_rows(
    df: DataFrame, order: Sequence[str] | None = None, into: str = "id", start: int = 1
) -> DataFrame:
    """Consecutive numbers in the given order, or in the order the rows are stored.

    Ordered rows are sorted into ranges over all tasks; rows with equal keys follow
    a hash of the whole row, which also lets a range end between them. Without an
    order no row moves, and the numbers follow the input's partitions. The rows
    are then checkpointed, so that the placement the numbers come from is fixed;
    only the row count of each task (one small row) comes to the driver.
    """
    if into in df.columns:
        raise ValueError(f"the rows already have a column {into}")
    columns = [col(c) for c in df.columns]
    placed = df
    if order:
        keys = [*[col(c) for c in order], F.xxhash64(*columns)]
        placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(placed.select(*columns, F.spark_partition_id().alias("_part"), place.alias("_place")))
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    earlier, offsets = start, []
    for part, count in counts:
        offsets.append((part, earlier))
        earlier += count
    table = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    # One row per task of the checkpointed table.
    numbered = placed.join(F.broadcast(table), "_part")
    return numbered.select((F.col("_place") + F.col("_before")).cast("long").alias(into), *columns)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    counts = df.groupBy(*[col(k) for k in key]).agg(F.count("*").alias("rows"))
    return counts.where("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(key, rows) of the non-null child keys without a parent; counted before they move."""
    counts = child.where(col(child_key).isNotNull()).groupBy(col(child_key)).agg(F.count("*").alias("rows"))
    return counts.join(parent.select(col(parent_key).alias(child_key)), child_key, "left_anti")


def check_table(
    df: DataFrame,
    key: Sequence[str],
    not_null: Sequence[str] = (),
    foreign: Mapping[str, tuple[DataFrame, str]] | None = None,
) -> DataFrame:
    """(check, violations) for the key, NOT NULL columns and foreign keys of a table."""
    name = ", ".join(key)
    checks = [
        duplicate_keys(df, key).agg(F.count("*").alias("violations"))
        .select(F.lit(f"unique {name}").alias("check"), "violations")
    ]
    if not_null:
        nulls = df.agg(*[F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(not_null)])
        rows = [
            F.struct(F.lit(f"not null {c}").alias("check"), F.col(f"c{i}").alias("violations"))
            for i, c in enumerate(not_null)
        ]
        checks.append(nulls.select(F.inline(F.array(*rows))))
    for child_key, (parent, parent_key) in (foreign or {}).items():
        missing = orphans(df, parent, child_key, parent_key)
        checks.append(
            missing.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations"))
            .select(F.lit(f"foreign key {child_key}").alias("check"), "violations")
        )
    return reduce(DataFrame.unionByName, checks)


def create_view(df: DataFrame, name: str) -> DataFrame:
    """Named view, replacing one of the same name."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def head_sample(
    df: DataFrame, key: Sequence[str], mode: str = "full", sample_size: int = 1000
) -> DataFrame:
    """The first rows in key order, or all rows in full mode."""
    if mode not in ("sample", "full"):
        raise ValueError("mode must be 'sample' or 'full'")
    if sample_size <= 0:
        raise ValueError("sample_size must be greater than 0")
    if mode == "full":
        return df
    return df.orderBy(*[col(k) for k in key]).limit(sample_size)
