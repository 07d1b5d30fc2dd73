"""Reports that are answered from small stored tables: pages of an ordered listing, and distinct postings as bitmaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.operators.records import col, in_countries
from jobtide.operators.reports import at_least_one

#: Order of the mapping listing: lowest similarity first, then by skill and item.
MAPPING_ORDER = ("similarity", "normalized_skill", "skill_id", "tks_id")


# --- pages ------------------------------------------------------------------
def write_pages(rows: DataFrame, path: str, order: Sequence[str] = MAPPING_ORDER, rows_per_block: int = 10_000) -> None:
    """Sort rows once and store them in blocks, with an index of the blocks.

    The rows are sorted into ranges over all tasks; each task writes its range in blocks of
    ``rows_per_block``, a folder each, so that a page opens no other. The index has a row per
    block: the place of its first row in its range, its rows, the rows of all blocks before
    it, and its first and last key. Only the row count of each task comes to the driver.
    """
    spark, each = rows.sparkSession, at_least_one("rows_per_block", rows_per_block)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = rows.orderBy(*[col(c) for c in order])
    placed = sorted_rows.select(F.struct(*[col(c) for c in rows.columns]).alias("row"), F.spark_partition_id().cast("long").alias("part"), place.alias("place"))
    block = F.shiftleft(F.col("part"), 32) + F.floor(F.col("place") / each)
    placed.select("row", "place", block.alias("block")).write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows")
    stored = _stored(spark, path, placed.schema["row"].dataType)
    key = F.struct(*[F.col("row").getField(c).alias(c) for c in order])
    blocks = stored.groupBy("block").agg(
        F.min("place").alias("start"), F.count("*").alias("rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"),
    ).withColumn("part", F.shiftright("block", 32))
    offsets, earlier = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("rows").alias("n")).collect()):
        offsets.append((part, earlier))
        earlier += n
    # One row per task that wrote.
    index = blocks.join(F.broadcast(spark.createDataFrame(offsets, "part long, earlier long")), "part")
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("earlier") + F.coalesce(F.sum("rows").over(within), F.lit(0))
    # The type of the rows, for a listing without any.
    kind = F.lit(None).cast(placed.schema["row"].dataType).alias("kind")
    index.select("block", "start", before.alias("before"), "rows", "first_key", "last_key", kind).write.mode("overwrite").parquet(f"{path}/index")


def _stored(spark: SparkSession, path: str, kind: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("row", kind), T.StructField("place", T.LongType()), T.StructField("block", T.LongType())])
    return spark.read.schema(schema).parquet(f"{path}/rows")


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """(block, start, before, rows, first_key, last_key) of the stored blocks."""
    return spark.read.parquet(f"{path}/index").drop("kind")


def stored_page(spark: SparkSession, path: str, page: int = 1, page_size: int = 50, order: Sequence[str] = MAPPING_ORDER) -> DataFrame:
    """One page of stored rows, read from the blocks that hold it; a page past the end has no rows."""
    size, first = at_least_one("page_size", page_size), (at_least_one("page", page) - 1) * page_size
    index = spark.read.parquet(f"{path}/index")
    holding = index.where((F.col("before") < first + size) & (F.col("before") + F.col("rows") > first))
    wanted = [
        (F.col("block") == r["block"]) & F.col("place").between(first - r["before"] + r["start"], first + size - 1 - r["before"] + r["start"])
        for r in holding.select("block", "start", "before").collect()
    ]
    rows = _stored(spark, path, index.schema["kind"].dataType)
    found = rows.where(reduce(lambda a, b: a | b, wanted) if wanted else F.lit(False))
    return found.select("row.*").orderBy(*[col(c) for c in order])


def stored_summary(spark: SparkSession, path: str, page: int = 1, page_size: int = 50) -> DataFrame:
    """One row: total rows, total pages (at least one) and the page shown, from the index alone."""
    size, page = at_least_one("page_size", page_size), at_least_one("page", page)
    total = F.coalesce(F.sum("rows"), F.lit(0)).cast("long")
    pages = F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long")
    return page_index(spark, path).agg(total.alias("total")).select(
        "total", pages.alias("total_pages"), F.least(F.lit(page), pages).cast("long").alias("page"),
    )


# --- distinct postings -----------------------------------------------------
def _dealt(rows: DataFrame, *key: Column | str) -> DataFrame:
    """Rows dealt by a grouping key, so that groups are formed once, where they end.

    Bitmaps are aggregated by sorting; partial ones of 4 KB would be made, sorted and moved for every task that
    has a posting of a group. The number of parts is named: adaptive execution counts compressed bytes.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def _bits(rows: DataFrame, *key: str) -> DataFrame:
    rows = _dealt(rows.withColumn("bucket", F.bitmap_bucket_number("posting")), *key, "bucket")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("posting")).alias("postings")
    return rows.groupBy(*key, "bucket").agg(bits)


def posting_bitmaps(bridge: DataFrame, postings: DataFrame) -> DataFrame:
    """(country, normalized_skill, bucket, postings): the distinct postings of each skill and country, as bits.

    The rows with a NULL skill hold all postings of the country. Bitmaps of one bucket
    (32,768 ids, 4 KB) are exact and can be united over countries, so that any
    list of countries is answered from this table, without the lines that it came from. Posting
    ids are integers; NULL ids, skills and countries take no part.
    """
    placed = postings.where("country IS NOT NULL AND id IS NOT NULL").select(col("id").cast("long").alias("posting"), "country")
    pairs = bridge.where("normalized_skill IS NOT NULL").select(col("job_posting_id").cast("long").alias("posting"), "normalized_skill")
    every = _bits(placed, "country").select("country", F.lit(None).cast("string").alias("normalized_skill"), "bucket", "postings")
    return _bits(pairs.join(placed, "posting"), "country", "normalized_skill").unionByName(every)


def united(bitmaps: DataFrame, *key: str) -> DataFrame:
    """(key, n): distinct postings over all rows of each key."""
    merged = _dealt(bitmaps, *key, "bucket").groupBy(*key, "bucket").agg(F.bitmap_or_agg("postings").alias("postings"))
    return merged.groupBy(*key).agg(F.sum(F.bitmap_count("postings")).cast("long").alias("n"))


def stored_frequency(bitmaps: DataFrame, countries: Sequence[str] | None = None, top_n: int = 30) -> DataFrame:
    """(normalized_skill, occurrences, total_postings, frequency): the n most frequent skills in the listed countries together."""
    rows = in_countries(bitmaps, "country", countries)
    total = united(rows.where("normalized_skill IS NULL")).select(F.coalesce("n", F.lit(0).cast("long"))).scalar()
    counts = united(rows.where("normalized_skill IS NOT NULL"), "normalized_skill").withColumnRenamed("n", "occurrences")
    top = counts.orderBy(F.desc("occurrences"), "normalized_skill").limit(at_least_one("top_n", top_n))
    return top.withColumn("total_postings", total).withColumn("frequency", F.col("occurrences") / F.col("total_postings"))


def stored_demand(bitmaps: DataFrame, top_n: int = 5, countries: Sequence[str] | None = None) -> DataFrame:
    """(country, total_postings, rank, skill, count): n skills of each listed country."""
    rows = in_countries(bitmaps, "country", countries)
    totals = united(rows.where("normalized_skill IS NULL"), "country").withColumnRenamed("n", "total_postings")
    counts = united(rows.where("normalized_skill IS NOT NULL"), "country", "normalized_skill").withColumnRenamed("n", "count")
    order = Window.partitionBy("country").orderBy(F.desc("count"), "normalized_skill")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= at_least_one("top_n", top_n))
    return top.join(totals, "country").select("country", "total_postings", "rank", col("normalized_skill").alias("skill"), "count")
