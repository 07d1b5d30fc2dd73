"""Translation through a table of results: every distinct chunk is rewritten once, in whatever run.

The texts that need it are cut into chunks, a row each, so that a long text is spread over
tasks. Chunks are known by the SHA-256 of their content. Those that the result table does
not hold are rewritten and added to it; then each text is put together again in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions.text import present, settle
from jobtide.operators.counters import Counters
from jobtide.operators.language import OUTCOMES, Rewriter, chunks, with_route
from jobtide.operators.records import col
from jobtide.session import scratch_path
from jobtide.sources.tables import first_per_key

#: Digest of a chunk and what it was rewritten to.
RESULT_SCHEMA = T.StructType([T.StructField("digest", T.StringType()), T.StructField("result", T.StringType())])


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def results(spark: SparkSession, path: str) -> DataFrame:
    """(digest, result) stored so far; none if there is no table yet.

    Every run adds a folder of its own, and these are named to the reader one by one: of two
    reads of one path Spark takes the second for the first, though files were added meanwhile.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [str(f.getPath()) for f in system.listStatus(place) if f.isDirectory()] if system.exists(place) else []
    if not folders:
        return spark.createDataFrame([], RESULT_SCHEMA)
    return spark.read.schema(RESULT_SCHEMA).parquet(*sorted(folders))


def chunk_rows(texts: DataFrame, size: int = 4000) -> DataFrame:
    """(text_digest, pos, digest, chunk) of each distinct text; ``texts`` has (text_digest, text)."""
    distinct = first_per_key(texts.select("text_digest", "text"), ["text_digest"], ["text"])
    rows = distinct.select("text_digest", F.posexplode(chunks(F.col("text"), size)).alias("pos", "chunk"))
    return rows.select("text_digest", "pos", _digest(F.col("chunk")).alias("digest"), "chunk")


def _rewritten(rows: DataFrame, load_rewriter: Callable[[], Rewriter]) -> DataFrame:
    """(digest, result) of each row; NULL where the rewriter fails. It is loaded once per task."""
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = load_rewriter()

        def one(chunk: str) -> str | None:
            try:
                return rewriter(chunk)
            except Exception:
                return None

        for batch in batches:
            yield batch.map(one)

    # Settled, so that a filter on the result does not call the rewriter again.
    return settle(rows.select("digest", run(F.col("chunk")).alias("result")), "result")


def add_results(rows: DataFrame, load_rewriter: Callable[[], Rewriter], path: str) -> None:
    """Rewrite the distinct chunks of ``chunk_rows`` that the table lacks, and add them. A failed chunk is not stored: the next run tries again."""
    spark = rows.sparkSession
    fresh = first_per_key(rows.select("digest", "chunk"), ["digest"], ["chunk"])
    missing = fresh.join(results(spark, path).select("digest"), "digest", "left_anti")
    # Few bytes, but much work: adaptive execution would put them into one task, unless the number of parts is named and
    # the rows are not dealt by this expression already.
    missing = missing.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("digest"))
    _rewritten(missing, load_rewriter).where("result IS NOT NULL").write.parquet(f"{path}/{uuid.uuid4().hex}")


def put_together(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """(text_digest, new) of each text: its results in order, NULL if one is missing."""
    # A result table may hold a chunk twice, if two runs met it at the same time.
    known = first_per_key(stored, ["digest"], ["result"])
    found = rows.select("text_digest", "pos", "digest").join(known, "digest", "left")
    parts = found.groupBy("text_digest").agg(
        F.sort_array(F.collect_list(F.struct("pos", "result"))).alias("parts"), F.count_if(F.col("result").isNull()).alias("failed"),
    )
    whole = F.array_join(F.transform("parts", lambda p: p["result"]), "")
    return parts.select("text_digest", F.when(F.col("failed") == 0, whole).alias("new"))


def translate_stored(
    df: DataFrame, fields: Sequence[str], load_rewriter: Callable[[], Rewriter], path: str, chunk_size: int = 4000,
    snippet_chars: int | None = None, detector: Callable[[Column], Column] | None = None, detect: bool = True,
    counters: Counters | None = None,
) -> DataFrame:
    """Rewrite the texts routed to translation, and add ``<field>_outcome``; like ``language.translate_fields``.

    What was rewritten stands in the table at ``path`` (a shared folder), so that equal texts and
    chunks, of any field and any run, are rewritten once. A text with a chunk that fails stays
    as it is. NULL, blank and repeated rows are fine, so are no rows; fields that do not
    exist are left out.
    """
    spark = df.sparkSession
    for field in fields:
        if field not in df.columns:
            continue
        routed = with_route(df, field, "_route", snippet_chars, detector, detect)
        wanted = F.col("_route") == "translate"
        texts = routed.where(wanted).select(_digest(col(field)).alias("text_digest"), col(field).alias("text"))
        # Stored: the table of results is asked twice, and texts would be routed and cut again.
        place = scratch_path(spark, "chunks")
        chunk_rows(texts, chunk_size).write.parquet(place)
        rows = spark.read.parquet(place)
        add_results(rows, load_rewriter, path)
        new = put_together(rows, results(spark, path)).withColumnRenamed("text_digest", "_digest")
        # Texts that stay get a key of their own: one key for all of them would be one task.
        own = F.concat(F.lit("stays "), F.xxhash64(*[col(c) for c in df.columns]).cast("string"))
        done = routed.withColumn("_digest", F.when(wanted, _digest(col(field))).otherwise(own)).join(new, "_digest", "left")
        outcome = (
            F.when(F.col("_route") == "missing", "missing").when(F.col("_route") == "skip", "skipped")
            .when(F.col("new").isNull(), "failed").otherwise("translated")
        )
        done = done.withColumn(f"{field}_outcome", outcome).withColumn(field, F.coalesce("new", col(field)))
        df = done.drop("_route", "_digest", "new")
        if counters is not None:
            df = counters.watch(df, {f"{field}: {o}": present(col(f"{field}_outcome") == o) for o in OUTCOMES})
    return df
