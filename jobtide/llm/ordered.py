"""Each row beside the next one in key order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from jobtide.llm.bytetext import column, slices, tidy


def with_next(
    df: DataFrame, key: str, text: str, outputs: list[StructField], work: Callable[[pa.Array, np.ndarray], list], per_partition: int = 4,
) -> DataFrame:
    """Columns that ``work`` makes of each text and the one behind it in key order (for the last row: the first).

    ``work`` gets a slice of texts and the indexes i whose next text is at i + 1.

    Rows are dealt into ranges of the key, by its quantiles, ``per_partition`` to a shuffle
    partition; the first row of each range is copied to the end of the one before. So
    every text moves once, and a task streams its ranges with one slice in memory. NULL
    keys come first; rows of equal keys follow the hash of their texts, and stay in one
    range; equal rows are each other's next. One row is its own next; no rows give none.
    """
    # Here, so that Python workers don't load it.
    from pyspark.ml.feature import Bucketizer

    spark = df.sparkSession
    ranges = per_partition * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(column(key).cast("long").alias("key"), column(text).cast("string").alias("text"), F.xxhash64(column(text).cast("string")).alias("h"))
    schema = StructType([StructField(key, LongType()), *outputs])
    cuts = np.unique(np.array(rows.select("key").approxQuantile("key", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)), np.float64))

    # The number of cuts that a key has reached. It is found without Python: a worker would stand beside those that make the outputs.
    reached = F.when(F.col("key").isNull(), F.lit(float("-inf"))).otherwise(F.col("key").cast("double"))
    if len(cuts):
        splits = [float("-inf"), *cuts.tolist(), float("inf")]
        rows = Bucketizer(splits=splits, inputCol="reached", outputCol="range").transform(rows.withColumn("reached", reached)).drop("reached")
        rows = rows.withColumn("range", F.col("range").cast("int"))
    else:
        rows = rows.withColumn("range", F.lit(0))
    place = F.struct(F.col("key").isNotNull().alias("some"), "key", "h")
    firsts = sorted(rows.groupBy("range").agg(F.min(place).alias("first")).collect(), key=lambda r: r["range"])
    if not firsts:
        return spark.createDataFrame([], schema)
    # One row per range, of which the session's partitions set the number.
    table = spark.createDataFrame(
        [(r["range"], firsts[i - 1]["range"], r["first"]["key"], r["first"]["h"]) for i, r in enumerate(firsts)],
        "range int, before int, first_key long, first_h long",
    )
    first = F.col("key").eqNullSafe(F.col("first_key")) & (F.col("h") == F.col("first_h"))
    own = F.struct(F.col("range").alias("at"), F.lit(False).alias("extra"))
    copy = F.struct(F.col("before").alias("at"), F.lit(True).alias("extra"))
    dealt = rows.join(F.broadcast(table), "range").withColumn("to", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.select("to.at", "to.extra", "key", "h", "text").repartition("at")
    dealt = dealt.sortWithinPartitions("at", "extra", F.col("key").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in slices(batch, "text"):
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                at = part.column(0).to_numpy()
                extra = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                use = np.flatnonzero((at[1:] == at[:-1]) & ~extra[:-1])
                if len(use):
                    made = work(part.column(4), use)
                    yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(use)), *made], [f.name for f in schema.fields])
                held = part.slice(part.num_rows - 1, 1)

    return dealt.mapInArrow(tidy(run), schema)
