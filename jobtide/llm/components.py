"""Connected components of a graph given as a table of edges, by contraction."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.session import scratch_path


#: Spark removes the shuffle files of a run when it ends if this is set.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: cuts lineage, survives lost executors.

    The shuffle files of the run that wrote it go at its end: nothing reads them again.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Where the tables of ``written`` stand, as long as someone holds them.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def removed(*tables: DataFrame) -> None:
    """Removes tables that ``written`` gave and that no plan will read again; others are left alone."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the smallest id that can be reached.

    Each round points every id at its smallest neighbour, follows the pointers to their
    roots and keeps the edges between different roots, which shrink fast. Hot ids (the
    middle of a star) are combined before they move, and joins read plain tables, so that
    adaptive execution may split them. Self-loops and repeated edges change nothing; NULL
    ends are left out; no edges give no rows.
    """
    edges = written(
        edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(
            both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component")),
            "parents",
        )
        while True:
            above = parents.select(F.col("id").alias("component"), F.col("component").alias("root"))
            before, parents = parents, written(
                parents.select("id", "component").join(above, "component")
                .select("id", F.col("root").alias("component"), (F.col("root") != F.col("component")).alias("moved")),
                "parents",
            )
            removed(before)
            if parents.where("moved").isEmpty():
                break
        root = parents.select(F.col("id").alias("a"), F.col("component").alias("ra"))
        far = parents.select(F.col("id").alias("b"), F.col("component").alias("rb"))
        before, edges = edges, written(
            edges.join(root, "a").join(far, "b").where("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
        removed(before)
        if labels is None:
            labels = parents
        else:
            above = parents.select(F.col("id").alias("component"), F.col("component").alias("root"))
            before, labels = labels, written(
                labels.join(above, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels"
            )
            removed(before, parents)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.select("id", "component")
