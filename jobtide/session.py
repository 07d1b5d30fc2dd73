"""Session helpers: defaults, and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import importlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "jobtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join handling and the UTC zone."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_packages(spark)
    return spark


_shipped: set[tuple[str, str]] = set()

#: Bytes of a batch of rows on its way to Python, and the setting that bounds them. Batches are bounded in rows as
#: well, but ten thousand long texts are too much to hold several times.
BATCH_BYTES, _BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches sent to Python in bytes, unless the application was started with a bound of its own."""
    if spark.sparkContext.getConf().get(_BATCH_SETTING) is None:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def ship_packages(spark: SparkSession, *names: str) -> None:
    """Let Python workers import this package (and others), once per application, in batches of bounded size.

    Needed wherever the package is not installed on the executors.
    """
    bound_batches(spark)
    sc = spark.sparkContext
    for name in names or ("jobtide",):
        if (sc.applicationId, name) in _shipped:
            continue
        root = Path(importlib.import_module(name).__file__).parent
        target = Path(tempfile.mkdtemp(prefix="jobtide-")) / name
        # The driver hands the archive to the executors itself.
        sc.addPyFile(shutil.make_archive(str(target), "zip", root.parent, root.name))
        _shipped.add((sc.applicationId, name))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session may fall back on a temporary folder; on a cluster an
    unset ``spark.checkpoint.dir`` is an error, since a machine-local folder
    would be lost together with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="jobtide-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, and pins the row placement."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
