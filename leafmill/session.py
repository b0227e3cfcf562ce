"""Session helpers: builder, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated plan size (bytes) that `small_side` will broadcast.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def build_session(app: str = "leafmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; callers may override any."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map=base | conf).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in spark.checkpoint.dir.

    Only where that setting is absent (a local test session) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor costs one stage only."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only if the optimizer's own size estimate is under `limit`.

    Without statistics the estimate is the product of the inputs, so a side of unknown
    size is never broadcast by this helper and the join stays a shuffle join.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def counted_side(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Hint a broadcast only if `df` is counted to hold at most `max_rows` narrow rows.

    For derived tables without statistics; beyond the bound the join stays a shuffle join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per Spark context.

    A zip of the package is added with `addPyFile`, so neither an installation on the
    executors nor a shared PYTHONPATH is needed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_leafmill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="leafmill-zip-")
    path = os.path.join(folder, "leafmill_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join("leafmill", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._leafmill_shipped = True
