"""Session helpers: a local session for tests / bench and the shared checkpoint folder."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "lendscope") -> SparkSession:
    """Local session used by tests and bench.py (cluster jobs bring their own session)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, as the context has it.

    A private scratch folder is set only for a ``local`` master without that setting (tests); elsewhere its absence
    is an error, since executors would write to their own disks.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not configured and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lendscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back.

    Lineage ends at files that every executor can read, so a lost executor costs a re-read.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def forget(table: DataFrame) -> None:
    """Delete the files of a table from ``written`` that no later step reads (nothing for any other DataFrame)."""
    at = table.__dict__.pop("_written_at", None)
    if at:
        remove(table.sparkSession, at)


def remove(spark: SparkSession, at: str) -> None:
    """Delete a file or folder of the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Sums of more tasks than this are added by a tree of tasks before the driver gets them.
TASKS_TO_DRIVER = 64


def added_up(parts: RDD, add: Callable[[Any, Any], Any]) -> Any:
    """One sum of an RDD's elements, of which every task has one."""
    return parts.treeReduce(add, 2) if parts.getNumPartitions() > TASKS_TO_DRIVER else functools.reduce(add, parts.collect())


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and read it back (lineage cut).

    Used before multi-pass fits so the joins behind an input are not recomputed
    for every statistic, and so a lost executor costs a re-read, not a recompute.
    """
    return written(df, "table")


def slug(text: str) -> str:
    """A folder-safe name for an input path (scratch subfolders per input)."""
    return re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_")
