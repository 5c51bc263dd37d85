"""Versioned artefacts (A3-A5): the files of a version appear together or not at all.

A writer fills a folder of its own below ``versions`` and then creates one empty file below ``published``, whose name holds
a running number and the version. That creation is the commit: a writer that dies before it leaves the version before
as the current one, and readers never see half of a new one. Two writers at once have two folders, so their files never mix;
the later name is current. A reader asks once for the current version and keeps to that folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def published(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions below ``path``, oldest first."""
    at, fs = _files(spark, f"{path}/published")
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    return [n for n in names if not n.startswith((".", "_"))]


def current(spark: SparkSession, path: str) -> str:
    """The folder of the current version. None published yet raises."""
    names = published(spark, path)
    if not names:
        raise FileNotFoundError(f"no version is published below {path}")
    return f"{path}/versions/{names[-1].split('-', 1)[1]}"


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder, then make it the current version; returns the folder.

    If ``write`` raises, nothing is published and its folder is deleted.
    """
    version = uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    try:
        write(folder)
    except BaseException:
        at, fs = _files(spark, folder)
        fs.delete(at, True)
        raise
    names = published(spark, path)
    number = int(names[-1].split("-", 1)[0]) + 1 if names else 1
    at, fs = _files(spark, f"{path}/published/{number:012d}-{version}")
    fs.mkdirs(at.getParent())
    if not fs.createNewFile(at):
        raise FileExistsError(str(at))
    return folder


def forget_older(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions, their names first; returns how many went. No reader may hold them."""
    old = published(spark, path)[:-max(keep, 1)]
    for name in old:
        for folder in (f"{path}/published/{name}", f"{path}/versions/{name.split('-', 1)[1]}"):
            at, fs = _files(spark, folder)
            fs.delete(at, True)
    return len(old)
