"""Per-session memo of fitted artefacts (statistics, label maps, models, written tables).

A fit runs once per (Spark application, input folder and its files, artefact) and is reused by every query that needs
it, the way a saved model is reused. The files' names, sizes and times are part of the key, so changed inputs are
fitted anew; ``clear`` forgets everything of a session.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

_MEMO: dict[tuple, Any] = {}
_LOCKS: dict[tuple, threading.RLock] = {}
_GUARD = threading.Lock()


def input_version(spark: SparkSession, folder: str) -> int:
    """Changes when an entry of the folder is added, removed or rewritten (one listing, any file system)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    entries = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return hash(tuple(sorted((e.getPath().getName(), e.getLen(), e.getModificationTime()) for e in entries)))


def memo(spark: SparkSession, sf: str, name: str, fit: Callable[[], Any]) -> Any:
    """Fit once per key; concurrent callers of the same key wait for the first fit."""
    key = (spark.sparkContext.applicationId, sf, input_version(spark, sf), name)
    with _GUARD:
        lock = _LOCKS.setdefault(key, threading.RLock())
    with lock:
        if key not in _MEMO:
            _MEMO[key] = fit()
    return _MEMO[key]


def clear(spark: SparkSession) -> None:
    """Forget all artefacts of the session's application, and of applications that have ended."""
    with _GUARD:
        _MEMO.clear()
        _LOCKS.clear()
