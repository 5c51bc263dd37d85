"""Versioned artefacts: all or nothing, and writers that do not mix."""

import pytest

from lendscope import artefacts
from lendscope.session import scratch_path


def _write(spark, rows, steps=2, fail=False):
    def write(folder):
        for step in range(steps):
            spark.createDataFrame([(x, step) for x in rows], "x int, step int").write.parquet(f"{folder}/t{step}")
        if fail:
            raise RuntimeError("killed")
    return write


def _read(spark, folder, steps=2):
    return [sorted(r.x for r in spark.read.parquet(f"{folder}/t{s}").collect()) for s in range(steps)]


def test_versions(spark):
    path = scratch_path(spark, "test_artefacts/versions")
    with pytest.raises(FileNotFoundError):
        artefacts.current(spark, path)
    for steps in (0, 1, 2):  # killed before, between and after the tables
        with pytest.raises(RuntimeError):
            artefacts.publish(spark, path, _write(spark, [0], steps, fail=True))
        with pytest.raises(FileNotFoundError):
            artefacts.current(spark, path)
    first = artefacts.publish(spark, path, _write(spark, [1, 2]))
    assert artefacts.current(spark, path) == first and _read(spark, first) == [[1, 2], [1, 2]]
    with pytest.raises(RuntimeError):
        artefacts.publish(spark, path, _write(spark, [9], 1, fail=True))
    assert artefacts.current(spark, path) == first  # the version before stays readable

    inner = []

    def slow(folder):  # another writer publishes while this one writes
        _write(spark, [3], 1)(folder)
        inner.append(artefacts.publish(spark, path, _write(spark, [4])))
        assert artefacts.current(spark, path) == inner[0]
        spark.createDataFrame([(3, 1)], "x int, step int").write.parquet(f"{folder}/t1")

    last = artefacts.publish(spark, path, slow)
    assert artefacts.current(spark, path) == last and _read(spark, last) == [[3], [3]] and _read(spark, inner[0]) == [[4], [4]]
    assert _read(spark, first) == [[1, 2], [1, 2]]  # a reader that pinned it goes on
    assert artefacts.forget_older(spark, path, keep=1) == 2 and artefacts.current(spark, path) == last
    assert len(artefacts.published(spark, path)) == 1
