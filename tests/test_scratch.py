"""Scratch tables: kept, released, and freed by a mark."""

import threading

import pytest
from pyspark.errors import AnalysisException

from loomsift import scratch


def test_tables_are_freed(spark):
    first = scratch.materialise(spark.range(3), "first")
    at = scratch.mark()
    second = scratch.materialise(first, "second")
    third = scratch.materialise(second.selectExpr("id * 2 as id"), "third")
    scratch.release_since(spark, at, third)
    assert sorted(r.id for r in third.collect()) == [0, 2, 4] and first.count() == 3
    with pytest.raises(AnalysisException):
        spark.read.parquet(second.scratch_folder).count()
    scratch.release(first)
    with pytest.raises(AnalysisException):
        spark.read.parquet(first.scratch_folder).count()
    scratch.release_since(spark, at - 1)
    with pytest.raises(AnalysisException):
        spark.read.parquet(third.scratch_folder).count()


def test_marks_are_of_a_thread(spark):
    at = scratch.mark()
    held = []
    other = threading.Thread(target=lambda: held.append(scratch.materialise(spark.range(2), "other")))
    other.start()
    other.join()
    scratch.release_since(spark, at)
    assert held[0].count() == 2
