"""Structured logs: one row per signature of records, the first of them kept and the worst level first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.functions import log
from loomsift.operators.lines import to_lines

KEY = ("level", "msg", "method", "status_class", "path_shape")


def records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, is_json, level, msg, method, status_class, path_shape) of the lines of NDJSON texts."""
    lines = to_lines(docs, key, text).where(F.trim("line") != "")
    parsed = lines.withColumn("r", log.record("line"))
    return parsed.select(
        key, "line_no", "line", "r.is_json", "r.level", "r.msg", "r.method", log.status_class("r.status").alias("status_class"), log.path_shape("r.path").alias("path_shape")
    )


def collapse(rows: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """(key, ord, the five key columns, n, first_line): groups of records by signature.

    The count and the first record are aggregates with map-side combine, so neither a large
    document nor a frequent signature meets in one task; only groups are ordered by document.
    """
    groups = rows.groupBy(key, *KEY).agg(F.count("*").alias("n"), F.min(order).alias("first_no"), F.min_by(line, order).alias("first_line"))
    by = Window.partitionBy(key).orderBy(F.desc(log.level_rank("level")), "first_no")
    return groups.withColumn("ord", F.row_number().over(by)).select(key, "ord", *KEY, "n", "first_line")
