"""Line filters of package managers and build tools on rows of lines, in SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.operators import distillers as of
from loomsift.operators.lines import collapse_blanks

# The distillers' patterns, for whole lines in SQL functions.
_at = lambda *patterns: "^(?:" + "|".join(patterns) + ")"
NPM_HEADER = _at(of.NPM_HEADER.pattern)
NPM_KEPT = _at(of.NPM_COUNTS.pattern, f"(?i:{of.NPM_SEVERITY.pattern})", of.NPM_PACKAGE.pattern + r"\z", "#")
CARGO_DROPPED, CARGO_MESSAGE, CARGO_POINTER = _at(of.CARGO_DROP.pattern), _at(of.CARGO_OPEN.pattern), _at(of.CARGO_POINTER.pattern)
CARGO_TEST = of.CARGO_TEST.pattern.replace("$", r"\s*\z")
CARGO_KEPT = rf"{_at(of.CARGO_PHASE.pattern)}|^\s*(?:{CARGO_TEST})|{of.CARGO_FAILED.pattern}"


def npm(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Messages, counts, severities and packages of (key, line_no, line); a notice once."""
    bare = F.trim("line")
    rows = lines.withColumn("line", bare)
    notice = F.col("line").rlike("^npm notice")
    first = F.row_number().over(Window.partitionBy(key, "line").orderBy(order))
    kept = rows.where((F.col("line") == "") | F.col("line").rlike(NPM_HEADER) | F.col("line").rlike(NPM_KEPT))
    # only notices are numbered: other lines would put equal text into one task for nothing
    once = kept.where(notice).withColumn("__n", first).where("__n = 1").drop("__n")
    return collapse_blanks(kept.where(~notice).unionByName(once), key, order)


def cargo(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Phases, messages with the place on the next line, and test results of (key, line_no, line)."""
    before = F.lag("line").over(Window.partitionBy(key).orderBy(order))
    rows = lines.withColumn("__before", F.coalesce(before, F.lit("")))
    line = F.col("line")
    pointed = F.col("__before").rlike(CARGO_MESSAGE) & line.rlike(CARGO_POINTER)
    kept = rows.where(~line.rlike(CARGO_DROPPED) & ((F.trim(line) == "") | line.rlike(CARGO_MESSAGE) | pointed | line.rlike(CARGO_KEPT)))
    return collapse_blanks(kept.drop("__before"), key, order)
