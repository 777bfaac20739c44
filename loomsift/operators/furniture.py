"""Lines that recur over the pages of a document: running heads, feet and navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.operators.lines import to_lines

FRACTION, MOST_BYTES, LEAST_PAGES = 0.60, 120, 4


def furniture(pages: DataFrame, fraction: float = FRACTION, most_bytes: int = MOST_BYTES, least_pages: int = LEAST_PAGES, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, line, n_pages): trimmed lines on at least ``fraction`` of a document's pages, each counted once a page.

    Distinct (document, page, line) rows are counted, with map-side combine, so a line on all
    pages of a very large document is no hot key.
    """
    lines = pages.select(doc, page, F.explode(F.split(text, "\n")).alias("line")).select(doc, page, F.trim("line").alias("line"))
    lines = lines.where((F.col("line") != "") & (F.octet_length("line") <= most_bytes)).distinct()
    total = pages.groupBy(doc).agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= least_pages)
    counts = lines.groupBy(doc, "line").agg(F.count("*").alias("n_pages"))
    return counts.join(total, doc).where(F.col("n_pages") >= F.col("pages") * fraction).select(doc, "line", "n_pages")


def without(pages: DataFrame, found: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(page, line_no, line): the lines of pages that are not furniture."""
    lines = to_lines(pages, page, text).join(pages.select(page, doc), page)
    return lines.withColumn("__bare", F.trim("line")).join(found.select(F.col(doc), F.col("line").alias("__bare")), [doc, "__bare"], "left_anti").select(page, "line_no", "line")
