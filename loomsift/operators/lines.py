"""Ordered lines as rows: splitting, filling down, runs, head and tail, and text again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_lines(text: Column) -> Column:
    """Lines of a text; CRLF counts as LF, and one empty line after the last line feed does not count."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.split(F.regexp_replace(unix, r"\n\z", ""), "\n")


def to_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) with line numbers from 0; null texts have no lines."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))


def to_text(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """(key, text): lines joined in their order, whatever order they arrive in."""
    held = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), F.col(line).alias("v"))))
    return lines.groupBy(key).agg(F.array_join(F.transform(held, lambda x: x["v"]), "\n").alias("text"))


def fill_down(lines: DataFrame, value: Column, name: str, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """The last value that is not null, from each line on down."""
    until = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(until))


def runs(lines: DataFrame, value: str, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """(key, start, value, length): runs of equal values in order."""
    by = Window.partitionBy(key).orderBy(order)
    fresh = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(by))).cast("int"), F.lit(1))
    marked = lines.withColumn("__fresh", F.when(F.row_number().over(by) == 1, 1).otherwise(fresh))
    numbered = marked.withColumn("__run", F.sum("__fresh").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "__run").agg(F.min(order).alias("start"), F.first(value).alias(value), F.count("*").alias("length")).drop("__run")


def head_tail(rows: DataFrame, head: int, tail: int, most: int, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """The first and last rows of a group that has more than ``most``; n_omitted says how many of its rows are gone."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    n = F.count("*").over(Window.partitionBy(key))
    ranked = rows.withColumn("__first", first).withColumn("__n", n)
    short = F.col("__n") <= most
    kept = ranked.where(short | (F.col("__first") <= head) | (F.col("__first") > F.col("__n") - tail))
    return kept.withColumn("n_omitted", F.when(short, 0).otherwise(F.col("__n") - head - tail)).drop("__first", "__n")


def collapse_blanks(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """The first of each run of blank lines, none at the end. Filter first: runs are those of the rows given."""
    by = Window.partitionBy(key).orderBy(order)
    blank = F.trim(F.col(line)) == ""
    marked = lines.withColumn("__again", blank & F.coalesce(F.lag(blank).over(by), F.lit(False)))
    after = F.max(F.when(~blank, F.col(order))).over(Window.partitionBy(key))
    return marked.withColumn("__last", after).where(~F.col("__again") & (F.col(order) <= F.col("__last"))).drop("__again", "__last")
