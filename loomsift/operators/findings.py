"""Findings as rows: one-line linter reports in SQL functions, and reports by rule and by severity."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loomsift.functions.common import col, let
from loomsift.functions.text import lookup, normal_severity, severity_letter, severity_rank
from loomsift.operators.distillers import TERSE, VULN_ID, VULN_LETTERS, VULN_RANK, lint_findings, vulnerabilities

_GROUP = re.compile(r"\(\?P<(\w+)>")


#: What parts the fields of a rewritten line.
_PART = "\x01"
_FIELDS = ("file", "line", "col", "sev", "rule", "msg")


def _java(kind: str, pattern: str) -> tuple[str, str]:
    """A pattern with numbered groups, and the rewriting of a line that it matches as parted fields and its kind."""
    names = _GROUP.findall(pattern)
    numbered = _GROUP.sub("(", pattern).replace(r"\s*$", r"\s*\z")
    return numbered, _PART.join([f"${names.index(n) + 1}" if n in names else "" for n in _FIELDS] + [kind])


# Strings of which a line of each shape has one at least.
_HINTS = {
    "shellcheck": ("[SC",), "rubocop": ("C:", "W:", "E:", "R:", "F:"), "stylelint": ("]",), "eslint-compact": ("col",), "eslint-unix": ("[Error/", "[Warning/"),
    "golangci": (".go:",), "gosec": ("CWE-",), "flake": (":",), "gcc-short": ("warning:", "error:", "note:", "help:"), "mypy": ("error:", "warning:", "note:"), "tsc": ("): ",),
}


def terse(line: Column | str) -> Column:
    """The finding of a line on its own as a struct, null without one: the first shape that fits decides.

    A pattern is run once a line, and only on lines that have a string which its shape needs.
    """

    def first(line: Column, shapes: list) -> Column:
        if not shapes:
            return F.lit(None).cast("string")
        kind, compiled = shapes[0]
        rest = first(line, shapes[1:])
        hinted = F.lit(False)
        for hint in _HINTS[kind]:
            hinted = hinted | line.contains(hint)
        # a line that does not match comes back as it is; one that does has parts
        taken = let(F.regexp_replace(line, *_java(kind, compiled.pattern)), lambda x: F.when(x.contains(_PART), x))
        return F.coalesce(F.when(hinted, taken), rest)

    bare = F.translate(F.rtrim(col(line), F.lit(" \t\r\n\x0b\f")), _PART, " ")
    parted = let(bare, lambda x: first(x, list(TERSE)))
    return let(F.split(parted, _PART), _finding)


def terse_rows(lines: DataFrame, key: str = "doc_id", order: str = "ord", line: str = "line") -> DataFrame:
    """(key, order, kind, sev, file, line, col, rule, msg, help) of the lines that report a finding on their own."""
    # made rows of, so that no filter on the finding takes the line apart a second time
    return lines.select(key, order, F.inline(F.array_compact(F.array(terse(line)))))


def _finding(part: Column) -> Column:
    file, number, column, sev, rule, msg, kind = (part[i] for i in range(len(_FIELDS) + 1))
    sev = F.when(sev != "", F.lower(sev)).when(kind == "golangci", "error").otherwise("info")
    rule = F.when((rule == "") & (kind == "gcc-short") & ~sev.isin("note", "help"), F.concat(F.lit("-W"), sev)).otherwise(rule)
    whole = lambda c: F.coalesce(F.when(c != "", c).cast("int"), F.lit(0))
    found = F.struct(
        kind.alias("kind"), normal_severity(sev).alias("sev"), F.trim(file).alias("file"), whole(number).alias("line"), whole(column).alias("col"),
        rule.alias("rule"), F.trim(msg).alias("msg"), F.lit("").alias("help"),
    )
    return F.when(rule != "", found)


def _listed(find: Callable[[str], list[dict]], names: tuple[str, ...]) -> Callable:
    """Findings of whole texts as an array column, in Arrow batches."""
    kind = StructType([StructField(n, IntegerType() if n in ("line", "col") else StringType()) for n in names])

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find(t or ""))

    return F.pandas_udf(run, ArrayType(kind))


def lint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, kind, sev, file, line, col, rule, msg, help): findings of whole reports, of any shape."""
    made = _listed(lint_findings, ("kind", "sev", "file", "line", "col", "rule", "msg", "help"))
    return docs.select(key, F.posexplode(made(text)).alias("ord", "f")).select(key, "ord", "f.*")


def lint_report(found: DataFrame, key: str = "doc_id", order: str = "ord", most: int = 0) -> DataFrame:
    """(key, place, line): report rows, the worst and most frequent rules first, ``most`` findings of a rule if not 0.

    Ranks of rules are aggregates; only a rule's findings are numbered, and only if they are capped.
    """
    rules = found.groupBy(key, "rule").agg(F.max(severity_rank("sev")).alias("worst"), F.count("*").alias("n"))
    if most:
        number = F.row_number().over(Window.partitionBy(key, "rule").orderBy(order))
        rows = found.withColumn("number", number).where(F.col("number") <= most)  # before the join: a task keeps ``most`` of a rule
    else:
        rows = found.withColumn("number", F.col(order))
    rows = rows.join(rules, [key, "rule"])
    where = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.when(F.col("col") != 0, F.concat(F.lit(":"), F.col("col").cast("string"))).otherwise(""))
    said = F.concat_ws("\t", severity_letter("sev"), where, F.col("rule"), F.col("msg"))
    hint = F.when(F.col("help") != "", F.concat_ws("\t", F.lit("-"), where, F.col("rule"), F.concat(F.lit("help: "), F.col("help"))))
    more = F.when(F.lit(bool(most)) & (F.col("number") == most) & (F.col("n") > most), F.concat(F.lit("-\t\t"), F.col("rule"), F.lit("\t+"), (F.col("n") - most).cast("string"), F.lit(" more "), F.col("rule")))
    place = F.struct((-F.col("worst")).alias("worst"), (-F.col("n")).alias("n"), "rule", "number", F.col("part"))
    lines = rows.select("*", F.posexplode(F.array(said, hint, more)).alias("part", "report")).where("report is not null")
    return lines.select(key, place.alias("place"), F.col("report").alias("line"))


def vulns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, lib, vuln, sev, status, installed, fixed, title): rows of vulnerability tables."""
    made = _listed(vulnerabilities, ("lib", "vuln", "sev", "status", "installed", "fixed", "title"))
    return docs.select(key, F.posexplode(made(text)).alias("ord", "f")).select(key, "ord", "f.*")


def vuln_report(found: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """(key, rank, line): a line per valid finding; library, severity and version hold until they change."""
    until = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lambda c: F.coalesce(F.last(F.when(c != "", c), ignorenulls=True).over(until), F.lit(""))
    rows = found.withColumns({"lib": held(F.col("lib")), "sev": held(F.lower(F.trim(F.col("sev")))), "installed": held(F.col("installed"))})
    rows = rows.where(F.col("vuln").rlike(f"^(?:{VULN_ID.pattern})\\z"))
    title = F.trim(F.regexp_replace(F.regexp_replace("title", r"(?<![A-Za-z0-9_])https?://\S+", ""), r"\s+", " "))
    letter = F.coalesce(lookup(VULN_LETTERS, F.col("sev")), F.when(F.col("sev") == "", "?").otherwise(F.upper(F.substring("sev", 1, 1))))
    lib = F.when(F.col("installed") != "", F.concat_ws("@", "lib", "installed")).otherwise(F.col("lib"))
    fixed = F.when(F.trim("fixed") == "", "-").otherwise(F.trim("fixed"))
    return rows.select(key, F.coalesce(lookup(VULN_RANK, F.col("sev")), F.lit(0)).alias("rank"), F.concat_ws("\t", letter, lib, F.col("vuln"), fixed, title).alias("line"))


def go_failures(events: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """From (key, ord, action, package, test, output): (key, ord, line) of failed tests' output, in order, then skips and packages."""
    failed = events.where("action = 'fail' and test is not null").groupBy(key, "test").agg(F.min(order).alias("at"))
    heads = failed.select(key, F.struct(F.lit(0).alias("k"), F.col("at"), F.lit(-1).cast("long").alias("o")).alias("ord"), F.concat(F.lit("--- FAIL: "), F.col("test")).alias("line"))
    said = events.where("action = 'output'").join(failed, [key, "test"]).where(F.trim("output") != "").where(~F.col("output").rlike(r"^\s*(?:=== |--- (?:PASS|FAIL|SKIP):)"))
    bodies = said.select(key, F.struct(F.lit(0).alias("k"), F.col("at"), F.col(order).cast("long").alias("o")).alias("ord"), F.concat(F.lit("    "), F.trim("output")).alias("line"))
    skips = events.where("action = 'skip' and test is not null").groupBy(key).agg(F.count("*").alias("n"))
    skips = skips.select(key, F.struct(F.lit(1).alias("k"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("o")).alias("ord"), F.concat(F.lit("(skipped "), F.col("n").cast("string"), F.lit(" test(s))")).alias("line"))
    packages = events.where("action in ('pass', 'fail') and test is null and package is not null")
    packages = packages.select(key, F.struct(F.lit(2).alias("k"), F.col(order).cast("long").alias("at"), F.lit(0).cast("long").alias("o")).alias("ord"), F.concat(F.when(F.col("action") == "pass", "ok ").otherwise("FAIL "), F.col("package")).alias("line"))
    heads, bodies = (x.withColumn("ord", F.struct(F.col("ord.k"), F.col("ord.at").cast("long").alias("at"), F.col("ord.o"))) for x in (heads, bodies))
    return heads.unionByName(bodies).unionByName(skips).unionByName(packages)


def diff_stat(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """(key, at, file, added, removed): counts by file of unified diffs, of lines after the first hunk of a file."""
    header = F.col(line).rlike(r"^diff --git a/\S+ b/\S+")
    until = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("at", F.last(F.when(header, F.col(order)), ignorenulls=True).over(until))
    rows = rows.withColumn("hunk", F.last(F.when(header, F.lit(-1)).when(F.col(line).startswith("@@ "), F.col(order)), ignorenulls=True).over(until))
    name = F.regexp_extract(line, r"^diff --git a/(\S+) b/\S+", 1)
    inside = F.col("hunk") >= 0
    return rows.where("at is not null").groupBy(key, "at").agg(
        F.max(F.when(header, name)).alias("file"),
        F.count_if(inside & F.col(line).startswith("+") & ~F.col(line).startswith("+++")).alias("added"),
        F.count_if(inside & F.col(line).startswith("-") & ~F.col(line).startswith("---")).alias("removed"),
    )
