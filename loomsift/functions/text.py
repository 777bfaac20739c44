"""Scalar text functions: sizes, headings, page kinds, token estimates, markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomsift.functions.common import WS, col

# Severity aliases, letters and ranks of lint findings.
SEVERITY_ALIASES = {
    "fatal": "error", "panic": "error", "crit": "error", "critical": "error", "err": "error", "e": "error", "f": "error", "warn": "warning", "w": "warning",
    "n": "note", "i": "info", "s": "style", "c": "convention", "r": "refactor", "high": "error", "medium": "warning", "low": "info",
}
SEVERITY_LETTERS = {"error": "E", "warning": "W", "info": "I", "note": "N", "style": "S", "convention": "C", "refactor": "R", "help": "H"}
SEVERITY_RANK = {"error": 4, "warning": 3, "info": 2, "style": 1, "note": 1, "convention": 1, "refactor": 1, "help": 0}
# Document titles that say nothing.
PLACEHOLDERS = ("untitled", "unknown", "none", "null", "n/a", "anonymous", "(anonymous)")
HEADING = r"^([1-9][0-9]*(?:\.[0-9]+){0,3})\.?[ \t\n\f\r]+([A-Z][^.\n]{0,59})\z"


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def human_size(n: Column | str) -> Column:
    """Whole mebibytes, kibibytes or bytes."""
    n = col(n).cast("long")
    mega, kilo = F.shiftright(n, 20), F.shiftright(n, 10)
    return F.when(mega >= 1, F.concat(mega.cast("string"), F.lit("MB"))).when(kilo >= 1, F.concat(kilo.cast("string"), F.lit("KB"))).otherwise(
        F.concat(n.cast("string"), F.lit("B"))
    )


def strip_ansi(s: Column | str) -> Column:
    return F.regexp_replace(col(s), "\\x1b\\[[0-9;]*[A-Za-z]", "")


def normal_severity(s: Column | str) -> Column:
    low = F.lower(col(s))
    return F.coalesce(lookup(SEVERITY_ALIASES, low), low)


def severity_letter(s: Column | str) -> Column:
    """Letter of a normal severity; the first letter of any other, ``?`` without one."""
    return F.coalesce(lookup(SEVERITY_LETTERS, col(s)), F.when(col(s) == "", "?").otherwise(F.upper(F.substring(col(s), 1, 1))))


def severity_rank(s: Column | str) -> Column:
    return F.coalesce(lookup(SEVERITY_RANK, col(s)), F.lit(0))


def promote_heading(line: Column | str) -> Column:
    """A numbered section title as a Markdown heading, a level deeper for each dot."""
    dots = F.length(F.regexp_replace(F.regexp_extract(col(line), HEADING, 1), "[^.]", ""))
    return F.when(col(line).rlike(HEADING), F.concat(F.repeat(F.lit("#"), F.least(dots + 2, F.lit(6))), F.lit(" "), F.trim(col(line)))).otherwise(col(line))


def page_kind(text: Column | str, has_images: Column) -> Column:
    """``blank``, ``scanned``, ``chart`` or ``text``; letters are ASCII letters and whatever lies above ASCII."""
    empty = ~col(text).rlike(r"[^ \t\n\x0B\f\r]")
    letters = F.regexp_count(col(text), F.lit(r"[A-Za-z]|[^\x00-\x7F]"))
    return F.when(empty & has_images, "scanned").when(empty, "blank").when((letters < 20) & has_images, "chart").otherwise("text")


def placeholder(title: Column | str) -> Column:
    return F.lower(F.trim(col(title))).isin(*PLACEHOLDERS)


def table_cell(s: Column | str) -> Column:
    """A cell of a Markdown table: white space squeezed, bars escaped."""
    return F.replace(F.trim(F.regexp_replace(col(s), f"{WS}+", " ")), F.lit("|"), F.lit("\\|"))


def collapse_space(s: Column | str) -> Column:
    return F.regexp_replace(col(s), r"[ \t\r\n]+", " ")


def collapse_blank_lines(s: Column | str) -> Column:
    return F.regexp_replace(col(s), r"\n{3,}", "\n\n")


def estimate_tokens(s: Column | str) -> Column:
    """A quarter of each run of ASCII letters and digits, rounded up, and one per run of white space and other character."""
    # quarters of runs, white space and single characters begin differently: one pass takes them in turn
    return F.regexp_count(col(s), F.lit(r"[A-Za-z0-9]{1,4}+|[ \t\n\f\r]++|[^A-Za-z0-9 \t\n\f\r]")).cast("long")


def sanitize_markers(s: Column | str) -> Column:
    """Control markers of chat models made harmless by a zero-width space."""
    return F.replace(F.replace(col(s), F.lit("<|"), F.lit("<​|")), F.lit("|>"), F.lit("|​>"))


def strip_thought(s: Column | str) -> Column:
    """Without closed thought blocks of up to 64 KiB; leading space goes with a block only."""
    gone = F.regexp_replace(col(s), r"(?s)<\|channel>thought.{0,65536}?<channel\|>", "")
    return F.when(gone == col(s), col(s)).otherwise(F.regexp_replace(gone, r"^[ \t\n\x0B\f\r]+", ""))
