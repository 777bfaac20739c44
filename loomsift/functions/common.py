"""Regular-expression pieces that mean the same in Java as in RE2-like engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word boundaries over ASCII word characters, before and after a word.
WORD_START = "(?<![A-Za-z0-9_])"
WORD_END = "(?![A-Za-z0-9_])"
#: White space without the vertical tab.
WS = r"[ \t\n\f\r]"
#: Multi-line mode in which only a line feed ends a line.
LINES = "(?dm)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(col(c), F.lit(" \t\n\x0b\f\r"))


def distinct_matches(c: Column | str, pattern: str, group: int = 0) -> Column:
    """Distinct matches in the order of their first appearance."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), use)[0]
