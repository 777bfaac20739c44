"""Signatures, levels and key tokens of log lines."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from loomsift.functions.common import WORD_END, WORD_START, col, let, strip

# Shape keys of structured records, the most telling first.
SHAPE_KEYS = (
    "level", "detected_level", "severity", "lvl", "method", "RequestMethod", "http.method", "status", "status_code", "DownstreamStatus", "OriginStatus",
    "RequestPath", "path", "url.path", "caller", "logger", "log.logger", "msg", "message", "error", "err", "action", "event", "RouterName", "ServiceName",
    "service_name", "service",
)
STATUS = {"status", "status_code", "DownstreamStatus", "OriginStatus"}
PATHS = {"RequestPath", "path", "url.path"}
MESSAGES = {"msg", "message", "error", "err"}
NESTS = ("labels", "attributes", "fields")
# Level words, aliases and ranks.
LEVELS = ("fatal", "panic", "error", "err", "critical", "crit", "warn", "warning", "info", "debug", "trace")
ALIASES = {"panic": "error", "err": "error", "critical": "error", "crit": "error", "warning": "warn"}
RANK = {"error": 5, "fatal": 5, "warn": 4, "info": 3, "debug": 2, "trace": 1, "unknown": 0}
# Patterns of variable parts and of key tokens.
_HEX = "[0-9a-fA-F]"
UUID = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
KEY_TOKEN = (
    r"(?:[A-Za-z]:[\\/][^ \t\n\f\r\"']+)|(?:/[^ \t\n\f\r\"']{2,})"
    f"|(?:{WORD_START}[0-9]{{3}}{WORD_END})|(?:{WORD_START}[A-Z]{{2,}}[0-9]+{WORD_END})"
    rf"|(?:{WORD_START}v?[0-9]+\.[0-9]+\.[0-9]+(?:-[A-Za-z0-9.+-]+)?{WORD_END})"
)
PLAIN_BYTES, SHAPED_BYTES, SAMPLE_CHARS, MOST_KEYS = 80, 200, 240, 12


def plain_signature(line: Column | str) -> Column:
    """A line of text with its variable parts named and all else in kebab case.

    The long patterns are run on lines that have eight hexadecimal digits in a row, or a digit, alone.
    """

    def named(s: Column, has: str, pattern: str, name: str) -> Column:
        return F.when(s.rlike(has), F.regexp_replace(s, pattern, name)).otherwise(s)

    def kebab(s: Column) -> Column:
        return F.btrim(F.regexp_replace(s, "[^A-Za-z0-9<>]+", "-"), F.lit("-"))

    word = lambda p: f"{WORD_START}{p}{WORD_END}"
    long_hex = f"{_HEX}{{8}}"
    s = let(strip(line), lambda x: named(x, long_hex, word(UUID), "<uuid>"))
    s = let(s, lambda x: named(x, "[0-9]", word(IP), "<ip>"))
    s = let(s, lambda x: named(x, long_hex, word(f"{_HEX}{{8,}}"), "<hex>"))
    s = let(s, lambda x: kebab(F.regexp_replace(x, "[0-9]+", "<n>")))
    return let(s, lambda x: F.when(x == "", "unknown").otherwise(F.substring(F.lower(x), 1, PLAIN_BYTES)))


def text_level(line: Column | str) -> Column:
    """Level of the first level word in a line, else ``unknown``; the pattern is run on lines that have the start of such a word alone."""
    stems = {w for w in LEVELS if not any(w != x and w.startswith(x) for x in LEVELS)}
    hinted = let(F.lower(col(line)), lambda x: reduce(or_, [x.contains(w) for w in sorted(stems)]))
    word = F.when(hinted, F.lower(F.regexp_extract(col(line), f"(?i){WORD_START}({'|'.join(LEVELS)}){WORD_END}", 1))).otherwise("")
    aliases = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return let(word, lambda w: F.when(w == "", "unknown").otherwise(F.coalesce(aliases[w], w)))


def level_rank(level: Column | str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[col(level)], F.lit(0))


def status_class(status: Column | str) -> Column:
    """The first of three or more digits and ``xx``; the status itself if it has fewer."""
    digits = F.regexp_replace(col(status), "[^0-9]", "")
    return F.when(F.length(digits) >= 3, F.concat(F.substring(digits, 1, 1), F.lit("xx"))).otherwise(col(status))


def path_stem(path: Column | str) -> Column:
    """The first four segments of a path, identifiers and numbers named."""
    cut = F.split(F.split(col(path), "[?#]", 2)[0], "/")
    segments = F.slice(F.filter(cut, lambda s: s != ""), 1, 4)

    def name(s: Column) -> Column:
        kinds = F.when(s.rlike(f"^{UUID}\\z"), "<uuid>").when(s.rlike(f"^{_HEX}{{8,}}\\z"), "<hex>").when(s.rlike(r"^[0-9]+\z"), "<n>")
        return kinds.otherwise(s)

    return F.when(F.size(segments) == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.transform(segments, name), "/")))


def key_tokens(line: Column | str) -> Column:
    """Paths, three-digit numbers, error codes and versions in a line, in order."""
    return F.regexp_extract_all(col(line), F.lit(KEY_TOKEN), F.lit(0))


def sample(line: Column | str) -> Column:
    return F.when(F.length(col(line)) > SAMPLE_CHARS, F.concat(F.substring(col(line), 1, SAMPLE_CHARS), F.lit("…"))).otherwise(col(line))


# structured records, in Python: JSON objects of any shape

_W = re.compile
_PY_PLAIN = [(_W(rf"\b{UUID}\b", re.A), "<uuid>"), (_W(rf"\b{IP}\b", re.A), "<ip>"), (_W(rf"\b{_HEX}{{8,}}\b", re.A), "<hex>"), (_W("[0-9]+"), "<n>")]
_PY_LEVEL = _W(rf"\b({'|'.join(LEVELS)})\b", re.A | re.I)


def parse_object(line: str) -> dict | None:
    """The object that starts at the first brace and ends with the line."""
    at = line.find("{")
    if at < 0:
        return None
    try:
        found = json.loads(line[at:], parse_float=str, parse_int=str)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def lookup(record: dict, key: str) -> str | None:
    """A scalar of the record, or one level down."""
    for place in (record, *(record.get(n) for n in NESTS)):
        if isinstance(place, dict) and key in place:
            value = place[key]
            if isinstance(value, bool):
                return str(value)
            if isinstance(value, str):
                return value
    return None


def _stem(path: str) -> str:
    segments = [s for s in re.split("[?#]", path, maxsplit=1)[0].split("/") if s][:4]
    kinds = ((UUID, "<uuid>"), (f"{_HEX}{{8,}}", "<hex>"), ("[0-9]+", "<n>"))
    return "/" + "/".join(next((n for p, n in kinds if re.fullmatch(p, s)), s) for s in segments) if segments else ""


def signature_of(line: str) -> str:
    """The signature of one line, structured or plain."""
    record = parse_object(line)
    tags: dict[str, None] = {}
    for key in SHAPE_KEYS if record else ():
        value = lookup(record, key)
        if value is None:
            continue
        if key in STATUS:
            digits = re.sub("[^0-9]", "", value)
            value = f"{digits[0]}xx" if len(digits) >= 3 else value
        elif key in PATHS:
            value = _stem(value) or value
        elif key in MESSAGES:
            value = "-".join(re.findall("[A-Za-z]+", value)[:3]).lower()
        else:
            value = value.lower()
        value = re.sub("[^A-Za-z0-9<>/-]+", "-", value).strip("-")
        if value:
            tags[f"{key.lower().rpartition('.')[2]}={value}"] = None
    if tags:
        return ";".join(tags)[:SHAPED_BYTES]
    s = line.strip()
    for pattern, name in _PY_PLAIN:
        s = pattern.sub(name, s)
    return re.sub("[^A-Za-z0-9<>]+", "-", s).strip("-").lower()[:PLAIN_BYTES] or "unknown"


def level_of(line: str) -> str:
    """The level of one line; a structured level that is not known is ``unknown`` whatever the text says."""
    record = parse_object(line)
    for key in ("level", "detected_level", "severity", "lvl") if record else ():
        value = lookup(record, key)
        if value:
            value = value.strip().lower()
            value = ALIASES.get(value, value)
            return value if value in RANK else "unknown"
    found = _PY_LEVEL.search(line)
    return ALIASES.get(found[1].lower(), found[1].lower()) if found else "unknown"


@pandas_udf(StructType([StructField("sig", StringType()), StructField("level", StringType())]))
def shape(lines: pd.Series) -> pd.DataFrame:
    """Signature and level of lines that may be structured."""
    return pd.DataFrame({"sig": [signature_of(x or "") for x in lines], "level": [level_of(x or "") for x in lines]})
