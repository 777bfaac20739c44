"""Redaction of secrets in log text, URLs, headers and bodies."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from loomsift.functions.common import WORD_END, WORD_START, col

# Patterns of secrets in logs.
LOG_PATTERNS = (
    f"(?i){WORD_START}AKIA[0-9A-Z]{{16}}{WORD_END}",
    f"{WORD_START}gh[pousr]_[A-Za-z0-9]{{36,}}{WORD_END}",
    f"{WORD_START}hf_[A-Za-z0-9]{{30,}}{WORD_END}",
    f"{WORD_START}xox[abpr]-[A-Za-z0-9-]{{10,}}{WORD_END}",
    rf"(?i){WORD_START}(?:authorization|bearer)[ \t\n\f\r]*[:=]?[ \t\n\f\r]*[A-Za-z0-9._\-]{{16,}}",
    rf"(?i){WORD_START}[A-Z][A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|PASSWD|APIKEY|API_KEY){WORD_END}[ \t\n\f\r]*[:=][ \t\n\f\r]*[^ \t\n\f\r\"']+",
    rf"(?i){WORD_START}(?:api[_-]?key|password|passwd|secret)[ \t\n\f\r]*[:=][ \t\n\f\r]*[^ \t\n\f\r\"']+",
)
# Names of secret parameters and headers, tokens, and static assets.
SECRET_NAME = (
    r"(?i)^(?:.*[-_.])?(?:authkey|api[-_]?key|access[-_]?token|refresh[-_]?token|id[-_]?token|token|secret|password|passwd|pwd|sig|signature|scid|sessionid"
    r"|session[-_]?token|auth|bearer|client[-_]?secret|x-api-key)$"
)
SECRET_HEADERS = (
    "authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "x-amz-security-token", "api-key", "proxy-authorization", "x-csrf-token", "x-xsrf-token",
)
JWT = r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"
LONG_TOKEN = f"{WORD_START}[A-Za-z0-9_-]{{32,}}{WORD_END}"
STATIC_EXTENSIONS = (".js", ".mjs", ".css", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".wasm", ".map")
STATIC_MIME = (
    "(?i)^(?:image/|font/|text/css|application/javascript|application/x-javascript|text/javascript|application/font|application/wasm"
    "|application/octet-stream|audio/|video/)"
)
HIDDEN, LOG_HIDDEN, BODY_BYTES = "<redacted>", "[REDACTED]", 300


def redact_log(text: Column | str) -> Column:
    out = col(text)
    for pattern in LOG_PATTERNS:
        out = F.regexp_replace(out, pattern, LOG_HIDDEN)
    return out


def redact_long_tokens(text: Column | str) -> Column:
    """JSON web tokens, then any run of 32 or more token characters."""
    return F.regexp_replace(F.regexp_replace(col(text), JWT, HIDDEN), LONG_TOKEN, HIDDEN)


def redact_params(query: Column | str) -> Column:
    """``k=v&…`` with the values of secret names hidden; a name may be percent-encoded and end in ``[]``."""

    def one(pair: Column) -> Column:
        key = F.split(pair, "=", 2)[0]
        name = F.regexp_replace(F.coalesce(F.try_url_decode(key), key), r"\[\]\z", "")
        return F.when((F.instr(pair, "=") > 0) & name.rlike(SECRET_NAME), F.concat(key, F.lit(f"={HIDDEN}"))).otherwise(pair)

    return F.array_join(F.transform(F.split(col(query), "&"), one), "&")


def redact_url(url: Column | str) -> Column:
    """A URL with its password, secret parameters, and secret fragment parameters hidden."""
    u = F.regexp_replace(col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", f"$1{HIDDEN}@")
    before, fragment = F.split(u, "#", 2)[0], F.get(F.split(u, "#", 2), F.lit(1))
    path, query = F.split(before, r"\?", 2)[0], F.get(F.split(before, r"\?", 2), F.lit(1))
    return F.concat(
        path,
        F.when(query.isNull(), "").otherwise(F.concat(F.lit("?"), redact_params(query))),
        F.when(fragment.isNull(), "").otherwise(F.concat(F.lit("#"), F.when(F.instr(fragment, "=") > 0, redact_params(fragment)).otherwise(fragment))),
    )


def secret_header(name: Column | str) -> Column:
    return F.lower(col(name)).isin(*SECRET_HEADERS)


def is_static(url: Column | str, mime: Column | str) -> Column:
    path = F.lower(F.split(col(url), "[?#]", 2)[0])
    named = F.lit(False)
    for extension in STATIC_EXTENSIONS:
        named = named | path.endswith(extension)
    return F.coalesce(named, F.lit(False)) | F.coalesce(col(mime).rlike(STATIC_MIME), F.lit(False))


_NAME, _JWT, _LONG = re.compile(SECRET_NAME[4:], re.I), re.compile(JWT), re.compile(LONG_TOKEN)


def is_secret(name: str) -> bool:
    return bool(_NAME.search(name.removesuffix("[]")))


def _hide(value):
    if isinstance(value, dict):
        return {k: HIDDEN if _NAME.search(k) else _hide(value[k]) for k in sorted(value)}
    return [_hide(v) for v in value] if isinstance(value, list) else value


def hide_params(query: str) -> str:
    """``k=v&…`` with the values of secret names hidden."""
    pairs = (p.partition("=") for p in query.split("&"))
    return "&".join(f"{k}={HIDDEN}" if eq and is_secret(unquote_plus(k)) else k + eq + v for k, eq, v in pairs)


def hide_body(text: str, mime: str = "") -> str:
    """A body for a report: secrets of its JSON or form fields hidden, tokens hidden, white space squeezed, cut short."""
    text = (text or "").strip()
    if text.startswith(("{", "[")):
        try:
            text = json.dumps(_hide(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            pass
    if "form-urlencoded" in mime or not text.startswith(("{", "[")) and "=" in text and " " not in text:
        text = hide_params(text)
    text = " ".join(_LONG.sub(HIDDEN, _JWT.sub(HIDDEN, text)).split())
    raw = text.encode("utf-8", "surrogatepass")
    return text if len(raw) <= BODY_BYTES else raw[:BODY_BYTES].decode("utf-8", "ignore") + "…"


@pandas_udf(StringType())
def redact_body(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda x: None if x is None else hide_body(x))
