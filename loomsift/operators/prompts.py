"""Processors that a model would run, as plug-ins: prompts, model routing and embedding have offline defaults."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomsift.functions.text import sanitize_markers, strip_thought
from loomsift.operators.routing import Registry, guard

#: Bytes of a document that a routing model sees.
SAMPLE_BYTES = 200
# Where a rewrite of prose is tried by itself, and what a reading hook takes.
SHORTHAND_GLOBS = ("**/SKILL.md", "**/AGENTS.md", "**/agents.md", "**/prompts/*.yaml", "**/prompts/*.yml")
SHORTHAND_BYTES, READ_BYTES = 500, 32768
READ_EXTENSIONS = ("log", "ndjson", "txt", "out", "err", "stderr", "trace", "dump", "pdf")

#: From (system prompt, text) to the answer.
Backend = Callable[[str, str], str]


def pass_through(system: str, text: str) -> str:
    return text


def prompt(text: Column, system: str, backend: Backend = pass_through) -> Column:
    """A model's answer to a text whose control markers are made harmless, without its thoughts; the text if it is not shorter."""

    def ask(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else backend(system, t)
            except Exception:  # a backend that fails leaves its input
                return t

        return texts.map(one)

    return guard(strip_thought(F.pandas_udf(ask, StringType())(sanitize_markers(text))), text)


def model_route(docs: DataFrame, choose: Callable[[str, Sequence[str]], Sequence[str]] | None = None, registry: Registry | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``chain``: processors that a model chose by the first bytes; empty if it names one that is not eligible."""
    names = (registry or Registry()).eligible()
    if choose is None:
        return docs.withColumn("chain", F.array().cast("array<string>"))

    def ask(samples: pd.Series) -> pd.Series:
        def one(s: str) -> list[str]:
            try:
                chosen = list(choose(s, names))
            except Exception:  # no answer is no chain
                return []
            return chosen if all(c in names for c in chosen) else []

        return samples.map(one)

    sample = F.substring(F.col(text).cast("binary"), 1, SAMPLE_BYTES).cast("string")
    return docs.withColumn("chain", F.pandas_udf(ask, ArrayType(StringType()))(F.coalesce(sample, F.lit(""))))


def _glob(glob: str) -> str:
    out = "".join({"**/": "(?:.*/)?", "*": "[^/]*"}.get(p, f"\\Q{p}\\E") for p in _parts(glob))
    return f"^{out}\\z"


def _parts(glob: str) -> list[str]:
    out: list[str] = []
    while glob:
        head = "**/" if glob.startswith("**/") else "*" if glob[0] == "*" else glob.split("*")[0]
        out.append(head)
        glob = glob[len(head) :]
    return out


def shorthand_gate(path: Column, size: Column, globs: Sequence[str] = SHORTHAND_GLOBS, least: int = SHORTHAND_BYTES) -> Column:
    """Whether a written file's prose is worth a rewrite."""
    named = F.lit(False)
    for g in globs:
        named = named | path.rlike(_glob(g))
    return named & (size >= least)


def read_gate(path: Column, size: Column) -> Column:
    """Whether a file that is read goes through a distiller first: by its kind, and by its size but for PDF."""
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    return (kind == "pdf") | kind.isin(*READ_EXTENSIONS) & (size >= READ_BYTES)
