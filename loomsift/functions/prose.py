"""The gate that a shortened text must pass: what has to survive, and what must not appear."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from loomsift.functions.common import WORD_END, WORD_START, col, distinct_matches

# Directives, and patterns of tokens that must survive.
DIRECTIVE = f"{WORD_START}(NEVER|MUST|SHALL|ALWAYS|DO NOT|IMPORTANT|CRITICAL){WORD_END}"
URL = rf"(?i){WORD_START}(?:https?|file)://[^ \t\n\f\r)]+"
VERSION = rf"{WORD_START}v?[0-9]+\.[0-9]+(?:\.[0-9]+(?:[-+][A-Za-z0-9_.]+)?)?{WORD_END}"
NUMBER_UNIT = (
    rf"{WORD_START}[0-9]+(?:\.[0-9]+)?[ \t\n\f\r]*(?:%|KiB|MiB|GiB|TiB|KB|MB|GB|TB|ms|s|min|hour|hr|day|week|month|year|tokens?|chars?|bytes?|lines?)"
    r"(?:(?<=%)(?=[A-Za-z0-9_])|(?<!%)(?![A-Za-z0-9_]))"
)
EXIT_CODE = rf"{WORD_START}(?:exit[ \t\n\f\r]+code[ \t\n\f\r]+|exit[ \t\n\f\r]+|error[ \t\n\f\r]+|status[ \t\n\f\r]+)[0-9]+{WORD_END}"
FILE_PATH = (
    r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))(?:[A-Za-z]:[\\/]|/|~/|\./|\.\./)?[A-Za-z0-9_./\\-]+"
    rf"\.(?:md|yaml|yml|json|toml|sh|ps1|py|go|rs|ts|js|html|css|sql|env|log|txt|gguf|gz|zip|sig|pem|cdx|cdx\.json){WORD_END}"
)
TRAILING = r"[.,;:!?)\]]+\z"
FENCE = r"(?s)```[^\n]*\n(.*?)```"
FRONTMATTER = r"(?s)\A---\r?\n(.*?)\n---(?:\r?\n|\z)"
# Paths whose YAML is never prose, and lengths of scalars that are.
YAML_BLOCK_CHARS, YAML_PLAIN_CHARS, YAML_PLAIN_SPACES = 80, 120, 4


def directives(s: Column | str) -> Column:
    return distinct_matches(s, DIRECTIVE, 1)


def fences(s: Column | str) -> Column:
    """Bodies of code blocks between triple backticks."""
    return F.regexp_extract_all(col(s), F.lit(FENCE), F.lit(1))


def frontmatter_keys(s: Column | str) -> Column:
    """Top-level keys between the leading pair of ``---`` lines."""
    lines = F.split(F.regexp_extract(col(s), FRONTMATTER, 1), "\n")
    keys = F.transform(lines, lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_][A-Za-z0-9_ .-]*):", 1))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def must_preserve(s: Column | str) -> Column:
    """Distinct URLs, versions, numbers with units, exit codes and file paths, without trailing marks."""
    found = F.flatten(F.array(*[F.regexp_extract_all(col(s), F.lit(p), F.lit(0)) for p in (URL, VERSION, NUMBER_UNIT, EXIT_CODE, FILE_PATH)]))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.regexp_replace(t, TRAILING, "")), lambda t: t != ""))


def backticked(s: Column | str) -> Column:
    return distinct_matches(s, "`([^`\n]+)`", 1)


def _missing(tokens: Column, text: Column | str) -> Column:
    return F.filter(tokens, lambda t: F.instr(col(text), t) == 0)


def failures(original: Column | str, short: Column | str) -> Column:
    """Reasons to keep the original; empty if the short text may replace it."""
    said = lambda what, tokens: F.transform(tokens, lambda t: F.concat(F.lit(f"{what}: "), t))
    new = F.filter(backticked(short), lambda t: F.instr(col(original), t) == 0)
    lost_keys = F.array_except(frontmatter_keys(original), frontmatter_keys(short))
    return F.concat(
        said("directive lost", F.array_except(directives(original), directives(short))),
        said("code block lost", _missing(fences(original), short)),
        said("frontmatter key lost", lost_keys),
        said("token lost", _missing(must_preserve(original), short)),
        said("code lost", _missing(backticked(original), short)),
        said("code made up", new),
    )


def gate(original: Column | str, short: Column | str) -> Column:
    """The short text if nothing fails and it is shorter, else the original: fail closed."""
    good = (F.size(failures(original, short)) == 0) & (F.octet_length(col(short)) < F.octet_length(col(original))) & (F.trim(col(short)) != "")
    return F.when(good, col(short)).otherwise(col(original))


def reduction_pct(source: Column | str, out: Column | str) -> Column:
    # hundredths are rounded as they are held in binary, not as they are written
    return F.when(col(source) <= 0, F.lit(0.0)).otherwise(F.round(100 * (1 - col(out) / col(source)) * 100) / 100)


def prose_scalars(text: str) -> list[str]:
    """Values of a YAML text that are long enough to be prose: block scalars, and plain ones with several spaces."""
    import yaml

    try:
        root = yaml.compose(text)
    except yaml.YAMLError:
        return []
    out, todo = [], [root] if root is not None else []
    while todo:
        node = todo.pop()
        if isinstance(node, yaml.MappingNode):
            todo += [v for _, v in reversed(node.value)]
        elif isinstance(node, yaml.SequenceNode):
            todo += reversed(node.value)
        elif isinstance(node.value, str):
            least = YAML_BLOCK_CHARS if node.style in ("|", ">") else YAML_PLAIN_CHARS
            if len(node.value) >= least and (node.style in ("|", ">") or node.value.count(" ") >= YAML_PLAIN_SPACES):
                out.append(node.value)
    return out


@pandas_udf(ArrayType(StringType()))
def yaml_prose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: prose_scalars(t or ""))


def is_yaml(path: Column | str) -> Column:
    return F.lower(col(path)).rlike(r"\.(?:yaml|yml)\z")


