"""Which distiller a document goes to, and the guard around what comes back."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomsift.functions import html
from loomsift.operators import distillers, pdf_text

SHORTEST_BYTES, SNIFFED_BYTES = 2000, 8192
COLLAPSED_LINES, COLLAPSED_GROUPS, COLLAPSED_SHARE = 30, 3, 0.05


def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern, outside groups and classes."""
    parts, depth, inside, at = [""], 0, False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            parts[-1] += pattern[at : at + 2]
            at += 2
            continue
        inside = c != "]" if inside else c == "["
        depth += 0 if inside else (c == "(") - (c == ")")
        if c == "|" and not depth and not inside:
            parts.append("")
        else:
            parts[-1] += c
        at += 1
    return parts


def _group(branch: str) -> str:
    """The group that a branch opens with, parentheses included."""
    depth, inside = 0, False
    for m in re.finditer(r"\\.|[][()]", branch, re.S):
        if len(m[0]) == 2:
            continue
        if inside:
            inside = m[0] != "]"
        elif m[0] == "[":
            inside = True
        elif m[0] in "()":
            depth += 1 if m[0] == "(" else -1
            if not depth:
                return branch[: m.end()]
    return branch


_OPENED = re.compile(r"\(\?(?:P?<\w+>|([a-zA-Z]*)(?:-[a-zA-Z]+)?:)|\(")


def rooted(pattern: str, lines: bool = False) -> bool:
    """Whether every branch of a pattern can match at the start of a text only; ``lines``: ``^`` matches after line feeds too."""
    if flags := re.match(r"\(\?([a-zA-Z]+)(?:-[a-zA-Z]+)?\)", pattern):
        return rooted(pattern[flags.end() :], lines or "m" in flags[1])

    def first(branch: str) -> bool:
        if branch.startswith(("^", r"\A")):
            return branch[0] != "^" or not lines
        opened = _OPENED.match(branch)
        if not opened or branch.startswith("(?") and opened[0] == "(":  # looking around
            return False
        group = _group(branch)
        rest, inner = branch[len(group) :], group[opened.end() : -1]
        if rest[:1] in ("?", "*", "+", "{"):
            return False
        return first(rest) if not inner else rooted(inner, lines or "m" in (opened[1] or ""))

    return bool(pattern) and all(map(first, _branches(pattern)))


@dataclass(frozen=True)
class Descriptor:
    """A processor: how documents reach it, by content or by the command that made them, and what it does."""

    name: str
    kind: str = "native"
    match: str = ""
    commands: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    routable: bool | None = None
    builtin: bool = True
    distil: Callable[[str], str] | None = field(default=None, compare=False)
    #: Whether ``distil`` takes bytes: the document need not be UTF-8.
    raw: bool = False

    @property
    def is_signature(self) -> bool:
        """Whether the pattern holds at the start of the text only."""
        return rooted(self.match)

    @property
    def eligible(self) -> bool:
        """Whether a model may choose it: as said, or else if no pattern leads to it."""
        return not self.match if self.routable is None else self.routable


# Patterns and commands of the built-in processors.
BUILTIN = (
    Descriptor("cargo-filter", match=r"(?dm)^(\s*Compiling |\s*Finished|\s*Running|error(\[E\d+\])?:|warning:|\s*Downloaded |test result:|running \d+ tests?$)", commands=("cargo",), distil=distillers.cargo),
    Descriptor("casefolder", "prompt", r"(?i)traceback|\Aerror(:|\[E\d+\])|\Aexception|fatal|panic:|\A  File \".+\", line \d+"),
    Descriptor("compress", "prompt"),
    Descriptor("cordon-filter", routable=False, distil=distillers.cordon),
    Descriptor("git-filter", match=r"(?dm)^(On branch |HEAD detached|Changes |Untracked files:|nothing to commit|diff --git|commit [0-9a-f]{7,40}$)", commands=("git",), distil=distillers.git),
    Descriptor("go-test-filter", match=r"(?dm)^\s*=== RUN\s|^\s*--- (?:PASS|FAIL|SKIP):|^(?:ok|FAIL|\?)\s+\S+\s", prefixes=("go test",), distil=distillers.go_test),
    Descriptor("har-filter", match=r"\"log\"\s*:\s*\{[\s\S]{0,300}\"version\"[\s\S]*?\"entries\"\s*:\s*\[", distil=distillers.har),
    Descriptor(
        "lint-filter",
        match=r"(?dm)^(?:[^\n:]+):\d+(?::\d+)?:\s+(?:warning|error|note|info|style|[CWERF]):\s|[^\n:]:\d+(?::\d+)?:\s+[EWFCBI]\d{2,4}\s"
        r"|[^\n:]:\d+(?::\d+)?:\s+[A-Z]+\d{3,4}:\s|[^\n:]:\s*line\s+\d+,\s*col\s+\d+,\s+(?:warning|error)\s"
        r"|[^\n:]:\d+(?::\d+)?:\s+[^\n]+\s\([\w./-]+\)$|[^\n:]\(\d+,\d+\):\s+(?:error|warning)\s+TS\d+:\s",
        commands=("gosec", "staticcheck", "golangci-lint", "shellcheck"), distil=distillers.lint,
    ),
    Descriptor("mhtml-filter", match=r"(?i)Content-Type:\s*multipart/related", distil=lambda b: html.markdown(html.saved_html(b)), raw=True),
    Descriptor("ndjson-filter", match=r"(?dm)^\{[^\n]*\"(?:level|severity|msg|message|@timestamp|time|ts)\":[^\n]*\}\s*$", distil=distillers.ndjson),
    Descriptor("npm-filter", match=r"(?dm)^(npm (warn|error|notice)|added \d+ packages|removed \d+ packages|# npm audit report|npm ERR!|[│├└]──\s+\S+@[0-9.]+)", commands=("npm", "npx", "pnpm", "yarn"), distil=distillers.npm),
    Descriptor("pdf-filter", match="^%PDF-", distil=pdf_text.pdf_markdown, raw=True),
    Descriptor("pdf-to-md", "script", "^%PDF-"),
    Descriptor("pytest-filter", match=r"(?dm)^(=+ test session starts =+|=+ FAILURES =+|=+ ERRORS =+|=+ short test summary info =+|collected \d+ items?)", commands=("pytest", "py.test"), distil=distillers.pytest),
    Descriptor("shorthand", "prompt", routable=False),
    Descriptor(
        "stacktrace-filter",
        match=r"(?dm)^(Traceback \(most recent call last\):|panic: |goroutine \d+ \[|fatal runtime error:|thread '[^']+' panicked at|Exception in thread |\s+at [\w$.]+\(.*\.java:|^\s*at [\w$.<>]+\s*\(.*:\d+\)$)",
        distil=distillers.stack_trace,
    ),
    Descriptor("trivy-filter", match=r"(?dm)^Total:\s+\d+\s+\(.*?(?:CRITICAL|HIGH|MEDIUM|LOW|UNKNOWN):\s+\d+|Library.*Vulnerability.*Severity.*(?:Status.*)?Installed Version.*Fixed Version.*Title", distil=distillers.vulnerability),
)


class Registry:
    """Processors by name; a user's takes the place of a built-in one of the same name."""

    def __init__(self, processors: Sequence[Descriptor] = BUILTIN):
        self.by_name: dict[str, Descriptor] = {}
        for p in processors:
            self.add(p)

    def add(self, processor: Descriptor) -> None:
        known = self.by_name.get(processor.name)
        if known and known.builtin == processor.builtin:
            raise ValueError(f"processor {processor.name} is there already")
        if known is None or known.builtin:
            self.by_name[processor.name] = processor

    def by_tier(self) -> list[Descriptor]:
        """The order in which patterns are tried: the cheapest evidence first, then names."""

        def tier(p: Descriptor) -> int:
            return (0 if p.kind == "native" else 1) if p.is_signature else (3 if p.kind == "prompt" else 2)

        return sorted((p for p in self.by_name.values() if p.match), key=lambda p: (tier(p), p.name))

    def eligible(self) -> list[str]:
        return sorted(p.name for p in self.by_name.values() if p.eligible)

    def fast_path(self, text: Column, binary: Column) -> Column:
        """The first processor whose pattern the text has, else null; binary texts are tried for signatures only."""
        out = None
        for p in self.by_tier():
            hit = text.rlike(p.match) if p.is_signature else ~binary & text.rlike(p.match)
            out = F.when(hit, p.name) if out is None else out.when(hit, p.name)
        return out if out is not None else F.lit(None).cast("string")

    def by_command(self, argv: Column) -> Column:
        """The processor of a command line, by its leading words, then by the program."""
        program = base_name(argv0(argv))
        words = F.regexp_replace(F.trim(argv), r"\s+", " ")
        out = F.lit(None).cast("string")
        ranked = [(0, c, p) for p in self.by_name.values() for c in p.commands] + [(len(c.split()), c, p) for p in self.by_name.values() for c in p.prefixes]
        for n, command, p in sorted(ranked, key=lambda x: (x[0], x[1]), reverse=False):
            hit = program == command if not n else (words == command) | words.startswith(command + " ")
            out = F.when(hit, p.name).otherwise(out)
        return F.when(argv0(argv).isNotNull(), out)


def is_binary(text: Column) -> Column:
    """A NUL among the first 8192 bytes."""
    return F.instr(F.substring(text.cast("binary"), 1, SNIFFED_BYTES).cast("string"), "\0") > 0


def argv0(command: Column) -> Column:
    """The program of a simple command line; null for pipes, redirections and substitutions."""
    bare = F.regexp_replace(F.trim(command), r"^(?:[A-Za-z_][A-Za-z0-9_]*=(?:\"[^\"]*\"|'[^']*'|\S*)\s+)+", "")
    word = F.regexp_extract(bare, r"^(?:\"([^\"]*)\"|'([^']*)'|(\S+))", 0)
    word = F.regexp_replace(word, "^[\"']|[\"']$", "")
    return F.when(command.rlike(r"[|&;><()$`]") | (word == ""), F.lit(None).cast("string")).otherwise(word)


def base_name(program: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(program, r"[/\\]"), -1), r"(?i)\.(exe|cmd|bat|ps1)$", "")


def rewritten(argv: Column, program: str, registry: Registry | None = None) -> Column:
    """A command line wrapped for ``program`` to run and distil; null for it to run as it is.

    That is so for pipes and other compound lines, for commands that no processor is for, and for
    lines that run ``program`` already, which would be wrapped for ever.
    """
    wrapped = (registry or Registry()).by_command(argv).isNotNull() & (base_name(argv0(argv)) != base_name(F.lit(program)))
    return F.when(wrapped, F.concat(F.lit(f"{program} exec -- "), argv))


def over_collapsed(lines_in: Column | int, lines_out: Column | int) -> Column | bool:
    """Whether so few lines are left that facts may be gone; of columns or of numbers."""
    return (lines_in >= COLLAPSED_LINES) & ((lines_out < COLLAPSED_GROUPS) | (lines_out < lines_in * COLLAPSED_SHARE))


def guard(out: Column, raw: Column) -> Column:
    """The result if it is not blank and shorter in bytes, else the input."""
    good = out.isNotNull() & out.rlike(r"\S") & (F.octet_length(out) < F.octet_length(raw))
    return F.when(good, out).otherwise(raw)


def route(docs: DataFrame, registry: Registry | None = None, text: str = "text") -> DataFrame:
    """``docs`` with path and processor: ``short_circuit``, ``fast_path`` or ``passthrough``. The patterns are tried once a row."""
    registry = registry or Registry()
    short = F.octet_length(text) < SHORTEST_BYTES
    named = docs.withColumn("processor", F.when(~short, registry.fast_path(F.col(text), is_binary(F.col(text)))))
    return named.withColumn("path", F.when(F.col(text).isNull() | short, "short_circuit").when(F.col("processor").isNotNull(), "fast_path").otherwise("passthrough"))


def distil(docs: DataFrame, registry: Registry | None = None, text: str = "text") -> DataFrame:
    """``docs`` with processor, path, distilled, outcome, bytes_in, bytes_out and fallback.

    A structured log that collapses to almost nothing is grouped by signature instead, if that
    keeps more lines. Errors, empty results and results that are not shorter leave the input.
    """
    registry = registry or Registry()
    routed = route(docs, registry, text)
    of = {name: p.distil for name, p in registry.by_name.items() if p.distil and not p.raw}
    of_bytes = {name: p.distil for name, p in registry.by_name.items() if p.distil and p.raw}

    def run(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([t if n not in of else _one(of, n, t) for t, n in zip(texts, names)], dtype=object)

    def run_bytes(files: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or n not in of_bytes else _of_bytes(of_bytes[n], b) for b, n in zip(files, names)], dtype=object)

    raw = F.coalesce(F.col("processor").isin(*of_bytes), F.lit(False)) if of_bytes else F.lit(False)
    # bytes never pass as text, which need not be UTF-8
    made = F.pandas_udf(run, StringType())(F.when(~raw & (F.col("path") == "fast_path"), F.col(text)), F.col("processor"))
    made_of_bytes = F.pandas_udf(run_bytes, StringType())(F.when(raw, F.col(text).cast("binary")), F.col("processor"))
    made = F.when(F.col("path") != "fast_path", F.col(text)).otherwise(F.when(raw, made_of_bytes).otherwise(made))
    out = routed.withColumn("distilled", guard(made, F.col(text)))
    bytes_in, bytes_out = F.octet_length(text).cast("long"), F.octet_length("distilled").cast("long")
    return out.withColumns({
        "bytes_in": bytes_in, "bytes_out": bytes_out, "outcome": F.when(bytes_out < bytes_in, "compressed").otherwise("passthrough"),
        "fallback": F.when((F.col("path") == "fast_path") & (bytes_out == bytes_in), "not_smaller").otherwise(""),
    })


def _column_of_bytes(convert: Callable[[bytes], str]):
    def run(files: pd.Series) -> pd.Series:
        return files.map(lambda b: None if b is None else _of_bytes(convert, b))

    return F.pandas_udf(run, StringType())


def _of_bytes(convert: Callable[[bytes], str], data: bytes) -> str | None:
    """What is made of the bytes; null, for the input to stay, where nothing can be."""
    try:
        return distillers.within(distillers.DEADLINE, convert, bytes(data)) or None
    except Exception:  # a distiller must never lose its input
        return None


def _one(of: dict, name: str, text: str) -> str:
    out = distillers.guarded(of[name], text)
    if name == "ndjson-filter" and out != text:
        filled = lambda t: sum(1 for x in t.split("\n") if x.strip())
        before, after = filled(text), filled(out)
        if over_collapsed(before, after):
            other = distillers.guarded(lambda t: distillers.group_report([x for x in distillers.lines_of(t) if x.strip()]), text) if "cordon-filter" in of else text
            if other != text and filled(other) > after:
                return other
    return out


def chain(docs: DataFrame, names: Sequence[str], registry: Registry | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` put through processors in turn; an unknown name leaves all as it is."""
    registry = registry or Registry()
    if any(n not in registry.by_name for n in names):
        return docs
    for n in names:
        p = registry.by_name[n]
        if p.raw and (f := p.distil):
            docs = docs.withColumn(text, guard(_column_of_bytes(f)(F.col(text).cast("binary")), F.col(text)))
        elif f := p.distil:
            docs = docs.withColumn(text, distillers.apply(f)(F.col(text)))
    return docs


def allowed(argv: Column, deny: Sequence[str] = (), allow: Sequence[str] = (), default: bool = True) -> Column:
    """Policy over programs by globs: denied, then allowed, then the default; no program is denied."""
    program = base_name(argv0(argv))

    def any_of(globs: Sequence[str]) -> Column:
        out = F.lit(False)
        for g in globs:
            out = out | program.rlike("^" + re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") + r"\z")
        return out

    return F.when(program.isNull(), False).when(any_of(deny), False).when(any_of(allow), True).otherwise(F.lit(default))
