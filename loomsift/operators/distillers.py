"""Distillers: whole outputs of tools to shorter texts that keep the facts.

Each is a function from text to text, for one document at a time; ``apply`` runs them over a
column in Arrow batches. They scan with rules: a rule names a kind of line, and what follows
is done on the sequence of kinds.
"""

from __future__ import annotations

import json
import re
import signal
import threading
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomsift.functions import log, redact
from loomsift.functions.common import WORD_END, WORD_START
from loomsift.functions.signature import MOST_KEYS, RANK, SAMPLE_CHARS, UUID, level_of, signature_of
from loomsift.functions.text import SEVERITY_ALIASES, SEVERITY_LETTERS, SEVERITY_RANK
from loomsift.operators import anomaly

# The patterns that mark kinds of lines, by tool.
ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
GIT_HINT, GIT_DIFF = re.compile(r"^\s*\(use [\"`]git"), re.compile(r"^diff --git a/(\S+) b/\S+")
NPM_HEADER, NPM_COUNTS = re.compile(r"npm (error|ERR!|warn|WARN|notice)"), re.compile(r"(added|removed|changed|audited|up to date)\s+\d")
NPM_SEVERITY, NPM_PACKAGE = re.compile(r"\s*(low|moderate|high|critical)\s+severity", re.I), re.compile(r"[A-Za-z0-9_@\-/.]+@[\d.\w\-+]+", re.A)
NPM_TREE = re.compile(r"\s*[+\-`]+\s*(?:UNMET DEPENDENCY\s+)?(.+?)\s*")
CARGO_DROP = re.compile(r"\s*(Compiling|Checking|Downloaded|Downloading|Updating|Generating)\s")
CARGO_PHASE, CARGO_OPEN, CARGO_POINTER = re.compile(r"\s*(Finished|Running)\s"), re.compile(r"error(\[E\d+\])?:|warning:"), re.compile(r"\s*-->")
CARGO_TEST, CARGO_FAILED = re.compile(r"running \d+ tests?$|test result:"), re.compile(f"{WORD_START}test .* FAILED{WORD_END}|{WORD_START}FAILED$")
PYTEST_SECTION, PYTEST_COLLECTED = re.compile(r"=+ (.+?) =+\s*$"), re.compile(r"collected (\d+) items?")
PYTEST_PROGRESS = re.compile(r"[\w./_-]+\.py [.FEsxXp]+\s+\[\s*\d+%\s*\]\s*$", re.A)
PYTEST_TOTALS = re.compile(r"=+ (\d+ (?:passed|failed|error|skipped|warning|deselected)[^=]*) =+\s*$")
PYTEST_KEPT, PYTEST_WARNINGS = ("FAILURES", "ERRORS", "short test summary info"), "warnings summary"
GO_RUN, GO_RESULT = re.compile(r"\s*=== (?:RUN|PAUSE|CONT|NAME)\s"), re.compile(r"\s*--- (PASS|FAIL|SKIP):\s")
GO_PACKAGE, GO_BUILD = re.compile(r"(?:ok|FAIL)\s+\S+|\?\s+\S+\s+\[no test files\]"), re.compile(r"# \S")
GO_PANIC, GO_BOUNDARY = re.compile(r"(panic:|fatal error:)\s"), re.compile(r"\s*(?:=== |--- (?:PASS|FAIL|SKIP):)")
TRACE_OPEN = tuple(
    re.compile(p, re.A)
    for p in (
        r"Traceback \(most recent call last\):\s*$", r"panic: (.+)$", r"goroutine (\d+) \[([^\]]+)\]:", r"thread '([^']+)' panicked at (.+):$",
        r"([\w.]+(?:Error|Exception)):.*$", r"Caused by: ",
    )
)
PYTHON_FRAME = re.compile(r'\s+File "([^"]+)", line (\d+)(?:, in (.+))?$')
FRAMES = (
    PYTHON_FRAME,
    *(
        re.compile(p, re.A)
        for p in (
            r"([\w./*-]+(?:\.\w+)+)\(.*\)$", r"\s+([^:]+\.go):(\d+)\b.*$", r"\s+(\d+):\s+(.+)$", r"\s+at\s+(.+?):(\d+)(?::(\d+))?$",
            r"\s+at ([\w$.]+)\(([^)]+)\)\s*$", r"\s+at ([\w$.<> ]+)\s*\(([^)]+):(\d+):(\d+)\)\s*$", r"\s+at ([^:]+):(\d+):(\d+)\s*$",
        )
    ),
)
HEAD_FRAMES, TAIL_FRAMES, LEAST_RUN = 3, 3, 3
_AT, _TO = r"^(?P<file>[^:\s][^:\n]*?):(?P<line>\d+):(?P<col>\d+):\s+", r"\s*$"
TERSE = tuple(
    (kind, re.compile(p, re.A))
    for kind, p in (
        ("shellcheck", _AT + r"(?P<sev>warning|error|info|style|note):\s+(?P<msg>.+?)\s+\[(?P<rule>SC\d+)\]" + _TO),
        ("rubocop", _AT + r"(?P<sev>[CWERF]):\s+(?:\[Correctable\]\s+)?(?P<rule>[A-Z][\w/]*):\s+(?P<msg>.+?)" + _TO),
        ("stylelint", _AT + r"(?P<sev>warning|error)\s{2,}(?P<msg>.+?)\s+\[(?P<rule>[\w-]+)\]" + _TO),
        ("eslint-compact", r"^(?P<file>[^:\s][^:\n]*?):\s+line\s+(?P<line>\d+),\s+col\s+(?P<col>\d+),\s+(?P<sev>warning|error|Warning|Error)\s+-\s+(?P<msg>.+?)\s+\((?P<rule>[\w/@.-]+)\)" + _TO),
        ("eslint-unix", _AT + r"(?P<msg>.+?)\s+\[(?P<sev>Error|Warning)/(?P<rule>[\w/@.-]+)\]" + _TO),
        ("golangci", r"^(?P<file>[^:\s][^:\n]*?\.go):(?P<line>\d+):(?P<col>\d+):\s+(?P<msg>.+?)\s+\((?P<rule>[\w./-]+)\)" + _TO),
        ("gosec", r"^\[(?P<file>[^:\s\]][^:\n\]]*?):(?P<line>\d+)\]\s+-\s+(?P<rule>G\d+)\s+\(CWE-\d+\):\s+(?P<msg>.+?)\s+\(Confidence:\s+\w+,\s+Severity:\s+(?P<sev>HIGH|MEDIUM|LOW)\)" + _TO),
        ("flake", _AT + r"(?P<rule>[A-Z]{1,3}\d{2,4})\s+(?P<msg>.+?)" + _TO),
        ("gcc-short", _AT + r"(?P<sev>warning|error|note|help|fatal\s+error):\s+(?P<msg>.+?)(?:\s+\[(?P<rule>-[WD][^\]]+|clippy::[\w:]+)\])?" + _TO),
        ("mypy", r"^(?P<file>[^:\s][^:\n]*?):(?P<line>\d+):\s+(?P<sev>error|warning|note):\s+(?P<msg>.+?)(?:\s+\[(?P<rule>[\w-]+)\])?" + _TO),
        ("tsc", r"^(?P<file>[^()\s][^()\n]*?)\((?P<line>\d+),(?P<col>\d+)\):\s+(?P<sev>error|warning)\s+(?P<rule>TS\d+):\s+(?P<msg>.+?)" + _TO),
    )
)
RUST_OPEN = re.compile(r"^\s*(?P<sev>warning|error|note|help)(?:\[(?P<rule>[\w:]+)\])?:\s+(?P<msg>.+?)\s*$", re.A)
RUST_PLACE = re.compile(r"^\s*-->\s+(?P<file>[^:\s][^:\n]*?):(?P<line>\d+):(?P<col>\d+)\s*$")
RUST_HELP, RUST_NOTE = re.compile(r"^\s*=?\s*help:\s+(.+?)\s*$"), re.compile(r"^\s*=\s+note:\s+`#\[\w+\(([\w:]+)\)\]`", re.A)
RUST_RULE, RUFF_OPEN = re.compile(r"\s*\[(-[WD][^\]]+|clippy::[\w:]+)\]\s*$"), re.compile(r"^\s*(?P<rule>[A-Z]{1,3}\d{2,4})(?:\s+\[\*\])?\s+(?P<msg>.+?)\s*$")
SOURCE_LINE = re.compile(r"^\s*\d+\s*\|\s|^\s*\|[\s~^]+$|^\s+\^[\s~^]*$")
STYLISH_FILE = re.compile(r"^(?:[A-Za-z]:\\|/|\\\\|\.[\\/])\S.*$")
STYLISH_ROW = re.compile(r"^\s+(?P<line>\d+):(?P<col>\d+)\s+(?P<sev>error|warning)\s+(?P<msg>.+?)\s+(?P<rule>[\w/@.-]+)\s*$", re.A)
VERBOSE = re.compile(
    r"^\s*(?:warning|error|note|help)(?:\[[\w:]+\])?:\s+\S|^\s*-->\s+\S+:\d+:\d+\s*$|^\s*\d+\s*\|\s|^\s+(?:\d+):(?:\d+)\s+(?:error|warning)\s"
    r"|^\s*[A-Z]{1,3}\d{2,4}(?:\s+\[\*\])?\s+\S", re.M | re.A,
)
VULN_HEADER = re.compile(r"Library.*Vulnerability.*Severity.*(?:Status.*)?Installed Version.*Fixed Version.*Title")
VULN_ID = re.compile(r"(?:CVE-\d{4}-\d+|GHSA-[\w-]+|CGA-[\w-]+|[A-Z]+-\d+(?:-\d+)?)", re.A)
VULN_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "unknown": 1}
VULN_LETTERS = {"critical": "C", "high": "H", "medium": "M", "low": "L", "unknown": "U"}
_URL = re.compile(r"\bhttps?://\S+", re.A)


def lines_of(text: str) -> list[str]:
    """Lines without CRLF and without an empty one after the last line feed."""
    out = text.replace("\r\n", "\n").split("\n")
    return out[:-1] if out and out[-1] == "" else out


def _squeezed(lines: Iterator[str] | list[str], lead: bool = False) -> str:
    """Lines as a text: one of each run of blank lines, none at the end and, without ``lead``, at the start."""
    out: list[str] = []
    for blank, run in groupby(lines, key=lambda x: not x.strip()):
        if not blank:
            out += run
        elif out or lead:
            out.append("")
    while out and out[-1] == "":
        out.pop()
    return "\n".join(out) + "\n" if out else ""


def git(text: str) -> str:
    """Status output without hints, and each file of a diff as its counts of added and removed lines."""

    def kept() -> Iterator[str]:
        name, counts, hunk = None, Counter(), False
        for line in lines_of(text):
            if GIT_HINT.search(line):
                continue
            opened = GIT_DIFF.match(line)
            closed = hunk and line.startswith("commit ")
            if name is not None and (opened or closed):
                yield f"diff {name} (+{counts['+']} -{counts['-']})"
                name = None
            if opened:
                name, counts, hunk = opened[1], Counter(), False
            elif name is None:
                hunk = False
                yield line
            elif line.startswith("@@ "):
                hunk = True
            elif hunk and line[:1] in ("+", "-") and line[:3] not in ("+++", "---"):
                counts[line[0]] += 1
        if name is not None:
            yield f"diff {name} (+{counts['+']} -{counts['-']})"

    return _squeezed(kept(), lead=True)


def npm(text: str) -> str:
    """Messages, counts, severities and packages; a notice once."""

    def kept() -> Iterator[str]:
        notices: set[str] = set()
        for line in lines_of(text):
            bare = line.strip()
            header = NPM_HEADER.match(bare)
            if header and header[1] == "notice":
                if bare not in notices:
                    notices.add(bare)
                    yield bare
            elif not bare or header or NPM_COUNTS.match(bare) or NPM_SEVERITY.match(bare) or NPM_PACKAGE.fullmatch(bare):
                yield bare
            elif tree := NPM_TREE.fullmatch(line):
                if NPM_PACKAGE.fullmatch(tree[1].strip()):
                    yield tree[1].strip()
            elif bare.startswith("#"):
                yield bare

    return _squeezed(kept())


def cargo(text: str) -> str:
    """Phases, messages with the place on the very next line, and test results."""

    def kept() -> Iterator[str]:
        before = ""
        for line in lines_of(text):
            bare = line.strip()
            pointed = CARGO_OPEN.match(before) and not CARGO_DROP.match(before) and CARGO_POINTER.match(line)
            if not CARGO_DROP.match(line) and (
                not bare or CARGO_PHASE.match(line) or CARGO_OPEN.match(line) or pointed or CARGO_TEST.match(bare) or CARGO_FAILED.search(line)
            ):
                yield line.rstrip("\r\n\t ")
            before = line

    return _squeezed(kept())


def pytest(text: str) -> str:
    """Failures, errors and summaries whole; the session's head without its environment; no progress lines."""
    lines = lines_of(ANSI.sub("", text))
    starts = [i for i, line in enumerate(lines) if PYTEST_SECTION.match(line)]
    if not starts:
        return text
    names = {i: PYTEST_SECTION.match(lines[i])[1].strip() for i in starts}
    failed = any(n == "FAILURES" for i, n in names.items() if i) or any("failed" in m[1] for x in lines if (m := PYTEST_TOTALS.match(x)))
    out: list[str] = []

    def loose(part: list[str]) -> None:
        progress = blank = False
        for line in part:
            if PYTEST_COLLECTED.match(line):
                progress = True
            elif progress and PYTEST_PROGRESS.match(line):
                continue
            if line.strip() or not blank:
                out.append(line)
            blank = not line.strip()

    loose(lines[: starts[0]])
    for at, end in zip(starts, [*starts[1:], len(lines)]):
        name, part = names[at], lines[at:end]
        if name.startswith("test session starts"):
            out.append(part[0])
            after = next((i for i, x in enumerate(lines[at + 1 :], at + 1) if PYTEST_COLLECTED.match(x)), len(lines))
            if after >= end:  # what was collected is not in this section: nothing up to there stays
                if after == len(lines):
                    break
                continue
            loose(lines[after:end])
        elif name != PYTEST_WARNINGS or failed:
            out += part
    return "\n".join(out) + ("\n" if text.endswith("\n") else "")


def go_events(lines: list[str]) -> list[dict] | None:
    """The events of a JSON test run; None if any line is none."""
    out = []
    for line in lines:
        if line.strip():
            try:
                event = json.loads(line)
            except ValueError:
                return None
            if not isinstance(event, dict) or not event.get("Action"):
                return None
            out.append(event)
    return out or None


def go_test(text: str) -> str:
    """Failed tests with their output, results of packages, and the number of skipped tests."""
    lines = lines_of(text)
    events = go_events(lines)
    return _squeezed(_go_json(events) if events else _go_text([ANSI.sub("", x).rstrip(" \t\r\n") for x in lines]), lead=True)


def _go_json(events: list[dict]) -> Iterator[str]:
    failed: dict[str, None] = {}
    packages = []
    for e in events:
        test, package = e.get("Test"), e.get("Package")
        if e["Action"] == "fail" and test and test not in failed:
            failed[test] = None
        elif e["Action"] == "fail" and package:
            packages.append(f"FAIL {package}")
        elif e["Action"] == "pass" and package and not test:
            packages.append(f"ok {package}")
    for name in failed:
        yield f"--- FAIL: {name}"
        said = (e.get("Output", "").removesuffix("\n") for e in events if e["Action"] == "output" and e.get("Test") == name)
        yield from (f"    {s.strip()}" for s in said if s.strip() and not GO_BOUNDARY.match(s))
    if skipped := sum(e["Action"] == "skip" and bool(e.get("Test")) for e in events):
        yield f"(skipped {skipped} test(s))"
    yield from packages


def _go_text(lines: list[str]) -> Iterator[str]:
    held: list[str] = []
    running, skipped, until = False, 0, None
    for line in lines:
        package = GO_PACKAGE.match(line)
        if until and not (package and until != "build" or until == "build" and (not line or line.startswith("FAIL") and package)):
            yield line
            continue
        until = None
        result = GO_RESULT.match(line)
        if GO_BUILD.match(line) or GO_PANIC.match(line):
            until = "build" if GO_BUILD.match(line) else "panic"
            yield line
        elif GO_RUN.match(line):
            running, held = True, []
        elif result or package:
            if package or result[1] == "FAIL":
                yield from held
                yield line
            skipped += bool(result and result[1] == "SKIP")
            running, held = False, []
        elif line == "PASS":
            held = []
        elif line and running and line != "FAIL":
            held.append(line)
        elif line:
            yield line
    yield from held
    if skipped:
        yield f"(skipped {skipped} test(s))"


def stack_trace(text: str) -> str:
    """Runs of equal frames as one, and the middle of long traces left out."""
    lines = ANSI.sub("", text).split("\n")
    lines = lines[:-1] if lines and lines[-1] == "" else lines
    starts = [i for i, line in enumerate(lines) if any(p.match(line) for p in TRACE_OPEN)]
    if not starts:
        return text
    out, at = lines[: starts[0]], 0
    for start, bound in zip(starts, [*starts[1:], len(lines)]):
        pairs = (i for i in range(start + 1, bound - 1) if not lines[i].strip() and not lines[i + 1].strip())
        end = next(pairs, bound)
        out += _trace(lines[start:end]) + lines[end:bound]
    return "\n".join(out) + ("\n" if text.endswith("\n") else "")


def _trace(block: list[str]) -> list[str]:
    units: list[tuple[bool, tuple[str, ...]]] = []
    rest = iter(range(len(block)))
    for i in rest:
        if PYTHON_FRAME.match(block[i]) and block[i + 1 : i + 2] and block[i + 1].startswith("    "):
            units.append((True, (block[i], block[i + 1])))
            next(rest)
        else:
            units.append((any(p.match(block[i]) for p in FRAMES), (block[i],)))
    merged = []
    for unit, run in groupby(units):
        n = len(list(run))
        merged += [(unit[0], (*unit[1][:-1], f"{unit[1][-1]}    × {n}"))] if n >= LEAST_RUN else [unit] * n
    frames = [i for i, u in enumerate(merged) if u[0]]
    if frames and (n := frames[-1] + 1 - frames[0]) > HEAD_FRAMES + TAIL_FRAMES + 1:
        first, last = frames[0] + HEAD_FRAMES, frames[-1] + 1 - TAIL_FRAMES
        merged[first:last] = [(False, (f"  ... {n - HEAD_FRAMES - TAIL_FRAMES} frames omitted ...",))]
    return [line for _, unit in merged for line in unit]


# findings of linters

def finding(line: str) -> dict | None:
    """The finding that a line reports on its own."""
    line = line.rstrip(" \t\r\n\v\f")
    for kind, pattern in TERSE:
        if found := pattern.match(line):
            part = {k: v or "" for k, v in found.groupdict().items()}
            sev = (part.get("sev") or ("error" if kind == "golangci" else "info")).lower()
            rule = part.get("rule", "")
            if not rule and kind == "gcc-short" and sev not in ("note", "help"):
                rule = f"-W{sev}"
            if not rule:
                return None
            return {
                "kind": kind, "sev": SEVERITY_ALIASES.get(sev, sev), "file": part["file"].strip(), "line": int(part["line"]), "col": int(part.get("col") or 0),
                "rule": rule, "msg": part["msg"].strip(), "help": "",
            }
    return None


def _block(lines: list[str], i: int) -> re.Match | None:
    """The opener of a block: a message line with its place on the next line."""
    if i + 1 < len(lines) and RUST_PLACE.match(lines[i + 1]):
        return RUST_OPEN.match(lines[i].rstrip()) or RUFF_OPEN.match(lines[i].rstrip())
    return None


def verbose_findings(lines: list[str]) -> list[dict]:
    """Findings that take several lines, or stand under the name of their file."""
    out: list[dict] = []
    under, i = "", 0
    while i < len(lines):
        line = lines[i].rstrip(" \t\r\n\v\f")
        if opened := _block(lines, i):
            rust = opened.re is RUST_OPEN
            place, msg, rule = RUST_PLACE.match(lines[i + 1]), opened["msg"].strip(), opened["rule"] or ""
            if rust and (tail := RUST_RULE.search(msg)):
                rule, msg = tail[1], msg[: tail.start()].rstrip(" \t")
            sev, hint, i = opened["sev"].lower() if rust else "warning", "", i + 2
            while i < len(lines) and not (_block(lines, i) and (not rust or RUST_OPEN.match(lines[i]))):
                line = lines[i]
                if (said := RUST_HELP.match(line)) and not hint:
                    hint = said[1].strip()
                elif rust and not rule and (said := RUST_NOTE.match(line)):
                    rule = said[1]
                elif line.strip() and not SOURCE_LINE.match(line) and not line.lstrip(" \t").startswith(("|", "=", "...")) and finding(line):
                    break
                i += 1
            out.append(
                {"kind": "verbose-rustc" if rust else "verbose-ruff", "sev": SEVERITY_ALIASES.get(sev, sev), "file": place["file"], "line": int(place["line"]), "col": int(place["col"]), "rule": rule or f"-W{sev}", "msg": msg, "help": hint}
            )
            continue
        i += 1
        if found := finding(line):
            while i < len(lines) and (not lines[i].strip() or SOURCE_LINE.match(lines[i]) or (not found["help"] and RUST_HELP.match(lines[i]))):
                if said := RUST_HELP.match(lines[i]):
                    found["help"] = found["help"] or said[1].strip()
                i += 1
            out.append(found)
        elif STYLISH_FILE.match(line) and not line.endswith(":"):
            under = line
        elif under and (row := STYLISH_ROW.match(line)):
            out.append({"kind": "eslint-stylish", "sev": row["sev"], "file": under, "line": int(row["line"]), "col": int(row["col"]), "rule": row["rule"], "msg": row["msg"].strip(), "help": ""})
    return out


def lint_findings(text: str) -> list[dict]:
    clean = ANSI.sub("", text)
    lines = lines_of(clean)
    return verbose_findings(lines) if VERBOSE.search(clean) else [f for x in lines if (f := finding(x))]


def lint_report(findings: list[dict], most: int = 0) -> str:
    """Findings by rule: the worst and most frequent rules first, ``most`` of a rule if not 0."""
    by: dict[str, list[dict]] = {}
    for f in findings:
        by.setdefault(f["rule"], []).append(f)
    rank = lambda fs: max(SEVERITY_RANK.get(f["sev"], 0) for f in fs)
    out = []
    for rule, fs in sorted(by.items(), key=lambda x: (-rank(x[1]), -len(x[1]), x[0])):
        for f in fs[: most or None]:
            place = f"{f['file']}:{f['line']}" + (f":{f['col']}" if f["col"] else "")
            out.append(f"{SEVERITY_LETTERS.get(f['sev'], f['sev'][:1].upper() or '?')}\t{place}\t{rule}\t{f['msg']}")
            if f["help"]:
                out.append(f"-\t{place}\t{rule}\thelp: {f['help']}")
        if most and len(fs) > most:
            out.append(f"-\t\t{rule}\t+{len(fs) - most} more {rule}")
    return "\n".join(out) + "\n"


def lint(text: str) -> str:
    found = lint_findings(text)
    return lint_report(found) if found else text


# tables of vulnerabilities

_COLUMNS = (("library", "lib"), ("vulnerability", "vuln"), ("severity", "sev"), ("status", "status"), ("installed", "installed"), ("fixed", "fixed"), ("title", "title"))


def _cells(line: str) -> list[str] | None:
    """The cells of a row between box lines; None for borders and other lines."""
    row = line.strip()
    return [c.strip() for c in row[1:-1].split("│")] if len(row) > 1 and row[0] == row[-1] == "│" and "─" not in row else None


def vulnerabilities(text: str) -> list[dict]:
    """The findings of all tables with the columns of a vulnerability report; wrapped titles are joined."""
    out: list[dict] = []
    names: dict[str, int] | None = None
    current, fresh = None, False
    for line in lines_of(ANSI.sub("", text)):
        bare, cells = line.strip(), _cells(line)
        if bare.startswith("┌") and bare.endswith("┐") or "─" in line and bare.endswith("┘"):
            names, current = None, None
        elif cells is None:
            fresh = fresh or "─" in line
        elif names is None:
            if VULN_HEADER.search(" | ".join(cells)):
                names = {}
                for i, cell in enumerate(cells):
                    if name := next((n for word, n in _COLUMNS if word in cell.lower()), None):
                        names[name] = i
        elif len(cells) > max(names.values()):
            row = {n: cells[names[n]] if n in names else "" for _, n in _COLUMNS}
            again = current is not None and any(row[n] and current[n] for _, n in _COLUMNS if n != "title")
            if current is None or fresh and row["vuln"] or again:
                current = row
                out.append(row)
            else:
                current["title"] = f"{current['title']} {row['title']}".strip()
                current.update({n: row[n] for _, n in _COLUMNS if n != "title" and row[n]})
            fresh = False
    return [f for f in out if f["vuln"]]


def vulnerability_report(findings: list[dict]) -> str:
    """A line per valid finding, the worst first; library, severity and version hold until they change."""
    rows, held = [], {"lib": "", "sev": "", "installed": ""}
    for f in findings:
        held = {k: (f[k].strip().lower() if k == "sev" else f[k]) or v for k, v in held.items()}
        if VULN_ID.fullmatch(f["vuln"]):
            title = " ".join(_URL.sub("", f["title"]).split())
            letter = VULN_LETTERS.get(held["sev"], held["sev"][:1].upper() or "?")
            lib = f"{held['lib']}@{held['installed']}" if held["installed"] else held["lib"]
            rows.append((-VULN_RANK.get(held["sev"], 0), "\t".join((letter, lib, f["vuln"], f["fixed"].strip() or "-", title))))
    return "".join(f"{line}\n" for _, line in sorted(rows))


def vulnerability(text: str) -> str:
    return vulnerability_report(vulnerabilities(text)) or text


# structured logs


def _go_json_text(value) -> str:
    """JSON as Go writes it: object keys sorted, angle brackets and ampersands escaped, whole floats without a point."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(v[k]) for k in sorted(v)}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e21 else v

    raw = json.dumps(plain(value), ensure_ascii=False, separators=(",", ":"))
    return raw.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


_STRING = re.compile(r'"((?:[^"\\]|\\.)*+)"( *:)?', re.S)


def _keys_in(line: str) -> list[str]:
    """Keys as they stand in a line, those of nested objects among them: the order of a record's fields."""
    return [m[1] for m in _STRING.finditer(line) if m[2]]


def ndjson(text: str) -> str:
    """Records by signature, the worst level first: the first record of each, and how many there are."""
    groups: dict[tuple, list] = {}
    other = []
    for line in lines_of(text):
        if not line.strip():
            continue
        record = log.parse_record(line)
        if record is None:
            other.append(line)
            continue
        status, path = (log.record_field(record, k) for k in (log.STATUS_KEYS, log.PATH_KEYS))
        status = f"{status[0]}xx" if re.fullmatch("[1-5][0-9]{2}", status) else status
        key = (log.record_level(record), log.record_message(record), log.record_field(record, log.METHOD_KEYS), status, shape_of(path))
        groups.setdefault(key, [record, 0, line])[1] += 1
    if not groups:
        return text
    out = []
    for _, (record, n, line) in sorted(groups.items(), key=lambda x: -log.LEVEL_RANK.get(x[0][0], 0)):
        record = record | ({"_count": n} if n > 1 else {})
        named = dict.fromkeys([k for k in _keys_in(line) if k in record] + list(record))
        out.append("{" + ",".join(f"{_go_json_text(k)}:{_go_json_text(record[k])}" for k in named) + "}")
    return "\n".join([*out, *([""] if other else []), *other]) + ("\n" if text.endswith("\n") else "")


_SEGMENT = re.compile(rf"[0-9]+|[\x00-\x7f]{{8}}(?:-[\x00-\x7f]{{4}}){{3}}-[\x00-\x7f]{{12}}|[0-9a-fA-F]{{24,}}|{UUID}")


def shape_of(path: str) -> str:
    return "/".join("<var>" if _SEGMENT.fullmatch(s) else s for s in re.split("[?#]", path, maxsplit=1)[0].split("/"))


_KEYS = re.compile(r"(?:[A-Za-z]:[\\/][^\s\"']+)|(?:/[^\s\"']{2,})|(?:\b\d{3}\b)|(?:\b[A-Z]{2,}\d+\b)|(?:\bv?\d+\.\d+\.\d+(?:-[A-Za-z0-9.+-]+)?\b)", re.A)


def group_report(lines: list[str], total: int | None = None) -> str:
    """Lines by signature as blocks of key=value lines, the worst level and most frequent first; ``total`` lines were read."""
    groups: dict[str, list[str]] = {}
    for line in lines:
        groups.setdefault(signature_of(line), []).append(line)
    out = []
    for sig, held in sorted(groups.items(), key=lambda x: (-RANK.get(level_of(x[1][0]), 0), -len(x[1]), x[0])):
        keys = list(dict.fromkeys(k for line in held for k in _KEYS.findall(line)))[:MOST_KEYS]
        sample = held[0] if len(held[0]) <= SAMPLE_CHARS else held[0][:SAMPLE_CHARS] + "…"
        out.append(f"sig={sig}\nlevel={level_of(held[0])}\ncount={len(held)}\nsample={sample}\nkeys={','.join(keys)}\n\n")
    return "".join(out) + f"tail={len(lines) if total is None else total}→{len(groups)}\n"


def cordon(text: str, embed: anomaly.Embedder = anomaly.hash_embedder) -> str:
    """Groups of the lines in the most outlying windows; a text of fewer than two windows' worth of lines stays."""
    lines = [x for x in (x.removesuffix("\r") for x in text.split("\n")) if x.strip()]
    if len(lines) < 2 * anomaly.SIZE:
        return text
    starts = range(0, len(lines) - anomaly.SIZE + 1, anomaly.STRIDE)
    vectors = embed(["\n".join(lines[s : s + anomaly.SIZE])[: anomaly.CHARS] for s in starts])
    scores = anomaly.mean_nearest(vectors, anomaly.NEIGHBOURS)
    top = sorted(range(len(starts)), key=lambda i: (-scores[i], i))[: max(int(len(starts) * anomaly.PERCENT / 100), 1)]
    flagged = sorted({starts[i] + j for i in top for j in range(anomaly.SIZE)})
    return group_report([lines[i] for i in flagged], len(lines))


# HTTP archives


def har(text: str) -> str:
    """Requests but for static assets, a line each, with secrets hidden and bodies that matter."""
    if not text.strip().startswith("{") or '"entries"' not in text:
        return text
    try:
        archive = json.loads(text)["log"]
        entries = archive["entries"]
        out, dropped = [], 0
        for e in entries:
            said = _entry(e)
            dropped += said is None
            out += said or []
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return text
    if not out:
        return text
    return "\n".join([f"HAR {archive.get('version', '')}: {len(entries) - dropped} requests ({dropped} static dropped)", *out]) + "\n"


_MIME = re.compile(redact.STATIC_MIME[4:], re.I)


def hide_url(url: str) -> str:
    url = re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", rf"\g<1>{redact.HIDDEN}@", url)
    before, hashed, fragment = url.partition("#")
    path, asked, query = before.partition("?")
    return path + asked + redact.hide_params(query) + hashed + (redact.hide_params(fragment) if "=" in fragment else fragment)


def _entry(e: dict) -> list[str] | None:
    request, response = e.get("request") or {}, e.get("response") or {}
    content, url = response.get("content") or {}, request.get("url", "")
    mime = content.get("mimeType", "").split(";")[0].strip()
    if re.split("[?#]", url, maxsplit=1)[0].lower().endswith(redact.STATIC_EXTENSIONS) or mime and _MIME.match(mime):
        return None
    size, took, status = content.get("size") or 0, e.get("time") or 0, response.get("status") or 0
    about = [mime, (f"{size >> 20}MB" if size >= 1 << 20 else f"{size >> 10}KB" if size >= 1 << 10 else f"{size}B") if size > 0 else "", f"{int(took + 0.5)}ms" if took > 0 else ""]
    about = [x for x in about if x]
    out = [f"{request.get('method', '').upper()} {status} {hide_url(url)}" + (f"  ({' '.join(about)})" if about else "")]
    out += [f"  {h['name']}: {redact.HIDDEN}" for h in request.get("headers") or [] if h.get("name", "").lower() in redact.SECRET_HEADERS]
    if posted := request.get("postData"):
        body = redact.hide_body(posted.get("text", ""), posted.get("mimeType", ""))
        body = body or "&".join(f"{p['name']}={redact.HIDDEN if redact.is_secret(p['name']) else p.get('value', '')}" for p in posted.get("params") or [])
        out += [f"  → {body}"] if body else []
    if "json" in content.get("mimeType", "") or status >= 400:
        body = redact.hide_body(content.get("text", ""), content.get("mimeType", ""))
        out += [f"  ← {body}"] if body else []
    return out


def apply(distil: Callable[[str], str], name: str = "distilled"):
    """A column function of a distiller. Errors and empty or longer results leave the input as it is."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else guarded(distil, t))

    run.__name__ = name
    return F.pandas_udf(run, StringType())


#: Seconds that a distiller may take over one text.
DEADLINE = 30.0


def within(seconds: float, f: Callable, *args):
    """``f`` of ``args``, or a TimeoutError after so many seconds; without a limit outside a process's main thread, where no alarm arrives."""
    if threading.current_thread() is not threading.main_thread() or not hasattr(signal, "setitimer"):
        return f(*args)

    def late(*_) -> None:
        raise TimeoutError(f"no result after {seconds} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return f(*args)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def guarded(distil: Callable[[str], str], text: str, seconds: float = DEADLINE) -> str:
    """What the distiller makes of the text if that is in time, shorter in bytes and not empty, else the text."""
    try:
        out = within(seconds, distil, text)
    except Exception:  # a distiller must never lose its input
        return text
    return out if out and out.strip() and len(out.encode("utf-8", "surrogatepass")) < len(text.encode("utf-8", "surrogatepass")) else text


def distil(docs: DataFrame, distiller: Callable[[str], str], text: str = "text") -> DataFrame:
    """``docs`` with the column ``distilled`` behind the others."""
    return docs.withColumn("distilled", apply(distiller)(F.col(text)))
