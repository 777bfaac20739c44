"""Distillers on inputs of our own in the shapes of real tools."""

import json
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomsift.operators import distillers as d
from loomsift.operators import routing
from loomsift.sources import cases, readers

TEXTS = st.text(alphabet="ab1 :=\n\t{}\"[]()-+@#<>|│┌┐└┘─.", max_size=200)
ALL = [d.git, d.npm, d.cargo, d.pytest, d.go_test, d.stack_trace, d.lint, d.vulnerability, d.ndjson, d.har]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_never_longer_never_lost(text):
    for f in ALL:
        out = d.guarded(f, text)
        assert out == text or (out.strip() and len(out.encode()) < len(text.encode()))


def test_guard_keeps_input_on_error():
    assert d.guarded(lambda t: 1 / 0, "abc") == "abc"
    assert d.guarded(lambda t: "", "abc") == "abc"
    assert d.guarded(lambda t: "abcd", "abc") == "abc"
    assert d.guarded(lambda t: "ab", "abc") == "ab"


def test_git():
    diff = "commit abc\n\n\ndiff --git a/x.py b/x.py\nindex 1..2\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-old\n+new\n+more\n ctx\ndiff --git a/y b/y\nBinary files differ\n"
    assert d.git(diff) == "commit abc\n\ndiff x.py (+2 -1)\ndiff y (+0 -0)\n"
    assert d.git('On branch main\n  (use "git add")\nfile\n\n\n') == "On branch main\nfile\n"


def test_npm():
    assert d.npm("npm notice a\nnpm notice a\nnoise\n\n\nadded 3 packages\n+-- lodash@4.1.0\n├── x@1.0\n") == "npm notice a\n\nadded 3 packages\nlodash@4.1.0\n"


def test_cargo():
    assert d.cargo("   Compiling x\nerror[E1]: bad\n  --> a.rs:1\n  --> b.rs:1\nnoise\n    Finished dev\n") == "error[E1]: bad\n  --> a.rs:1\n    Finished dev\n"


def test_pytest_sections():
    text = "=== test session starts ===\nplatform x\ncollected 2 items\n\na.py .F   [100%]\n=== FAILURES ===\nboom\n=== warnings summary ===\nw\n=== 1 failed in 0.1s ===\n"
    out = d.pytest(text)
    assert "platform" not in out and "a.py .F" not in out and "boom" in out and "\nw\n" in out
    assert "\nw\n" not in d.pytest(text.replace("FAILURES", "OTHER").replace("1 failed", "1 passed"))
    assert d.pytest("no sections\n") == "no sections\n"


def test_go_json_and_text():
    events = [{"Action": "run", "Test": "A"}, {"Action": "output", "Test": "A", "Output": "  boom\n"}, {"Action": "fail", "Test": "A", "Package": "p"}, {"Action": "skip", "Test": "B"}, {"Action": "fail", "Package": "p"}]
    assert d.go_test("\n".join(map(json.dumps, events))) == "--- FAIL: A\n    boom\n(skipped 1 test(s))\nFAIL p\n"
    assert d.go_test("=== RUN   A\n  log\n--- FAIL: A (0s)\n=== RUN   B\n  gone\n--- PASS: B (0s)\nFAIL\tp\t0s\n") == "  log\n--- FAIL: A (0s)\nFAIL\tp\t0s\n"


def test_stack_trace():
    frames = "".join(f'  File "a.py", line {i}, in f\n    x({i})\n' for i in range(9))
    out = d.stack_trace("before\nTraceback (most recent call last):\n" + frames + "ValueError: x\n")
    assert out.startswith("before\nTraceback") and "... 3 frames omitted ..." in out and out.endswith("ValueError: x\n")
    same = '  File "a.py", line 1, in f\n    x()\n' * 5
    assert "    x()    × 5" in d.stack_trace("Traceback (most recent call last):\n" + same + "E\n")


LINT = {
    "a.py:1:2: E501 line too long": ("flake", "info", "E501"),
    "a.sh:1:2: note: quote [SC2086]": ("shellcheck", "note", "SC2086"),
    "a.rb:1:2: C: [Correctable] Style/X: bad": ("rubocop", "convention", "Style/X"),
    "a.css:1:2: error  bad [no-x]": ("stylelint", "error", "no-x"),
    "a.js: line 1, col 2, Warning - bad (no-x)": ("eslint-compact", "warning", "no-x"),
    "a.js:1:2: bad [Error/no-x]": ("eslint-unix", "error", "no-x"),
    "a.go:1:2: bad (errcheck)": ("golangci", "error", "errcheck"),
    "[a.go:1] - G104 (CWE-703): bad (Confidence: HIGH, Severity: LOW)": ("gosec", "info", "G104"),
    "a.c:1:2: warning: bad": ("gcc-short", "warning", "-Wwarning"),
    "a.c:1:2: fatal error: bad [-Wx]": ("gcc-short", "fatal error", "-Wx"),
    "a.py:1: error: bad [arg-type]": ("mypy", "error", "arg-type"),
    "a.ts(1,2): error TS2304: bad": ("tsc", "error", "TS2304"),
}


@pytest.mark.parametrize("line", LINT)
def test_lint_shapes(line):
    f = d.finding(line)
    assert (f["kind"], f["sev"], f["rule"]) == LINT[line]


def test_lint_shapes_in_sql(spark):
    from loomsift.operators.findings import terse

    rows = spark.createDataFrame([(x,) for x in [*LINT, "noise", "a.c:1:2: note: see", ""]], "line string").select("line", terse("line").alias("f")).collect()
    for r in rows:
        want = d.finding(r.line)
        assert (r.f.asDict() if r.f else None) == want, r.line


def test_lint_report():
    fs = d.lint_findings("a.py:1:2: E501 long\na.py:2:2: E501 long\na.c:1:2: error: bad [-Wx]\n")
    assert d.lint_report(fs).split("\n")[0] == "E\ta.c:1:2\t-Wx\tbad"
    assert "+1 more E501" in d.lint_report(fs, 1)
    block = "warning: unused\n  --> src/a.rs:3:5\n   |\n3 | let x;\n   = help: remove it\n\n"
    assert d.lint_findings(block) == [{"kind": "verbose-rustc", "sev": "warning", "file": "src/a.rs", "line": 3, "col": 5, "rule": "-Wwarning", "msg": "unused", "help": "remove it"}]


TABLE = """x (alpine)
Total: 2
┌─────────┬────────────────┬──────────┬────────┬───────────────────┬───────────────┬──────────────┐
│ Library │ Vulnerability  │ Severity │ Status │ Installed Version │ Fixed Version │ Title        │
├─────────┼────────────────┼──────────┼────────┼───────────────────┼───────────────┼──────────────┤
│ zlib    │ CVE-2022-37434 │ CRITICAL │ fixed  │ 1.2.11            │ 1.2.12        │ heap over-   │
│         │                │          │        │                   │               │ read https://a.b/c │
│         ├────────────────┼──────────┤        │                   ├───────────────┼──────────────┤
│         │ CVE-2018-25032 │ HIGH     │        │                   │               │ memory       │
└─────────┴────────────────┴──────────┴────────┴───────────────────┴───────────────┴──────────────┘
"""


def test_vulnerabilities(spark):
    want = "C\tzlib@1.2.11\tCVE-2022-37434\t1.2.12\theap over- read\nH\tzlib@1.2.11\tCVE-2018-25032\t-\tmemory\n"
    assert d.vulnerability(TABLE) == want
    from loomsift.operators.findings import vuln_report, vulns

    df = spark.createDataFrame([(1, TABLE)], "doc_id long, text string")
    lines = [r.line for r in vuln_report(vulns(df)).orderBy("rank", ascending=False).collect()]
    assert "\n".join(lines) + "\n" == want


def test_ndjson_counts_are_kept():
    text = "\n".join(['{"level":"info","msg":"a","path":"/u/1"}', "noise", '{"level":"info","msg":"a","path":"/u/2"}', '{"severity":17,"msg":"b"}']) + "\n"
    assert d.ndjson(text) == '{"severity":17,"msg":"b"}\n{"level":"info","msg":"a","path":"/u/1","_count":2}\n\nnoise\n'
    assert d.ndjson("plain\n") == "plain\n"


def test_har():
    entry = {
        "request": {"method": "post", "url": "https://u:p@x.org/a?token=s&b=1#t", "headers": [{"name": "Cookie", "value": "c"}], "postData": {"mimeType": "application/x-www-form-urlencoded", "text": "password=x&a=1"}},
        "response": {"status": 500, "content": {"size": 2048, "mimeType": "application/json; x", "text": '{"token": {"a": 1}, "b": 2}'}}, "time": 1.5,
    }
    static = {"request": {"method": "GET", "url": "https://x.org/a.css?v"}, "response": {"status": 200}}
    out = d.har(json.dumps({"log": {"version": "1.2", "entries": [entry, static]}}))
    assert out.split("\n") == [
        "HAR 1.2: 1 requests (1 static dropped)", "POST 500 https://<redacted>@x.org/a?token=<redacted>&b=1#t  (application/json 2KB 2ms)", "  Cookie: <redacted>",
        "  → password=<redacted>&a=1", '  ← {"b":2,"token":"<redacted>"}', "",
    ]
    assert d.har('{"log": {"entries": []}}') == '{"log": {"entries": []}}'


def test_cordon_groups_rare_lines_only(spark):
    from loomsift.operators import anomaly

    lines = [f"info worker {i} ticked at {i * 7}" for i in range(200)]
    lines[100] = "ERROR disk /dev/sda1 failed with EIO5"
    out = d.cordon("\n".join(lines) + "\n\n")
    flagged = [r.line for r in anomaly.flagged_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).orderBy("line_no").collect()]
    assert out == d.group_report(flagged, 200) and len(flagged) < 200
    assert "ERROR disk" in out and out.split("\n")[-2].startswith("tail=200→")
    few = "\n".join(lines[:19])
    assert d.cordon(few) == few


def test_files_are_distilled(spark, sf_dir):
    from loomsift.operators import routing
    from loomsift.plans import catalog, outputs

    rows = catalog.QUERIES["distil_files"](spark, sf_dir).collect()
    for r in rows:
        name = ("pdf-filter", "mhtml-filter", "har-filter", "trivy-filter")[r.doc_id % 4]
        assert (r.processor, r.path, r.outcome) == (name, "fast_path", "compressed")
        assert (f"1.2 Part {r.doc_id}", f"page {r.doc_id}", f"x.org/{r.doc_id}", f"lib{r.doc_id}")[r.doc_id % 4] in r.distilled
    pdfs = outputs.saved_files(spark, sf_dir).where("doc_id % 4 = 0").limit(2)
    assert all("1.2 Part" in r.text and "%PDF" not in r.text for r in routing.chain(pdfs, ["pdf-filter"]).collect())


def test_fields_stand_as_in_the_line():
    line = '{"b" : {"z":1,"k":[{"y":2}]},"a":"say \\"k\\": x","z":3,"y":null,"c":0}'
    out = d.ndjson("\n".join([line] * 30) + "\n")
    assert out == '{"b":{"k":[{"y":2}],"z":1},"z":3,"y":null,"a":"say \\"k\\": x","c":0,"_count":30}\n'
    own = '{"_count":7,"a":1}'
    assert d.ndjson(f"{own}\n{own}") == '{"_count":2,"a":1}'


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("^%PDF-", True), (r"\A#!", True), ("^a|^b", True), ("^a|b", False), ("(?m)^a", False), (r"(?m)\Aa", True), ("(?i)^a", True), ("(^a|\\Ab)c", True), ("(^a|b)c", False), ("(?:^a)x", True), ("(^a)?b", False), ("(?P<n>^a)|^b", True),
        ("()^a", True), ("[|(]^", False), (r"\(^a", False), ("(?m:^a)|^b", False), ("a^", False), ("", False), ("(?=^a)", False), ("^[)|]x|^y", True), (r"^\[|b", False),
    ],
)
def test_rooted_patterns(pattern, want):
    assert routing.rooted(pattern) == want


def test_distillers_have_a_deadline():
    began = time.time()
    assert d.guarded(lambda t: re.sub(r"(?:a+)+$", "", t), "a" * 40 + "b", 0.3) == "a" * 40 + "b"
    assert time.time() - began < 5 and d.guarded(lambda t: t[:2], "abc", 0.3) == "ab"


def test_activity_is_swept(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-{d:02d} 10:00:00", c, "info", "m") for d in (1, 10, 20, 21) for c in ("a", "b")], "t string, component string, level string, msg string")
    cases.write_activity(rows.withColumn("t", F.col("t").cast("timestamp")), str(tmp_path / "log"))
    (tmp_path / "log/component=a/notes").mkdir()
    assert cases.sweep_activity(spark, f"file://{tmp_path}/log", "a", "2024-01-20", 10) == ["2024-01-01"]
    assert cases.sweep_activity(spark, f"file://{tmp_path}/log", "none", "2024-01-20", 10) == []
    left = sorted(p.name for p in (tmp_path / "log/component=a").iterdir() if not p.name.endswith(".crc"))
    assert left == ["day=2024-01-10", "day=2024-01-20", "day=2024-01-21", "notes"] and len(list((tmp_path / "log/component=b").iterdir())) == 4


def test_script_processors(spark, tmp_path):
    for name, entry, code in (("first", "run.py", "import sys; sys.stdout.write(sys.stdin.read()[:5])"), ("second", "run.sh", "head -c 3"), ("fails", "run.sh", "exit 3"), ("odd", "run.rb", "x"), ("slow", "run.sh", "sleep 30")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "processor.yaml").write_text(f"name: {name}\ntype: script\nentry: {entry}\nmatch: ^hello\n")
        (tmp_path / name / entry).write_text(code)
    found, broken = readers.processors(str(tmp_path), lambda place: readers.script(place, 1.0))
    assert [p.name for p in found] == ["fails", "first", "second", "slow"] and broken == ["odd"]
    (tmp_path / "first" / "run.py").write_text("raise SystemExit(1)")  # swapped after loading
    registry = routing.Registry(found)
    docs = spark.createDataFrame([("hello wörld",)], "text string")
    assert routing.chain(docs, ["first", "fails", "second", "slow"], registry).first().text == "hel"
    long = spark.createDataFrame([("hello " * 500,)], "text string")
    assert routing.distil(long, routing.Registry([p for p in found if p.name == "first"])).first().distilled == "hello"
