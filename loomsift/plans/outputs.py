"""Queries over whole tool outputs, saved pages and PDF files that are rendered from the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsift.functions import html, prose, redact, signature
from loomsift.operators import distillers, findings, lines, pdf_tables, pdf_text, prompts, routing, telemetry
from loomsift.plans.catalog import facts, query, table
from loomsift.sources import pdf, readers

# Tool outputs by kind: the text, its processor and what is left of it; # stands for the document's id.
_KINDS = (
    ("On branch b#\n" + '  (use "git add" to add)\n' * 120 + "modified: x#\n", "git-filter", "On branch b#\nmodified: x#\n"),
    ("   Compiling a v0.1.0 (some/place/on/disk)\n" * 60 + "error[E1]: bad #\n  --> f.rs:1\n", "cargo-filter", "error[E1]: bad #\n  --> f.rs:1\n"),
    ('{"level":"info","msg":"tick tock"}\n' * 100, "ndjson-filter", 'sig=level=info;msg=tick-tock\nlevel=info\ncount=100\nsample={"level":"info","msg":"tick tock"}\nkeys=\n\ntail=100→1\n'),
    ("npm warn old #\n" + "fetching something from somewhere\n" * 80, "npm-filter", "npm warn old #\n"),
    ("=== RUN   TestA\n    a line of log output\n--- PASS: TestA (0.00s)\n" * 40 + "FAIL\tpkg#\t0.1s\n", "go-test-filter", "FAIL\tpkg#\t0.1s\n"),
    ("=== test session starts ===\n" + "plugins: and other lines of the environment\n" * 60 + "collected # items\n", "pytest-filter", "=== test session starts ===\ncollected # items\n"),
    ("panic: no #\n" + "main.f(0x1, 0x2)\n" * 150, "stacktrace-filter", "panic: no #\nmain.f(0x1, 0x2)    × 150\n"),
    ("a.py:1:2: E501 line too long\n" + "checked one more file without a finding\n" * 60, "lint-filter", "I\ta.py:1:2\tE501\tline too long\n"),
)


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def _literal(column: int) -> str:
    return "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {_sql(k[column])}" for i, k in enumerate(_KINDS)) + " END"


def tool_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): an output of some tool for each document."""
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in _KINDS]), (F.col("doc_id") % len(_KINDS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(kind, F.lit("#"), F.col("doc_id").cast("string")).alias("text"))


@query(f"SELECT doc_id, {_literal(1)} AS processor, 'fast_path' AS path, 'compressed' AS outcome, replace({_literal(2)}, '#', CAST(doc_id AS VARCHAR)) AS distilled FROM documents")
def distil_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.distil(tool_outputs(spark, sf_dir)).select("doc_id", "processor", "path", "outcome", "distilled")


@query(f"SELECT processor, count(*) AS docs, CAST(sum(strlen(t)) AS BIGINT) AS bytes_in, CAST(sum(strlen(d)) AS BIGINT) AS bytes_out FROM (SELECT {_literal(1)} AS processor, replace({_literal(0)}, '#', CAST(doc_id AS VARCHAR)) AS t, replace({_literal(2)}, '#', CAST(doc_id AS VARCHAR)) AS d FROM documents) GROUP BY 1")
def outputs_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.savings(routing.distil(tool_outputs(spark, sf_dir))).select("processor", "docs", "bytes_in", "bytes_out")


# Lines of every shape of one-line report, and what they say: kind, severity, file, column, rule and message; # is the line number.
_SHAPES = (
    ("a.sh:#:2: warning: quote it [SC2086]", "shellcheck", "warning", "a.sh", 2, "SC2086", "quote it"),
    ("b.rb:#:3: C: [Correctable] Style/Foo: use it", "rubocop", "convention", "b.rb", 3, "Style/Foo", "use it"),
    ("c.css:#:4: error  bad unit [unit-no-unknown]", "stylelint", "error", "c.css", 4, "unit-no-unknown", "bad unit"),
    ("d.js: line #, col 5, Warning - no console (no-console/x)", "eslint-compact", "warning", "d.js", 5, "no-console/x", "no console"),
    ("e.js:#:6: is not used [Error/no-unused-vars]", "eslint-unix", "error", "e.js", 6, "no-unused-vars", "is not used"),
    ("f.go:#:7: result is not used (errcheck)", "golangci", "error", "f.go", 7, "errcheck", "result is not used"),
    ("[g.go:#] - G104 (CWE-703): errors are not handled (Confidence: HIGH, Severity: HIGH)", "gosec", "error", "g.go", 0, "G104", "errors are not handled"),
    ("h.py:#:8: E501 line too long \t", "flake", "info", "h.py", 8, "E501", "line too long"),
    ("i.c:#:9: warning: unused x [-Wunused]", "gcc-short", "warning", "i.c", 9, "-Wunused", "unused x"),
    ("j.py:#: note: see there  [misc]", "mypy", "note", "j.py", 0, "misc", "see there"),
    ("k.ts(#,10): error TS2304: no name x", "tsc", "error", "k.ts", 10, "TS2304", "no name x"),
    ("m.c:#:1: error: no rule said", "gcc-short", "error", "m.c", 1, "-Werror", "no rule said"),
    ("j.py:#: note: without a rule", "", "", "", 0, "", ""), ("plain line # of text", "", "", "", 0, "", ""), ("[g.go:#] - G104 (CWE-x): no", "", "", "", 0, "", ""),
)


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join([str(k), *[_sql(x) if isinstance(x, str) else str(x) for x in row]]) + ")" for k, row in enumerate(rows))


def _numbered(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    """(ord, n, text): orders as texts of some kinds in turn, the customer's number in them."""
    text = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("o_orderkey") % len(kinds) + 1).cast("int"))
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("n"), F.replace(text, F.lit("#"), F.col("o_custkey").cast("string")).alias("text"))


@query(f"""
WITH s(k, text, kind, sev, file, col, rule, msg) AS (VALUES {_values(_SHAPES)})
SELECT o_orderkey AS ord, kind, sev, file, CAST(o_custkey AS INTEGER) AS line, CAST(col AS INTEGER) AS col, rule, msg FROM orders JOIN s ON o_orderkey % {len(_SHAPES)} = k WHERE kind <> ''""")
def lint_all_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines_ = _numbered(spark, sf_dir, [x[0] for x in _SHAPES])
    return findings.terse_rows(lines_.withColumn("doc_id", F.lit(0)), line="text").drop("doc_id", "help")


# Reports whose findings take several lines, and the findings of each: kind, severity, file, line, column, rule, message and help.
_BLOCKS = (
    ("warning: unused variable: `x#`\n  --> src/m.rs:#:9\n   |\n3 | let x = 1;\n   |     ^\n   |\n   = note: `#[warn(unused_variables)]` on by default\n",
     (("verbose-rustc", "warning", "src/m.rs", "#", 9, "unused_variables", "unused variable: `x#`", ""),)),
    ("error[E0308]: mismatched types\n  --> src/n.rs:#:4\n   |\n4 | f(x)\n   |   ^\n  = help: try x#\n\nwarning: unused [clippy::all]\n  --> src/o.rs:#:5\n",
     (("verbose-rustc", "error", "src/n.rs", "#", 4, "E0308", "mismatched types", "try x#"), ("verbose-rustc", "warning", "src/o.rs", "#", 5, "clippy::all", "unused", ""))),
    ("F401 [*] `os` imported but unused\n --> p.py:#:8\n  |\n1 | import os\n  |        ^^\n  |\nhelp: Remove `os`\n\nE711 Compare to None\n --> q.py:#:2\n",
     (("verbose-ruff", "warning", "p.py", "#", 8, "F401", "`os` imported but unused", "Remove `os`"), ("verbose-ruff", "warning", "q.py", "#", 2, "E711", "Compare to None", ""))),
    ("\n/src/app#.js\n  #:3  error  Missing semicolon  semi\n  #:14  warning  Unexpected console  no-console/x\n\n/src/b.js\n  #:1  error  Bad  @a/b\n\n3 problems\n",
     (("eslint-stylish", "error", "/src/app#.js", "#", 3, "semi", "Missing semicolon", ""), ("eslint-stylish", "warning", "/src/app#.js", "#", 14, "no-console/x", "Unexpected console", ""), ("eslint-stylish", "error", "/src/b.js", "#", 1, "@a/b", "Bad", ""))),
    ("lib/a.c:#:7: warning: unused x [-Wunused]\n  7 | int x;\n    |     ^\n  help: drop it\nchecked # files\n", (("gcc-short", "warning", "lib/a.c", "#", 7, "-Wunused", "unused x", "drop it"),)),
)
_BLOCK_ROWS = [(k, i, *(str(x) for x in f)) for k, (_, found) in enumerate(_BLOCKS) for i, f in enumerate(found)]


@query(f"""
WITH s(k, ord, kind, sev, file, line, col, rule, msg, help) AS (VALUES {", ".join("(" + ", ".join([str(r[0]), str(r[1]), *map(_sql, r[2:])]) + ")" for r in _BLOCK_ROWS)}),
o AS (SELECT o_orderkey AS doc_id, o_orderkey % {len(_BLOCKS)} AS k, CAST(o_custkey AS VARCHAR) AS n FROM orders)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, kind, sev, replace(file, '#', n) AS file, CAST(replace(line, '#', n) AS INTEGER) AS line, CAST(col AS INTEGER) AS col, rule, replace(msg, '#', n) AS msg, replace(help, '#', n) AS help FROM o JOIN s USING (k)""")
def lint_verbose_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the attribute of a note keeps its own hash sign
    texts = [x[0].replace("`#[", "`\x02[") for x in _BLOCKS]
    docs = _numbered(spark, sf_dir, texts).select(F.col("ord").alias("doc_id"), F.translate("text", "\x02", "#").alias("text"))
    return findings.lint(docs)


@query(r"""
SELECT event_id, 'level=' || CASE event_id % 7 WHEN 0 THEN 'err' WHEN 1 THEN 'warning' WHEN 2 THEN 'debug' ELSE 'info' END || ';severity=x;method=get;status_code=' || CASE event_id % 3 WHEN 0 THEN '2xx' WHEN 1 THEN '4xx' ELSE '7' END
  || ';path=/users/<n>/items' || CASE event_id % 2 WHEN 0 THEN '/<hex>' ELSE '' END || ';caller=main-go-' || event_id % 9 || ';msg=' || event_type || '-by-user;service=shop' AS sig,
  CASE event_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' WHEN 2 THEN 'debug' ELSE 'info' END AS level FROM events""")
def shaped_signature_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured lines behind a prefix, some of their fields a level down."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    level = F.when(i % 7 == 0, "ERR").when(i % 7 == 1, "Warning").when(i % 7 == 2, "debug").otherwise("info")
    path = F.concat(F.lit("/users/"), F.col("user_id").cast("string"), F.lit("/items"), F.when(i % 2 == 0, "/deadbeef99/more/segments?x=1").otherwise("?q=/a"))
    line = F.concat(
        F.lit('2024-01-01 host {"msg":"'), "event_type", F.lit(' by user '), F.col("user_id").cast("string"), F.lit(' now","severity":"x","level":"'), level, F.lit('","labels":{"method":"GET","status_code":'),
        F.when(i % 3 == 0, "201").when(i % 3 == 1, "404").otherwise("7"), F.lit(',"service":"Shop"},"path":"'), path, F.lit('","caller":"main.go:'), (i % 9).cast("string"), F.lit('"}'),
    )
    return e.select("event_id", signature.shape(line).alias("s")).select("event_id", "s.sig", "s.level")


@query(r"""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'user=' || conv_id || '&api_token=<redacted>&q=' || role || '&password[]=<redacted>'
  WHEN 1 THEN '{"a":[{"token":"<redacted>"},' || conv_id || '],"b":"' || role || '","client_secret":"<redacted>"}' ELSE 'plain ' || role || ' of <redacted>' END AS body FROM conversations""")
def redact_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t, n = table(spark, sf_dir, "conversations"), F.col("turn") % 3, F.col("conv_id").cast("string")
    form = F.concat(F.lit("user="), n, F.lit("&api_token=s1&q="), "role", F.lit("&password[]=x"))
    made = F.concat(F.lit('{ "client_secret": {"x": 1}, "b": "'), "role", F.lit('", "a": [{"token": "t"}, '), n, F.lit("]}"))
    plain = F.concat(F.lit("plain  "), "role", F.lit("\n of eyJhbGciOi.eyJzdWIiOi.abcdefgh "))
    return c.select("conv_id", "turn", redact.redact_body(F.when(t == 0, form).when(t == 1, made).otherwise(plain)).alias("body"))


_HEAD = "┌──┐\n│ Library │ Vulnerability │ Severity │ Status │ Installed Version │ Fixed Version │ Title │\n"


@query("""
SELECT p_partkey % 40 AS doc_id, 'H' || chr(9) || 'lib' || p_partkey || '@1.0' || chr(9) || 'CVE-2024-' || p_partkey || chr(9) || '-' || chr(9) || 'flaw of ' || p_size AS line FROM part""")
def trivy_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    row = F.concat(F.lit("│ lib"), key, F.lit(" │ CVE-2024-"), key, F.lit(" │ HIGH │ fixed │ 1.0 │  │ flaw of │\n│  │  │  │  │  │  │ "), F.col("p_size").cast("string"), F.lit(" │\n├──┤\n"))
    held = F.array_join(F.sort_array(F.collect_list(row)), "")
    reports = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).alias("doc_id")).agg(F.concat(F.lit(_HEAD + "├──┤\n"), held, F.lit("└──┘\n")).alias("text"))
    return findings.vuln_report(findings.vulns(reports)).select("doc_id", "line")


@query("SELECT page_id, 'page ' || page_id || ' of **' || length(url) || '**' || chr(10) AS markdown FROM pages")
def mhtml_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(
        F.lit("Subject: x\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/html\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<nav>n</nav><p>p=\r\nage "),
        F.col("page_id").cast("string"), F.lit(" of <b>"), F.length("url").cast("string"), F.lit("</b></p>\r\n--B--\r\n"),
    )
    return table(spark, sf_dir, "pages").select("page_id", html.mhtml_to_markdown(page.cast("binary")).alias("markdown"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_bin): a small PDF for each page of the table."""
    shown = F.concat(F.lit("BT /F1 10 Tf 72 700 Td (1.2 Part "), F.col("page_id").cast("string"), F.lit(") Tj 0 -30 Td (has words) Tj 60 0 Td (and more) Tj ET"))
    file = F.concat(
        F.lit("%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Kids[3 0 R]>> endobj\n3 0 obj <</Type/Page/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>> endobj\n4 0 obj <</Length "),
        F.length(shown).cast("string"), F.lit(">> stream\n"), shown, F.lit("\nendstream endobj\n5 0 obj <</Type/Font/BaseFont/F>> endobj\ntrailer <</Root 1 0 R/Info<</Title(T)>>>>"),
    )
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), file.cast("binary").alias("raw_bin"))


_FILE_TASKS = 100


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_bin): orders as PDF tables, a file for each of 100 groups of customers and a page for each status, numbered lines above and below."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("doc_id"), F.col("o_orderstatus").alias("status"), "o_orderkey", "o_orderpriority", "o_totalprice")
    # the rows of a file are dealt out once, narrow, and to many tasks, as files take long to read; pages and files are made where they are
    o = o.repartition(_FILE_TASKS, "doc_id")
    by = Window.partitionBy("doc_id", "status").orderBy("o_orderkey")
    # texts of one column are as wide as each other: gaps are found by their middles
    y = (650 - 14 * F.row_number().over(by)).cast("string")
    shown = lambda x, y, text: F.concat(F.lit(f"BT /F1 10 Tf 1 0 0 1 {x} "), y, F.lit(" Tm ("), text, F.lit(") Tj ET\n"))
    row = F.concat(shown(50, y, F.lpad(F.col("o_orderkey").cast("string"), 8, "0")), shown(150, y, F.substring("o_orderpriority", 3, 3)), shown(300, y, F.format_string("%.2f", "o_totalprice")))
    rows = o.select("doc_id", "status", "o_orderkey", row.alias("row"))
    held = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "row"))), lambda x: x["row"]), "")
    head = F.concat(*[F.lit(f"BT /F1 10 Tf 1 0 0 1 {x} 650 Tm ({name}) Tj ET\n") for x, name in ((50, "OrderKey"), (150, "Pri"), (300, "Price"))])
    top = F.concat(F.lit("BT /F1 14 Tf 72 760 Td (1.2 Orders of group "), F.col("doc_id").cast("string"), F.lit(") Tj ET\n"))
    pages = rows.groupBy("doc_id", "status").agg(held.alias("held")).select("doc_id", "status", F.concat(top, head, "held").alias("shown"))
    pages = pages.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("status", "shown"))), lambda x: x["shown"]).alias("pages"))
    numbers = F.sequence(F.lit(0), F.size("pages") - 1)
    kids = F.array_join(F.transform(numbers, lambda k: F.concat((4 + 2 * k).cast("string"), F.lit(" 0 R"))), " ")
    objects = F.array_join(F.transform(numbers, lambda k: F.concat(
        (4 + 2 * k).cast("string"), F.lit(" 0 obj <</Type/Page/Contents "), (5 + 2 * k).cast("string"), F.lit(" 0 R/Resources<</Font<</F1 3 0 R>>>>>> endobj\n"), (5 + 2 * k).cast("string"), F.lit(" 0 obj <</Length "),
        F.length(F.get("pages", k)).cast("string"), F.lit(">> stream\n"), F.get("pages", k), F.lit("\nendstream endobj\n"),
    )), "")
    file = F.concat(F.lit("%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Kids["), kids, F.lit("]>> endobj\n3 0 obj <</Type/Font/BaseFont/F>> endobj\n"), objects, F.lit("trailer <</Root 1 0 R>>"))
    return pages.select("doc_id", file.cast("binary").alias("raw_bin"))


_ORDER_ROWS = """o AS (SELECT o_custkey % 100 AS doc_id, o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS key, substr(o_orderpriority, 3, 3) AS priority, printf('%.2f', o_totalprice) AS price, o_orderstatus,
  row_number() OVER (PARTITION BY o_custkey % 100, o_orderstatus ORDER BY o_orderkey) AS n, dense_rank() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderstatus) AS p, count(*) OVER (PARTITION BY o_custkey % 100, o_orderstatus) AS held FROM orders)"""


@query(f"""
WITH {_ORDER_ROWS}, c AS (SELECT *, unnest([0, 1, 2]) AS k FROM o WHERE held >= 2)
SELECT doc_id, CAST(p - 1 AS INTEGER) AS page, CAST(n - 1 AS INTEGER) AS row, CAST(k AS INTEGER) AS "column", ['OrderKey', 'Pri', 'Price'][k + 1] AS name, [key, priority, price][k + 1] AS text FROM c""")
def pdf_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_tables.cells(order_files(spark, sf_dir)).drop("number")


@query(f"""
WITH {_ORDER_ROWS}, g AS (SELECT doc_id, p, any_value(held) AS held, string_agg('| ' || key || ' | ' || priority || ' | ' || price || ' |', chr(10) ORDER BY n) AS rows FROM o GROUP BY 1, 2)
SELECT doc_id, CAST(p AS INTEGER) AS page, '### Table ' || p || '.1' || chr(10) || chr(10) || '| OrderKey | Pri | Price |' || chr(10) || '| --- | --- | --- |' || chr(10) || rows AS markdown FROM g WHERE held >= 2""")
def pdf_tables_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables in the Markdown of whole files."""
    made = order_files(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(pdf_text.pdf_to_markdown("raw_bin"), F.lit(r"### Table \d+\.\d+\n\n(?:\|[^\n]*+\n?)*+"), F.lit(0))).alias("t"))
    return made.select("doc_id", F.regexp_extract("t", r"Table (\d+)", 1).cast("int").alias("page"), F.rtrim("t", F.lit("\n")).alias("markdown"))


def saved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a PDF with a padded comment, a saved page, an HTTP archive and a Trivy table, by doc_id in turn."""
    key = F.col("doc_id").cast("string")
    mhtml = F.concat(F.lit("Subject: x\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/html\r\n\r\n<nav>" + "n " * 1200 + "</nav><p>page "), key, F.lit("</p>\r\n--B--\r\n"))
    har = F.concat(F.lit('{"log":{"version":"1","entries":[{"time":1,"request":{"method":"get","url":"https://x.org/'), key, F.lit('"},"response":{"status":200,"content":{"mimeType":"text/html","size":1}},"pad":"' + "p" * 2400 + '"}]}}'))
    trivy = F.concat(F.lit(_HEAD + "├──┤\n│ lib"), key, F.lit(" │ CVE-2024-1 │ HIGH │ fixed │ 1.0 │ 1.1 │ flaw │\n├" + "─" * 2400 + "┤\n└──┘\n"))
    padded = F.concat(F.col("raw_bin"), F.lit("\n%" + "\u00ff" * 2400 + "\n").cast("binary"))
    files = page_files(spark, sf_dir)
    kind = F.col("doc_id") % 4
    return files.select("doc_id", F.when(kind == 0, padded.cast("string")).when(kind == 1, mhtml).when(kind == 2, har).otherwise(trivy).alias("text"))


@query()
def distil_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.distil(saved_files(spark, sf_dir)).select("doc_id", "processor", "path", "outcome", "distilled")


@query("SELECT page_id AS doc_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS ord, unnest([72.0, 72.0, 132.0]) AS x, unnest([700.0, 670.0, 670.0]) AS y, unnest(['1.2 Part ' || page_id, 'has words', 'and more']) AS text FROM pages")
def pdf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.pdf_spans(page_files(spark, sf_dir)).select("doc_id", "ord", "x", "y", "text")


@query("SELECT page_id AS doc_id, CAST(0 AS INTEGER) AS line_no, '1.2 Part ' || page_id AS text FROM pages UNION ALL SELECT page_id, 1, 'has words' || repeat(' ', 6) || 'and more' FROM pages")
def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf_text.lines_of_spans(pdf.pdf_spans(page_files(spark, sf_dir))).select("doc_id", "line_no", "text")


@query("SELECT page_id AS doc_id, '# T' || chr(10) || chr(10) || '- pages: 1' || chr(10) || chr(10) || '## Page 1' || chr(10) || chr(10) || '### 1.2 Part ' || page_id || chr(10) || 'has words' || repeat(' ', 6) || 'and more' || chr(10) AS markdown FROM pages")
def pdf_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_files(spark, sf_dir).select("doc_id", pdf_text.pdf_to_markdown("raw_bin").alias("markdown"))


@query("SELECT page_id AS doc_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS ord, unnest([0, 0, 1]) AS \"column\" FROM pages")
def pdf_nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pdf.pdf_spans(page_files(spark, sf_dir))
    columns = spans.select("doc_id", "page").distinct().select("*", F.posexplode(F.array(F.lit(70.0), F.lit(140.0))).alias("column", "column_x"))
    return pdf_text.nearest_column(spans, columns).select("doc_id", "ord", "column")


@query("SELECT page_id AS doc_id, 1 AS n, 'GET' AS method, 200 AS status, url, 'text/html' AS mime, CAST(strlen(html) AS BIGINT) AS size FROM pages")
def har_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    text = F.concat(F.lit('{"log":{"version":"1","entries":[{"time":1,"request":{"method":"get","url":"'), "url", F.lit('"},"response":{"status":200,"content":{"mimeType":"text/html; x","size":'), F.octet_length("html").cast("string"), F.lit("}}}]}}"))
    rows = readers.har_entries(p.select(F.col("page_id").alias("doc_id"), text.alias("text")))
    return rows.select("doc_id", (F.col("ord") + 1).alias("n"), "method", "status", "url", "mime", "size")


@query("SELECT conv_id * 1000 + turn AS doc_id, CAST(unnest([0, 1]) AS INTEGER) AS ord, unnest(['run', 'fail']) AS action, 'T' || turn AS test FROM conversations WHERE turn % 2 = 0")
def gotest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, turn = table(spark, sf_dir, "conversations"), F.col("turn").cast("string")
    text = F.concat(F.lit('{"Action":"run","Test":"T'), turn, F.lit('"}\n{"Action":"fail","Test":"T'), turn, F.when(F.col("turn") % 2 == 0, '"}\n').otherwise('"}\nnot an event\n'))
    return readers.go_events(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), text.alias("text"))).select("doc_id", "ord", "action", "test")


@query()
def yaml_prose_all_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a block scalar, each of its lines indented."""
    c = table(spark, sf_dir, "conversations")
    body = F.regexp_replace("text", r"(\r\n|[\n\r\x{85}\x{2028}\x{2029}])", "$1  ")
    return c.select("conv_id", "turn", prose.yaml_prose(F.concat(F.lit("name: short one\nbody: |2+\n  "), body, F.lit("\n"))).alias("prose"))


@query("""
WITH d AS (SELECT doc_id, text, left(text, CAST(length(text) // 2 AS BIGINT)) AS half FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR trim(half, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN text ELSE half END AS answer FROM d""")
def prompt_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = prompts.prompt(F.col("text"), "half", lambda system, said: said[: len(said) // 2])
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.col("doc_id") % 4 == 0, prompts.prompt(F.col("text"), "none")).otherwise(answer).alias("answer"))


@query("SELECT doc_id % 4 AS kind, count_if(n_chars >= 32768 AND doc_id % 4 < 2 OR doc_id % 4 = 2) AS n_read, count_if(doc_id % 4 = 3 AND n_chars >= 500) AS n_shorthand FROM documents GROUP BY 1")
def file_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*[F.lit(x) for x in ("a/x.log", "b.TRACE", "c.pdf", "d/e/SKILL.md")]), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").withColumn("path", path)
    return d.groupBy((F.col("doc_id") % 4).alias("kind")).agg(F.count_if(prompts.read_gate(F.col("path"), F.col("n_chars"))).alias("n_read"), F.count_if(prompts.shorthand_gate(F.col("path"), F.col("n_chars"))).alias("n_shorthand"))


@query("""
SELECT event_type, CASE event_id % 6 WHEN 0 THEN 'sift exec -- A=1 /usr/bin/git  log' WHEN 1 THEN 'sift exec -- go  test ./...' WHEN 5 THEN 'sift exec -- cargo ' || event_type END AS command, count(*) AS n
FROM events GROUP BY 1, 2""")
def rewrite_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines_ = ["A=1 /usr/bin/git  log", "go  test ./...", "git log | cat", "/opt/sift exec -- git log", "go build", "cargo "]
    argv = F.element_at(F.array(*[F.lit(x) for x in lines_]), (F.col("event_id") % 6 + 1).cast("int"))
    argv = F.when(F.col("event_id") % 6 == 5, F.concat(argv, "event_type")).otherwise(argv)
    return table(spark, sf_dir, "events").groupBy("event_type", routing.rewritten(argv, "sift").alias("command")).agg(F.count("*").alias("n"))


@query("SELECT event_type, CASE event_id % 4 WHEN 0 THEN 'git-filter' WHEN 1 THEN 'go-test-filter' WHEN 2 THEN NULL ELSE 'npm-filter' END AS processor, count(*) AS n FROM events GROUP BY 1, 2")
def route_by_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    argv = F.element_at(F.array(*[F.lit(x) for x in ("A=1 /usr/bin/git  log", "go  test ./...", "git log | cat", '"C:\\n\\pnpm.cmd" i')]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy("event_type", routing.Registry().by_command(argv).alias("processor")).agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT lang AS processor, 'native' AS kind, doc_id % 1000 AS d FROM documents) SELECT processor, kind, count(*) AS n, quantile_disc(d, 0.5) AS p50_ms, quantile_disc(d, 0.95) AS p95_ms, max(d) AS max_ms FROM f GROUP BY 1, 2")
def telemetry_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.durations(facts(spark, sf_dir))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
f AS (SELECT doc_id, line_no, last_value(CASE WHEN length(line) < 60 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS head FROM l)
SELECT doc_id, head, count(*) AS n FROM f GROUP BY 1, 2""")
def fill_down_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.fill_down(d, F.when(F.length("line") < 60, F.col("line")), "head").groupBy("doc_id", "head").agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_replace(text, '\\n$', '') AS text FROM documents")
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.to_text(lines.to_lines(table(spark, sf_dir, "documents")))


@query()
def cordon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", distillers.apply(distillers.cordon)("text").alias("report"))
