"""Scalar functions, HTML, routing, sources and PDF on small inputs."""

import base64
import zlib

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loomsift.functions import html, log, prose, redact, signature, text
from loomsift.operators import anomaly, lines, pdf_text, routing, telemetry
from loomsift.sources import cases, pdf, readers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(("f", "given", "want"), [
    (log.status_class, "404", "4xx"), (log.status_class, "604", "604"), (log.status_class, "4040", "4040"),
    (log.path_shape, "/u/12/a?x#y", "/u/<var>/a"), (log.path_shape, "/8f14e45f-ceea-467f-a8ba-a3f1b2c3d4e5/x", "/<var>/x"), (log.path_shape, "/abcdefabcdefabcdefabcdef", "/<var>"),
    (signature.plain_signature, "  Error 12 at 10.0.0.1 id deadbeef99! ", "error-<n>-at-<ip>-id-<hex>"), (signature.plain_signature, "é!", "unknown"),
    (signature.text_level, "a CRIT b error", "error"), (signature.text_level, "terror", "unknown"), (signature.status_class, "HTTP 503", "5xx"), (signature.status_class, "OK", "OK"),
    (signature.path_stem, "/a/12//deadbeef1/b/c?x", "/a/<n>/<hex>/b"), (signature.path_stem, "?", ""),
    (redact.redact_log, "x password=abc MY_TOKEN=1 Bearer abcdefghijklmnopq", "x [REDACTED] [REDACTED] [REDACTED]"), (redact.redact_long_tokens, "a " + "b" * 32, "a <redacted>"),
    (redact.redact_url, "https://u:p@h/x?api%5Fkey=1&b=2#token=3", "https://<redacted>@h/x?api%5Fkey=<redacted>&b=2#token=<redacted>"), (redact.redact_url, "/a#token", "/a#token"),
    (text.strip_ansi, "\x1b[31mred\x1b[0m", "red"), (text.promote_heading, "1.2 Intro", "### 1.2 Intro"), (text.promote_heading, "0.1 No", "0.1 No"),
    (text.estimate_tokens, "Hello, world 12", 8), (text.sanitize_markers, "<|x|>", "<\u200b|x|\u200b>"), (text.strip_thought, "<|channel>thought x<channel|>\n a", "a"), (text.strip_thought, " <|channel>thought", " <|channel>thought"),
    (text.table_cell, " a |  b ", "a \\| b"), (text.collapse_blank_lines, "a\n\n\n\nb", "a\n\nb"),
    (prose.directives, "MUST not, MUST, DO NOT x", ["MUST", "DO NOT"]), (prose.fences, "a ```py\nx\n``` b", ["x\n"]), (prose.frontmatter_keys, "---\na: 1\nb-c: 2\n---\nx: 3", ["a", "b-c"]), (prose.backticked, "`a` `b` `a`", ["a", "b"]),
    (prose.must_preserve, "see https://a.b/c. v1.2.3, 5 MB, exit code 2, ./x/y.py!", ["https://a.b/c", "v1.2.3", "5 MB", "exit code 2", "x/y.py"]),
    (prose.is_yaml, "A/b.YML", True),
])
def test_scalars(spark, f, given, want):
    assert one(spark, f("x"), x=given) == want


def test_gate(spark):
    def gate(a, b):
        return one(spark, F.size(prose.failures("a", "b")), a=a, b=b), one(spark, prose.gate("a", "b"), a=a, b=b)

    assert gate("You MUST use `x` v1.2.3 now please", "MUST use `x` v1.2.3") == (0, "MUST use `x` v1.2.3")
    assert gate("You MUST use `x` now", "use `y`")[0] == 3
    assert gate("a", "a longer one")[1] == "a"


def test_records():
    parse = log.parse_record
    assert parse('{"a":1} x') is None and parse("[1]") is None and parse('{"a":NaN}') is None and parse('{"a":1,"a":2}') == {"a": 2}
    assert [log.record_level(r) for r in ({"level": "", "severity": 13}, {"level": True}, {"lvl": "WARN"}, {"level": 1})] == ["error", "info", "warn", "debug"]
    assert log.record_message({"msg": "", "message": "x"}) == "" and log.record_field({"status": 404.9}, log.STATUS_KEYS) == "404"


def test_signatures():
    sig = signature.signature_of
    assert sig('pre {"level":"WARN","http.method":"GET","status":404,"path":"/a/12","msg":"Retry now for 3"}') == "level=warn;method=get;status=4xx;path=/a/<n>;msg=retry-now-for"
    assert sig('{"labels":{"level":"info"}}') == "level=info" and sig("") == "unknown" and sig('{"zzz":1}') == "zzz-<n>"
    assert signature.level_of('{"level":"odd"} ') == "unknown" and signature.level_of("a panic") == "error"


def test_bodies():
    assert redact.hide_body('{"password": 5, "a": [{"token": "x"}]}') == '{"a":[{"token":"<redacted>"}],"password":"<redacted>"}'
    assert redact.hide_body("a  b\n" + "é" * 200).endswith("…") and redact.hide_body("") == ""


PAGE = "<html><head><title>T &amp; x</title></head><body><nav>no</nav><h1> A <b>b</b></h1><p>x<br>y <i>z</i><p>2<ul><li>a<li>b<ol><li>c</ol></ul><pre>k\n v</pre><blockquote>q</blockquote><a href='cid:1'>d</a><a href='/u'>l</a><img src='data:x' alt='p'><table><tr><th>1<th>2<tr><td>|<td>4</table></body></html>"


def test_markdown(spark):
    out = html.markdown(PAGE)
    assert out.startswith("# T & x\n\n# A **b**\n\nx\ny *z*\n\n2\n\n- a\n- b")
    for part in ("```\nk\n v\n```", "> q", "d[l](/u)[image: p]", "| 1 | 2 |\n| --- | --- |\n| | | 4 |"):
        assert part in out, (part, out)
    assert "no" not in out.split() and html.markdown("<script>x</script>") == ""
    mime = b"From: x\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: image/png\r\n\r\nx\r\n--B\r\nContent-Type: text/html\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>caf=C3=A9</p>\r\n--B--\r\n"
    assert html.markdown(html.saved_html(mime)) == "café\n"
    df = spark.createDataFrame([(mime,), (b"plain",), (None,)], "b binary")
    assert [r.v for r in df.select(html.mhtml_to_markdown("b").alias("v")).collect()] == ["café\n", "plain", None]


def test_routing(spark):
    pad = "x" * 2000
    given = {"On branch a\n": "git-filter", "%PDF-1 === FAILURES ===\n": "pdf-filter", "error: x\n": "cargo-filter", "prose ": None, "\0On branch a\n": None, "a.py:1:2: E501 x\n": "lint-filter", "panic: x\n": "stacktrace-filter", "a fatal b": "casefolder"}
    rows = spark.createDataFrame([(i, k + pad) for i, k in enumerate(given)], "doc_id long, text string")
    assert [r.processor for r in routing.route(rows).orderBy("doc_id").collect()] == list(given.values())
    short = spark.createDataFrame([(1, "On branch a"), (2, None)], "doc_id long, text string")
    assert {r.path for r in routing.route(short).collect()} == {"short_circuit"}
    log_lines = '{"level":"info","msg":"x","n":1}\n' * 100
    seen = Observation()
    out = telemetry.observed(routing.distil(spark.createDataFrame([(1, log_lines), (2, pad)], "doc_id long, text string")), seen).collect()
    out.sort(key=lambda r: r.doc_id)
    assert seen.get["docs"] == 2 and seen.get["compressed"] == 1 and seen.get["bytes_out"] < seen.get["bytes_in"]
    assert out[0].outcome == "compressed" and out[0].bytes_out < out[0].bytes_in and out[1].distilled == pad


def test_commands(spark):
    registry = routing.Registry()
    given = {"git status": "git-filter", "A=1 /usr/bin/go test ./...": None, "go test ./...": "go-test-filter", "go build": None, "cat x | git log": None, '"C:\\x\\npm.CMD" i': "npm-filter", "": None}
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(given)], "i long, c string")
    assert [r.p for r in rows.select("i", registry.by_command(F.col("c")).alias("p")).orderBy("i").collect()] == list(given.values())
    with pytest.raises(ValueError):
        registry.add(routing.Descriptor("git-filter"))
    registry.add(routing.Descriptor("git-filter", match="^x", builtin=False))
    assert registry.by_name["git-filter"].match == "^x" and "compress" in registry.eligible()
    assert one(spark, routing.allowed(F.col("x"), ["rm*"]), x="rm -rf") is False


def test_processor_folders(tmp_path):
    for name, body in (("good", "name: mine\nmatch: '^x'\ncommands: [a]\n"), ("bad", "nonsense: 1\n"), ("worse", "a: [")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "processor.yaml").write_text(body)
    good, broken = readers.processors(str(tmp_path))
    assert [g.name for g in good] == ["mine"] and broken == ["bad", "worse"]


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\n\r\n\nb\n\n"), (2, None)], "doc_id long, text string")
    rows = lines.to_lines(df)
    assert [r.line for r in rows.orderBy("line_no").collect()] == ["a", "", "", "b", ""]
    assert [r.line for r in lines.collapse_blanks(rows).orderBy("line_no").collect()] == ["a", "", "b"]
    assert lines.to_text(rows).first().text == "a\n\n\nb\n"


def test_knn_blocks_agree(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], 1) for i in range(30)], "vec_id long, embedding array<double>, g int")
    want = anomaly.mean_nearest(v, 5)
    for scores in (anomaly.knn_scores(df), anomaly.knn_scores(df, group="g")):
        got = {r.vec_id: r.score for r in scores.collect()}
        assert all(abs(got[i] - want[i]) < 1e-9 for i in range(30))
    single = df.limit(1)
    assert anomaly.knn_scores(single).first().score == 0.0


def test_flagged_lines(spark):
    body = ["request served fine"] * 80
    body[40] = "kernel panic at 0xdeadbeef"
    df = spark.createDataFrame([(1, "\n".join(body)), (2, "a\nb")], "doc_id long, text string")
    got = anomaly.flagged_lines(df).collect()
    assert any(r.line.startswith("kernel") for r in got) and sum(r.doc_id == 2 for r in got) == 2 and sum(r.doc_id == 1 for r in got) < 80
    groups = anomaly.groups(lines.to_lines(df.where("doc_id = 1"))).orderBy("ord").collect()
    assert groups[0].level == "error" and groups[0].n == 1 and sum(g.n for g in groups) == 80


def make_pdf(contents, trailer=b""):
    objects = [b"<< /Type /Catalog /Pages 2 0 R /Outlines << /First 90 0 R >> >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(contents))) + b"] >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /F >>"]
    for i, c in enumerate(contents):
        packed = zlib.compress(c)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream")
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % i + o + b"\nendobj\n" for i, o in enumerate(objects, 1))
    return out + b"90 0 obj << /Title (Part \\(1\\)) >> endobj trailer << /Root 1 0 R /Info << /Title (My Doc) >> " + trailer + b">>"


def show(*items):
    return b"".join(b"BT /F1 10 Tf 1 0 0 1 %d %d Tm (%s) Tj ET\n" % i for i in items)


def test_pdf(spark):
    table = show(*[(x, y, t) for y, row in zip((700, 680, 660, 640), ((b"Name", b"Qty", b"Price"), (b"apple", b"10", b"2.5"), (b"pear", b"20", b"3.5"), (b"plum", b"30", b"4.5"))) for x, t in zip((72, 200, 330), row)])
    pages = [show((72, 720, b"1.%d Part of it" % i), (72, 700, b"body %d of the page" % i), (72, 30, b"the foot")) for i in range(4)] + [table, b""]
    data = make_pdf(pages)
    out = pdf_text.pdf_markdown(data)
    assert out.startswith("# My Doc\n\n- pages: 6\n\n## Outline\n\n- Part (1)\n\n## Page 1\n\n### 1.0 Part of it\nbody 0 of the page\n\n## Page 2")
    assert "the foot" not in out and "### Table 5.1\n\n| Name | Qty | Price |" in out and out.rstrip().endswith("_[blank page]_")
    assert pdf_text.pdf_markdown(make_pdf(pages, b"/Encrypt 9 0 R ")) == "" and pdf_text.pdf_markdown(make_pdf([])) == ""
    assert pdf_text.LOW_VALUE in pdf_text.pdf_markdown(make_pdf([b""]))
    df = spark.createDataFrame([(1, data), (2, b"no"), (3, data[:600])], "doc_id long, raw_bin binary")
    spans = pdf.pdf_spans(df)
    assert spans.where("doc_id = 1").count() == 24 and spans.where("doc_id = 2").count() == 0
    assert pdf_text.lines_of_spans(spans).where("doc_id = 1 and page = 4").orderBy("line_no").first().text.split() == ["Name", "Qty", "Price"]
    assert df.select(pdf_text.pdf_to_markdown("raw_bin").alias("m")).collect()[1].m is None


def test_pdf_filters():
    raw = bytes(range(30))
    assert pdf._unpacked(zlib.compress(raw)[:-4], "FlateDecode", {}) == raw
    assert pdf._unpacked(b"48656C6C6F>", "ASCIIHexDecode", {}) == b"Hello" and pdf._unpacked(base64.a85encode(b"Hello w") + b"~>", "ASCII85Decode", {}) == b"Hello w"
    assert pdf._unpacked(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), "LZWDecode", {}) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    up = b"\x02\x01\x01\x02\x01\x01"
    assert pdf._unpacked(zlib.compress(up), "FlateDecode", {"Predictor": 12, "Columns": 2}) == b"\x01\x01\x02\x02"


def test_cases(spark, tmp_path):
    at = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    rows = cases.cases(spark.createDataFrame([("/a", "x" * 100, "x")], "path string, text string, distilled string"), at)
    r = rows.first()
    assert r.case_id.startswith("20240131-120000-") and len(r.case_id) == 24 and r.reduction_pct == 99.0
    cases.write_cases(rows, str(tmp_path / "cases"))
    back = spark.read.parquet(str(tmp_path / "cases"))
    assert back.count() == 1 and cases.kept(back, F.lit("2024-03-01").cast("timestamp_ntz"), "7 days").count() == 0
    for _ in range(2):
        cases.keep_originals(rows.withColumn("text", F.lit("t")), str(tmp_path / "originals"))
    assert spark.read.parquet(str(tmp_path / "originals")).count() == 1


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    assert readers.texts(spark, str(tmp_path), 5).first()[1:] == ("hello", True)
    har = '{"log":{"version":"1","entries":[{"time":1.6,"request":{"method":"get","url":"u"},"response":{"status":200,"content":{"size":3,"mimeType":"a/b;c"}}}]}}'
    r = readers.har_entries(spark.createDataFrame([(1, har), (2, "x")], "doc_id long, text string")).collect()
    assert [(x.method, x.mime, x.ms) for x in r] == [("GET", "a/b", 2)]
    events = '{"Action":"fail","Test":"A"}\n{"Action":"skip","Test":"B"}'
    assert readers.go_events(spark.createDataFrame([(1, events), (2, events + "\nx")], "doc_id long, text string")).count() == 2
