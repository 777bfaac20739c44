"""Tables, structure and scans of PDF, prompts and gates."""

import gc
import math
import random
import sys

from pyspark.sql import functions as F

from loomsift.operators import pdf_structure, pdf_tables, pdf_text, prompts, routing
from loomsift.sources.pdf import Document, Span


def page(*rows, xs=(50, 150, 250), top=700, step=20):
    return [Span(x, top - i * step, x + 6 * len(t), 10, "F", t) for i, row in enumerate(rows) for x, t in zip(xs, row) if t]


BODY = [("1", "pies", "2.50"), ("2", "plum", "3.50"), ("3", "pear", "4.50"), ("4", "figs", "5.50")]


def test_gaps_and_anchors():
    t = pdf_tables.find_tables(page(("No", "Name", "Price"), *BODY))[0]
    assert t.names == ["No", "Name", "Price"] and t.texts()[0] == ["1", "pies", "2.50"]
    tight = pdf_tables.Options(gap=500)
    found = pdf_tables.by_anchors(page(("No", "Name", "Price"), *BODY), tight)
    assert found.names == ["No", "Name", "Price"] and len(found.rows) == 4
    assert pdf_tables.find_tables([Span(50, 700 - i * 12, 400, 10, "F", "running text of a page") for i in range(9)]) == []


class Counted(float):
    """A place that counts how often it is compared."""

    steps = 0

    def __sub__(self, other):
        Counted.steps += 1
        return float(self) - float(other)


def test_rows_of_long_pages():
    """Work grows with the rows of a page, not with their square, and a span still joins the first row that is near."""
    spans = [Span(x, Counted(-14 * i), x + 40, 10, "F", t) for i in range(3000) for x, t in ((50, f"{i:08}"), (150, "LOW"), (300, "1.00"))]
    Counted.steps = 0
    assert [len(r.spans) for r in pdf_tables.grid(spans)] == [3] * 3000 and Counted.steps < 20 * len(spans)
    rng = random.Random(1)
    for near in (2.0, 0.3, 0):
        ys = [rng.choice((rng.uniform(0, 40), rng.randint(0, 80) / 2, math.nan, math.inf, 1e16)) for _ in range(300)]
        want = []
        for i, y in enumerate(ys):
            row = next((r for r in want if abs(y - ys[r[0]]) < near), None)
            want.append([i]) if row is None else row.append(i)
        made = pdf_tables.grid([Span(i, y, 0, 10, "F", "t") for i, y in enumerate(ys)], near)
        assert sorted([s.x for s in r.spans] for r in made) == want


def test_shown_text_is_read_alike(spark):
    """Operators that are read whole give what they give token by token, as after a comment."""
    plain = "BT /F#31 10 Tf 1 0 0 1 50 700 Tm (ab c) Tj 5. -.5 TD (d) Tj 3 2 Td (e\\)f) Tj ET q 2 0 0 2 1 1 cm BT 0 1 -1 0 9 8.25 Tm (g)Tj 1 2 BT 1e5 7 Td (h) Tj 4 Tx ET Q (i) Tj"
    files = [raw({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        4: b"<< /Length %d >>\nstream\n" % len(c) + c + b"\nendstream", 5: b"<< /Type /Font /BaseFont /A /FirstChar 97 /Widths [100 200 300] >>"}) for c in (plain.encode(), plain.replace(" T", "%\n T").replace(")Tj", ")%\nTj").encode())]
    one, other = ([d.spans(p) for p in d.pages()] for d in map(Document, files))
    assert one == other and [s.text for s in one[0]] == ["ab c", "d", "e)f", "g", "h", "i"] and one[0][0].end_x == 50 + 1 + 2 + 5 + 3


def test_markdown_of_long_pages():
    """Twice the rows take twice the calls."""
    def calls(n):
        shown = "".join(f"BT /F 10 Tf 1 0 0 1 {x} {700 - 14 * i} Tm ({t}) Tj ET\n" for i in range(n) for x, t in ((50, f"{i:08}"), (150, "LOW"), (300, "1.00"))).encode()
        data = raw({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: b"<< /Length %d >>\nstream\n" % len(shown) + shown + b"\nendstream"})
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event))
        try:
            made = pdf_text.pdf_markdown(data)
        finally:
            sys.setprofile(None)
        assert made.count("\n| ") == n + 1 and gc.isenabled()
        return len(seen)

    assert calls(1200) < 2.3 * calls(600)


def test_cells_of_files(spark):
    """Cells of files of several tables in turn; files that can't be read give none, and keys of any type stay."""
    def shown(rows):
        return "".join(f"BT /F 10 Tf 1 0 0 1 {x} {700 - 14 * i} Tm ({t}) Tj ET\n" for i, r in enumerate(rows) for x, t in zip((50, 150, 300), r)).encode()

    rows = [("OrderKey", "Pri", "Price"), *((f"{i:08}", "LOW", "1.00") for i in range(40_000))]
    pages = [shown(rows[:5]), shown(rows)]
    data = raw({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [4 0 R 6 0 R] >>", 3: b"<< /Type /Font >>"} | {4 + 2 * k: b"<< /Type /Page /Contents %d 0 R /Resources << /Font << /F 3 0 R >> >> >>" % (5 + 2 * k) for k in (0, 1)}
        | {5 + 2 * k: b"<< /Length %d >>\nstream\n" % len(p) + p + b"\nendstream" for k, p in enumerate(pages)})
    df = spark.createDataFrame([("a", bytearray(data)), ("b", None), ("c", bytearray(b"%PDF- no")), (None, bytearray(data))], "doc string, file binary")
    got = pdf_tables.cells(df, key="doc", raw="file")
    assert got.columns == ["doc", "page", "number", "row", "column", "name", "text"]
    counts = {(r.doc, r.page): (r.n, r.last) for r in got.groupBy("doc", "page").agg(F.count("*").alias("n"), F.max(F.struct("row", "column", "name", "text")).alias("last")).collect()}
    assert {k: (n, *last) for k, (n, last) in counts.items()} == {(d, p): (3 * n, n - 1, 2, "Price", "1.00") for d in ("a", None) for p, n in ((0, 4), (1, 40_000))}


def test_headers_wraps_and_options():
    spans = page(("No", "Product", "Unit"), ("", "Code", "Price"), *BODY, ("", "and cream", ""), ("", "", "9.99"), step=12)
    t = pdf_tables.by_headers(spans, ["product", "unit"])
    assert t.names == ["No", "Product Code", "Unit Price"] and len(t.rows) == 6
    t = pdf_tables.by_headers(spans, ["product"], pdf_tables.Options(anchor="no"))
    assert t.texts()[-1] == ["4", "figs and cream", "5.50"] and len(t.rows) == 4
    t = pdf_tables.by_headers(spans, ["product"], pdf_tables.Options(require_any=["No"], keep=lambda c: c[0] != "2"))
    assert [r[0] for r in t.texts()] == ["1", "3", "4"]
    t = pdf_tables.by_headers(spans, ["product"], pdf_tables.Options(merge_gap=13))
    assert len(t.rows) == 1
    assert pdf_tables.by_headers(spans, ["absent"]) is None


def test_across_pages():
    head = ("No", "Name", "Price")
    first, second = page(head, *BODY), page(("5", "kiwi", "1.00"), head, ("6", "lime", "2.00"))
    t = pdf_tables.across_pages([first, second], ["no", "price"])
    assert [r[0] for r in t.texts()] == ["1", "2", "3", "4", "5", "6"]
    assert pdf_tables.across_pages([first, first]).names == list(head)
    many = [(str(i), "thing", "1.0") if i % 2 else ("", "more words", "") for i in range(1, 20)]
    t = pdf_tables.across_pages([page(("Date", "Text", "Sum"), *many)], tune=True)
    assert all(r[0] for r in t.texts()) and t.texts()[0][1] == "thing more words"
    assert pdf_tables.score(t) > 0 and pdf_tables.zones([("a", 10), ("b", 95), ("c", 99)], [0, 100]) == [("a", 0), ("b", 100)]


def raw(objects):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n" % i + o + b"\nendobj\n" for i, o in objects.items()) + b"trailer << /Root 1 0 R >>"


def test_tagged_structure():
    content = b"/P <</MCID 0>> BDC BT /F 10 Tf 50 700 Td (Big ti) Tj (tle) Tj ET EMC /P <</MCID 1>> BDC BT /F 10 Tf 50 650 Td (item) Tj ET EMC /P <</MCID 2>> BDC BT /F 10 Tf 50 600 Td (a|b) Tj ET EMC"
    data = raw({
        1: b"<< /Type /Catalog /Pages 2 0 R /MarkInfo << /Marked true >> /StructTreeRoot 5 0 R >>", 2: b"<< /Kids [3 0 R] >>",
        3: b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F 9 0 R >> >> >>", 4: b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream",
        5: b"<< /K [6 0 R 7 0 R 8 0 R] >>", 6: b"<< /S /H2 /Pg 3 0 R /K 0 >>", 7: b"<< /S /L /K [<< /S /LI /K [<< /Type /MCR /MCID 1 >>] >> 7 0 R] >>",
        8: b"<< /S /Table /K << /S /TR /K [<< /S /TH /K 2 >> << /S /TH >>] >> >>", 9: b"<< /Type /Font >>",
    })
    assert pdf_structure.structured(Document(data)) == "## Big title\n\n- item\n| a\\|b |\n| --- |\n"
    assert "## Document structure\n\n## Big title" in pdf_text.pdf_markdown(data)


def test_scans_and_ocr():
    data = raw({
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] /MediaBox [0 0 100 200] >>", 3: b"<< /Type /Page /Contents 4 0 R /Resources << /XObject << /I 5 0 R >> >> >>",
        4: b"<< /Length 34 >>\nstream\nq 98 0 0 198 1 1 cm /I Do Q         \nendstream", 5: b"<< /Subtype /Image /Length 1 >>\nstream\nx\nendstream",
    })
    doc = Document(data)
    assert doc.placements(doc.pages()[0]) == [(1, 1, 99, 199)] and doc.is_scan(doc.pages()[0])
    out = pdf_text.pdf_markdown(data)
    assert "_[scanned page 1]_" in out and pdf_text.strip_low_value(out)[1]
    assert "read!" in pdf_text.pdf_markdown(data, lambda d, n: "read!") and "_[scanned page 1]_" in pdf_text.pdf_markdown(data, lambda d, n: 1 / 0)


def test_prompts_and_gates(spark):
    df = spark.createDataFrame([("a long text here", "x/SKILL.md", 600), ("b", "prompts/a.yml", 10), (None, "a/b.LOG", 40000), ("c", "n.pdf", 1)], "text string, path string, size long")
    answers = [r.a for r in df.select(prompts.prompt(F.col("text"), "be short", lambda s, t: "<|channel>thought<channel|> ok" if len(t) > 3 else "longer than that").alias("a")).collect()]
    assert answers[:2] == ["ok", "b"]
    got = df.select(prompts.shorthand_gate(F.col("path"), F.col("size")).alias("s"), prompts.read_gate(F.col("path"), F.col("size")).alias("r")).collect()
    assert [(r.s, r.r) for r in got] == [(True, False), (False, False), (False, True), (False, True)]
    assert {tuple(r.chain) for r in prompts.model_route(df).collect()} == {()}
    assert {tuple(r.chain) for r in prompts.model_route(df, lambda s, n: ["compress"] if s.startswith("a") else ["git-filter"]).collect()} == {("compress",), ()}
    assert routing.chain(df, ["nope"]) is df
