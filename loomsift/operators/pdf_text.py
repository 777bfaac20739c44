"""Text spans of pages to lines, tables and Markdown."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from loomsift.functions.text import PLACEHOLDERS
from loomsift.operators.furniture import FRACTION, LEAST_PAGES, MOST_BYTES
from loomsift.operators.pdf_structure import structured
from loomsift.operators.pdf_tables import cell_text, end_of, find_tables
from loomsift.sources.pdf import MOST_PAGES, Document, Span, many_objects

# Tolerances, and thresholds that tell tables from layout.
LINE_Y, MOST_OCR_PAGES = 1.0, 25
LONGEST_CELL, LEAST_FILL, LEAST_ROWS, MOST_SINGLE_TOKENS, MOST_SINGLE_NAMES, MOST_TIGHT, GUTTER = 1000, 0.40, 2, 0.30, 0.50, 0.25, 0.25
LOW_VALUE = "_[no extractable text: OCR needed]_"
_HEADING = re.compile(r"([1-9]\d*(?:\.\d+){0,3})\.?\s+([A-Z][^.\n]{0,59})", re.A)


def line_text(spans: list[Span]) -> str:
    """Spans of one line, spaced as wide as the gaps between them are."""
    out = ""
    for before, s in pairwise([None, *sorted(spans, key=lambda s: s.x)]):
        if before is not None:
            gap, space = s.x - end_of(before), max(s.font_size * 0.25, 2)
            out += " " * min(10, int(gap / space)) if gap > space else " " if gap > 0.5 else ""
        out += s.text
    return out


def page_lines(spans: list[Span]) -> list[str]:
    """Lines from top to bottom; a line takes what lies within a point of its first span."""
    lines: list[tuple[float, list[Span]]] = []
    for s in sorted(spans, key=lambda s: -s.y):
        if not lines or abs(s.y - lines[-1][0]) > LINE_Y:
            lines.append((s.y, []))
        lines[-1][1].append(s)
    return [line_text(held).rstrip(" ") for _, held in lines]


def is_layout(names: list[str], rows: list[list[list[Span]]]) -> bool:
    """Whether a grid is a frame of running text, not a table."""
    texts = [[cell_text(cell) for cell in row] for row in rows]
    filled = [t for row in texts for t in row if t]
    tokens = [w for t in filled for w in t.split()]
    if len(names) < 2 or len(rows) < LEAST_ROWS or not filled or max(len(t.encode()) for t in filled) > LONGEST_CELL:
        return True
    if tokens and sum(len(w) == 1 for w in tokens) / len(tokens) > MOST_SINGLE_TOKENS or sum(len(n) <= 1 for n in names) / len(names) > MOST_SINGLE_NAMES:
        return True
    seams = [(max(map(end_of, a)), min(b, key=lambda s: s.x)) for row in rows for a, b in pairwise(row) if a and b]
    if seams and sum(s.x - end < s.font_size * GUTTER for end, s in seams) / len(seams) > MOST_TIGHT:
        return True
    return len(filled) / (len(names) * len(rows)) < LEAST_FILL


def _bar(cells: list[str]) -> str:
    return f"| {' | '.join(' '.join(c.replace('|', chr(92) + '|').split()) for c in cells)} |"


def table_markdown(names: list[str], rows: list[list[list[Span]]]) -> str:
    return "\n".join([_bar(names), "|" + " --- |" * len(names), *(_bar([cell_text(c) for c in row]) for row in rows)])


def headed(line: str) -> str:
    m = _HEADING.fullmatch(line.strip())
    return f"{'#' * min(6, 2 + m[1].count('.'))} {line.strip()}" if m else line


def page_kind(text: str, images: bool) -> str:
    if not text.strip():
        return "scanned" if images else "blank"
    return "chart" if images and sum(c.isascii() and c.isalpha() or ord(c) > 0x7F for c in text) < 20 else "text"


def furniture_of(pages: list[list[str]]) -> set[str]:
    """Lines on most pages, each counted once a page."""
    if len(pages) < LEAST_PAGES:
        return set()
    counts = Counter(line for page in pages for line in {x.strip() for x in page} if line and len(line.encode()) <= MOST_BYTES)
    return {line for line, n in counts.items() if n >= len(pages) * FRACTION}


def _body(lines: list[str], gone: set[str]) -> str:
    out: list[str] = []
    for line in lines:
        if line.strip() not in gone and (not gone or line.strip() or out and out[-1].strip()):
            out.append(line)
    return "\n".join(out).strip()


def strip_low_value(markdown: str) -> tuple[str, bool]:
    """Markdown without the lines of the low-value marker, and whether it was there."""
    return "\n".join(x for x in markdown.split("\n") if LOW_VALUE not in x), LOW_VALUE in markdown


@many_objects()
def pdf_markdown(data: bytes, ocr: Callable[[bytes, int], str] | None = None, most_ocr: int = MOST_OCR_PAGES) -> str:
    """A PDF as Markdown: title, author, outline, tagged structure, pages; empty for files that can't be read.

    With a tagged structure, which holds the prose in reading order, pages give only what it
    lacks. ``ocr`` is asked for the text of scanned pages, ``most_ocr`` at most; where it fails
    or there is none, a placeholder stays.
    """
    doc = Document(data)
    pages = [] if doc.encrypted else doc.pages()
    if not pages:
        return ""
    parts = [f"# {title}"] if (title := doc.info("Title")) and title.lower() not in PLACEHOLDERS else []
    author = doc.info("Author")
    parts.append((f"- author: {author}\n" if author and author.lower() not in PLACEHOLDERS else "") + f"- pages: {len(pages)}")
    if outline := doc.outline():
        parts.append("## Outline\n\n" + "\n".join(f"{'  ' * depth}- {title}" for depth, title in outline))
    tagged = structured(doc)
    parts += ["## Document structure", tagged.strip()] if tagged else []
    read = [(doc.spans(p), doc.has_images(p)) for p in pages[:MOST_PAGES]]
    lines = [page_lines(spans) for spans, _ in read]
    gone, any_text, asked = furniture_of(lines), bool(tagged), 0
    for number, ((spans, images), held) in enumerate(zip(read, lines), 1):
        whole, block = "\n".join(held), [f"## Page {number}"]
        kind = page_kind(whole, images)
        if kind == "text":
            any_text = True
            block += [] if tagged else ["\n".join(headed(x) for x in (_body(held, gone) or whole.strip()).split("\n"))]
            real = [t for t in find_tables(spans) if not is_layout(t.names, t.rows)]
            block += [x for j, t in enumerate(real, 1) for x in (f"### Table {number}.{j}", table_markdown(t.names, t.rows))]
            block += [f"_[images on page {number}]_"] if images else []
        elif kind == "chart":
            block += [f"_[chart on page {number}]_"] + ([f"```\n{whole.strip()}\n```"] if whole.strip() else [])
        else:
            said = ""
            if kind == "scanned" and ocr and asked < most_ocr:
                asked += 1
                said = _asked(ocr, data, number)
            any_text = any_text or bool(said)
            block.append(said or (f"_[scanned page {number}]_" if kind == "scanned" else "_[blank page]_"))
        if len(block) > 1 or not tagged:
            parts.append("\n\n".join(block))
    if len(pages) > MOST_PAGES:
        parts.append(f"_[document truncated: {MOST_PAGES} of {len(pages)} pages rendered]_")
    if not any_text:
        parts.append(LOW_VALUE)
    return "\n\n".join(parts) + "\n"


def _asked(ocr: Callable[[bytes, int], str], data: bytes, number: int) -> str:
    try:
        return (ocr(data, number) or "").strip()
    except Exception:  # whatever a backend does, the placeholder is there
        return ""


@pandas_udf(StringType())
def pdf_to_markdown(files: pd.Series) -> pd.Series:
    """Markdown of PDF files in binary; null for files that can't be read or are encrypted."""

    def one(data: bytes | None) -> str | None:
        try:
            return (pdf_markdown(bytes(data)) or None) if data is not None else None
        except (ValueError, TypeError, RecursionError, IndexError):
            return None

    return files.map(one)


def lines_of_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text) from rows of spans, a page at a time."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [Span(r.x, r.y, r.end_x, r.font_size, r.font, r.text, r.mcid) for r in pdf.sort_values("ord").itertuples()]
        made = page_lines(held)
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "page": pdf["page"].iloc[0], "line_no": range(len(made)), "text": made})

    return spans.groupBy("doc_id", "page").applyInPandas(build, "doc_id long, page int, line_no int, text string")


def elements(spans: DataFrame, structure: DataFrame) -> DataFrame:
    """(doc_id, element, role, text): texts of tagged elements, by an equi-join of spans with (doc_id, page, mcid, element, role)."""
    joined = spans.join(structure, ["doc_id", "page", "mcid"])
    held = F.sort_array(F.collect_list(F.struct("page", "ord", "text")))
    return joined.groupBy("doc_id", "element", "role").agg(F.array_join(F.transform(held, lambda x: x["text"]), "").alias("text"))


def nearest_column(spans: DataFrame, columns: DataFrame) -> DataFrame:
    """Each span with the column (doc_id, page, column, column_x) of its page that starts nearest to it."""
    near = Window.partitionBy("doc_id", "page", "ord").orderBy(F.abs(F.col("x") - F.col("column_x")), "column")
    return spans.join(columns, ["doc_id", "page"]).withColumn("__n", F.row_number().over(near)).where("__n = 1").drop("__n")


