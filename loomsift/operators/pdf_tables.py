"""Tables from where spans stand on a page: by gaps, by columns that start alike, by named headers, across pages."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import chain, pairwise, product
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from loomsift.sources.pdf import Document, Span, many_objects

# Tolerances and least sizes in points, shares and counts.
ROW_Y, WRAP_Y, WRAP_X, LEAST_GAP, CLUSTER_X, COLUMN_X = 2.0, 15.0, 30.0, 10.0, 5.0, 20.0
LEAST_COLUMNS, MOST_COLUMNS, HEADER_CHARS, ANCHOR_SHARE = 3, 10, 30, 0.15
MERGE_GAPS, ROW_GAPS = (0, 12, 16, 20), (0, 25, 35, 50)
LEAST_RECORDS, LEAST_CONTINUED, MOST_CONTINUED, DIGIT_SHARE = 10, 0.2, 0.95, 0.6


@dataclass
class Options:
    """How rows become records."""

    row_y: float = ROW_Y
    columns: int = LEAST_COLUMNS
    gap: float = LEAST_GAP
    wrap: float = WRAP_Y
    merge_gap: float = 0  # rows closer than this are one
    most_row_gap: float = 0  # a wider gap ends the table
    anchor: str = ""  # a column without which a row continues the one before
    require_any: Sequence[str] = ()
    keep: Callable[[list[str]], bool] | None = None


@dataclass
class Table:
    names: list[str]
    xs: list[float]
    rows: list[list[list[Span]]]

    def texts(self) -> list[list[str]]:
        return [[cell_text(c) for c in row] for row in self.rows]


@dataclass
class _Row:
    y: float
    bottom: float
    spans: list[Span] = field(default_factory=list)


_x = attrgetter("x")


def end_of(s: Span) -> float:
    """Where a span ends, guessed by its letters if it doesn't say."""
    return s.end_x if s.end_x > s.x else s.x + len(s.text) * s.font_size * 0.5


def cell_text(cell: list[Span]) -> str:
    return cell[0].text.strip() if len(cell) == 1 else " ".join([s.text.strip() for s in cell])


class _Places:
    """Places on an axis in the order that they were first seen; a place near an earlier one counts as that.

    Those kept are no nearer to each other than ``near``, so a stretch of that width holds two at most.
    """

    def __init__(self, near: float):
        self.near, self.count, self.known = near, 0, {}
        self._held: dict[int, list[tuple[int, float]]] = {}

    def number(self, at: float) -> int:
        """Which of the places ``at`` is: the first one near, else a new one."""
        found = self.known.get(at)
        return self._find(at) if found is None else found

    def _find(self, at: float) -> int:
        if not (self.near > 0 and math.isfinite(at) and math.isfinite(at / self.near)):  # near to nothing, itself included
            self.count += 1
            return self.count - 1
        stretch, held = math.floor(at / self.near), self._held
        # quotients are rounded, so the stretches beyond the neighbours count as well
        found = min((n for k in range(stretch - 2, stretch + 3) if k in held for n, x in held[k] if abs(at - x) < self.near), default=-1)
        if found < 0:
            found = self.count
            self.count += 1
            held.setdefault(stretch, []).append((found, at))
        self.known[at] = found
        return found


def grid(spans: Iterable[Span], near: float = ROW_Y) -> list[_Row]:
    """Rows from top to bottom, each from left to right; a span joins the first row that is near."""
    rows: list[_Row] = []
    places = _Places(near)
    for s in spans:
        if s.text.strip():
            n = places.number(s.y)
            if n == len(rows):
                rows.append(_Row(s.y, s.y))
            rows[n].spans.append(s)
    for r in rows:
        r.spans.sort(key=_x)
    return sorted(rows, key=lambda r: -r.y)


def _clusters(places: Iterable[tuple[float, int]]) -> list[tuple[float, set[int]]]:
    """Places close to the first of their kind, with the rows that they are in, from left to right."""
    out: list[tuple[float, set[int]]] = []
    kinds = _Places(CLUSTER_X)
    for x, row in places:
        n = kinds.number(x)
        if n == len(out):
            out.append((x, set()))
        out[n][1].add(row)
    return sorted(out, key=lambda c: c[0])


def _numeric(text: str) -> bool:
    return all(c in "0123456789.,- " for c in text)


def _header_like(text: str) -> bool:
    return 0 < len(text.encode()) <= HEADER_CHARS and not _numeric(text)


def _starts(rows: list[_Row], least: int) -> list[tuple[float, set[int]]]:
    """Where many rows have spans that start, no two closer than a column."""
    out: list[tuple[float, set[int]]] = []
    for x, held in _clusters((s.x, i) for i, r in enumerate(rows) for s in r.spans):
        if len(held) >= least and (not out or x - out[-1][0] >= COLUMN_X):
            out.append((x, held))
    return out


def _record(rows: list[_Row], names: list[str], xs: list[float], o: Options) -> list[list[list[Span]]]:
    """Rows as cells: a span goes to the column that starts nearest."""
    if o.merge_gap:
        merged: list[_Row] = []
        for r in rows:
            if merged and merged[-1].bottom - r.y < o.merge_gap:
                merged[-1] = _Row(merged[-1].y, min(merged[-1].bottom, r.bottom), sorted(merged[-1].spans + r.spans, key=lambda s: s.x))
            else:
                merged.append(r)
        rows = merged
    lower = [n.lower() for n in names]
    needed = [lower.index(n.lower()) for n in o.require_any if n.lower() in lower]
    out: list[list[list[Span]]] = []
    nearest: dict[float, int] = {}
    for before, r in pairwise([None, *rows]):
        if o.most_row_gap and before is not None and before.bottom - r.y > o.most_row_gap:
            break
        cells: list[list[Span]] = [[] for _ in xs]
        for s in r.spans:
            at = nearest.get(s.x)
            if at is None:
                at = nearest[s.x] = min(range(len(xs)), key=lambda i: abs(s.x - xs[i]))
            cells[at].append(s)
        texts = [cell_text(c) for c in cells]
        if any(texts) and (o.keep is None or o.keep(texts)) and (not needed or any(texts[i] for i in needed)):
            out.append(cells)
    return _by_anchor(out, lower.index(o.anchor.lower())) if o.anchor.lower() in lower else out


def _by_anchor(rows: list[list[list[Span]]], at: int) -> list[list[list[Span]]]:
    """Rows without an anchor joined to the one before, if the next column says something in words."""
    out: list[list[list[Span]]] = []
    for row in rows:
        if row[at] or not out:
            out.append(row)
        elif at + 1 < len(row) and row[at + 1] and not _numeric(cell_text(row[at + 1])):
            out[-1] = [a + b for a, b in zip(out[-1], row)]
    return out


def by_gaps(spans: list[Span], o: Options | None = None) -> list[Table]:
    """Runs of rows with wide gaps at the same places."""
    o = o or Options()
    rows = grid(spans, o.row_y)
    gaps = ((((end_of(a) + b.x) / 2), i) for i, r in enumerate(rows) for a, b in pairwise(r.spans) if b.x - end_of(a) > o.gap)
    strong = [(x, held) for x, held in _clusters(gaps) if len(held) >= max(3, len(rows) // 4)]
    edges, score = [x for x, _ in strong], Counter(i for _, held in strong for i in held)
    if len(rows) < 2 or len(edges) < o.columns - 1:
        return []
    out, at = [], 0
    while at < len(rows):
        end = at
        while end < len(rows) and score[end] >= o.columns - 1:
            end += 1
        if end - at >= 2:
            heads: list[tuple[int, float, list[str]]] = []
            for s in rows[at].spans:
                segment = bisect_left(edges, s.x)
                if not heads or heads[-1][0] != segment:
                    heads.append((segment, s.x, []))
                heads[-1][2].append(s.text.strip())
            names, xs = [" ".join(h[2]) for h in heads], [h[1] for h in heads]
            body = _record(rows[at + 1 : end], names, xs, o)
            if len(heads) > 1 and body:
                out.append(Table(names, xs, body))
        at = max(end, at + 1)
    return out


def _wrapped(rows: list[_Row], at: int, heads: list[list], o: Options) -> int:
    """Single words under single-word headers join them; the first row after the header is returned."""
    top = low = rows[at].y
    open_heads = sum(" " not in h[0] for h in heads)
    for r in rows[at + 1 :] if open_heads and o.wrap > 0 else ():
        words = [s for s in r.spans if " " not in s.text.strip()]
        if not o.row_y <= top - r.y <= o.wrap or not 0 < len(words) <= open_heads:
            break
        low = min(low, r.y)
        for s in words:
            near = [h for h in heads if " " not in h[0] and abs(s.x - h[1]) < WRAP_X]
            if near:
                head = min(near, key=lambda h: abs(s.x - h[1]))
                head[0] += f" {s.text.strip()}"
    return next((i for i in range(at + 1, len(rows)) if rows[i].y < low - o.row_y), len(rows))


def by_anchors(spans: list[Span], o: Options | None = None) -> Table | None:
    """A table whose columns start at the same places in many rows, under a row of short words there."""
    o = o or Options()
    rows = grid(spans, o.row_y)
    starts = [x for x, _ in _starts(rows, max(3, int(len(rows) * ANCHOR_SHARE)))]
    if len(rows) < 2 or not o.columns <= len(starts) <= MOST_COLUMNS:
        return None

    def nearest(r: _Row, x: float) -> Span | None:
        return min((s for s in r.spans if abs(s.x - x) < CLUSTER_X), key=lambda s: abs(s.x - x), default=None)

    def score(r: _Row) -> int:
        return sum(any(abs(s.x - x) < CLUSTER_X and _header_like(s.text.strip()) for s in r.spans) for x in starts)

    at = max(range(len(rows)), key=lambda i: (score(rows[i]), -i))
    heads = [[found.text.strip(), x] for x in starts if (found := nearest(rows[at], x))]
    if score(rows[at]) < max(o.columns, len(starts) * 2 // 3) or len(heads) < o.columns:
        return None
    first = _wrapped(rows, at, heads, o)
    names, xs = [h[0] for h in heads], [h[1] for h in heads]
    body = _record(rows[first:], names, xs, o)
    return Table(names, xs, body) if body else None


def zones(heads: list[tuple[str, float]], starts: list[float]) -> list[tuple[str, float]]:
    """Header names at the data columns whose zone they stand in; the first of a zone counts, columns without a name go."""
    edges = [(a + b) / 2 for a, b in pairwise(starts)]
    named: dict[int, str] = {}
    for name, x in heads:
        named.setdefault(sum(x >= e for e in edges), name)
    return [(named[i], x) for i, x in enumerate(starts) if i in named]


@dataclass
class _Head:
    first: int
    last: int
    heads: list[list]


def _header(rows: list[_Row], wanted: Sequence[str]) -> _Head | None:
    """The first row, or pair of rows, whose spans hold all wanted headers."""
    low = [w.lower() for w in wanted]
    for wide in (1, 2):
        for i in range(len(rows) - wide + 1):
            said = [s for r in rows[i : i + wide] for s in r.spans]
            if all(any(w in s.text.lower() for s in said) for w in low):
                if wide == 2:
                    said = sorted((s for s in said if any(w.strip() in s.text.lower() for w in low)), key=lambda s: s.x)
                heads: list[list] = []
                for s in said:
                    if not any(abs(s.x - x) < 1 and t == s.text.strip() for t, x in heads):
                        heads.append([s.text.strip(), s.x])
                return _Head(i, i + wide - 1, heads) if heads else None
    return None


def _data_columns(heads: list[tuple[str, float]], rows: list[_Row]) -> list[tuple[str, float]]:
    """Headers moved to where the data below them starts, if every one finds a column there."""
    if len(rows) < 3:
        return heads
    starts = [x for x, _ in _starts(rows, max(3, len(rows) // 10))]
    moved = zones(heads, starts) if len(starts) >= len(heads) else []
    return moved if len(moved) >= len(heads) else heads


def by_headers(spans: list[Span], wanted: Sequence[str], o: Options | None = None, columns: list[tuple[str, float]] | None = None) -> Table | None:
    """The table under the row that holds all ``wanted`` headers, parts of their words in any case."""
    o = o or Options()
    rows = grid(spans, o.row_y)
    head = _header(rows, wanted)
    if head is None:
        return None
    first = _wrapped(rows, head.last, head.heads, o)
    columns = columns or _data_columns([(t, x) for t, x in head.heads], rows[first:])
    names, xs = [n for n, _ in columns], [x for _, x in columns]
    return Table(names, xs, _record(rows[first:], names, xs, o))


def find_tables(spans: list[Span], wanted: Sequence[str] = (), o: Options | None = None) -> list[Table]:
    """Tables of a page: by headers if they are named, else by gaps, else by columns that start alike."""
    if wanted:
        found = by_headers(spans, wanted, o)
        return [found] if found else []
    tables = by_gaps(spans, o)
    if not tables and (found := by_anchors(spans, o)):
        tables = [found]
    return tables


def _discovered(pages: list[list[Span]], o: Options) -> list[tuple[str, float]]:
    """Columns of a table over pages: the row with most header-like words, at the data columns of all rows."""
    rows = [r for spans in pages for r in grid(spans, o.row_y)]
    best: list[tuple[str, float]] = []
    for r in rows:
        heads: list[tuple[str, float]] = []
        for s in r.spans:
            if _header_like(s.text.strip()) and (not heads or s.x - heads[-1][1] >= COLUMN_X):
                heads.append((s.text.strip(), s.x))
        size = lambda h: (len(h), -sum(len(n) for n, _ in h))
        if len(heads) >= o.columns and (not best or size(heads) > size(best)):
            best = heads
    starts = _starts(rows, max(3, min(20, int(len(rows) * ANCHOR_SHARE)))) if best else []
    starts = sorted(sorted(starts, key=lambda c: -len(c[1]))[: len(best)])
    return zones(best, [x for x, _ in starts]) if len(starts) >= o.columns else best


def across_pages(pages: list[list[Span]], wanted: Sequence[str] = (), o: Options | None = None, tune: bool = False) -> Table | None:
    """One table over pages. Rows above a later page's header continue the table; ``tune`` tries how rows become records."""
    o = o or Options()
    if not wanted:
        columns = _discovered(pages, o)
        if not columns:
            return None
        names = [n for n, _ in columns]
        return _tuned(pages, names, columns, o) if tune and not o.merge_gap and not o.most_row_gap else _merged(pages, names, columns, o)
    columns, below = None, []
    for spans in pages:
        rows = grid(spans, o.row_y)
        if head := _header(rows, wanted):
            columns = columns or [(t, x) for t, x in head.heads]
            below += rows[head.last + 1 :]
    moved = _data_columns(columns, below) if columns else []
    return _merged(pages, wanted, moved if len(moved) >= len(wanted) else None, o)


def _merged(pages: list[list[Span]], wanted: Sequence[str], columns: list[tuple[str, float]] | None, o: Options) -> Table | None:
    out: Table | None = None
    for spans in pages:
        found = by_headers(spans, wanted, o, columns)
        if found is None:
            continue
        if out is None:
            out = found
        else:
            rows = grid(spans, o.row_y)
            above = rows[: _header(rows, wanted).first]
            out.rows += _record(above, found.names, found.xs, o) + found.rows
    return out


def score(t: Table) -> float:
    """Grows with the rows, and with the square of the share of cells that are filled."""
    cells = [c for row in t.rows for c in row]
    return math.log1p(len(t.rows)) * (sum(map(bool, cells)) / len(cells)) ** 2 if cells else 0.0


def _tuned(pages: list[list[Span]], names: list[str], columns: list[tuple[str, float]], o: Options) -> Table | None:
    raw = _merged(pages, names, columns, replace(o, anchor=""))
    if raw and len(raw.rows) >= LEAST_RECORDS:
        bare = sum(not row[0] for row in raw.rows) / len(raw.rows)
        if LEAST_CONTINUED <= bare <= MOST_CONTINUED and (found := _merged(pages, names, columns, replace(o, anchor=columns[0][0]))) and found.rows:
            return _records_only(found)
    made = [t for a, b in product(MERGE_GAPS, ROW_GAPS) if (t := _merged(pages, names, columns, replace(o, merge_gap=a, most_row_gap=b)))]
    return max(made, key=score, default=None)


def _records_only(t: Table) -> Table:
    """Without rows whose key is words, if most keys start with a digit."""
    keys = [cell_text(row[0]).strip() for row in t.rows]
    said, digits = [k for k in keys if k], [k for k in keys if k[:1].isdigit()]
    if len(t.rows) < LEAST_RECORDS or not said or len(digits) / len(said) < DIGIT_SHARE:
        return t
    return Table(t.names, t.xs, [row for row, k in zip(t.rows, keys) if k[:1].isdigit()])


_CELLS = "page int, number int, row int, `column` int, name string, text string"
_UNREADABLE = (ValueError, TypeError, RecursionError, IndexError, zlib.error)
_BATCH = 1 << 16


@many_objects()
def file_tables(data: bytes, wanted: Sequence[str] = ()) -> list[tuple[int, int, list[str], list[list[str]]]]:
    """(page, number, names, texts) of the tables of a PDF file, a page held at a time; none if it can't be read."""
    out: list[tuple[int, int, list[str], list[list[str]]]] = []
    try:
        doc = Document(bytes(data))
        pages = [] if doc.encrypted else doc.pages()
    except _UNREADABLE:
        return []
    for page, held in enumerate(pages):
        try:
            spans = doc.spans(held)
        except _UNREADABLE:
            return []
        out += [(page, number, t.names, t.texts()) for number, t in enumerate(find_tables(spans, wanted))]
    return out


def cells(files: DataFrame, wanted: Sequence[str] = (), key: str = "doc_id", raw: str = "raw_bin") -> DataFrame:
    """(key, page, number, row, column, name, text): the cells of all tables of PDF files, page by page; files that can't be read give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                for page, number, names, texts in [] if data is None else file_tables(data, wanted):
                    wide, labels = len(names), pa.array(names, pa.string())
                    for at in range(0, len(texts), max(1, _BATCH // wide)):
                        rows = texts[at : at + max(1, _BATCH // wide)]
                        n = len(rows) * wide
                        column = np.tile(np.arange(wide, dtype=np.int32), len(rows))
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array(np.full(n, i))), pa.array(np.full(n, page, np.int32)), pa.array(np.full(n, number, np.int32)),
                            pa.array(np.repeat(np.arange(at, at + len(rows), dtype=np.int32), wide)), pa.array(column), labels.take(pa.array(column)), pa.array(list(chain.from_iterable(rows)), pa.string()),
                        ], [batch.schema.names[0], "page", "number", "row", "column", "name", "text"])

    held = files.select(key, raw)
    return held.mapInArrow(run, StructType([held.schema[0], *StructType.fromDDL(_CELLS)]))
