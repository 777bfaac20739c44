"""Tagged PDF: the structure tree, which states headings, lists and tables in reading order, as Markdown."""

from __future__ import annotations

from collections import defaultdict
from itertools import pairwise

from loomsift.sources.pdf import Document, Ref, Span

MOST_DEPTH, MOST_ELEMENTS = 64, 100_000
HEADINGS = {"H": 1, "Title": 1, **{f"H{i}": i for i in range(1, 7)}}
BLOCKS = frozenset(("P", "LI", "Code", "Caption", "BlockQuote", "Note", "TOCI", *HEADINGS))


class _Tree:
    def __init__(self, doc: Document):
        self.doc, self.seen, self.left = doc, set(), MOST_ELEMENTS
        self.marked: dict[tuple[int, int], list[Span]] = defaultdict(list)
        pages = doc.pages()
        self.first = pages[0]["#"] if pages else -1
        for page in pages:
            for s in doc.spans(page):
                if s.mcid >= 0 and s.text:
                    self.marked[page["#"], s.mcid].append(s)

    def kids(self, node: dict) -> list:
        found = self.doc.get(node.get("K"))
        return found if isinstance(found, list) else [] if node.get("K") is None else [node["K"]]

    def enter(self, item) -> dict | None:
        """An element that has not been met before; none for references to content."""
        if isinstance(item, Ref):
            if item.number in self.seen:
                return None
            self.seen.add(item.number)
        node = self.doc.get(item)
        self.left -= 1
        return node if isinstance(node, dict) and node.get("Type") not in ("MCR", "OBJR") and self.left > 0 else None

    def spans(self, node: dict, page: int, depth: int) -> list[Span]:
        """All content below an element, in order."""
        page, out = node["Pg"].number if isinstance(node.get("Pg"), Ref) else page, []
        for item in self.kids(node) if depth < MOST_DEPTH else ():
            found = self.doc.get(item)
            if isinstance(found, int):
                out += self.marked.get((page, found), ())
            elif isinstance(found, dict) and found.get("Type") == "MCR":
                own = found["Pg"].number if isinstance(found.get("Pg"), Ref) else page
                out += self.marked.get((own, self.doc.get(found.get("MCID"))), ())
            elif (kid := self.enter(item)) is not None:
                out += self.spans(kid, page, depth + 1)
        return out

    def text(self, node: dict, page: int, depth: int, parted: str = " ") -> str:
        from loomsift.operators.pdf_text import line_text

        lines: list[list[Span]] = []
        for before, s in pairwise([None, *self.spans(node, page, depth)]):
            if before is None or abs(s.y - before.y) > 1:
                lines.append([])
            lines[-1].append(s)
        said = (line_text(line).strip() for line in lines)
        return parted.join(x for x in said if x)

    def table(self, node: dict, page: int, depth: int) -> str:
        rows: list[list[str]] = []

        def walk(node: dict, page: int, depth: int) -> None:
            page = node["Pg"].number if isinstance(node.get("Pg"), Ref) else page
            cells = []
            for item in self.kids(node) if depth < MOST_DEPTH else ():
                kid = self.enter(item)
                role = kid.get("S") if kid else None
                if role in ("TH", "TD"):
                    cells.append(" ".join(self.text(kid, page, depth + 1).replace("|", "\\|").split()))
                elif role in ("TR", "THead", "TBody", "TFoot"):
                    walk(kid, page, depth + 1)
            if cells:
                rows.append(cells)

        walk(node, page, depth)
        wide = max((i + 1 for row in rows for i, c in enumerate(row) if c), default=0)
        if not wide:
            return ""
        lines = [f"| {' | '.join((row + [''] * wide)[:wide])} |" for row in rows]
        return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]) + "\n\n"

    def walk(self, item, page: int, depth: int) -> str:
        node = self.enter(item) if depth < MOST_DEPTH else None
        if node is None:
            return ""
        role, page = node.get("S"), node["Pg"].number if isinstance(node.get("Pg"), Ref) else page
        if role == "Table":
            return self.table(node, page, depth)
        if role not in BLOCKS:
            loose = {**node, "K": [k for k in self.kids(node) if isinstance(self.doc.get(k), int) or self.doc.dict(k).get("Type") == "MCR"]}
            own = self.text(loose, page, depth)
            return (f"{own}\n\n" if own else "") + "".join(self.walk(k, page, depth + 1) for k in self.kids(node) if not isinstance(self.doc.get(k), int))
        said = self.text(node, page, depth, "\n" if role == "Code" else " ")
        if not said:
            return ""
        if role in HEADINGS:
            return f"{'#' * HEADINGS[role]} {said}\n\n"
        return f"- {said}\n" if role == "LI" else f"```\n{said}\n```\n\n" if role == "Code" else f"{said}\n\n"


def structured(doc: Document) -> str:
    """The structure tree of a tagged document as Markdown; empty without one or without its text."""
    root = doc.dict(doc.root.get("StructTreeRoot"))
    if not root or doc.dict(doc.root.get("MarkInfo")).get("Marked") is not True:
        return ""
    tree = _Tree(doc)
    out = "".join(tree.walk(k, tree.first, 0) for k in tree.kids(root)).strip()
    return f"{out}\n" if out else ""
