"""HTML to Markdown, and the HTML of saved web pages."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Elements left out, block elements, and elements that end one another.
SKIPPED = frozenset("script style head nav footer noscript svg iframe form button".split())
BLOCKS = frozenset("p div section article main header".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"},
    "p": {"p", "div", "section", "article", "main", "header", "footer", "nav", "ul", "ol", "table", "pre", "blockquote", "hr", "form", *HEADINGS},
    "head": {"body"},
}
MOST_HTML_BYTES, MOST_PARTS = 32 << 20, 5000
ENVELOPE = re.compile(rb"(?i)Content-Type:\s*multipart/related")
_SPACE, _BLANKS = re.compile(r"[ \t\r\n]+"), re.compile(r"\n{3,}")


class _Tree(HTMLParser):
    """Elements as [name, attributes, children], texts as strings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while len(self.open) > 1 and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self.open.pop()
        node: list = [tag, {k: v or "" for k, v in reversed(attrs)}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "p":
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        names = [n[0] for n in self.open]
        if tag in names[1:]:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


class _Writer:
    """Pieces of Markdown; only the end of what is written is looked at, so writing stays linear."""

    def __init__(self, depth: int = 0, verbatim: bool = False) -> None:
        self.parts: list[str] = []
        self.depth, self.verbatim = depth, verbatim

    def put(self, text: str) -> None:
        if text:
            self.parts.append(text)

    def ends(self, count: int = 2) -> str:
        tail = ""
        for part in reversed(self.parts):
            tail = part[-count:] + tail
            if len(tail) >= count:
                break
        return tail[-count:]

    def block(self) -> None:
        while self.parts and not (bare := self.parts[-1].rstrip(" \t")):
            self.parts.pop()
        if self.parts:
            self.parts[-1] = bare
            tail = self.ends()
            self.put("" if tail == "\n\n" else "\n" if tail.endswith("\n") else "\n\n")

    def text(self) -> str:
        return "".join(self.parts)


def _inner(nodes: list, depth: int = 0, verbatim: bool = False) -> str:
    out = _Writer(depth, verbatim)
    _write(nodes, out)
    return out.text()


def _flat(nodes: list, depth: int = 0, verbatim: bool = False) -> str:
    return _SPACE.sub(" ", _inner(nodes, depth, verbatim)).strip()


def _rows(nodes: list) -> list[list[str]]:
    out = []
    for node in nodes:
        if isinstance(node, list):
            cells = [_flat(c[2]) for c in node[2] if isinstance(c, list) and c[0] in ("td", "th")] if node[0] == "tr" else []
            out += ([cells] if cells else []) if node[0] == "tr" else _rows(node[2])
    return out


def _write(nodes: list, out: _Writer) -> None:
    for node in nodes:
        if isinstance(node, str):
            if out.verbatim:
                out.put(node)
            elif node.strip():
                out.put(_SPACE.sub(" ", node))
            elif out.ends(1) not in ("", " ", "\n"):
                out.put(" ")
            continue
        name, attributes, children = node
        if name in SKIPPED:
            continue
        if name in HEADINGS:
            if title := _flat(children):
                out.block()
                out.put(f"{'#' * HEADINGS[name]} {title}")
                out.block()
        elif name in BLOCKS:
            out.block()
            _write(children, out)
            out.block()
        elif name == "br":
            out.put("\n")
        elif name == "hr":
            out.block()
            out.put("---")
            out.block()
        elif name in MARKS and not (name == "code" and out.verbatim):
            inner = _inner(children, verbatim=out.verbatim)
            out.put(f"{MARKS[name]}{inner.strip()}{MARKS[name]}" if inner.strip() else inner)
        elif name == "pre":
            out.block()
            body = _inner(children, verbatim=True)
            out.put(f"```\n{body}" + ("" if body.endswith("\n") or not body else "\n") + "```")
            out.block()
        elif name == "blockquote":
            out.block()
            out.put("".join(f"> {line}\n" for line in _inner(children).rstrip("\n").split("\n")))
            out.block()
        elif name in ("ul", "ol"):
            out.block()
            number = 0
            for item in children:
                if isinstance(item, list) and item[0] == "li":
                    number += 1
                    if said := _flat(item[2], out.depth + 1):
                        out.put(f"{'  ' * out.depth}{f'{number}. ' if name == 'ol' else '- '}{said}\n")
            out.block()
        elif name == "a":
            href, said = attributes.get("href", ""), _flat(children, verbatim=out.verbatim)
            dead = not href or href.startswith(("cid:", "javascript:"))
            out.put(said if dead else f"[{said}]({href})" if said else href)
        elif name == "img":
            src, alt = attributes.get("src", ""), attributes.get("alt", "").strip()
            src = "" if src.startswith(("cid:", "data:")) else src
            out.put(f"![{alt}]({src})" if src else f"[image: {alt}]" if alt else "")
        elif name == "table":
            if rows := _rows(children):
                out.block()
                bar = lambda cells: f"| {' | '.join(cells)} |\n"
                out.put(bar(rows[0]) + bar(["---"] * len(rows[0])) + "".join(map(bar, rows[1:])))
                out.block()
        else:
            _write(children, out)


def _title(nodes: list) -> str:
    for node in nodes:
        if isinstance(node, list):
            if node[0] == "title":
                return node[2][0].strip() if node[2] and isinstance(node[2][0], str) else ""
            if found := _title(node[2]):
                return found
    return ""


def markdown(html: str) -> str:
    """A page as Markdown under its title; empty if nothing is left of it."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    body = _BLANKS.sub("\n\n", _inner(tree.root[2])).strip()
    title = _title(tree.root[2])
    return (f"# {title}\n\n" if title else "") + body + "\n" if body else ""


def saved_html(raw: bytes) -> str:
    """The first HTML part of a saved page, if it is quoted-printable or plain; empty without one."""
    if not ENVELOPE.search(raw):
        return ""
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    if not message.is_multipart():
        return ""
    for part in message.get_payload()[:MOST_PARTS]:
        if part.get_content_type() == "text/html":
            encoding = str(part.get("Content-Transfer-Encoding", "")).strip().lower()
            body = part.get_payload(decode=encoding == "quoted-printable")
            body = body if isinstance(body, bytes) else str(body).encode("utf-8", "surrogateescape")
            return body.decode("utf-8", "replace") if len(body) <= MOST_HTML_BYTES else ""
    return ""


def _kept(convert: Callable, source, fallback) -> str:
    try:
        return convert(source) or fallback(source)
    except (ValueError, RecursionError, LookupError, AssertionError):
        return fallback(source)


@pandas_udf(StringType())
def html_to_markdown(pages: pd.Series) -> pd.Series:
    """Markdown of HTML; what can't be converted stays as it is."""
    return pages.map(lambda x: None if x is None else _kept(markdown, x, str))


@pandas_udf(StringType())
def mhtml_to_markdown(pages: pd.Series) -> pd.Series:
    """Markdown of saved pages in binary; anything else as text, unchanged."""
    return pages.map(lambda x: None if x is None else _kept(lambda b: markdown(saved_html(b)), x, lambda b: b.decode("utf-8", "replace")))


def title(html: Column) -> Column:
    """The text of the first title element, in SQL functions."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)", 1))


def links(html: Column) -> Column:
    """Targets of links in order, in SQL functions."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))
