"""Token counts by section, from one encoding of the whole document.

A document is encoded once with a public byte-level vocabulary. Each token covers a span of
bytes; sections cover spans too, both in ascending order, and the two are joined as intervals.
A token that crosses from one section to the next counts for the section that holds its first
byte, so a document's counts add up to its tokens.

The vocabulary's library can't match white space of any length. A long run of it is taken out
and encoded apart, as the pattern would part it: all of a run at the end of the text, and all but
the last character of another, which goes with what follows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomsift.llm.frames import slices

#: Characters of a run of white space that is encoded apart.
LONG_RUN = 4096
# The characters that the pattern's class for white space holds.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Rows of a result batch.
BATCH_ROWS = 50_000
_RUN = re.compile(f"[{_SPACES}]{{{LONG_RUN},}}+")


class ByteBpe:
    """A rank file of a byte-level vocabulary and the lengths of its tokens in bytes."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ids(self, text: str) -> list[int]:
        """The tokens of a text; the pattern must give white space before a word the last of its characters alone, as ``\\s+(?!\\S)`` does."""
        at, found = 0, []
        for run in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
            end = run.end() if run.end() == len(text) else run.end() - 1
            found += self.encoding.encode_ordinary(text[at : run.start()])
            found += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        return found + self.encoding.encode_ordinary(text[at:]) if at else self.encoding.encode_ordinary(text)

    def spans(self, text: str) -> np.ndarray:
        """The end of each token in bytes of UTF-8."""
        return np.cumsum(self.lengths[np.array(self.ids(text), dtype=np.int64)])


@lru_cache(4)
def vocabulary(path: str, pattern: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(path, pattern)


def lines(raw: bytes) -> np.ndarray:
    """Starts of the lines of a text in bytes; a line holds the line feed that ends it."""
    breaks = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1
    return np.concatenate([[0], breaks[breaks < len(raw)]]).astype(np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, by where a token starts, and how many of them reach into a later section."""
    begins = ends - np.diff(ends, prepend=0)
    owner = np.searchsorted(starts, begins, side="right") - 1
    stops = np.append(starts[1:], size)
    crossing = ends > stops[owner] if len(ends) else np.zeros(0, bool)
    return np.bincount(owner, minlength=len(starts)), np.bincount(owner[crossing], minlength=len(starts))


def section_tokens(docs: DataFrame, path: str, pattern: str, sections: Callable[[bytes], np.ndarray] = lines) -> DataFrame:
    """(doc_id, section, start, length, n_tokens, n_crossing): a row for each section of each row of ``docs`` (doc_id, text).

    start and length are in bytes of UTF-8; sections are numbered from 0. A null or empty text has
    one section without tokens. Rows repeated whole are counted as often. An empty table gives
    no rows; other columns are not read.
    """
    names = ["doc_id", "section", "start", "length", "n_tokens", "n_crossing"]

    def batch_of(rows: list) -> pa.RecordBatch:
        ids = [x[0] for x in rows for _ in range(len(x[1]))]
        parts = [np.concatenate([np.arange(len(x[1])) for x in rows]).astype(np.int32), *(np.concatenate([x[k] for x in rows]).astype(np.int64) for k in (1, 2, 3, 4))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, parts)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in slices(batches):
            rows, n = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode("utf-8")
                starts = sections(raw)
                tokens, crossing = attribute(bpe.spans(text or ""), starts, len(raw))
                rows.append((doc_id, starts, np.diff(np.append(starts, len(raw))), tokens, crossing))
                n += len(starts)
                if n >= BATCH_ROWS:
                    yield batch_of(rows)
                    rows, n = [], 0
            if rows:
                yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, section int, start long, length long, n_tokens long, n_crossing long")
