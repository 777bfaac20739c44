"""Encoding and decoding with a public word-level BPE vocabulary, exactly as its library does.

No token crosses white space, so a text's ids are the ids of its chunks between white space in
turn; in a text of Latin-1 letters the vocabulary's own splitting into words, digits and marks
is done on bytes. A worker keeps the ids of the parts it has seen (CACHE_PARTS at most, then
anew).

A long stretch that the vocabulary's own splitting leaves whole is encoded by tree
concatenation: its halves are encoded apart, down to LEAF symbols, and joined by encoding anew
a window around the cut, which grows on either side until its first and last tokens agree with
the neighbours left standing. They agree when the two tokens, taken as one stretch, encode to
themselves; a sequence in which all neighbours agree is the encoding of the whole, because the
first merge that broke a boundary would also break it in that pair alone. Stretches
over SPREAD_SYMBOLS are dealt to tasks leaf by leaf, and joined by document.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.scratch import materialise

CACHE_PARTS = 1_000_000
#: Texts looked up at a time, with one call of the library for what is new in them.
TOGETHER = 64
#: A chunk of more code points is split by its own pre-tokens, and those by the tree.
LONG_CHUNK = 2048
LEAF = 256
SPREAD_SYMBOLS = 65_536
#: Separators that Python's split takes for white space and the library does not.
_ODD = re.compile("[\x1c-\x1f]")
# The characters that the library's pattern class for white space holds.
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
_END = "</w>"
#: Chunks whose normal form and words are plain: neither special tokens nor contractions nor marks that compose.
_PLAIN = re.compile(r"(?:[a-zA-ZÀ-ÖØ-öø-ÿ0-9!-&(-/:;=-@\[-`{-~]|<(?!\|))*")
#: In lower-case Latin-1: contractions and runs of marks, between words and digits.
_MARKS = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[^a-z\xdf-\xf6\xf8-\xff0-9\t-\r ]+")
#: Latin-1 letters and numbers outside the plain ranges: ordinals, micro, superscripts, fractions.
_RARE = re.compile(rb"[\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe]")
#: Lower case, and a space for the white space above ASCII.
_LOWER = bytes(0x20 if c in (0x85, 0xA0) else ord(chr(c).lower()) if c != 0xB5 else c for c in range(256))
#: Letters, digits and white space; their complement as a translation to zero bytes; and each byte.
_NO_MARKS = bytes(c for c in range(256) if not _MARKS.match(bytes([c])))
_KINDS = bytes(c if c in _NO_MARKS else 0 for c in range(256))
_MARK = [bytes([c]) for c in range(256)]
_WORDS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordBpe:
    """A vocabulary file of the tokenizers library whose tokens end words with ``</w>``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.vocab: dict[str, int] = whole["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.names = [names.get(i, "").encode("utf-8") for i in range(max(names) + 1)]
        self.ends = np.array([x.endswith(_END.encode()) for x in self.names])
        self.chunks: dict[str | bytes, bytes] = {}
        self.agree = lru_cache(200_000)(lambda a, b: self.merge([*self.symbols(a), *self.symbols(b)]) == [a, b])

    # stretches of symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        """The symbols of a token or stretch: characters, the last with the word end if there is one."""
        if token.endswith(_END) and len(token) > len(_END):
            token = token[: -len(_END)]
            return [*token[:-1], token[-1] + _END]
        return list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """The tokens of a stretch by the vocabulary's merges, the best rank first and the leftmost of equals."""
        parts, ranks = list(symbols), self.ranks
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The tokens of two stretches in one, from the tokens of each."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            window = self.merge([s for t in (*left[-i:], *right[:j]) for s in self.symbols(t)])
            sure_left = i == len(left) or self.agree(left[-i - 1], window[0])
            sure_right = j == len(right) or self.agree(window[-1], right[j])
            if sure_left and sure_right:
                return [*left[:-i], *window, *right[j:]]
            i = i if sure_left else min(2 * i, len(left))
            j = j if sure_right else min(2 * j, len(right))

    def joined(self, leaves: list[list[str]]) -> list[str]:
        """Neighbours joined level by level until one stretch is left."""
        while len(leaves) > 1:
            leaves = [self.join(leaves[k], leaves[k + 1]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def tree(self, symbols: list[str], leaf: int = LEAF) -> list[str]:
        """The tokens of a stretch from the tokens of its halves."""
        if len(symbols) <= max(1, leaf):
            return self.merge(symbols)
        middle = len(symbols) // 2
        return self.join(self.tree(symbols[:middle], leaf), self.tree(symbols[middle:], leaf))

    # texts

    def stretches(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """(id, []) for a special token, (-1, symbols) for each stretch that the vocabulary's own splitting leaves whole."""
        at = 0
        for m in [*self._special.finditer(text), None]:
            part = self.library.normalizer.normalize_str(text[at : m.start() if m else len(text)])
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                yield -1, [*piece[:-1], piece[-1] + _END]
            if m:
                yield self.special[m[0]], []
                at = m.end()

    def long(self, chunk: str) -> bytes:
        ids: list[int] = []
        for special, symbols in self.stretches(chunk):
            ids += [special] if special >= 0 else [self.vocab[t] for t in self.tree(symbols)]
        return np.array(ids, dtype="<u4").tobytes()

    @staticmethod
    def split(text: str) -> list[str] | list[bytes]:
        """Parts of a text that are encoded apart: its own words in Latin-1, in lower case, or chunks between white space."""
        try:
            plain = text.encode("latin-1")
        except UnicodeEncodeError:
            plain = b"<|"
        if b"<|" not in plain and not _RARE.search(plain):
            plain = plain.translate(_LOWER)
            if b"\0\0" in plain.translate(_KINDS) or b"'" in plain:
                return _MARKS.sub(rb" \g<0> ", plain).split()
            for mark in set(plain.translate(None, _NO_MARKS)):  # single marks only: the same, by plain replacement
                plain = plain.replace(_MARK[mark], b" " + _MARK[mark] + b" ")
            return plain.split()
        return [x for x in _SPACE.split(text) if x] if _ODD.search(text) else text.split()

    def learn(self, parts: set) -> None:
        """Take the ids of ``parts`` into the cache."""
        held, other = {}, []
        for x in parts:
            text = x if isinstance(x, str) else x.decode("latin-1")
            if len(text) > LONG_CHUNK:
                self.chunks[x] = self.long(text)
            elif isinstance(x, str):
                if _PLAIN.fullmatch(x):
                    held[x] = [w.encode("latin-1") for w in _WORDS.findall(x.lower())]
                else:
                    other.append(x)
            elif text.isalpha() or not text[0].isalnum():
                held[x] = (x,)
            else:
                held[x] = [w.encode("latin-1") for w in _WORDS.findall(text)]
        new = list({w for ws in held.values() for w in ws}.difference(self.chunks))
        for at in range(0, len(new), 5000):  # each word gives one token that ends a word
            part = new[at : at + 5000]
            ids = np.array(self.library.encode_batch_fast([b" ".join(part).decode("latin-1")], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            self.chunks.update(zip(part, (raw[i:j] for i, j in zip([0, *ends], ends))))
        get = self.chunks.__getitem__
        self.chunks.update((x, b"".join(map(get, ws))) for x, ws in held.items() if ws != (x,))
        for x, e in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False)):
            self.chunks[x] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        for at in range(0, len(texts), TOGETHER):
            out, later, get = [], [], self.chunks.get
            for i, text in enumerate(texts[at : at + TOGETHER]):
                parts = self.split(text)
                ids = list(map(get, parts))
                try:
                    out.append(b"".join(ids))
                except TypeError:  # a part that is not known yet
                    out.append(b"")
                    later.append((i, parts, ids))
            if later:
                new = {p for _, parts, ids in later for p, x in zip(parts, ids) if x is None}
                if len(self.chunks) + len(new) > CACHE_PARTS:
                    self.chunks.clear()
                self.learn(new)
                for i, parts, ids in later:
                    out[i] = b"".join([self.chunks[p] if x is None else x for p, x in zip(parts, ids)])
            yield from out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids, special tokens included."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(4)
def vocabulary(path: str) -> WordBpe:
    """One per worker process."""
    return WordBpe(path)


def _digest(bpe: WordBpe, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()



_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digests(docs: DataFrame, path: str, spread: int = SPREAD_SYMBOLS, leaf: int = LEAF) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    ids are those that the vocabulary at ``path`` gives without added special tokens; the
    special tokens' own strings in a text become their ids. A null or empty text has no ids.
    Rows repeated whole stay repeated. An empty table gives no rows; other columns are not read.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            later = [len(x) > spread // 4 and max(map(len, bpe.split(x)), default=0) > spread // 4 for x in texts]
            rows = [_digest(bpe, ids) for ids in bpe.encode(["" if z else x for x, z in zip(texts, later)])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows]), pa.array([x if z else None for x, z in zip(texts, later)], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "later"],
            )

    rows = materialise(docs.select("doc_id", "text").mapInArrow(first, f"{_DIGEST}, later string"), "tokens")
    plain = rows.where("later is null").drop("later")
    long = rows.where("later is not null").select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "later")
    return plain.unionByName(_spread(long, path, leaf))


def _spread(long: DataFrame, path: str, leaf: int) -> DataFrame:
    """Digests of texts (row_id, doc_id, later) whose long stretches are dealt to tasks leaf by leaf."""
    kinds = "row_id long, doc_id long, part int, leaf int, ids binary, symbols array<string>"
    slots = max(leaf, LEAF * 16)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for row_id, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list = [(row_id, doc_id, 0, 0, b"", None)]
                part = 0
                for special, symbols in bpe.stretches(text):
                    part += 1
                    if special >= 0:
                        rows.append((row_id, doc_id, part, 0, np.array([special], "<u4").tobytes(), None))
                    else:
                        rows += [(row_id, doc_id, part, k, None, symbols[at : at + slots]) for k, at in enumerate(range(0, len(symbols), slots))]
                    if len(rows) >= 4096:
                        yield _table(rows)
                        rows = []
                if rows:
                    yield _table(rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            tokens = [None if x is None else bpe.tree(x, leaf) for x in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(tokens, pa.list_(pa.string()))], names=batch.schema.names)

    def whole(table: pa.Table) -> pa.Table:
        bpe = vocabulary(path)
        rows = sorted(zip(*(table.column(k).to_pylist() for k in ("part", "leaf", "ids", "symbols"))), key=lambda x: x[:2])
        parts: dict[int, list] = {}
        for part, _, ids, tokens in rows:
            parts.setdefault(part, []).append(ids if tokens is None else tokens)
        out = [x[0] if isinstance(x[0], bytes) else np.array([bpe.vocab[t] for t in bpe.joined(x)], "<u4").tobytes() for _, x in sorted(parts.items())]
        n, a, b = _digest(bpe, b"".join(out))
        return pa.table({"doc_id": pa.array(table.column("doc_id").to_pylist()[:1], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [a], "decoded_sha256": [b]})

    leaves = long.mapInArrow(cut, kinds).repartition("row_id", "part", "leaf").mapInArrow(encode, kinds)
    return leaves.groupBy("row_id").applyInArrow(whole, _DIGEST)


def _table(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["row_id", "doc_id", "part", "leaf", "ids", "symbols"])
