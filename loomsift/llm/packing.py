"""Best-fit packing of token sequences after a Martello-Toth reduction.

Documents are cut into pieces of at most CAPACITY tokens. Only the number of pieces of each
length matters to the packing, so the instance that the driver solves is a histogram of
CAPACITY counts, whatever the number of documents. The reduction fixes, for a length j, a set
that dominates all others that hold j: j alone if nothing fits beside it; {j, k} if k fills the
rest exactly, or if at most one piece fits beside j and k is the largest that does, or if at
most two fit and k is no smaller than any two that fit together. What is left is packed
best-fit decreasing, all pieces of a length at once, over classes of sequences with the same
contents.

A piece finds its place by its rank among the pieces of its length. Ranks are counted
inside SALTS shares of each length and put together by prefix sums of the shares' counts, so a
length that most pieces have is still ranked by many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.llm.bpe import vocabulary
from loomsift.scratch import materialise

CAPACITY = 2048
#: The id that ends each document.
END_ID = 0
SALTS = 1024

#: A class of sequences: their number, and (length, pieces of it) in the order of places.
Class = tuple[int, tuple[tuple[int, int], ...]]


def reduce_counts(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Class], dict[int, int]]:
    """Sequences fixed because they dominate all others with their first piece, and the counts that remain."""
    left = {w: n for w, n in counts.items() if n > 0}
    fixed: list[Class] = []

    def take(n: int, *lengths: int) -> None:
        fixed.append((n, tuple((w, lengths.count(w)) for w in dict.fromkeys(lengths))))
        for w in lengths:
            left[w] -= n
            if not left[w]:
                del left[w]

    for j in sorted(left, reverse=True):
        if j in left and j == capacity:
            take(left[j], j)
        elif j in left and capacity - j in left and (2 * j != capacity or left[j] > 1):
            k = capacity - j
            take(left[j] // 2 if j == k else min(left[j], left[k]), j, k)
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            if j not in left:
                continue
            room, order = capacity - j, sorted(left)
            others = [w for w in order[: bisect_right(order, room)] if w != j or left[j] > 1]
            if not others:
                take(left[j], j)
                changed = True
                continue
            spare = lambda w: left[w] - (w == j)
            smallest = [w for w in others[:3] for _ in range(min(3, spare(w)))][:3]
            k = others[-1]
            if len(smallest) > 1 and sum(smallest[:2]) <= room:
                if len(smallest) > 2 and sum(smallest) <= room:
                    continue
                best, b = 0, len(others) - 1
                for a in range(len(others)):  # the largest two that fit together
                    while b >= a and others[a] + others[b] > room:
                        b -= 1
                    if b < a:
                        break
                    if b > a or spare(others[a]) > 1:
                        best = max(best, others[a] + others[b])
                if best > k:
                    continue
            take(max(1, left[j] // 2) if j == k else min(left[j], left[k]), j, k)
            changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Class]:
    """Best-fit decreasing over a histogram: all pieces of a length at once into the fullest sequences that take them."""
    by_room: dict[int, list[Class]] = {}

    def put(room: int, n: int, held: tuple) -> None:
        if n:
            by_room.setdefault(room, []).append((n, held))

    for w in sorted(counts, reverse=True):
        c = counts[w]
        for room in sorted(r for r in by_room if r >= w):
            each = room // w
            while c and by_room.get(room):
                n, held = by_room[room].pop()
                full = min(n, c // each)
                rest = c - full * each if full < n else 0
                put(room - each * w, full, (*held, (w, each)))
                if rest:
                    put(room - rest * w, 1, (*held, (w, rest)))
                put(room, n - full - bool(rest), held)
                c -= full * each + rest
            if not c:
                break
        if c:
            each = capacity // w
            put(capacity - each * w, c // each, ((w, each),))
            put(capacity - c % each * w, int(c % each > 0), ((w, c % each),))
    return [x for room in sorted(by_room) for x in by_room[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Class]:
    """Classes of sequences that hold every piece: the reduction's, then best fit's for the remainder."""
    fixed, left = reduce_counts(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(classes: list[Class]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: arrays of the first rank, first sequence, pieces a sequence and offset, a row per class that holds it."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for n, held in classes:
        offset = 0
        for w, each in held:
            first = ranks.get(w, 0)
            slots.setdefault(w, []).append((first, sequence, each, offset))
            ranks[w] = first + n * each
            offset += w * each
        sequence += n
    return {w: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for w, rows in slots.items()}


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt): the pieces of each row's ids and END_ID, cut only where longer."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = vocabulary(path), 0
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode([x or "" for x in batch.column(1).to_pylist()])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    seen += 1
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), seen * 7919 % SALTS))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the one id END_ID. Rows repeated whole are packed as often as they
    occur. An empty table gives no rows; other columns of ``docs`` are not read.
    """
    parts = materialise(pieces(docs, path, capacity), "pieces")
    shares = materialise(parts.groupBy("length", "salt").count(), "shares")
    counts = {r.length: r.n for r in shares.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    slots = docs.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    shares = shares.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = parts.withColumn("number", number).join(shares, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("number") - 1)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for w in np.unique(length):
                at = np.flatnonzero(length == w)
                first, base, each, start = slots.value[int(w)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                inside = rank[at] - first[k]
                sequence[at] = base[k] + inside // each[k]
                offset[at] = start[k] + inside % each[k] * w
            columns = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in schema.split(", ")])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)
