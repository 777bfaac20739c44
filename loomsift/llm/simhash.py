"""SimHash near-duplicate components.

Fingerprints: 64 bits, each the majority over the XXH64 hashes of all 3-word shingles.

Links: two fingerprints that differ in at most ``radius`` bits agree in all but ``radius`` of
eight 8-bit blocks, so they meet under at least one of the C(8, radius) masks that blank out
``radius`` blocks. Under a mask only 8 * radius bits vary, hence a bucket of distinct
fingerprints holds 2 ** (8 * radius) at most (65,536 for radius 2) however the documents
are spread: no cap is needed. Inside a bucket the comparison is bit-sliced: one bit plane
per varying bit, stored vertically over a block of fingerprints; a query adds its
differing planes into carry-save counters, and leaves a block as soon as every count in it
exceeds the radius. A bucket yields a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.llm.components import connected
from loomsift.scratch import mark, materialise, release_since

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Blocks of bits that the masks blank out.
BLOCKS = 8
#: Fingerprints in one bit-sliced block.
SLICE = 2048
#: Fingerprints that a task puts under all masks.
KEYED = 50_000


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text; null, empty and blank texts have 0.

    ``A-Z`` are lower-cased; words are runs without ASCII white space; fewer words than a
    shingle make one shingle of all. Repeated shingles count each time; a bit is set if it is
    set in more than half of the hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    hashed = xxhash.xxh64_intdigest
    digests = [hashed(b"%b %b %b" % z, SEED) for z in zip(words, words[1:], words[2:])]
    bits = np.unpackbits(np.array(digests, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(digests), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x) for x in batch.column(2).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "digest", "fp"])


def digest() -> Column:
    """A hash of the text that, with the doc_id, finds a row of documents again."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp) for every row of ``docs``; fp is the fingerprint as a signed long."""
    return docs.select("doc_id", digest().alias("digest"), "text").mapInArrow(_fingerprints, "doc_id long, digest long, fp long")


def forest(prints: list[int], radius: int = RADIUS, size: int = SLICE) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct unsigned fingerprints, as pairs of positions."""
    n, blocks = len(prints), []
    same, least = ~0, prints[0] if prints else 0
    for x in prints:
        same &= ~(x ^ least)
    varying = [b for b in range(64) if not same >> b & 1]
    for at in range(0, n, size):
        part = np.array(prints[at : at + size], dtype=np.uint64)
        planes = [int.from_bytes(np.packbits((part >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little").tobytes(), "little") for b in varying]
        blocks.append([at, planes, (1 << len(part)) - 1, (1 << len(part)) - 1])
    levels = (radius + 1).bit_length()
    links: list[tuple[int, int]] = []
    for block in blocks:
        while block[3]:
            first = (block[3] & -block[3]).bit_length() - 1
            block[3] &= block[3] - 1
            todo = [block[0] + first]
            while todo:
                at = todo.pop()
                query = prints[at]
                for other in blocks:
                    alive = other[3]  # not reached yet
                    if not alive:
                        continue
                    counts = [0] * levels
                    for plane, bit in zip(other[1], varying):
                        carry = (plane ^ other[2] if query >> bit & 1 else plane) & alive
                        for k in range(levels):  # carry-save: the k-th word holds the k-th bit of all counts
                            counts[k], carry = counts[k] ^ carry, counts[k] & carry
                        # counts stop at radius + 1: those rows leave, with what they have counted
                        over = alive
                        for k in range(levels):
                            over &= counts[k] if (radius + 1) >> k & 1 else ~counts[k]
                        alive &= ~over
                        if not alive:
                            break
                    other[3] &= ~alive
                    while alive:
                        near = other[0] + (alive & -alive).bit_length() - 1
                        alive &= alive - 1
                        links.append((at, near))
                        todo.append(near)
    return links


def _links(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for prints in batch.column(0).to_pylist():
                found = [x & 0xFFFFFFFFFFFFFFFF for x in sorted(prints)]
                for i, j in forest(found, radius):
                    left.append(found[i])
                    right.append(found[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (left, right)], names=["a", "b"])

    return links


def near_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, digest, fingerprint, component_id, n_same, root.

    component_id is the smallest doc_id that links reach; n_same counts the rows with this
    fingerprint; root is a fingerprint that names the component, one without any doc_id too. Rows without text have fingerprint zero and link like any others. Rows
    repeated whole stay repeated. A null doc_id is never a component_id unless the component has
    no other. An empty table gives no rows; other columns of ``docs`` are not read.
    """
    if not 0 <= radius < BLOCKS:
        raise ValueError("radius must be from 0 to 7")
    at = mark()
    rows = materialise(fingerprints(docs), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same"))
    prints = materialise(prints, "distinct")
    masks = []
    for blanked in combinations(range(BLOCKS), radius):
        mask = (1 << 64) - 1
        for block in blanked:
            mask &= ~(0xFF << 8 * block)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    # few bytes become many rows: dealt out by number, which is not coalesced
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, prints.count() // KEYED)
    keyed = prints.repartition(parts, "fp").select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("mask", "key"))
    buckets = keyed.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    edges = buckets.select("fps").mapInArrow(_links(radius), "a long, b long")
    roots = connected(edges)
    placed = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", "n_same", F.coalesce("root", "fp").alias("root"))
    placed = materialise(placed, "placed")
    # written, so that the join is between two plain exchanges, of which a hot root's is split
    named = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    release_since(docs.sparkSession, at, rows, placed, named)
    named = placed.join(named, "root").select("fp", "n_same", "component_id", "root")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return rows.join(named, "fp").select("doc_id", "digest", digits("fp").alias("fingerprint"), "component_id", "n_same", digits("root").alias("root"))
