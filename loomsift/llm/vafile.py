"""Exact top-k inner products over vector-approximation files.

Vectors are turned into integers. Of equal vectors the k + 1 smallest ids alone can be among
any query's k best, whichever id is the query's own, so only those go on; a very common vector
shrinks to k + 1 rows before it is shuffled. They are kept as the exact file, under row
numbers, and dealt into blocks. In a block every dimension is cut into CELLS cells between the
block's least and largest value, and the approximation file holds one byte a dimension.

Search, in three steps:

1. Blocks of queries meet blocks of the approximation file, and no exact vector: a scan of the
   cells bounds each score from above and below. A pair of blocks passes on what its own k best lower
   bounds can't rule out, and the k best lower bounds of all blocks rule out more.
2. The exact vectors of the FIRST best upper bounds of a query are read.
3. Only those whose upper bound still reaches the kth exact score are read after them. Then
   the kth result is certain, as no bound that is left reaches it.

Memory of a task is bounded by two blocks. The scan grows with queries times vectors, as any
exact answer's does here, in blocks of bytes and without a row per pair; what is moved of the
exact vectors is one pass over the exact file for each of the two reads, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.llm.frames import slices
from loomsift.scratch import mark, materialise, release_since

SCALE = 1024
#: Cells of a dimension; their numbers are bytes.
CELLS = 256
#: Vectors and queries in a block; a task holds one block of each.
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 4096
#: Queries whose bounds are computed at a time.
TOGETHER = 64
#: Exact vectors read first for a query, as a multiple of k.
FIRST = 2

_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as a long, the nearest long beyond that range; vectors or ids that are null, or with null or non-finite components, are left out."""
    raw = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return raw.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite).select(
        "vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("v")
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of longs, shorter vectors filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def approximate(vectors: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers, and the least integer and the number of integers of the cells of each dimension."""
    low = vectors.min(axis=0)
    span = vectors.max(axis=0).view(np.uint64) - low.view(np.uint64)  # differences fit when unsigned
    width = span // np.uint64(cells) + np.uint64(1)
    return ((vectors.view(np.uint64) - low.view(np.uint64)) // width).astype(np.uint8), low, width


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of all scores, and how far below them each query's lower bounds lie."""
    q, w, least = queries.astype(np.float64), width.astype(np.float64), low.astype(np.float64)
    gap = np.abs(q) @ (w - 1)
    # far above what rounding can change in sums of so many terms
    slack = (len(w) + 8) * 2.0**-50 * (np.abs(q) @ (np.abs(least) + w * CELLS)) + 1e-6
    base = q @ least + np.maximum(q, 0) @ (w - 1) + slack
    return base[:, None] + (q * w) @ cells.astype(np.float64).T, gap + 2 * slack


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The inner products row by row, exactly; the nearest long of those beyond its range."""
    if not len(queries) or not queries.shape[1]:
        return np.zeros(len(queries), np.int64)
    largest = [max(int(x.max()), -int(x.min())) for x in (queries, vectors)]
    if largest[0] * largest[1] * queries.shape[1] <= _MOST:
        return np.einsum("ij,ij->i", queries, vectors)
    return np.array([min(_MOST, max(_LEAST, int(x))) for x in (queries.astype(object) * vectors.astype(object)).sum(axis=1)], np.int64)


def _within(bound: np.ndarray) -> np.ndarray:
    """Bounds cut to the range of a long, as scores are."""
    return np.clip(bound, float(_LEAST), float(_MOST))


def _pack_vectors(dims: int):
    def pack(table: pa.Table) -> pa.Table:
        cells, low, width = approximate(np.ascontiguousarray(_matrix(table["v"], dims)))
        one = lambda x, t: pa.array([x.tolist()], pa.list_(t))
        return pa.table(
            {"b": table["b"][:1], "rows": one(table["row"].to_numpy(), pa.int64()), "ids": one(table["vec_id"].to_numpy(), pa.int64()), "low": one(low, pa.int64()), "width": one(width.astype(np.int64), pa.int64()), "cells": pa.array([cells.tobytes()], pa.binary())}
        )

    return pack


def _pack_queries(dims: int):
    def pack(table: pa.Table) -> pa.Table:
        one = lambda x: pa.array([x.to_pylist()], pa.list_(pa.int64()))
        return pa.table({"q": table["q"][:1], "asked": one(table["asked"]), "query_ids": one(table["query_id"]), "matrix": pa.array([_matrix(table["v"], dims).tobytes()], pa.binary())})

    return pack


def _bound(k: int, dims: int):
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows, ids, low, width, asked, query_ids = (batch.column(c).flatten().to_numpy() for c in ("rows", "ids", "low", "width", "asked", "query_ids"))
            cells = np.frombuffer(batch.column("cells")[0].as_buffer(), np.uint8).reshape(len(rows), dims)
            queries = np.frombuffer(batch.column("matrix")[0].as_buffer(), np.int64).reshape(len(asked), dims)
            for at in range(0, len(asked), TOGETHER):
                part = slice(at, at + TOGETHER)
                upper, gap = bounds(queries[part], cells, low, width)
                upper[query_ids[part][:, None] == ids[None, :]] = -np.inf
                reach = upper > -np.inf
                if len(rows) > k:
                    least = np.partition(upper, len(rows) - k, axis=1)[:, len(rows) - k] - gap
                    reach &= _within(upper) >= _within(least)[:, None]
                i, j = np.nonzero(reach)
                columns = [asked[part][i], rows[j], _within(upper[i, j]), _within(upper[i, j] - gap[i])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["asked", "row", "upper", "lower"])

    return bound


def _exact(dims: int):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            found = scores(_matrix(batch.column("qv"), dims), _matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([batch.column("asked"), batch.column("query_id"), batch.column("row"), batch.column("vec_id"), batch.column("copies"), pa.array(found)], names=["asked", "query_id", "row", "vec_id", "copies", "score"])

    return exact


def candidates(vectors: DataFrame, k: int, every: int, scale: int) -> tuple[DataFrame, DataFrame, DataFrame, int] | None:
    """(asked, row, upper, lower) that bounds can't rule out, the queries (asked, query_id, v), the exact file (row, vec_id, copies, v) and its dimensions."""
    distinct = materialise(integers(vectors, scale).groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("copies")), "vectors")
    rank = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    few = distinct.withColumn("h", F.xxhash64("v")).withColumn("n", rank).where(F.col("n") <= k + 1)
    exact = materialise(few.select(F.monotonically_increasing_id().alias("row"), "vec_id", "copies", "v"), "exact")
    queries = distinct.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("asked"), F.col("vec_id").alias("query_id"), "v")
    queries = materialise(queries, "queries")
    n_rows, dims = exact.agg(F.count("*"), F.greatest(F.max(F.size("v")), F.lit(1))).first()
    n_queries = queries.count()
    if not n_queries:
        return None
    n_blocks, q_blocks = -(-n_rows // BLOCK_VECTORS), -(-n_queries // BLOCK_QUERIES)
    blocks = exact.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(n_blocks))).groupBy("b").applyInArrow(
        _pack_vectors(dims), "b long, rows array<long>, ids array<long>, low array<long>, width array<long>, cells binary"
    )
    blocks = materialise(blocks, "approximations")
    asked = queries.withColumn("q", F.pmod(F.xxhash64("asked"), F.lit(q_blocks))).groupBy("q").applyInArrow(_pack_queries(dims), "q long, asked array<long>, query_ids array<long>, matrix binary")
    asked = materialise(asked, "asked")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    met = blocks.withColumn("q", numbers(q_blocks)).join(asked.withColumn("b", numbers(n_blocks)), ["b", "q"])  # one row of each a pair
    found = met.drop("b", "q").mapInArrow(_bound(k, dims), "asked long, row long, upper double, lower double")
    return materialise(found, "candidates"), queries, exact, dims


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``, the k highest inner products.

    Candidates are all rows with another id; all of them are returned if they are fewer than k.
    Ties go to the smaller vec_id. Vectors or ids that are null, and vectors with null or
    non-finite components, take no part. Components and scores beyond the range of a long
    count as the nearest long. Vectors of unlike length are compared as if filled
    with zeros. Rows repeated under one id each count as candidates; those of the queries' ids are
    one query if equal, else their results are ranked together. An empty table, and one without
    such ids, gives no rows; other columns are not read.
    """
    none = "query_id long, rank int, vec_id long, score long"
    at = mark()
    found = candidates(vectors, k, every, scale)
    if found is None:
        return vectors.sparkSession.createDataFrame([], none)
    left, queries, exact, dims = found
    order = lambda by: F.row_number().over(Window.partitionBy("asked").orderBy(F.desc(by), "row"))
    asked = queries.select("asked", "query_id", F.col("v").alias("qv"))

    def read(rows: DataFrame) -> DataFrame:
        """Exact scores of (asked, row); of a row that very many queries ask for the join is split."""
        met = rows.join(exact, "row").select("asked", "row", "vec_id", "copies", "v").join(asked, "asked")
        return materialise(met.mapInArrow(_exact(dims), "asked long, query_id long, row long, vec_id long, copies long, score long"), "scores")

    def kth(rows: DataFrame, by: str) -> DataFrame:
        """(asked, least): the kth value of each query; none where there are fewer."""
        best = rows.withColumn("n", order(by)).where(F.col("n") <= k)
        return best.groupBy("asked").agg(F.count("*").alias("n"), F.min(by).alias("least")).where(F.col("n") == k).select("asked", "least")

    certain = materialise(kth(left, "lower"), "certain")
    left = left.join(certain, "asked", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    left = materialise(left.select("asked", "row", "upper"), "left")
    strides = materialise(left.withColumn("n", order("upper")).where(F.col("n") <= FIRST * k), "first")
    first = read(strides.select("asked", "row"))
    # where the first stride ended, and the score that the rest must reach; queries without both have no rest
    ends = strides.where(F.col("n") == FIRST * k).select("asked", F.col("upper").alias("last_upper"), F.col("row").alias("last_row"))
    ends = materialise(ends.join(kth(first, "score"), "asked"), "ends")
    later = (F.col("upper") < F.col("last_upper")) | ((F.col("upper") == F.col("last_upper")) & (F.col("row") > F.col("last_row")))
    rest = left.join(ends, "asked").where(later & (F.col("upper") >= F.col("least").cast("double")))
    second = read(rest.select("asked", "row"))
    release_since(vectors.sparkSession, at, first, second)
    scored = first.unionByName(second)
    scored = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
