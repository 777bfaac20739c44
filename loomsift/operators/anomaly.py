"""Anomalous lines: row windows, embeddings, k-nearest-neighbour scores, the top share, and groups."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsift.functions import signature
from loomsift.functions.signature import MOST_KEYS
from loomsift.operators.lines import to_lines
from loomsift.scratch import materialise

# Window size, stride, neighbours, share and characters by default.
SIZE, STRIDE, NEIGHBOURS, PERCENT, CHARS, DIMENSIONS = 10, 5, 5, 20.0, 4000, 256
#: Vectors in a block; a task compares two blocks, TOGETHER vectors of the one at a time. A vector moves twice as often as there are blocks.
BLOCK = 8192
TOGETHER = 512

Embedder = Callable[[list[str]], np.ndarray]


def windows(docs: DataFrame, size: int = SIZE, stride: int = STRIDE, chars: int = CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, text): full windows over the non-blank lines, ``start`` counted in those."""
    lines = F.filter(F.split(F.regexp_replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), r"\n\z", ""), "\n"), lambda x: F.trim(x) != "")
    held = docs.where(F.col(text).isNotNull()).select(key, lines.alias("l")).where(F.size("l") >= size)
    starts = held.select(key, "l", F.explode(F.sequence(F.lit(0), F.size("l") - size, F.lit(stride))).alias("start"))
    return starts.select(key, "start", F.substring(F.array_join(F.slice("l", F.col("start") + 1, size), "\n"), 1, chars).alias("text"))


def thin(rows: DataFrame, most: int, key: str = "doc_id", order: str = "start") -> DataFrame:
    """At most ``most`` rows of each group, evenly spread; all of them for 0."""
    if most <= 0:
        return rows
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(key))
    ranked = rows.withColumn("__at", at).withColumn("__n", n)
    # row a is taken if some i has floor(i * n / most) = a: the least such i is ceil(a * most / n)
    i = F.ceil(F.col("__at") * most / F.col("__n"))
    taken = (F.col("__n") <= most) | ((i < most) & (F.floor(i * F.col("__n") / most) == F.col("__at")))
    return ranked.where(taken).drop("__at", "__n")


def squared_distance(a: Column, b: Column) -> Column:
    """Over the dimensions that both vectors have."""
    n = F.least(F.size(a), F.size(b))
    parts = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def _vectors(column: pa.ChunkedArray) -> np.ndarray | list:
    """A matrix of a column of vectors of one length, else lists."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = set(held.value_lengths().to_pylist())
    return held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), sizes.pop()) if len(sizes) == 1 and None not in sizes else column.to_pylist()


def nearest(x: list | np.ndarray, y: list | np.ndarray, own: Callable[[int, int], np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``x`` and distances of the k nearest vectors of ``y`` for each of ``x``; pairs that ``own`` marks, for some of ``x``, take no part.

    Vectors of unlike length are compared over the dimensions that both have. The k nearest are
    chosen by a product of matrices, some rows at a time, and their distances are exact.
    """
    even = len({len(v) for v in (*x[:1], *y[:1])} if isinstance(x, np.ndarray) and isinstance(y, np.ndarray) else {len(v) for v in x} | {len(v) for v in y}) == 1
    if even:
        x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
        square = (y**2).sum(axis=1)
    at, found = [], []
    for first in range(0, len(x), TOGETHER):
        part = x[first : first + TOGETHER]
        if even:
            d = (part**2).sum(axis=1)[:, None] + square[None, :] - 2 * part @ y.T
        else:
            d = np.array([[np.linalg.norm(np.subtract(a[: min(len(a), len(b))], b[: min(len(a), len(b))])) for b in y] for a in part])
        d[own(first, first + len(part))] = np.inf
        near = np.argpartition(d, min(k, len(y)) - 1, axis=1)[:, :k]
        i, j = np.repeat(np.arange(len(part)), near.shape[1]), near.ravel()
        there = np.isfinite(d[i, j])
        i, j = i[there], j[there]
        at.append(i + first)
        found.append(np.sqrt(((part[i] - y[j]) ** 2).sum(axis=1)) if even else d[i, j])
    return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, np.int64), np.zeros(0))


def mean_nearest(vectors: np.ndarray, k: int) -> np.ndarray:
    """Mean distance of each vector to its k nearest others; 0 without any."""
    n = len(vectors)
    i, d = nearest(vectors, vectors, lambda low, high: np.arange(low, high)[:, None] == np.arange(n)[None, :], k)
    return np.bincount(i, d, n) / np.maximum(np.bincount(i, minlength=n), 1)


def knn_scores(vectors: DataFrame, k: int = NEIGHBOURS, key: str = "vec_id", vector: str = "embedding", group: str | None = None) -> DataFrame:
    """(group, key, score): mean distance to the k nearest other vectors of the group, or of all without one.

    A group's vectors are compared in pairs of blocks that are dealt to tasks; the k smallest
    distances of each pair of blocks are merged by vector. So no task holds more than two
    blocks, and a group of any size is spread over as many tasks as it has pairs.
    """
    names = [x for x in (group, key) if x]
    types = dict(vectors.dtypes)
    rows = vectors.select(*names, vector, F.col(group).alias("__g") if group else F.lit(0).alias("__g"))
    rows = rows.join(rows.groupBy("__g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__blocks")), "__g")
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(key), F.col("__blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    own = lambda: [F.col(c).alias(c) for c in dict.fromkeys([*names, vector, "__g"])]  # noqa: E731  new columns on either side
    left = rows.select(*own(), F.col("__b").alias("__l"), every.alias("__r"))
    right = rows.select(*own(), F.col("__b").alias("__r"), every.alias("__l"))
    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + ", d double"

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        at, found = np.zeros(0, np.int64), np.zeros(0)
        if a.num_rows and b.num_rows:
            left_keys, right_keys = np.array(a[key].to_pylist()), np.array(b[key].to_pylist())
            at, found = nearest(_vectors(a[vector]), _vectors(b[vector]), lambda low, high: left_keys[low:high, None] == right_keys[None, :], k)
        return pa.table({**{n: a[n].take(pa.array(at, pa.int64())) for n in names}, "d": pa.array(found, pa.float64())})

    near = left.groupBy("__g", "__l", "__r").cogroup(right.groupBy("__g", "__l", "__r")).applyInArrow(pair, schema)
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy(*names).orderBy("d"))).where(F.col("n") <= k)
    scores = ranked.groupBy(*names).agg(F.avg("d").alias("score"))
    return vectors.select(*names).join(scores, names, "left").select(*names, F.coalesce("score", F.lit(0.0)).alias("score"))


def top_percent(scored: DataFrame, percent: float = PERCENT, key: str | None = "doc_id", order: str = "start") -> DataFrame:
    """The highest-scored share of each group, one row at least; earlier rows win ties. Without a key, of all rows.

    All rows are written once, parted by ranges of score and order; a row's rank is its place in its
    part behind the sizes of the parts before, so no task holds more than a part.
    """
    if key is None:
        part, place = "__p", "__r"
        rows = scored.repartitionByRange(F.desc("score"), F.col(order)).withColumn(part, F.spark_partition_id())
        rows = materialise(rows, "ranked")
        before, n = {}, 0
        for r in sorted(rows.groupBy(part).count().collect()):  # a row for each part
            before[r[part]], n = n, n + r["count"]
        most = min(max(int(n * percent / 100), 1), n)
        left = F.create_map(*[F.lit(x) for p, b in before.items() for x in (p, max(0, most - b))]) if before else F.create_map(F.lit(0), F.lit(0))
        at = F.row_number().over(Window.partitionBy(part).orderBy(F.desc("score"), order))
        return rows.withColumn(place, at).where(F.col(place) <= left[F.col(part)]).drop(part, place)
    by = Window.partitionBy(key)
    n = F.count("*").over(by)
    most = F.least(F.greatest((n * percent / 100).cast("int"), F.lit(1)), n)
    return scored.withColumn("__r", F.row_number().over(by.orderBy(F.desc("score"), order))).withColumn("__m", most).where("__r <= __m").drop("__r", "__m")


def hash_embedder(texts: list[str], dims: int = DIMENSIONS) -> np.ndarray:
    """Stands in for a model: counts of hashed words and letter triples, of unit length."""
    out = np.zeros((len(texts), dims))
    for i, text in enumerate(texts):
        words = re.findall(r"[a-z0-9]+", text.lower())
        for gram in [*words, *(w[j : j + 3] for w in words for j in range(len(w) - 2))]:
            h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
            out[i, h % dims] += 1 if h >> 63 else -1
        out[i] /= np.linalg.norm(out[i]) or 1
    return out


def flagged_lines(docs: DataFrame, embed: Embedder = hash_embedder, size: int = SIZE, stride: int = STRIDE, k: int = NEIGHBOURS, percent: float = PERCENT, most: int = 0) -> DataFrame:
    """(doc_id, line_no, line): the lines of the most outlying windows, each once, in order; line_no counts non-blank lines.

    A document of fewer than two strides' worth of lines, or of fewer than two windows, has all its lines.
    """

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "start"]].assign(vec=list(embed(list(pdf["text"]))))

    cut = thin(windows(docs, size, stride), most)
    scored = knn_scores(cut.mapInPandas(vectors, "doc_id long, start int, vec array<double>"), k, "start", "vec", "doc_id")
    top = top_percent(scored).select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + size - 1)).alias("line_no")).distinct()
    whole = to_lines(docs).where(F.trim("line") != "")
    numbered = whole.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1)
    few = numbered.groupBy("doc_id").count().where(F.col("count") < max(2 * size, size + stride)).select("doc_id")
    return numbered.join(top, ["doc_id", "line_no"], "left_semi").unionByName(numbered.join(few, "doc_id", "left_semi").join(top.select("doc_id").distinct(), "doc_id", "left_anti"))


def groups(lines: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line", structured: bool = True, keys: bool = True) -> DataFrame:
    """(key, ord, sig, level, n, sample, keys): lines by signature, the worst level and largest group first.

    Level and sample come from the first line; keys are its distinct key tokens in order, 12 at most;
    they are left out on request. ``structured`` reads JSON lines by their fields, in Python; without
    it lines count as text.
    """
    if structured:
        shaped = lines.withColumn("__s", signature.shape(line)).select(key, order, line, "__s.sig", "__s.level")
    else:
        shaped = lines.select(key, order, line, signature.plain_signature(line).alias("sig"), signature.text_level(line).alias("level"))
    made = shaped.groupBy(key, "sig").agg(F.count("*").alias("n"), F.min_by("level", order).alias("level"), signature.sample(F.min_by(line, order)).alias("sample"))
    by = Window.partitionBy(key).orderBy(F.desc(signature.level_rank("level")), F.desc("n"), "sig")
    made = made.withColumn("ord", F.row_number().over(by)).select(key, "ord", "sig", "level", "n", "sample")
    return made.join(group_keys(shaped, key, order, line), [key, "sig"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>"))).select(*made.columns, "keys") if keys else made


def group_keys(shaped: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """(key, sig, keys): the first 12 distinct key tokens of each signature's lines, by line and place; the first place of each token is found with map-side combine."""
    said = shaped.select(key, "sig", F.col(order).alias("__o"), F.posexplode(signature.key_tokens(line)).alias("__i", "__t"))
    first = said.groupBy(key, "sig", "__t").agg(F.min(F.struct("__o", "__i")).alias("__f"))
    rank = F.row_number().over(Window.partitionBy(key, "sig").orderBy("__f"))
    few = first.withColumn("__n", rank).where(F.col("__n") <= MOST_KEYS)
    return few.groupBy(key, "sig").agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__t"))), lambda x: x["__t"]).alias("keys"))
