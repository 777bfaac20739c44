"""Toxicity by class-conditional Kneser-Ney models.

A word is a chain of letters between a start and an end mark. Two models, of toxic and of
ordinary text, give each letter's probability after the ORDER - 1 letters before it from the
class's own discounted counts, and both back off to one shared Kneser-Ney model of
continuation counts, gathered over all documents, labelled or not. The back-off has the weight of
STRENGTH letters besides what discounting sets aside, so a few letters seen in one class are no
evidence yet, and a rare expression that neither class has seen says next to nothing.

A word's log-likelihood ratio is the sum over its letters. What counts is how far ratios go
beyond MARGIN, as most words of a toxic document are ordinary ones, whose ratios tell of its language
and subject: that excess, by the number of words and by its root, leads; the plain mean ratio and
the length stand beside it. A logistic regression in which more evidence never lowers the
score maps them to a score. To fit that mapping on ratios that were not themselves fitted
on the same documents, the learning rows are halved: each half is scored by models of the other half.

What is broadcast has a bound: class counts and mapping come from LABELLED labelled documents at most,
chosen by a hash of the doc_id (a documented sample, its size a parameter), one row for each id; every
letter sequence of those rows is broadcast, the rare ones too, as Arrow tables of 64-bit hashes
and ratios, 16 bytes a sequence. The counts themselves and both models are computed as tables;
sequences have ORDER letters at most, so their number grows far slower than the corpus. Counts are
summed with map-side combine; texts are never shuffled, but for the sample's.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomsift.llm.frames import slices
from loomsift.scratch import mark, materialise, release_since

#: Letters of a sequence: the last one is predicted from the others.
ORDER = 7
#: Labelled rows that class counts and the mapping are fitted on, at most.
LABELLED = 20_000
DISCOUNT = 0.75
#: Letters that the back-off weighs besides the discounts.
STRENGTH = 5.0
#: Ratios up to this are no evidence.
MARGIN = 2.0
THRESHOLD = 0.7
#: Words that a worker keeps, with their ratios or as told.
CACHE_WORDS = 100_000
#: Letters of a word that travel together; longer words are sent in overlapping stretches with the same sequences, and not kept.
STRETCH = 64
#: Letter sequences looked up at a time, and texts whose words are.
TOGETHER = 1 << 18
KNOWN_TOGETHER = 100
ALPHABET = 256
FEATURES = 4

_START, _STOP = "^", "$"
#: ASCII bytes other than letters part words.
_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters above ASCII in lower case, in UTF-8."""
    return (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()


def _marked(word: bytes) -> str:
    return f"{_START}{word.decode('utf-8', 'replace')}{_STOP}"


def sequences(word: bytes, order: int = ORDER) -> list[str]:
    """Each letter and the end of a word, with the letters before it, ``order`` in all at most."""
    s = _marked(word)
    return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]


def stretches(word: bytes, order: int = ORDER) -> list[str]:
    """A word between its marks in parts; those behind the first repeat ``order`` - 1 letters."""
    s = _marked(word)
    return [s[max(0, at - order + 1) : at + STRETCH] for at in range(0, len(s), STRETCH)] if len(s) > STRETCH + 1 else [s]


def sequence_rows(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, s, n) from (kind, word, n), where word is a stretch of a word: the same sequences as rows, with the counts of their stretches."""
    rows = counted.select("kind", "n", F.col("word").alias("w"))
    first = F.when(F.col("w").startswith(_START), 2).otherwise(order)
    rows = rows.where(F.char_length("w") >= first).select("kind", "n", "w", F.explode(F.sequence(first, F.char_length("w"))).alias("i"))
    cut = F.substring(F.col("w"), F.greatest(F.col("i") - (order - 1), F.lit(1)), F.least(F.col("i"), F.lit(order)))
    return rows.select("kind", cut.alias("s"), "n").groupBy("kind", "s").agg(F.sum("n").alias("n"))


def shared_model(sequences_seen: DataFrame, order: int = ORDER) -> DataFrame:
    """(s, p): the shared Kneser-Ney probability of the last letter of ``s`` after the others, for shorter and shorter ends.

    The count of a sequence is the number of longer sequences that end with it, among the
    distinct ones of all documents; each level backs off to the next shorter one.
    """
    level, counted = sequences_seen, {}
    for size in range(order, 1, -1):
        ends = level.where(F.char_length("s") == size).groupBy(F.expr("substring(s, 2)").alias("s")).agg(F.count("*").alias("n"))
        counted[size - 1] = materialise(ends, "ends")
        level = level.where(F.char_length("s") < size).union(counted[size - 1].select("s")).distinct()
    model = None
    for size in range(1, order):
        rows = counted[size].withColumn("h", F.expr(f"substring(s, 1, {size - 1})"))
        rows = rows.join(rows.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("types")), "h")
        if model is None:
            rows = rows.withColumn("lower", F.lit(1 / ALPHABET))
        else:
            rows = rows.join(model.where(F.char_length("s") == size - 1).select(F.col("s").alias("end"), F.col("p").alias("lower")), F.expr("substring(s, 2)") == F.col("end"))
        p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("lower")) / F.col("total")
        rows = materialise(rows.select("s", p.alias("p")), "shared")
        model = rows if model is None else model.unionByName(rows)
    return model


def ratios(counts: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (model, s, ordinary, toxic): (model, s, r) of the sequences seen, and (model, h, r) of any other letter after a context.

    r is the log-likelihood ratio of the last letter between the two classes' models, which both
    back off to the shared one. A letter that neither class has seen after a context has the
    same back-off in both, which cancels out: what is left are the shares that the classes set
    aside after that context.
    """
    names = ("ordinary", "toxic")
    rows = counts.withColumn("h", F.expr("substring(s, 1, char_length(s) - 1)"))
    contexts = rows.groupBy("model", "h").agg(
        *[F.sum(c).alias(f"{c}_total") for c in names], *[F.count_if(F.col(c) > 0).alias(f"{c}_types") for c in names]
    )
    aside = [(STRENGTH + DISCOUNT * F.col(f"{c}_types")) / (STRENGTH + F.col(f"{c}_total")) for c in names]
    after = contexts.select("model", "h", F.log(aside[1] / aside[0]).alias("r"))
    rows = rows.join(contexts, ["model", "h"]).join(shared.select(F.col("s").alias("end"), "p"), F.expr("substring(s, 2)") == F.col("end"))
    of = [F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / (STRENGTH + F.col(f"{c}_total")) + x * F.col("p") for c, x in zip(names, aside)]
    return rows.select("model", "s", F.log(of[1] / of[0]).alias("r")), after


#: Odd numbers that a letter is multiplied with by its distance from the last one.
_POWERS = np.cumprod(np.full(16, 0x9E3779B97F4A7C15, dtype=np.uint64)) * np.uint64(0xD1B54A32D192ED03) | np.uint64(1)


def _points(text: str) -> np.ndarray:
    """Code points, from 1 on."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)


def _keys(points: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sequence that ends at each place, and of the one before its last letter; ``first`` is where its word begins."""
    whole, context, at = points * _POWERS[0], np.zeros_like(points), np.arange(len(points))
    for t in range(1, min(order, len(points))):
        before = np.where(at[t:] - t >= first[t:], points[: len(points) - t], np.uint64(0))
        whole[t:] += before * _POWERS[t]
        context[t:] += before * _POWERS[t - 1]
    return whole.view(np.int64), context.view(np.int64)


def hashes(found: list[str]) -> np.ndarray:
    """A 64-bit hash of each string, of 16 letters at most: what ``_keys`` gives for the sequence."""
    ends = np.cumsum([len(s) for s in found], dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return np.zeros(len(found), np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    whole, _ = _keys(_points("".join(found)), np.repeat(starts, ends - starts), len(_POWERS))
    return np.where(ends > starts, whole[np.maximum(ends - 1, 0)], 0)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(hashes(batch.column(0).to_pylist())), batch.column(1)], names=["key", "r"])


def _at(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``asked`` in sorted ``keys``, and which of them are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Model(dict):
    """Log-likelihood ratios by word, from Arrow tables (key, r) of sequences and of contexts, sorted by key."""

    def __init__(self, seen: pa.Table, after: pa.Table, order: int = ORDER):
        self.seen, self.after = ((t["key"].to_numpy(), t["r"].to_numpy()) for t in (seen, after))
        self.order = order

    def _letters(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The ratio of the letter at each place; none at the start of a word."""
        whole, context = _keys(points, first, self.order)
        at, known = _at(self.seen[0], whole)
        ratio = np.where(known, self.seen[1][at] if len(self.seen[1]) else 0.0, 0.0)
        rest = np.flatnonzero(~known)
        at, known = _at(self.after[0], context[rest])
        ratio[rest[known]] = self.after[1][at[known]]
        ratio[first == np.arange(len(first))] = 0.0
        return ratio

    def _long(self, word: bytes) -> float:
        s, k, total = _marked(word), self.order - 1, 0.0
        for at in range(0, len(s), TOGETHER):
            low = max(0, at - k)  # what stands before a part gives its letters their context
            part = self._letters(_points(s[low : at + TOGETHER]), np.zeros(min(at + TOGETHER, len(s)) - low, np.int64) - bool(low))
            total += float(part[at - low :].sum())
        return total

    def learn(self, new: list[bytes]) -> None:
        """Take the ratios of words, none of them long, into the cache."""
        for at in range(0, len(new), TOGETHER // STRETCH):
            part = new[at : at + TOGETHER // STRETCH]
            points = _points("".join(map(_marked, part)))
            starts = np.flatnonzero(points == np.uint64(ord(_START) + 1))
            ratio = self._letters(points, np.repeat(starts, np.diff(starts, append=len(points))))
            self.update(zip(part, np.add.reduceat(ratio, starts).tolist()))

    def know(self, texts: list[list[bytes]]) -> None:
        """Take the words of some texts into the cache that are not there yet."""
        every = set().union(*texts)
        new = [w for w in every if w not in self and len(w) <= STRETCH]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = [w for w in every if len(w) <= STRETCH]
        self.learn(new)

    def ratios(self, found: list[bytes]) -> np.ndarray:
        """The ratio of each word; those that are not long must be known."""
        v = list(map(self.get, found))
        if None in v:
            v = [self._long(w) if x is None else x for w, x in zip(found, v)]
        return np.array(v, dtype=np.float64)

    def table(self, texts: list[str | None]) -> np.ndarray:
        """A row of features for each text."""
        found = [words(t) for t in texts]
        out = np.zeros((len(texts), FEATURES))
        for at in range(0, len(found), KNOWN_TOGETHER):
            self.know(found[at : at + KNOWN_TOGETHER])
            for i, x in enumerate(found[at : at + KNOWN_TOGETHER], at):
                out[i] = self.features(x)
        return out

    def features(self, found: list[bytes]) -> list[float]:
        """The excess of ratios by the number of words and by its root, their mean, and the length; all 0 for a text without words."""
        if not found:
            return [0.0] * FEATURES
        n, v = len(found), self.ratios(found)
        excess = float(np.maximum(v - MARGIN, 0).sum())
        return [excess / n, excess / math.sqrt(n), float(v.mean()), math.log1p(n)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a logistic regression; the rate of the rows alone if they are of one class.

    No feature but the last, the length, gets a weight below 0: those that would are left out, the lowest first.
    """
    if not len(y):
        return np.zeros(FEATURES), np.ones(FEATURES), np.array([0.0] * FEATURES + [-4.0])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = math.log(rate / (1 - rate))
    free = list(range(len(w)))
    while 0 < y.sum() < len(y):
        v, rows, pull = w[free], z[:, free], ridge * np.array([i < len(w) - 1 for i in free])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(rows @ v, -30, 30)))
            step = np.linalg.solve((rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows + np.diag(pull + 1e-9), rows.T @ (y - p) - pull * v)
            v += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        below = [(x, i) for x, i in zip(v, free) if i < FEATURES - 1 and x < 0]
        if not below:
            w[free] = v
            break
        free.remove(min(below)[1])
    return mean, scale, w


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(labels: DataFrame, most: int) -> dict[int, int]:
    """The label of each learning row: those that are not held out, ``most`` by hash at most; of one id's labels the largest."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return {r.doc_id: r.toxic for r in rows.sort(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}


def _half(doc_id: int) -> int:
    return zlib.crc32(b"half" + str(doc_id).encode()) % 2


_COUNTS = "kind int, word string, n long"
#: The kind of row that tells of a word in any document; below it: twice the half and the label.
_SHARED = 4


def _rows(kind: int, counts: dict[bytes, int] | set[bytes], order: int) -> pa.RecordBatch:
    parts = [(x, counts[w] if isinstance(counts, dict) else 1) for w in counts for x in stretches(w, order)]
    columns = [pa.array(np.full(len(parts), kind, np.int32)), pa.array([x for x, _ in parts], pa.string()), pa.array([n for _, n in parts], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "word", "n"])


def _tell(order: int):
    """Words of all documents, each once a worker as far as it is kept."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in slices(batches):
            new: set[bytes] = set()
            for text in batch.column(0).to_pylist():
                new.update(words(text))
            new -= told
            if len(told) < CACHE_WORDS:  # a word that is told again is counted once later
                told |= {w for w in new if len(w) <= STRETCH}
            yield _rows(_SHARED, new, order)

    return tell


def _count(order: int):
    """Words of the sample by half and label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by: dict[int, Counter] = {}
            for doc_id, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                by.setdefault(2 * _half(doc_id) + label, Counter()).update(words(text))
            for kind, counted in by.items():
                yield _rows(kind, counted, order)

    return count


class Prepared:
    """Models that travel as tables and are built once in a worker that needs them."""

    def __init__(self, tables: list[tuple[pa.Table, pa.Table]], order: int):
        self.tables, self.order = tables, order

    def __getstate__(self) -> dict:
        return {"tables": self.tables, "order": self.order}

    def models(self) -> list[Model]:
        if "built" not in self.__dict__:
            self.built, self.tables = [Model(*t, self.order) for t in self.tables], []  # the tables have been copied
        return self.built


def _keyed(table: DataFrame, of: str) -> pa.Table:
    """All rows as (key, r), sorted by the key: the hash of column ``of``."""
    return table.select(of, "r").mapInArrow(_hashed, "key long, r double").toArrow().sort_by("key")


def sample_texts(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, label, text): the learning documents; of rows with one id the text with the smallest hash."""
    listed = docs.sparkSession.createDataFrame(list(_sample(labels, most).items()), "doc_id long, label int")  # ``most`` rows at most
    found = docs.select("doc_id", F.struct(F.xxhash64("text").alias("digest"), "text").alias("said")).join(F.broadcast(listed), "doc_id")
    found = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("said").alias("said"))
    return materialise(found.select("doc_id", "label", "said.text"), "sample")


def learn(docs: DataFrame, sample: DataFrame, order: int = ORDER) -> list[tuple[pa.Table, pa.Table]]:
    """Sequences and contexts of the models of both halves and of the whole, from (doc_id, label, text) of the sample."""
    rows = docs.select("text").mapInArrow(_tell(order), _COUNTS).unionByName(sample.mapInArrow(_count(order), _COUNTS))
    counted = materialise(rows.groupBy("kind", "word").agg(F.sum("n").alias("n")), "words")
    counts = materialise(sequence_rows(counted, order), "sequences")
    shared = shared_model(counts.where(F.col("kind") == _SHARED).select("s"), order)
    models = F.explode(F.array(F.floor(F.col("kind") / 2).cast("int"), F.lit(2)))
    toxic = F.col("kind") % 2 == 1
    by_class = counts.where(F.col("kind") < _SHARED).select(models.alias("model"), "kind", "s", "n").groupBy("model", "s").agg(
        F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("ordinary"), F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("toxic")
    )
    seen, after = (materialise(x, "ratios") for x in ratios(materialise(by_class, "classes"), shared))
    return [(_keyed(seen.where(F.col("model") == m), "s"), _keyed(after.where(F.col("model") == m), "h")) for m in range(3)]


def model(docs: DataFrame, labels: DataFrame, most: int = LABELLED, order: int = ORDER) -> tuple[tuple[pa.Table, pa.Table], tuple]:
    """The whole model's sequences and contexts, and the mapping from features to scores."""
    at = mark()
    sample = sample_texts(docs, labels, most)
    *halves, whole = learn(docs, sample, order)
    parts = docs.sparkSession.sparkContext.broadcast(Prepared(halves, order))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = parts.value.models()
        for batch in slices(batches):
            half = np.array([_half(i) for i in batch.column(0).to_pylist()], dtype=int)
            texts, x = batch.column(2).to_pylist(), np.zeros((batch.num_rows, FEATURES))
            for h in (0, 1):
                x[half == h] = models[1 - h].table([t for t, own in zip(texts, half) if own == h])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = sample.mapInArrow(describe, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")  # ``most`` rows at most
    release_since(docs.sparkSession, at)
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if rows.num_rows else np.zeros((0, FEATURES))
    return whole, fit(x, rows["y"].to_numpy().astype(np.float64))


def with_scores(docs: DataFrame, labels: DataFrame, column: str = "score", most: int = LABELLED, order: int = ORDER) -> DataFrame:
    """``docs`` with a column of scores behind the others, under a name that none of them has."""
    whole, (mean, scale, weights) = model(docs, labels, most, order)
    shared, names = docs.sparkSession.sparkContext.broadcast(Prepared([whole], order)), [*docs.columns, column]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.models()[0]
        for batch in slices(batches):
            x = of.table(batch.column("text").to_pylist())
            scores = 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / scale, np.ones(len(x))] @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)
        of.clear()  # a worker that waits holds no words

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Scores come from the text alone. Labels are learnt from rows of ``labels`` (doc_id, toxic)
    that are not held out. A null or empty text, or one without words, has the score of a text
    without any evidence. Without labels, or with labels of one class, all documents get one
    score per length, below the threshold unless most labels are 1. Rows repeated whole stay
    repeated. An empty table gives no rows; other columns are not read.
    """
    scored = with_scores(docs.select("doc_id", "text"), labels, most=most)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
