"""The training-data pipeline: stages over documents, each reread from Parquet by the next.

All stages but the last return the columns of documents, whatever others there are and however
they are named. A row of documents is found again by its doc_id and a hash of its text; of rows
that are alike in both, one at most stays. A stage of an empty table gives an empty table;
null and empty texts are documents like others, without toxic words or secrets, equal
to each other, and of one end token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsift.llm import dedup, packing, queries, secrets, simhash, toxicity
from loomsift.llm.frames import free
from loomsift.scratch import mark, materialise, release_since

_NO_ID = -(1 << 63)


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(_NO_ID).cast("long"))


def _only(docs: DataFrame, keep: DataFrame, sign: Column) -> DataFrame:
    """The rows of ``docs`` whose id and ``sign`` are in ``keep`` (id, sign): one each. The text moves once, by both."""
    key, word, row = (free(x, docs.columns) for x in ("key", "sign", "row"))
    one = F.row_number().over(Window.partitionBy(key, word).orderBy(F.lit(0)))
    # copies of a row go before the rows are shuffled; the join finds them dealt out by its own keys
    alone = docs.withColumn(key, _id()).withColumn(word, sign).withColumn(row, one).where(F.col(row) == 1)
    found = alone.join(keep.select(F.col("id").alias(key), F.col("sign").alias(word)), [key, word], "left_semi")
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    score = free("score", docs.columns)
    scored = toxicity.with_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    keep = dedup.exact_duplicates(docs).where("kept").select(_id().alias("id"), F.col("text_sha256").alias("sign"))
    return _only(docs, keep, F.sha2(F.coalesce("text", F.lit("")), 256))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id."""
    rows = materialise(simhash.near_components(docs), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fingerprint", "digest")).alias("first")
    # by root, as a component without any doc_id has no component_id
    keep = rows.groupBy("root").agg(first).select("first.*").select(_id().alias("id"), F.col("digest").alias("sign"))
    return _only(docs, keep, simhash.digest())


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts covered."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in training sequences."""
    return packing.packed(docs, queries.word_vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", exact_dedup),
    ("simhash", near_dedup),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: Learnt scores can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written on the way goes once its result is written."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        release_since(spark, at, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
