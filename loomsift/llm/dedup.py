"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed size. Equal blocks get one integer name: copies become one
before they are shuffled, the distinct blocks are dealt by a hash into buckets, sorted inside the bucket
by that hash and, where two share it, by their whole content, and numbered; so names depend
on content alone and two different blocks never share one. Then adjacent names are paired and the
pairs named in the same way, level by level, until one name stands for a document. Texts with
as many blocks pass the same levels, so (number of blocks, name) is one identity per text
without collisions.

A block's occurrences learn its name by the hash, without the text: every distinct block meets
its hash's name once, however many documents share it, and the join is between two plain
exchanges, which adaptive execution splits. Hashes that two different blocks share are found when the
blocks are named; their occurrences, and theirs alone, are joined by the whole block. The text is
shuffled once, a distinct block a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsift.scratch import mark, materialise, release_since

#: Code points in a block.
BLOCK_CHARS = 4096
#: Buckets in which distinct blocks or pairs are sorted; a name is a bucket and a rank in it.
BUCKETS = 1 << 20


def _hash(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """``distinct`` with an integer name per row, from a sort by the columns ``by`` inside buckets."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*by))
    rows = distinct.withColumn("bucket", F.pmod(_hash(*by), F.lit(BUCKETS)))
    return rows.withColumn("name", F.col("bucket") * F.lit(1 << 32) + rank).drop("bucket")


def _cut(docs: DataFrame, *keep: str) -> DataFrame:
    """The blocks of each text in one linear pass: the columns ``keep``, at, n_blocks, block and its hash h."""
    pieces = F.when(F.length("text") <= BLOCK_CHARS, F.array("text")).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))
    )
    cut = docs.select(*keep, pieces.alias("pieces")).select(*keep, F.size("pieces").alias("n_blocks"), F.posexplode("pieces").alias("at", "block"))
    return cut.withColumn("h", _hash("block"))


def _first_names(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_id, doc_id, sha, n_blocks, at, name): the blocks of ``rows`` under their names; sha with the first block only."""
    sets = _cut(texts).groupBy("h").agg(F.array_sort(F.collect_set("block")).alias("blocks"))  # one block, but for collisions
    distinct = materialise(sets.select("h", F.explode(F.sequence(F.lit(0), F.size("blocks") - 1)).alias("r")), "distinct")
    names = materialise(_named(distinct, ["h", "r"]), "names")
    shared = materialise(names.where("r > 0").select("h").distinct(), "shared")
    keep = ("row_id", "doc_id", "sha", "n_blocks", "at", "name")
    found = _cut(rows, "row_id", "doc_id", "sha").withColumn("sha", F.when(F.col("at") == 0, F.col("sha")))
    if shared.isEmpty():
        return found.drop("block").join(names, "h").select(*keep)
    alone = found.join(shared, "h", "left_anti").drop("block").join(names, "h").select(*keep)
    blocks = sets.join(shared, "h", "left_semi").select("h", F.posexplode("blocks").alias("r", "block")).join(names, ["h", "r"])
    return alone.unionByName(found.join(shared, "h", "left_semi").join(blocks, ["h", "block"]).select(*keep))


def identities(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, sha, n_blocks, name): one row per row of ``docs``; equal (n_blocks, name) means equal texts."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.sha2("text", 256).alias("sha"), "text")
    nodes = materialise(_first_names(texts, rows), "blocks")

    heads = nodes.where("at = 0").select("row_id", "doc_id", "sha", "n_blocks")
    done = nodes.where("n_blocks = 1").select("row_id", "name")
    level = nodes.where("n_blocks > 1").select("row_id", "at", F.col("n_blocks").alias("nodes"), "name")
    left = level.agg(F.max("nodes")).first()[0] or 1
    while left > 1:
        slot = F.floor(F.col("at") / 2).cast("int")
        pairs = level.groupBy("row_id", slot.alias("at"), F.ceil(F.col("nodes") / 2).cast("int").alias("nodes")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"), F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("right")
        )
        pairs = materialise(pairs.withColumn("right", F.coalesce("right", F.lit(-(1 << 62)))), "pairs")
        names = materialise(_named(pairs.select("left", "right").distinct(), ["left", "right"]), "names")
        level = materialise(pairs.join(names, ["left", "right"]).select("row_id", "at", "nodes", "name"), "level")
        done = done.unionByName(level.where("nodes = 1").select("row_id", "name"))
        level, left = level.where("nodes > 1"), (left + 1) // 2
    return heads.join(done, "row_id")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; null counts as empty. Of equal texts the
    row with the largest doc_id stays (null ids last); of rows repeated whole one stays.
    An empty table gives no rows; other columns of ``docs`` are not read.
    """
    at = mark()
    rows = materialise(identities(docs), "identities")
    release_since(docs.sparkSession, at, rows)
    groups = rows.groupBy("n_blocks", "name").agg(
        F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("id"), "row_id", "doc_id")).alias("keep"), F.count("*").alias("group_size")
    )
    groups = materialise(groups, "groups")  # so that the join is between two plain exchanges, of which a hot one is split
    return rows.join(groups, ["n_blocks", "name"]).select(
        rows.doc_id, F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.row_id") == rows.row_id).alias("kept"), F.col("sha").alias("text_sha256")
    )
