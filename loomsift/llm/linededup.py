"""Line deduplication by a log-template tree of fixed depth, in DataFrame functions only.

A line is masked first: a token with a digit or an ``@`` becomes ``<*>``. Its path in the tree is
its number of tokens, then its leading token; in the leaf it belongs to several templates:

* the masked line itself, which generalises numbers, addresses, dates and keys;
* where it has BANDS tokens or more, the line with FREE of its BANDS stretches of tokens left open,
  in every choice that keeps the first. Lines of a leaf that agree in all other tokens share such a
  template, so words that vary without a digit are generalised too, wherever they stand.

A masked line recurs if two documents hold it; a short one, which is no evidence by itself, if
SHORT_DOCUMENTS do. A template with open stretches recurs if VARIANTS different masked lines in
more than one document share it. Lines of a recurring template stay in the first document that has
one, and are dropped from every later document.

Work is kept small where nothing recurs: two open stretches leave two quarters of a line whole at
least, so lines of which not two quarters are shared by VARIANTS lines of the leaf take no part.
Shuffles carry hashes, counted with map-side combine, of distinct lines where that will do; the text moves
once, to meet the numbers of its dropped lines. A hash that very many lines share is a hot key
of a join between two plain exchanges, which adaptive execution splits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.scratch import mark, materialise, release_since

#: Stretches of a line, and how many of them a template may leave open.
BANDS = 8
FREE = 2
#: Different masked lines that make a template with open stretches.
VARIANTS = 3
#: Tokens of such a template that are neither open nor variable, at least.
LEAST_CONSTANT = 5
#: Masked lines of fewer tokens and fewer code points are short.
SHORT_TOKENS = 5
SHORT_CHARS = 32
#: Documents in which a short line recurs.
SHORT_DOCUMENTS = 10

_BLANK = " \t\x0b\f\r"
#: Without these a text's lines are parted by single spaces only.
_UNEVEN = ("\t", "\x0b", "\f", "\r", "  ", " \n", "\n ")
_SPACE = r"[ \t\x0B\f\r]+"
#: A token with a digit or an at sign, read once from its start.
_VARIABLE = r"(?<![^ ])[^ 0-9@]*+[0-9@][^ ]*+"
_NO_ID = -(1 << 63)
_KEY = ["leaf", "salted"]


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(_NO_ID).cast("long"))


def _bands() -> Column:
    """Hashes of the stretches of ``tokens``, each of ``n * (k + 1) / BANDS - n * k / BANDS`` tokens."""
    edge = lambda k: F.floor(F.col("n") * k / BANDS).cast("int")
    return F.array(*[F.xxhash64("n", F.lit(k), F.slice("tokens", edge(k) + 1, edge(k + 1) - edge(k))) for k in range(BANDS)])


def masked_lines(docs: DataFrame) -> DataFrame:
    """(id, digest, line_no, leaf, salted, kind, n, wild, bands): the lines that can recur.

    digest names the text, so that (id, digest) finds its row again; leaf and salted are two
    independent hashes of the masked line, 128 bits together; kind tells short lines ('s'), others
    ('l') and those long enough for open stretches ('o'), of which bands has the hashes. Blank
    lines, lines of variable fields only, and short lines without a letter are left out.
    """
    text = F.coalesce("text", F.lit(""))
    uneven = text.startswith(" ") | text.endswith(" ")
    for sign in _UNEVEN:
        uneven = uneven | text.contains(sign)
    parts = F.split(text, "\n")
    even = F.when(uneven, F.transform(parts, lambda x: F.regexp_replace(F.btrim(x, F.lit(_BLANK)), _SPACE, " "))).otherwise(parts)
    masked = F.transform(even, lambda x: F.when(x.rlike("[0-9@]"), F.regexp_replace(x, _VARIABLE, "<*>")).otherwise(x))
    # masked before they are rows: filters on rows don't repeat the patterns
    lines = docs.select(_id().alias("id"), F.xxhash64(text).alias("digest"), F.posexplode(masked).alias("line_no", "line"))
    lines = lines.where(F.replace(F.replace("line", F.lit("<*>"), F.lit("")), F.lit(" "), F.lit("")) != "")
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    wild = F.floor((F.octet_length("line") - F.octet_length(F.replace("line", F.lit("<*>"), F.lit("")))) / 3)
    lines = lines.select("id", "digest", "line_no", "line", (spaces + 1).alias("n"), wild.cast("int").alias("wild"))
    short = (F.col("n") < SHORT_TOKENS) & (F.char_length("line") < SHORT_CHARS)
    lines = lines.where(~short | F.col("line").rlike(r"\p{L}"))
    kind = F.when(short, "s").when(F.col("n") < BANDS, "l").otherwise("o")
    tokens = F.when(F.col("n") >= BANDS, F.split("line", " "))
    lines = lines.select("id", "digest", "line_no", "n", "wild", kind.alias("kind"), F.xxhash64("line").alias("leaf"), F.xxhash64(F.lit("salt"), "line").alias("salted"), tokens.alias("tokens"))
    return lines.select("id", "digest", "line_no", *_KEY, "kind", "n", "wild", F.when(F.col("n") >= BANDS, _bands()).alias("bands"))


def open_templates(distinct: DataFrame) -> DataFrame:
    """(leaf, salted, first): distinct lines of recurring templates with open stretches, and the first document that has one."""
    band = lambda k: F.get("bands", F.lit(k))
    long = distinct.where("kind = 'o'")
    step = BANDS // (2 * FREE)
    quarters = long.select(*_KEY, F.explode(F.array(*[F.xxhash64(*[band(k) for k in range(at, at + step)]) for at in range(0, BANDS, step)])).alias("quarter"))
    shared = materialise(quarters.groupBy("quarter").count().where(F.col("count") >= VARIANTS).select("quarter"), "quarters")
    passing = quarters.join(shared, "quarter").groupBy(*_KEY).count().where(F.col("count") >= FREE).select(*_KEY)
    passing = materialise(passing, "passing")
    keys = []
    for free in combinations(range(1, BANDS), FREE):
        size = sum((F.floor(F.col("n") * (k + 1) / BANDS) - F.floor(F.col("n") * k / BANDS) for k in free), F.lit(0))
        kept = [F.lit("".join(map(str, free))), *[band(k) for k in range(BANDS) if k not in free]]
        said = F.struct(F.xxhash64(*kept).alias("key"), F.xxhash64(F.lit("salt"), *kept).alias("other"))
        keys.append(F.when(F.col("n") - size - F.col("wild") >= LEAST_CONSTANT, said))
    keyed = long.join(passing, _KEY).select(*_KEY, "first", "last", F.explode(F.array_compact(F.array(*keys))).alias("t")).select(*_KEY, "first", "last", "t.key", "t.other")
    keyed = materialise(keyed, "keyed")
    templates = keyed.groupBy("key", "other").agg(F.count("*").alias("variants"), F.min("first").alias("first"), F.max("last").alias("last"))
    templates = materialise(templates.where((F.col("variants") >= VARIANTS) & (F.col("first") < F.col("last"))).select("key", "other", "first"), "templates")
    return keyed.drop("first").join(templates, ["key", "other"]).select(*_KEY, "first")


def firsts(lines: DataFrame) -> DataFrame:
    """(leaf, salted, first): the lines of all recurring templates, and the first document (id, digest) that has a line of one."""
    place = F.struct("id", "digest")
    distinct = lines.where("kind <> 's'").groupBy(*_KEY).agg(
        F.min(place).alias("first"), F.max(place).alias("last"), *[F.first(c).alias(c) for c in ("kind", "n", "wild", "bands")]
    )
    distinct = materialise(distinct, "distinct")
    exact = distinct.where(F.col("first") < F.col("last")).select(*_KEY, "first")
    short = lines.where("kind = 's'").select(*_KEY, "id", "digest").distinct().groupBy(*_KEY).agg(F.count("*").alias("documents"), F.min(place).alias("first"))
    short = short.where(F.col("documents") >= SHORT_DOCUMENTS).select(*_KEY, "first")
    return exact.unionByName(short).unionByName(open_templates(distinct)).groupBy(*_KEY).agg(F.min("first").alias("first"))


def drop_recurring(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text, n_lines, n_dropped.

    Lines are parts of the text between line feeds. Documents are ordered by doc_id, null ids first;
    of rows with one doc_id or none, those with different texts are documents of their own,
    ordered by a hash of the text, and rows repeated whole are one document, which stays
    repeated. Lines of a recurring template go from all documents behind the first that has one;
    the rest of a text stays as it is. A null or empty text has one empty line, which stays: its
    text is empty. An empty table gives no rows; other columns are not read.
    """
    at = mark()
    lines = materialise(masked_lines(docs), "lines")
    first = materialise(firsts(lines), "firsts")
    dropped = lines.select("id", "digest", "line_no", *_KEY).join(first, _KEY).where(F.struct("id", "digest") > F.col("first"))
    dropped = dropped.groupBy("id", "digest").agg(F.collect_set("line_no").alias("gone"))
    dropped = materialise(dropped, "dropped")
    release_since(docs.sparkSession, at, dropped)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), _id().alias("id"), F.xxhash64(text).alias("digest"))
    rows = rows.join(dropped, ["id", "digest"], "left").withColumn("parts", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n")
    return rows.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.size("parts").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
