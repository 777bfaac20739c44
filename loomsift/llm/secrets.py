"""Secret scans over a ledger of blobs.

Every text version is addressed by its SHA-256. The ledger holds which (blob, rule version)
pairs have been scanned and what was found; a scan reads only blobs that are not in it under a
rule version, each once however many rows (paths) hold it, and findings are joined back to all
paths. Copies of a blob are combined before they are shuffled, so that each task sends it once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.llm.frames import free, slices
from loomsift.scratch import materialise

# The base rules' patterns and least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_HINT = re.compile(rb"passw|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
# Formats of credentials that the method adds to the base.
_MORE = {
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+(?:-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----)?"),
    "forge": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", re.ASCII),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}", re.ASCII),
    # from the start of a run, so that a long run is read once
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", re.ASCII),
}
_MORE_HINTS = {"pem": ("-----BEGIN",), "forge": ("gh", "glpat-"), "chat": ("xox",), "jwt": ("eyJ",)}
#: Kinds by rule version; a later version holds new rules only, so that old blobs are scanned for those alone.
RULES: dict[int, tuple[str, ...]] = {1: ("assign", "access", "hex"), 2: tuple(_MORE)}
KINDS = tuple(kind for version in sorted(RULES) for kind in RULES[version])
BASE = RULES[1]

_SPANS = "array<struct<start: int, end: int, kind: string>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def find(text: str, versions: tuple[int, ...] = tuple(RULES)) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind as listed in KINDS.

    Matches are leftmost and do not overlap within a kind. A value assigned that is too short
    is dropped after matching, so it still takes its place.
    """
    spans: list[tuple[int, int, str]] = []
    if 1 in versions:
        if _ASSIGN_HINT.search(text.encode("utf-8", "surrogatepass").lower()):
            spans += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
        if "AKIA" in text:
            spans += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
        spans += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    if 2 in versions:
        for kind, pattern in _MORE.items():
            if any(hint in text for hint in _MORE_HINTS[kind]):
                spans += [(*m.span(), kind) for m in pattern.finditer(text)]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [
            [{"start": s, "end": e, "kind": k} for s, e, k in find(text, tuple(versions))]
            for text, versions in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, _SPAN_TYPE)], names=["blob", "versions", "spans"])


def _blob() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def pending(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(blob, text, versions): a row per distinct text of ``docs`` with the rule versions that ``ledger`` has not scanned it under."""
    every = F.array(*[F.lit(v) for v in sorted(RULES)])
    blobs = docs.select(_blob().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return blobs.withColumn("versions", every)
    done = ledger.groupBy("blob").agg(F.collect_set("version").alias("done"))  # a rule version each
    left = F.when(F.col("done").isNull(), every).otherwise(F.array_except(every, "done"))
    return blobs.join(done, "blob", "left").select("blob", "text", left.alias("versions")).where(F.size("versions") > 0)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger rows (blob, version, spans) that ``docs`` adds: one per blob and rule version not in ``ledger`` yet."""
    scanned = pending(docs, ledger).mapInArrow(_scan, f"blob string, versions array<int>, spans {_SPANS}")
    rows = scanned.select("blob", "spans", F.explode("versions").alias("version"))
    kinds = F.create_map(*[x for v, ks in RULES.items() for x in (F.lit(v), F.array(*[F.lit(k) for k in ks]))])
    return rows.select("blob", "version", F.filter("spans", lambda x: F.array_contains(kinds[F.col("version")], x["kind"])).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings (doc_id, blob, spans) for every row of ``docs``, and the ledger with what this scan adds.

    Spans are those of all rule versions, ordered as by ``find``; null without any. Write the
    ledger down and hand it to the next scan, which then reads new blobs and new rules only.
    """
    whole = materialise(update_ledger(docs, ledger), "ledger")
    if ledger is not None:
        whole = whole.unionByName(ledger.select("blob", "version", "spans"))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    found = whole.where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    keyed = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    found = found.select("blob", F.sort_array(keyed).alias("spans"))
    found = materialise(found, "found")  # so that the join is between two plain exchanges, of which a hot one is split
    return docs.select("doc_id", _blob().alias("blob")).join(found, "blob", "left").select("doc_id", "blob", "spans"), whole


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text counts as empty; a text without findings has counts 0, the SHA-256 of the empty
    string and empty spans. Rows repeated whole stay repeated. An empty table gives no rows;
    other columns of ``docs`` are not read.
    """
    spans = F.coalesce("spans", F.array().cast("array<struct<start: int, rank: int, end: int, kind: string>>"))
    found = scan(docs, ledger)[0].select("doc_id", spans.alias("spans"))
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` and n_chars, where there is such a column, counted anew.

    Spans that overlap are replaced by one mark. Rows without findings, null texts among them,
    stay as they are; columns and rows are those of ``docs``.
    """
    new = materialise(update_ledger(docs), "ledger").where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    blob, spans = free("blob", docs.columns), free("spans", docs.columns)
    new = materialise(new.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), "found")
    found = docs.withColumn(blob, _blob()).join(new, blob, "left")
    schema = docs.schema

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, said in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist()):
                if said:
                    parts, at = [], 0
                    for s, e in sorted((x["start"], x["end"]) for x in said):
                        if s >= at:
                            parts += [text[at:s], mark]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if name == "text" else batch.column(name) for name in schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = found.select(*[F.col(f"`{x}`") for x in docs.columns], spans).mapInArrow(cover, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
