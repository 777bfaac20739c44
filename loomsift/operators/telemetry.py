"""Roll-ups of invocations: counts, bytes, savings, ratios, durations and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomsift.functions.text import estimate_tokens

# Reasons of fallbacks by class of error.
REASONS = {"TimeoutError": "timeout", "ConnectionError": "backend_unreachable", "ScriptError": "script_error", "RouterError": "router_error", "EmptyOutput": "empty_output"}


def processor_label(name: Column, builtin: Column) -> Column:
    """Names that users gave are not told."""
    return F.when(builtin, name).otherwise("custom")


def fail_reason(error: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[error], F.lit("other"))


def saved(bytes_in: Column, bytes_out: Column, outcome: Column) -> Column:
    return F.when((outcome == "compressed") & (bytes_in > 0), F.greatest(bytes_in - bytes_out, F.lit(0))).otherwise(0)


def invocations(facts: DataFrame) -> DataFrame:
    """Counts by path, outcome and tool, and over each and all of them."""
    return facts.cube("path", "outcome", "tool").agg(F.count("*").alias("n"))


def processed_bytes(facts: DataFrame) -> DataFrame:
    """(direction, processor, kind, bytes) and savings, by grouping sets over one pass."""
    each = facts.select("processor", "kind", F.explode(F.create_map(
        F.lit("in"), F.col("bytes_in"), F.lit("out"), F.col("bytes_out"), F.lit("saved"), saved(F.col("bytes_in"), F.col("bytes_out"), F.col("outcome")).cast("long"),
    )).alias("direction", "bytes"))
    return each.groupingSets([["direction", "processor", "kind"], ["direction", "processor"], ["direction"]], "direction", "processor", "kind").agg(F.sum("bytes").alias("bytes"))


def ratios(facts: DataFrame) -> DataFrame:
    """Distribution of bytes out over bytes in by processor; without input there is no ratio."""
    r = F.when(F.col("bytes_in") > 0, F.col("bytes_out") / F.col("bytes_in"))
    return facts.groupBy("processor").agg(F.count(r).alias("n"), F.round(F.avg(r), 6).alias("mean_ratio"), F.round(F.min(r), 6).alias("min_ratio"), F.round(F.max(r), 6).alias("max_ratio"))


def durations(facts: DataFrame) -> DataFrame:
    """Exact percentiles of durations by processor and kind: the least duration that so many percent don't exceed. Equal durations are counted before they are ordered."""
    held = facts.groupBy("processor", "kind", "duration_ms").agg(F.count("*").alias("n"), F.count("duration_ms").alias("known"))
    by = Window.partitionBy("processor", "kind")
    ranked = held.withColumns({"reached": F.sum("known").over(by.orderBy("duration_ms")), "all": F.sum("known").over(by)})
    least = lambda percent: F.min(F.when(F.col("reached") * 100 >= F.col("all") * percent, F.col("duration_ms")))
    return ranked.groupBy("processor", "kind").agg(F.sum("n").alias("n"), least(50).alias("p50_ms"), least(95).alias("p95_ms"), F.max("duration_ms").alias("max_ms"))


def fallbacks(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("fallback") != "").groupBy("fallback").agg(F.count("*").alias("n"))


def savings(distilled: DataFrame, by: str = "processor", text: str = "text", out: str = "distilled") -> DataFrame:
    """Bytes and estimated tokens in and out by group, and what share is saved."""
    size = lambda c: F.octet_length(c).cast("long")
    sums = distilled.groupBy(by).agg(
        F.count("*").alias("docs"), F.sum(size(text)).alias("bytes_in"), F.sum(size(out)).alias("bytes_out"),
        F.sum(estimate_tokens(text)).alias("tokens_in"), F.sum(estimate_tokens(out)).alias("tokens_out"),
    )
    pct = lambda a, b: F.when(F.col(a) > 0, F.round(100 * (1 - F.col(b) / F.col(a)), 2)).otherwise(0.0)
    return sums.withColumn("bytes_saved_pct", pct("bytes_in", "bytes_out")).withColumn("tokens_saved_pct", pct("tokens_in", "tokens_out"))


def observed(distilled: DataFrame, observation: Observation) -> DataFrame:
    """``distilled`` with its totals told to ``observation`` by whatever action runs it, without a pass of its own. A global sort above it would read it twice."""
    compressed = F.count_if(F.col("outcome") == "compressed")
    return distilled.observe(observation, F.count("*").alias("docs"), compressed.alias("compressed"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))
