"""Sources: whole files, NDJSON lines, test events and HTTP archives as DataFrames."""

from __future__ import annotations

import subprocess
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.operators.distillers import DEADLINE
from loomsift.operators.routing import Descriptor, Registry

MOST_BYTES = 64 << 20
GO_EVENT = "Time string, Action string, Package string, Test string, Output string"
_NV = "array<struct<name: string, value: string>>"
HAR = (
    "log struct<version: string, entries: array<struct<time: double, "
    f"request: struct<method: string, url: string, headers: {_NV}, postData: struct<mimeType: string, text: string, params: {_NV}>>, "
    "response: struct<status: int, content: struct<size: bigint, mimeType: string, text: string>>>>>"
)


def texts(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, raw, truncated): a row per file; files over ``most_bytes`` are cut there and flagged."""
    files = binaries(spark, path)
    return files.select("path", F.substring("raw_bin", 1, most_bytes).cast("string").alias("raw"), (F.col("length") > most_bytes).alias("truncated"))


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, raw_bin): a row per file, of any kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.col("content").alias("raw_bin"))


def go_events(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, action, package, test, output) of documents whose every line is a test event."""
    lines = docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("ord", "line")).where(F.trim("line") != "")
    parsed = lines.withColumn("e", F.from_json("line", GO_EVENT))
    whole = parsed.groupBy(key).agg(F.bool_and(F.coalesce(F.col("e.Action") != "", F.lit(False))).alias("ok")).where("ok").select(key)
    return parsed.join(whole, key).select(key, "ord", F.col("e.Action").alias("action"), F.col("e.Package").alias("package"), F.col("e.Test").alias("test"), F.col("e.Output").alias("output"))


def har_entries(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, method, status, url, mime, size, ms) of HTTP archives; other documents give no rows."""
    gate = docs.where(F.ltrim(text).startswith("{") & F.col(text).contains('"entries"'))
    entries = gate.select(key, F.posexplode(F.from_json(text, HAR)["log"]["entries"]).alias("ord", "e"))
    mime = F.trim(F.split(F.coalesce(F.col("e.response.content.mimeType"), F.lit("")), ";")[0])
    return entries.select(
        key, "ord", F.upper("e.request.method").alias("method"), F.col("e.response.status").alias("status"), F.col("e.request.url").alias("url"),
        mime.alias("mime"), F.col("e.response.content.size").alias("size"), F.floor(F.col("e.time") + 0.5).cast("int").alias("ms"),
    )


#: Bytes of a script, which travels as an argument of its interpreter.
MOST_SCRIPT = 100_000


def script(place: Path, seconds: float = DEADLINE) -> Callable[[str], str]:
    """A script processor's function: text in, text out, in a process of its own that may take so many seconds.

    The script is taken as it is when it is loaded, and travels to the executors with the function;
    what happens to its file later changes nothing. An exit code other than 0 is an error.
    """
    import yaml

    entry = place / yaml.safe_load((place / "processor.yaml").read_text())["entry"]
    command = {".py": ["python3", "-c"], ".sh": ["bash", "-c"]}.get(entry.suffix.lower())
    code = entry.read_text()
    if command is None or len(code.encode()) > MOST_SCRIPT:
        raise ValueError(f"{entry.name}: not a Python or shell script of {MOST_SCRIPT} bytes at most")

    def run(text: str) -> str:
        done = subprocess.run([*command, code], input=text.encode(), capture_output=True, timeout=seconds)
        if done.returncode:
            raise RuntimeError(f"{entry.name}: exit {done.returncode}: {done.stderr[-500:].decode('utf-8', 'replace')}")
        return done.stdout.decode()

    return run


def processors(folder: str, load: Callable[[Path], Callable[[str], str]] | None = None, builtin: bool = False) -> tuple[list[Descriptor], list[str]]:
    """Descriptors of a folder of processors, and the names of those that are broken and left out.

    A sub-folder holds ``processor.yaml``, or ``processor.md`` with the same keys between ``---``
    lines. ``load``, such as ``script``, turns a script's folder into its function; without it
    scripts do nothing.
    """
    import yaml

    known = {"name", "type", "entry", "match", "commands", "command_prefixes", "description", "route_hint", "routable", "temperature", "max_tokens", "top_p", "top_k"}
    good, broken = [], []
    for place in sorted(p for p in Path(folder).iterdir() if p.is_dir()):
        try:
            script, prompt = place / "processor.yaml", place / "processor.md"
            text = script.read_text() if script.exists() else prompt.read_text().split("---")[1]
            keys = yaml.safe_load(text)
            if not isinstance(keys, dict) or set(keys) - known:
                raise ValueError("unknown keys")
            kind = keys.get("type", "script" if script.exists() else "prompt")
            good.append(
                Descriptor(
                    keys.get("name", place.name), kind, keys.get("match", ""), tuple(keys.get("commands") or ()), tuple(keys.get("command_prefixes") or ()),
                    keys.get("routable"), builtin, load(place) if load and kind == "script" else None,
                )
            )
        except (OSError, ValueError, IndexError, KeyError, yaml.YAMLError):
            broken.append(place.name)
    return good, broken


def registry(*folders: str, load: Callable[[Path], Callable[[str], str]] | None = None) -> Registry:
    """The built-in processors and those of the user's folders."""
    out = Registry()
    for folder in folders:
        for d in processors(folder, load)[0]:
            out.add(d)
    return out
