"""Cases and logs as tables: case ids, atomic writes by day, retention, originals and activity."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.functions.prose import reduction_pct


def case_id(created: Column, path: Column) -> Column:
    """Time of creation and the start of the path's hash."""
    return F.concat(F.date_format(created, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))


def cases(distilled: DataFrame, created: Column, *keys: str) -> DataFrame:
    """A row per distilled document (path, text, distilled): case id, sizes, reduction, the distilled text, and ``keys`` of the document, as paths may recur."""
    size = lambda c: F.octet_length(c).cast("long")
    rows = distilled.withColumns({"created_at": created, "bytes_in": size("text"), "bytes_out": size("distilled")})
    return rows.select(
        case_id(F.col("created_at"), F.col("path")).alias("case_id"), "path", "created_at", F.to_date("created_at").alias("day"), "bytes_in", "bytes_out",
        reduction_pct("bytes_in", "bytes_out").alias("reduction_pct"), "distilled", *keys,
    )


def summary(rows: DataFrame) -> Column:
    """A short Markdown note for each row of ``cases``; flags ``fallback``, ``low_value`` and ``incomparable`` add remarks where there are such columns."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
    number = F.format_string("%.2f", F.col("reduction_pct").cast("double"))
    plain = F.concat(F.lit("- reduction: "), number, F.lit("%\n"))
    binary = F.concat(F.lit("- reduction: "), number, F.lit("% **(not a token saving)** — the source is a binary\n  container, so its byte count is not comparable to extracted text.\n"))
    return F.concat(
        F.lit("# case "), "case_id", F.lit("\n\n- source: "), "path", F.lit("\n- captured: "), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\n- source size: "),
        F.col("bytes_in").cast("string"), F.lit(" bytes\n- compressed size: "), F.col("bytes_out").cast("string"), F.lit(" bytes\n"), F.when(flag("incomparable"), binary).otherwise(plain),
        F.when(flag("fallback"), "- **Note:** the pipeline was unavailable; the distilled text is the source.\n").otherwise(""),
        F.when(flag("low_value"), "- **Note:** the distilled text is a placeholder only.\n").otherwise(""),
    )


def write_cases(rows: DataFrame, path: str) -> None:
    """Append cases by day; Spark's committer leaves nothing of a failed write."""
    rows.write.mode("append").partitionBy("day").parquet(path)


def kept(rows: DataFrame, now: Column, age: str, at: str = "created_at") -> DataFrame:
    """Rows younger than ``age``, an interval; a filter on the partition column reaches the scan."""
    return rows.where(F.col(at) > now - F.expr(f"interval {age}"))


def write_activity(rows: DataFrame, path: str) -> None:
    """Append activity records (t, component, level, msg, …) as JSON by component and day."""
    rows.withColumn("day", F.to_date("t")).write.mode("append").partitionBy("component", "day").json(path)


def sweep_activity(spark: SparkSession, path: str, component: str, today: str, days: int) -> list[str]:
    """Delete a component's days that lie more than ``days`` before ``today``, and name them; other folders, files and components stay."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/component={component}")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    first = date.fromisoformat(today) - timedelta(days)
    gone = []
    for status in files.listStatus(root) if files.exists(root) else ():
        name = status.getPath().getName()
        try:
            day = date.fromisoformat(name.removeprefix("day="))
        except ValueError:
            continue
        if status.isDirectory() and name.startswith("day=") and day < first:
            files.delete(status.getPath(), True)
            gone.append(day.isoformat())
    return sorted(gone)


def keep_originals(rows: DataFrame, path: str, text: str = "text") -> None:
    """Append originals once each, keyed by hash."""
    spark: SparkSession = rows.sparkSession
    new = rows.select(F.sha2(text, 256).alias("sha256"), F.col(text).alias("original")).dropDuplicates(["sha256"])
    try:
        known = spark.read.parquet(path).select("sha256")
    except Exception as e:  # the table is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    (new if known is None else new.join(known, "sha256", "left_anti")).write.mode("append").parquet(path)
