"""Streams against the same operators in batch."""

from pyspark.sql import functions as F

from loomsift.streaming import logs


def test_hourly_stream_equals_batch(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "in/e"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/e"))
    logs.hourly(stream, ["event_type"]).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = logs.hourly(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"])
    got = sorted(map(tuple, spark.table("hourly").collect()))
    assert got == sorted(map(tuple, batch.collect())) and got


def test_first_seen_tells_once(spark, tmp_path):
    told = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00"), ("c", None)]
    later = [("a", "2024-01-01 00:03:00"), ("d", "2024-01-20 00:00:00")]
    again = [("a", "2024-01-20 00:01:00"), ("d", "2024-01-20 00:02:00")]
    for n, batch in enumerate((told, later, again)):
        rows = spark.createDataFrame(batch, "sig string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        out = logs.first_seen(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at"))
        q = out.outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120), f"run {n} does not end"
    # a was forgotten after 19 days without a record, and is told again
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("sig", "cast(ts as string) ts").collect()
    assert sorted(map(tuple, got), key=repr) == [("a", "2024-01-01 00:00:00"), ("a", "2024-01-20 00:01:00"), ("b", "2024-01-01 00:02:00"), ("c", None), ("d", "2024-01-20 00:00:00")]


def test_distil_stream(spark, tmp_path):
    text = "On branch a\n" + '  (use "git add")\n' * 200
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    logs.distil_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert r.processor == "git-filter" and r.distilled == "On branch a\n"


def test_once_and_sessions_in_batch(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert logs.once(e.union(e), ["event_id"]).count() == e.count()
    assert logs.sessions(e).agg(F.sum("n")).first()[0] == e.count()
