from pyspark.sql import functions as F

from siltworks.streaming import progress

SCHEMA = "scan_id string, seq long, ts timestamp, status string"


def stream(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def rows_of(spark, data):
    from datetime import datetime

    return [(s, q, datetime.fromisoformat(f"2024-01-01T00:00:{t:06.3f}"), st) for s, q, t, st in data]


def test_distinct_stream(spark, tmp_path):
    rows = rows_of(spark, [("a", 1, 0, "x"), ("a", 1, 1, "x"), ("b", 1, 2, "x")])
    q = progress.distinct_stream(stream(spark, tmp_path, rows), ["scan_id", "seq"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_budget_stream_equals_its_batch_twin(spark, tmp_path):
    rows = rows_of(spark, [("a", k, k % 60, "x") for k in range(40)])
    live = stream(spark, tmp_path, rows)
    q = progress.daily_budget(live, by="scan_id").writeStream.outputMode("complete").format("memory").queryName("used").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    batch = progress.daily_budget(spark.read.parquet(str(tmp_path / "in")), by="scan_id")
    assert sorted(map(tuple, spark.table("used").collect())) == sorted(map(tuple, batch.collect())) == [("a", "2024-01-01", 40)]


def test_throttled_stream_passes_first_and_terminal(spark, tmp_path):
    rows = rows_of(spark, [("a", 1, 0, "running"), ("a", 2, 0.1, "running"), ("a", 3, 0.2, "completed"), ("a", 4, 0.9, "running"), ("b", 1, 0, "running")])
    q = progress.throttled_stream(stream(spark, tmp_path, rows)).writeStream.outputMode("append").format("memory").queryName("thin").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert {("a", 1), ("a", 3), ("a", 4), ("b", 1)} <= {(r.scan_id, r.seq) for r in spark.table("thin").collect()}
    assert ("a", 2) not in {(r.scan_id, r.seq) for r in spark.table("thin").collect()}


def test_gated_pacing_skips_what_would_wait_too_long(spark):
    rows = spark.createDataFrame([("s", k, 1000) for k in range(6)], "scope string, event_id long, ms long")
    waits = [r.wait for r in progress.gated(rows, 100, 250).orderBy("event_id").collect()]
    assert waits == [0, 100, 200, 300, 300, 300]
    assert [r.slot for r in progress.paced(rows, 100).orderBy("event_id").collect()] == [1000, 1100, 1200, 1300, 1400, 1500]


def test_paced_slots_beyond_an_int(spark):
    rows = spark.range(5).select(F.lit("s").alias("scope"), F.col("id").alias("event_id"), F.lit(7).cast("long").alias("ms"))
    slots = [r.slot for r in progress.paced(rows, 1_000_000_000).orderBy("event_id").collect()]
    assert slots == [7 + k * 1_000_000_000 for k in range(5)]


def test_pause_holds_between_its_bounds(spark):
    rows = spark.createDataFrame([("s", k, v) for k, v in enumerate([30, 5, 10, 20, 21, 10])], "scope string, event_id long, remaining long")
    assert [r.paused for r in progress.paused(rows).orderBy("event_id").collect()] == [False, True, True, True, False, False]


def test_sticky_status(spark):
    rows = rows_of(spark, [("a", 1, 0, "running"), ("a", 2, 1, "cancelled"), ("a", 3, 2, "running"), ("b", 1, 0, "running")])
    assert dict(map(tuple, progress.sticky_status(spark.createDataFrame(rows, SCHEMA)).collect())) == {"a": "cancelled", "b": "running"}
    assert progress.merged(spark.createDataFrame(rows[:1], SCHEMA), spark.createDataFrame(rows, SCHEMA)).groupBy("scan_id").agg(F.max("seq")).count() == 2
