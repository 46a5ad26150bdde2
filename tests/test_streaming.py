"""A stream of operations, stopped and started again, out of order and delivered twice."""

from pyspark.sql import functions as F

from runweave.operators import resolve
from runweave.streaming import latest


def _write(spark, path, rows):
    spark.createDataFrame(rows, latest.LOG).coalesce(1).write.mode("append").parquet(path)


def test_restart_gives_the_same_state(spark, tmp_path):
    src, root = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    first = [(i % 9, i, "DELETE" if i % 5 == 0 else "PUT", f"v{i}") for i in range(40)]
    late = [(3, -1, "PUT", "old"), (4, 100, "PUT", "new"), (2, 101, "DELETE", None)]
    _write(spark, src, first)
    stream = lambda: spark.readStream.schema(latest.LOG).option("maxFilesPerTrigger", 1).parquet(src)
    latest.start(stream(), root).awaitTermination()
    assert {r.key: r.value for r in latest.state(spark, root).collect()} == {r.key: r.value for r in resolve.live(spark.read.parquet(src)).collect()}
    _write(spark, src, late)
    _write(spark, src, late)
    latest.start(stream(), root).awaitTermination()
    want = {r.key: r.value for r in resolve.live(spark.read.parquet(src).distinct()).collect()}
    assert want[4] == "new" and 2 not in want
    assert {r.key: r.value for r in latest.state(spark, root).collect()} == want


def test_stateful_latest(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    _write(spark, src, [(1, 5, "PUT", "b"), (1, 3, "PUT", "a"), (2, 1, "DELETE", None)])
    q = latest.latest_stateful(spark.readStream.schema(latest.LOG).parquet(src)).writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.key, r.seq, r.op) for r in spark.table("newest").collect()} == {(1, 5, "PUT"), (2, 1, "DELETE")}


def test_windows(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.range(48).select(F.timestamp_seconds(F.col("id") * 1800).cast("timestamp_ntz").alias("ts"), F.lit("e").alias("event_type")).write.parquet(src)
    q = latest.windowed_counts(spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(src), "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.n for r in spark.table("hours").collect()} == {2}
