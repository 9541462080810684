"""Messages come back by themselves: a stream over a clock of its own; samples by threshold."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weftlake.operators.clusters import sample_points
from weftlake.session import shared_path
from weftlake.streaming import jobs

START = datetime(2024, 3, 1, 12)


def test_failed_messages_come_back_until_they_die(spark):
    """Each start of the stream sees one more batch; the clock is the time of the messages."""
    path = shared_path(spark, "clock")
    schema = "message_id long, ts timestamp, seq long, error string, attempts long"

    def start(rows):
        spark.createDataFrame([(i, START + timedelta(seconds=s), k, e, 0) for k, (i, s, e) in enumerate(rows)], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        q = jobs.redeliver(stream, late="1 second").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        out = spark.read.parquet(f"{path}/out") if rows else None
        return sorted((r.message_id, r.attempts, r.last_error, r.dead, r.due_at and int((r.due_at - START).total_seconds())) for r in out.collect())

    # 1 fails again and again, 2 is acknowledged before its time, 3 dies in one batch; 9 only moves the clock.
    assert start([(1, 0, "a"), (2, 0, "b"), (3, 0, "x"), (3, 1, "x"), (3, 2, "x"), (3, 3, "x"), (3, 4, "y"), (None, 5, "n")]) == [(3, 5, "y", True, None)]
    assert start([(2, 10, None), (9, 20, None)]) == [(3, 5, "y", True, None)]
    assert start([(9, 40, None)]) == [(1, 1, "a", False, 30), (3, 5, "y", True, None)]
    assert start([(1, 50, "c"), (9, 100, None)])[:1] == [(1, 1, "a", False, 30)]
    got = start([(9, 120, None)])
    assert got[:2] == [(1, 1, "a", False, 30), (1, 2, "c", False, 110)] and len(got) == 3
    got = start([(1, 130, "d"), (1, 131, "e"), (1, 132, "f"), (9, 140, None)])
    assert got[2] == (1, 5, "f", True, None) and len(got) == 4


def test_statuses_settle_without_order(spark):
    rows = [(1, 1, "failed", 2, 5), (1, 1, "success", 4, 3), (1, 1, "success", 9, 4), (1, 2, "failed", 1, 2), (1, 2, "pending", 0, 7)]
    path = shared_path(spark, "settle")
    spark.createDataFrame(rows, "key long, batch long, status string, chunk_count long, seq long").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = {(r.key, r.batch): (r.status, r.chunks) for r in jobs.run_settled(stream).collect()}
    assert got == {(1, 1): ("success", 4), (1, 2): ("pending", 0)}


def test_samples_are_the_smallest_hashes(spark):
    points = spark.range(20_000).withColumn("x", F.col("id") % 7)
    for most in (0, 1, 500, 19_999, 20_000, 30_000):
        want = {r.id for r in points.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(most).collect()}
        assert {r.id for r in sample_points(points, most).collect()} == want
    same = spark.range(300).select((F.col("id") % 2).alias("id"))
    assert sample_points(same, 200).count() == 200


def test_rows_without_id_move_the_clock(spark):
    """They don't reach the state: a stream of them alone brings a failed message back."""
    path = shared_path(spark, "clock")
    schema = "message_id long, ts timestamp, seq long, error string"
    got = []
    for k, (i, s, e) in enumerate([(1, 0, "a"), (None, 60, None), (None, 70, "n")]):
        spark.createDataFrame([(i, START + timedelta(seconds=s), k, e)], schema).write.mode("append").parquet(f"{path}/in")
        q = jobs.redeliver(spark.readStream.schema(schema).parquet(f"{path}/in"), late="1 second").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sum(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"][:1] if p["numInputRows"]) <= 1
        got = [(r.message_id, r.attempts) for r in spark.read.parquet(f"{path}/out").collect()]
    assert got == [(1, 1)]


def test_statuses_of_messages_without_chunks_settle(spark):
    rows = [(1, 1, "failed", None, -5), (1, 2, "success", None, 3), (1, 2, "failed", 7, 1)]
    path = shared_path(spark, "settle")
    spark.createDataFrame(rows, "key long, batch long, status string, chunk_count long, seq long").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    assert "FlatMapGroups" not in jobs.settle(stream)._jdf.queryExecution().analyzed().toString()
    got = {(r.key, r.batch): (r.status, r.chunks) for r in jobs.run_settled(stream).collect()}
    assert got == {(1, 1): ("failed", None), (1, 2): ("success", None)}
