"""Incremental pipelines: watermarks, batches, statuses, retries and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_TRIES = 10
TERMINAL = "success"


def positions(items: DataFrame, count: str, key: str = "item_id", partitions: int = 0) -> DataFrame:
    """Items with ``before``, the sum of the counts of all smaller keys.

    Keys are dealt by range; sums within a range are windows over it, and the
    sums of whole ranges, one row each, are added. No task sees all items.
    """
    n = partitions or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.repartitionByRange(n, key).withColumn("_p", F.spark_partition_id())
    from weftlake.session import stash

    dealt = stash(dealt, "positions")
    sums = dealt.groupBy("_p").agg(F.sum(count).alias("_s"))
    base = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # one row a range
    inner = Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(base), "_p").withColumn("before", F.col("_b") + F.coalesce(F.sum(count).over(inner), F.lit(0))).drop("_p", "_b")


def after_watermark(items: DataFrame, watermark: int, limit: int | None = None, key: str = "item_id") -> DataFrame:
    """Items past the watermark in key order, one more than the limit to tell whether it cut."""
    rows = items.filter(F.col(key) > watermark)
    return rows.orderBy(key).limit(limit + 1) if limit else rows


def plan_batches(items: DataFrame, batch: int, count: str = "total_chunks", key: str = "item_id") -> DataFrame:
    """(key, chunk_index, batch_no) of every chunk: contiguous batches of ``batch`` chunks."""
    at = positions(items, count, key)
    return at.filter(F.col(count) > 0).select(key, "before", F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int"))).alias("chunk_index")).select(
        key, "chunk_index", F.floor((F.col("before") + F.col("chunk_index")) / batch).cast("long").alias("batch_no")
    )


def next_watermark(items: DataFrame, batch: int, max_batches: int, count: str = "total_chunks", key: str = "item_id", last: int = 0) -> DataFrame:
    """One row: the last item all of whose chunks lie in the first ``max_batches`` batches, a contiguous prefix."""
    at = positions(items, count, key)
    return at.agg(F.coalesce(F.max(F.when(F.col("before") + F.col(count) <= batch * max_batches, F.col(key))), F.lit(last)).alias("watermark"))


def unprocessed(listed: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return listed.join(done.select(key), key, "left_anti")


def backoff(tries: Column) -> Column:
    """Seconds until the next try: 30 doubled for each, an hour at most."""
    return F.least(F.lit(30.0) * F.pow(F.lit(2.0), tries), F.lit(3600.0)).cast("long")


def due(pending: DataFrame, as_of: Column, limit: int = 100) -> DataFrame:
    """Pending batches whose time has come and that have tries left, the oldest first."""
    ok = (F.col("status") == "pending") & (F.col("next_retry_at") <= as_of) & (F.col("retry_count") < MAX_TRIES)
    return pending.filter(ok).orderBy("next_retry_at", "id").limit(limit)


def stuck(batches: DataFrame, as_of: Column, hours: int = 2) -> DataFrame:
    return batches.filter((F.col("status") == "processing") & (F.col("updated_at") < as_of - F.expr(f"INTERVAL {hours} HOURS")))


def final_status(messages: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Status by key: success absorbs, else the latest message; ``chunks`` is that message's count."""
    done = F.max_by(F.struct("status", "chunk_count"), F.when(F.col("status") == TERMINAL, -F.col(seq)))
    late = F.max_by(F.struct("status", "chunk_count"), F.col(seq))
    g = messages.groupBy(*keys).agg(F.coalesce(done, late).alias("m"))
    return g.select(*keys, F.col("m.status").alias("status"), F.col("m.chunk_count").alias("chunks"))


def counters(batches: DataFrame, keys: list[str], status: str = "status", chunks: str = "chunks") -> DataFrame:
    """Numbers and chunks of batches by status: derived from the ledger, so that they can't drift."""
    aggs = []
    for s in ("success", "failed", "processing", "pending"):
        hit = F.col(status) == s
        aggs += [F.count(F.when(hit, 1)).alias(f"{s}_batches"), F.coalesce(F.sum(F.when(hit, F.col(chunks))), F.lit(0)).cast("long").alias(f"{s}_chunks")]
    return batches.groupBy(*keys).agg(*aggs)


def overall(c: DataFrame, dispatched: str = "dispatched", to_process: str = "to_process") -> DataFrame:
    """Counters with the transform's status: batches decide if any were dispatched, else chunks do."""

    def verdict(good: str, bad: str) -> Column:
        return F.when(F.col(bad) == 0, "completed").when(F.col(good) == 0, "failed").otherwise("completed_with_errors")

    ended, embedded = F.col("success_batches") + F.col("failed_batches"), F.col("success_chunks") + F.col("failed_chunks")
    by_batch = F.when(ended >= F.col(dispatched), verdict("success_batches", "failed_batches")).when(ended > 0, "processing").otherwise("pending")
    by_chunk = (
        F.when((F.col(to_process) == 0) & (ended > 0), "completed")
        .when(F.col(to_process) == 0, "idle")
        .when(embedded >= F.col(to_process), verdict("success_chunks", "failed_chunks"))
        .when(ended == 0, "pending")
        .otherwise("processing")
    )
    return c.withColumn("overall_status", F.when(F.col("processing_batches") > 0, "processing").when(F.col(dispatched) > 0, by_batch).otherwise(by_chunk))


def progress(c: DataFrame, expected: Column) -> DataFrame:
    """Expected and done chunks, and whether nothing is missing and nothing runs."""
    done = F.col("success_chunks") + F.col("failed_chunks")
    return c.withColumn("expected", expected).withColumn("done", done).withColumn("is_complete", (F.col("expected") > 0) & (done >= F.col("expected")) & (F.col("processing_batches") == 0))


def retry_failed(batches: DataFrame, ledger: DataFrame, key: str = "batch") -> tuple[DataFrame, DataFrame]:
    """(batches with failed ones pending again, ledger without their rows)."""
    failed = batches.filter(F.col("status") == "failed").select(key)
    return batches.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status"))), ledger.join(failed, key, "left_anti")


def reconcile(pending: DataFrame, batches: DataFrame, as_of: Column) -> DataFrame:
    """One row: what a reconciliation run finds to retry, to expire, to purge and to report."""
    day, week = as_of - F.expr("INTERVAL 24 HOURS"), as_of - F.expr("INTERVAL 7 DAYS")
    a = pending.agg(
        F.count(F.when((F.col("status") == "pending") & (F.col("next_retry_at") <= as_of) & (F.col("retry_count") < MAX_TRIES), 1)).alias("due"),
        F.count(F.when((F.col("status") == "pending") & (F.col("created_at") < day), 1)).alias("orphans"),
        F.count(F.when((F.col("status") != "pending") & (F.col("created_at") < week), 1)).alias("purged"),
    )
    b = stuck(batches, as_of).agg(F.count("*").alias("stuck"))
    return a.crossJoin(b)  # one row each


def dedup_window(messages: DataFrame, minutes: int, key: str = "key", ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Messages that no equal key precedes by less than the window."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    prev = F.lag(ts).over(w)
    return messages.withColumn("_p", prev).filter(F.col("_p").isNull() | (F.col(ts) >= F.col("_p") + F.expr(f"INTERVAL {minutes} MINUTES"))).drop("_p")


#: Deliveries of a message before it is dead, and seconds to wait after each failed one.
MAX_DELIVERIES, WAITS = 5, (30, 60, 120, 300)


def redeliveries(failures: DataFrame, key: str = "message_id", ts: str = "ts", seq: str = "seq", error: str = "error", most: int = MAX_DELIVERIES, waits: tuple[int, ...] = WAITS) -> DataFrame:
    """(key, attempts, last_error, dead, due_at) of every message that failed, one row of ``failures`` for each failed delivery.

    A message is dead after ``most`` deliveries, and then due never; else it is due
    again after the wait of its last attempt (the last wait beyond those listed).
    The last failure is that of the latest ``ts``, of equal ones of the largest ``seq``.
    """
    g = failures.groupBy(key).agg(F.count("*").alias("attempts"), F.max(F.struct(ts, seq, error)).alias("_l"))
    wait = F.element_at(F.array(*map(F.lit, waits)), F.least(F.col("attempts"), F.lit(len(waits))).cast("int"))
    dead = F.col("attempts") >= most
    due = F.when(~dead, F.col(f"_l.{ts}") + F.make_dt_interval(secs=wait))
    return g.select(key, "attempts", F.col(f"_l.{error}").alias("last_error"), dead.alias("dead"), due.alias("due_at"))
