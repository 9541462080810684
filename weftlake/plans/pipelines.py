"""Watermarks, batches, statuses, retries and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.operators import ledger
from weftlake.plans.registry import Tables, query


def items(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("item_id"), F.ceil(F.col("n_chars") / 200).cast("long").alias("total_chunks"))


ITEMS = "WITH i AS (SELECT doc_id AS item_id, CAST(ceil(n_chars / 200) AS BIGINT) AS total_chunks FROM documents) "


@query("scan_watermark", ITEMS + "SELECT item_id, total_chunks FROM i WHERE item_id > 100 ORDER BY item_id LIMIT 51")
def scan_watermark(t: Tables) -> DataFrame:
    return ledger.after_watermark(items(t), 100, 50)


@query("chunk_boundaries", ITEMS + "SELECT item_id, total_chunks, CAST(coalesce(sum(total_chunks) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM i")
def chunk_boundaries(t: Tables) -> DataFrame:
    return ledger.positions(items(t), "total_chunks")


@query(
    "batch_plan",
    ITEMS
    + ", c AS (SELECT item_id, unnest(range(0, total_chunks)) AS chunk_index FROM i) SELECT item_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(floor((row_number() OVER (ORDER BY item_id, chunk_index) - 1) / 96) AS BIGINT) AS batch_no FROM c",
)
def batch_plan(t: Tables) -> DataFrame:
    return ledger.plan_batches(items(t), 96)


@query(
    "capped_watermark",
    ITEMS + "SELECT max(CASE WHEN after <= 96 * 10 THEN item_id END) AS watermark FROM (SELECT item_id, sum(total_chunks) OVER (ORDER BY item_id) AS after FROM i)",
)
def capped_watermark(t: Tables) -> DataFrame:
    return ledger.next_watermark(items(t), 96, 10)


def messages(t: Tables) -> DataFrame:
    s = F.col("event_type")
    status = F.when(s == "view", "processing").when(s == "purchase", "success").when(s == "error", "failed").otherwise("pending")
    return t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("batch"), status.alias("status"), F.col("value").cast("long").alias("chunk_count"), "ts")


MESSAGES = """WITH m AS (SELECT user_id AS key, event_id AS seq, event_id % 50 AS batch, CASE event_type WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
  CAST(trunc(value) AS BIGINT) AS chunk_count, ts FROM events),
  s AS (SELECT key, batch, coalesce(arg_min(status, seq) FILTER (status = 'success'), arg_max(status, seq)) AS status,
        coalesce(arg_min(chunk_count, seq) FILTER (status = 'success'), arg_max(chunk_count, seq)) AS chunks FROM m GROUP BY key, batch),
  c AS (SELECT key, count(*) AS dispatched, """ + ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s}_batches, CAST(coalesce(sum(chunks) FILTER (status = '{s}'), 0) AS BIGINT) AS {s}_chunks" for s in ("success", "failed", "processing", "pending")
) + " FROM s GROUP BY key) "


@query("status_machine", MESSAGES + "SELECT key, batch, status, chunks FROM s")
def status_machine(t: Tables) -> DataFrame:
    return ledger.final_status(messages(t), ["key", "batch"])


@query("status_counters", MESSAGES + "SELECT * EXCLUDE (dispatched) FROM c")
def status_counters(t: Tables) -> DataFrame:
    return ledger.counters(ledger.final_status(messages(t), ["key", "batch"]), ["key"])


@query(
    "transform_status",
    MESSAGES
    + """, x AS (SELECT *, CASE WHEN key % 3 = 0 THEN 0 ELSE dispatched END AS d, CASE WHEN key % 6 = 0 THEN 0 ELSE 500 END AS p FROM c)
  SELECT key, CASE WHEN processing_batches > 0 AND key % 2 = 0 THEN 'processing'
    WHEN d > 0 AND success_batches + failed_batches >= d THEN CASE WHEN failed_batches = 0 THEN 'completed' WHEN success_batches = 0 THEN 'failed' ELSE 'completed_with_errors' END
    WHEN d > 0 AND success_batches + failed_batches > 0 THEN 'processing' WHEN d > 0 THEN 'pending'
    WHEN p = 0 AND success_batches + failed_batches > 0 THEN 'completed' WHEN p = 0 THEN 'idle'
    WHEN success_chunks + failed_chunks >= p THEN CASE WHEN failed_chunks = 0 THEN 'completed' WHEN success_chunks = 0 THEN 'failed' ELSE 'completed_with_errors' END
    WHEN success_batches + failed_batches = 0 THEN 'pending' ELSE 'processing' END AS overall_status FROM x""",
)
def transform_status(t: Tables) -> DataFrame:
    c = ledger.counters(ledger.final_status(messages(t), ["key", "batch"]), ["key"])
    all_ = F.col("success_batches") + F.col("failed_batches") + F.col("processing_batches") + F.col("pending_batches")
    c = c.withColumn("dispatched", F.when(F.col("key") % 3 == 0, 0).otherwise(all_)).withColumn("to_process", F.when(F.col("key") % 6 == 0, 0).otherwise(500))
    c = c.withColumn("processing_batches", F.when(F.col("key") % 2 == 0, F.col("processing_batches")).otherwise(0))
    return ledger.overall(c).select("key", "overall_status")


@query(
    "embedder_progress",
    MESSAGES + "SELECT key, key * 10 AS expected, success_chunks + failed_chunks AS done, key * 10 > 0 AND success_chunks + failed_chunks >= key * 10 AND processing_batches = 0 AS is_complete FROM c",
)
def embedder_progress(t: Tables) -> DataFrame:
    c = ledger.counters(ledger.final_status(messages(t), ["key", "batch"]), ["key"])
    return ledger.progress(c, F.col("key") * 10).select("key", "expected", "done", "is_complete")


@query("retry_failed", MESSAGES + "SELECT key, batch, CASE status WHEN 'failed' THEN 'pending' ELSE status END AS status FROM s")
def retry_failed(t: Tables) -> DataFrame:
    s = ledger.final_status(messages(t), ["key", "batch"]).withColumn("id", F.struct("key", "batch"))
    return ledger.retry_failed(s, s.select("id"), "id")[0].select("key", "batch", "status")


@query("retry_ledger", MESSAGES + "SELECT key, batch FROM s WHERE status <> 'failed'")
def retry_ledger(t: Tables) -> DataFrame:
    s = ledger.final_status(messages(t), ["key", "batch"]).withColumn("id", F.struct("key", "batch"))
    return ledger.retry_failed(s, s.select("id", "key", "batch"), "id")[1].select("key", "batch")


def pending(t: Tables) -> DataFrame:
    tries = (F.col("event_id") % 12).cast("int")
    return t.events.select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "done").otherwise("pending").alias("status"), tries.alias("retry_count"), F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_interval(secs=ledger.backoff(tries))).alias("next_retry_at"), F.col("ts").alias("updated_at")
    )


PENDING = """WITH p AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'done' ELSE 'pending' END AS status, CAST(event_id % 12 AS INTEGER) AS retry_count, ts AS created_at,
  ts + to_seconds(CAST(least(30 * pow(2, event_id % 12), 3600) AS BIGINT)) AS next_retry_at, ts AS updated_at FROM events) """
AS_OF = "2024-01-20 00:00:00"


@query("backoff", "SELECT event_id, CAST(least(30 * pow(2, event_id % 12), 3600) AS BIGINT) AS seconds FROM events")
def backoff(t: Tables) -> DataFrame:
    return t.events.select("event_id", ledger.backoff(F.col("event_id") % 12).alias("seconds"))


@query("due_retry", PENDING + f"SELECT id, retry_count, next_retry_at FROM p WHERE status = 'pending' AND next_retry_at <= TIMESTAMP '{AS_OF}' AND retry_count < 10 ORDER BY next_retry_at, id LIMIT 100")
def due_retry(t: Tables) -> DataFrame:
    return ledger.due(pending(t), F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")).select("id", "retry_count", "next_retry_at")


@query("stuck", MESSAGES + f"SELECT key, seq FROM m WHERE status = 'processing' AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR")
def stuck(t: Tables) -> DataFrame:
    m = messages(t).withColumnRenamed("ts", "updated_at")
    return ledger.stuck(m, F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")).select("key", "seq")


@query(
    "reconcile",
    PENDING
    + f"""SELECT count(*) FILTER (status = 'pending' AND next_retry_at <= TIMESTAMP '{AS_OF}' AND retry_count < 10) AS due, count(*) FILTER (status = 'pending' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS orphans,
  count(*) FILTER (status <> 'pending' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS purged, (SELECT count(*) FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR) AS stuck FROM p""",
)
def reconcile(t: Tables) -> DataFrame:
    return ledger.reconcile(pending(t), messages(t).withColumnRenamed("ts", "updated_at"), F.expr(f"TIMESTAMP_NTZ '{AS_OF}'"))


@query("dedup_window", "SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts >= p + INTERVAL 60 MINUTE")
def dedup_window(t: Tables) -> DataFrame:
    m = t.events.select(F.struct("user_id", "event_type").alias("key"), "ts", F.col("event_id").alias("seq"))
    return ledger.dedup_window(m, 60).select(F.col("seq").alias("event_id"))


@query("changed_datasets", "SELECT o_custkey, max(o_orderdate) AS updated_at FROM orders GROUP BY 1 HAVING max(o_orderdate) > TIMESTAMP '1998-01-01'")
def changed_datasets(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("updated_at")).filter("updated_at > TIMESTAMP_NTZ '1998-01-01'")


@query("retained", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{AS_OF}'")
def retained(t: Tables) -> DataFrame:
    as_of = F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")
    return t.events.filter((F.col("ts") >= as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") <= as_of)).select("event_id")
