"""Streams that run to their end; the batch plans give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.plans.pipelines import MESSAGES, messages
from weftlake.plans.registry import Tables, query
from weftlake.session import shared_path
from weftlake.streaming import jobs


class _Streamed(Tables):
    """The tables of a folder as streams."""

    def __getattr__(self, name: str) -> DataFrame:
        return jobs.read_table(self.spark, self.folder, name)


@query("stream_status", MESSAGES + "SELECT key, batch, status, chunks FROM s")
def stream_status(t: Tables) -> DataFrame:
    return jobs.run_settled(messages(_Streamed(t.spark, t.folder)).select("key", "batch", "status", "chunk_count", "seq"))


@query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    e = _Streamed(t.spark, t.folder).events.withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.run_once(jobs.dedup(e.unionByName(e), ["event_id"], window="40 days").select("event_id"), name="dedup")


@query("stream_audit_sink", "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'Failure' ELSE 'Success' END AS outcome FROM events")
def stream_audit_sink(t: Tables) -> DataFrame:
    from weftlake.operators.audit import audit_view

    return jobs.run_once(audit_view(_Streamed(t.spark, t.folder).events).select("event_id", "event_type", "outcome"), name="audit")


@query("stream_ingest", "SELECT doc_id AS item_id, CAST(ceil(length(text) / 500) AS BIGINT) AS n, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text <> ''")
def stream_ingest(t: Tables) -> DataFrame:
    from weftlake.operators.chunking import fixed_size
    from weftlake.operators.embed import HashingProvider

    path = shared_path(t.spark, "points")
    jobs.ingest(_Streamed(t.spark, t.folder).documents.select("doc_id", "text"), path, lambda c: fixed_size(c, 500, trim=False), HashingProvider(8))
    return t.spark.read.parquet(path).groupBy("item_id").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query(
    "stream_redelivery",
    """WITH f AS (SELECT user_id AS message_id, count(*) AS attempts, arg_max(event_id, epoch_us(ts) * 1000000000::HUGEINT + event_id) AS last_error,
    max(ts) + to_seconds([30, 60, 120, 300][least(count(*), 4)]) AS due FROM events WHERE event_type = 'error' AND user_id IS NOT NULL GROUP BY user_id)
  SELECT message_id, attempts, last_error, attempts >= 5 AS dead, CASE WHEN attempts < 5 THEN strftime(due, '%Y-%m-%d %H:%M:%S') END AS due_at
  FROM f WHERE attempts >= 5 OR due <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events WHERE user_id IS NOT NULL)""",
)
def stream_redelivery(t: Tables) -> DataFrame:
    """What a stream with timers hands out by itself: messages that are due again by its own clock, and dead letters."""
    e = _Streamed(t.spark, t.folder).events.filter("user_id IS NOT NULL")
    failed = e.withColumn("error", F.when(F.col("event_type") == "error", F.col("event_id")))
    clock = failed.select(F.when(F.col("error").isNotNull(), F.col("user_id")).alias("message_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "error")
    out = jobs.run_once(jobs.redeliver(clock), name="redelivery")
    last = out.groupBy("message_id").agg(F.max_by(F.struct("attempts", "last_error", "dead", "due_at"), "attempts").alias("x"))
    return last.select("message_id", "x.attempts", "x.last_error", "x.dead", F.date_format("x.due_at", "yyyy-MM-dd HH:mm:ss").alias("due_at"))


@query(
    "collection_results",
    """SELECT doc_id AS item_id, CASE WHEN doc_id % 9 = 0 THEN 'extract' WHEN coalesce(length(text), 0) < 200 THEN 'no chunks' ELSE 'item' END AS outcome,
    CASE WHEN doc_id % 9 <> 0 AND length(text) >= 200 THEN CAST(length(text) // 200 AS BIGINT) END AS chunks FROM documents""",
)
def collection_results(t: Tables) -> DataFrame:
    """Results of a stage (a failure for every ninth document), settled as items and failures."""
    path = shared_path(t.spark, "results")
    chunks = F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / 200).cast("long")
    jobs.collect_results(_Streamed(t.spark, t.folder).documents.select(F.col("doc_id").alias("item_id"), chunks.alias("chunks"), F.when(F.col("doc_id") % 9 == 0, "extract").alias("error"), F.lit(0).cast("long").alias("seq")), path)
    items = t.spark.read.parquet(f"{path}/items").select("item_id", F.lit("item").alias("outcome"), "chunks")
    return items.unionByName(t.spark.read.parquet(f"{path}/failures").select("item_id", F.col("error").alias("outcome"), F.lit(None).cast("long").alias("chunks")))


@query("stream_commits", "SELECT event_id, user_id, event_type FROM events")
def stream_commits(t: Tables) -> DataFrame:
    """Events in two commits, read as a stream by two runs of one consumer: the second goes on where the first has acknowledged."""
    from weftlake.sources.commits import write_commit

    queue, out = shared_path(t.spark, "queue"), shared_path(t.spark, "consumed")
    later = F.coalesce(F.col("event_id") % 2, F.lit(0)) != 0
    for k, part in enumerate((~later, later)):
        write_commit(t.events.filter(part).select("event_id", "user_id", "event_type"), queue)
        jobs.consume(t.spark, queue, f"{out}/{k}", "reader")
    return t.spark.read.parquet(f"{out}/0", f"{out}/1")
