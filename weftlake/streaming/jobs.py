"""Streams: deduplication, statuses with absorbing success, ingest to an upserted table, and the audit sink."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftlake.operators.ledger import MAX_DELIVERIES, WAITS
from weftlake.session import shared_path
from weftlake.sources.blobs import merge_into


def read_table(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 16) -> DataFrame:
    """A table's Parquet files as a stream; the number of files a trigger bounds what a batch holds."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{table}.parquet*")


def run_once(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over all that is there, to Parquet in the shared folder; what it wrote."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").format("parquet").start(path)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def dedup(messages: DataFrame, key: list[str], ts: str = "ts", window: str = "60 minutes") -> DataFrame:
    """Messages without those that repeat a key within the window; state older than the watermark is dropped."""
    return messages.withWatermark(ts, window).dropDuplicatesWithinWatermark(key)


def settle(messages: DataFrame) -> DataFrame:
    """The status of (key, batch) whenever there are messages for it: the first success absorbs, else the latest ``seq`` decides.

    State is one row a batch, kept by Spark's own aggregates. A message that changes nothing gives the same status again.
    """
    row = F.struct("status", F.col("chunk_count").cast("long").alias("chunks"), F.col("seq").cast("long").alias("seq"))
    first, last = F.min_by(row, F.when(F.col("status") == "success", F.col("seq"))), F.max_by(row, "seq")
    keys = [F.col(k).cast("long").alias(k) for k in ("key", "batch")]
    return messages.groupBy(*keys).agg(F.coalesce(first, last).alias("s")).select("key", "batch", "s.*")


def run_settled(messages: DataFrame) -> DataFrame:
    """The last status of every batch after a run over all messages, kept in a table that each micro-batch is merged into."""
    spark = messages.sparkSession
    path = shared_path(spark, "statuses")

    def put(df: DataFrame, epoch: int) -> None:
        rows = df.withColumn("id", F.concat_ws(":", "key", "batch")).withColumn("_epoch", F.lit(epoch).cast("long"))
        merge_into(spark, rows, path, "id", "_epoch")

    q = settle(messages).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.parquet(path).select("key", "batch", "status", "chunks")


def ingest(docs: DataFrame, path: str, chunker, embedder, dataset: int = 1, files_per_trigger: int = 4) -> None:
    """Stream of (doc_id, text) to a table of points (id, item_id, chunk_index, text, vector), upserted by id.

    A batch that runs again after a failure writes the same ids, so that it changes nothing.
    """
    from weftlake.functions.ids import chunk_id
    from weftlake.operators.embed import embed

    spark = docs.sparkSession

    def put(df: DataFrame, epoch: int) -> None:
        chunks = df.select(F.col("doc_id").alias("item_id"), F.posexplode(chunker(F.col("text"))).alias("chunk_index", "text"))
        points = embed(chunks, embedder, "text", "vector").withColumn("id", chunk_id(F.lit(dataset), F.col("item_id"), F.col("chunk_index"))).withColumn("seq", F.lit(epoch).cast("long"))
        merge_into(spark, points, path, "id", "seq")

    q = docs.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").foreachBatch(put).start()
    q.awaitTermination()


def deliver(messages: DataFrame, work, path: str) -> None:
    """Run ``work`` over a stream of messages; each micro-batch is split by what it reports.

    ``work`` maps (message_id, seq, ...) to rows with ``error``, null where all went
    well. Rows that worked are upserted by id below ``path``/done, failed
    deliveries by (id, seq) below ``path``/failed, so that a batch that runs again
    counts none twice; :func:`weftlake.operators.ledger.redeliveries` over these
    tells which are due again and which are dead letters.
    """
    spark = messages.sparkSession

    def put(df: DataFrame, epoch: int) -> None:
        from weftlake.session import drop_stash, stash

        out = stash(work(df).withColumn("_epoch", F.lit(epoch).cast("long")), "delivered")
        merge_into(spark, out.filter("error IS NULL"), f"{path}/done", "message_id", "seq")
        merge_into(spark, out.filter("error IS NOT NULL").withColumn("delivery", F.concat_ws(":", "message_id", "seq")), f"{path}/failed", "delivery", "_epoch")
        drop_stash(out)

    messages.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").foreachBatch(put).start().awaitTermination()


def consume(spark: SparkSession, queue: str, path: str, consumer: str) -> None:
    """Write to Parquet at ``path`` what ``consumer`` hasn't acknowledged of the commits in ``queue``, and acknowledge it."""
    from weftlake.sources.commits import acknowledge, stream_commits

    q = stream_commits(spark, queue, consumer).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").format("parquet").start(path)
    q.awaitTermination()
    end = q.lastProgress["sources"][0]["endOffset"] if q.lastProgress else None  # Spark commits a batch with the next one, and the last never
    if end:
        acknowledge(queue, consumer, ast.literal_eval(str(end))["commit"])


def collect_results(results: DataFrame, path: str) -> None:
    """Settle a stream of (item_id, chunks, error, seq): items that have chunks, failures, and a trigger for each batch.

    A result without error and with a chunk or more is upserted below
    ``path``/items, any other below ``path``/failures, both by id, the largest ``seq`` stays. Only
    then the batch is committed to ``path``/triggers (batch, items, failures), where
    the next stage reads it as a stream; a batch that runs again triggers nothing
    twice. Rows without an id are failures under the null id.
    """
    from weftlake.session import drop_stash, stash
    from weftlake.sources.commits import write_commit

    good = F.col("item_id").isNotNull() & F.col("error").isNull() & (F.coalesce("chunks", F.lit(0)) > 0)

    def put(df: DataFrame, epoch: int) -> None:
        told = stash(df.withColumn("ok", F.coalesce(good, F.lit(False))), "results")
        merge_into(df.sparkSession, told.filter("ok").drop("ok", "error"), f"{path}/items", "item_id", "seq")
        failed = told.filter("NOT ok").select("item_id", F.coalesce("error", F.when(F.col("item_id").isNull(), "no item").otherwise("no chunks")).alias("error"), "seq")
        merge_into(df.sparkSession, failed, f"{path}/failures", "item_id", "seq")
        counts = told.agg(F.count_if("ok").alias("items"), F.count_if(~F.col("ok")).alias("failures"))
        write_commit(counts.select(F.lit(epoch).cast("long").alias("batch"), "items", "failures"), f"{path}/triggers", "results", epoch)
        drop_stash(told)

    results.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").foreachBatch(put).start().awaitTermination()


def subject(owner: Column, kind: Column, resource: Column) -> Column:
    """The subject under which a status is published: kind, owner and resource, with what would split a subject replaced."""
    clean = [F.regexp_replace(c.cast("string"), r"[\s.*>]", "_") for c in (kind, owner, resource)]
    return F.concat_ws(".", F.lit("status"), *clean)


def fan_out_statuses(statuses: DataFrame, path: str) -> None:
    """A stream of (subject, ...) to a folder for each subject, each batch written once under its number: readers follow only theirs."""

    def put(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch).cast("long")).repartition("subject").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject", "epoch").json(path)

    statuses.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").foreachBatch(put).start().awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by time bucket and type, each once its window has passed the watermark."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "event_type", "n")


REDELIVERY = "message_id {id}, attempts long, last_error {error}, dead boolean, due_at timestamp"


def redeliver(outcomes: DataFrame, late: str = "1 minute", most: int = MAX_DELIVERIES, waits: tuple[int, ...] = WAITS, forget: int = 86_400) -> DataFrame:
    """(message_id, attempts, last_error, dead, due_at) of a message when it comes back by itself, and when it dies.

    ``outcomes`` is a stream of (message_id, ts, seq, error), one row for each
    delivery; a null ``error`` acknowledges the message and what failed before. A
    failed one gets a timer for the wait of its attempt; when the watermark (``late``
    behind the latest ``ts``) has passed it, the message is handed out again. The
    ``most``-th failure makes it a dead letter at once. State goes with the
    acknowledgement, or ``forget`` seconds after the last hand-out. Failures that come later than the
    watermark count too. Rows without id only move the clock, and are neither shuffled nor kept; rows without time are ignored.
    """
    rows = outcomes.filter("ts IS NOT NULL").select("message_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "error").withWatermark("ts", late)
    # The condition names ts, or Spark would meet it before the watermark has seen the row.
    rows = rows.filter(F.when(F.col("ts").isNotNull(), F.col("message_id").isNotNull()).otherwise(False))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = REDELIVERY.format(id=kinds["message_id"], error=kinds["error"])

    def out(key: tuple, attempts: int, error: object, due: int | None) -> pd.DataFrame:
        at = np.array([due if due else "NaT"], "datetime64[ms]").astype("datetime64[ns]")
        return pd.DataFrame({"message_id": [key[0]], "attempts": [attempts], "last_error": [error], "dead": [due is None], "due_at": at})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        attempts, error, due = state.get if state.exists else (0, None, 0)
        if state.hasTimedOut:
            if not due:
                state.remove()
                return
            yield out(key, attempts, error, due)
            state.update((attempts, error, 0))
            state.setTimeoutTimestamp(max(due, now) + forget * 1000)
            return
        # Arrays, not frames: a call is for one message, and there may be millions.
        read = [[pdf[c].to_numpy() for c in ("ts", "seq", "error")] for pdf in batches]
        ts, seq, errors = read[0] if len(read) == 1 else map(np.concatenate, zip(*read))
        order = np.lexsort((pd.Series(seq).rank().to_numpy() if seq.dtype == object else seq, ts))
        good = np.flatnonzero(pd.isna(errors[order]))
        if len(good):
            attempts, order = 0, order[good[-1] + 1 :]
        if not len(order):
            if state.exists:
                state.remove()
            return
        attempts += len(order)
        error, ts = errors[order[-1]], int(ts[order[-1]].astype("datetime64[ms]").astype(np.int64))
        error = error.item() if hasattr(error, "item") else error
        due = 0 if attempts >= most else ts + 1000 * waits[min(attempts, len(waits)) - 1]
        if not due:
            yield out(key, attempts, error, None)
        elif due <= now:
            yield out(key, attempts, error, due)
            due = 0
        state.update((attempts, error, due))
        state.setTimeoutTimestamp(due or max(ts, now) + forget * 1000)

    return rows.groupBy("message_id").applyInPandasWithState(step, schema, f"attempts long, error {kinds['error']}, due long", "append", GroupStateTimeout.EventTimeTimeout)
