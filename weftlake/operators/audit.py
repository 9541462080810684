"""Reports over the audit log (ts, event_type, outcome, user_id, resource_type, resource_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.operators.sketches import exact_quantiles, sketch_rollup


def audit_view(events: DataFrame) -> DataFrame:
    """The event table as an audit log."""
    return events.select(
        "event_id",
        "ts",
        "event_type",
        F.when(F.col("event_type") == "error", "Failure").otherwise("Success").alias("outcome"),
        "user_id",
        F.when(F.col("event_type") == "signup", None).otherwise(F.concat(F.lit("res-"), F.col("event_type"))).alias("resource_type"),
        F.get_json_object("props", "$.k").alias("resource_id"),
    )


def totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"), F.count(F.when(F.col("outcome") == "Success", 1)).alias("successes"), F.count(F.when(F.col("outcome") == "Failure", 1)).alias("failures"))


def distincts(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("event_types"), F.countDistinct("resource_type").alias("resource_types"))


def approx_users(log: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Extension: distinct users by a sketch, one small buffer a task."""
    return log.agg(F.approx_count_distinct("user_id", rsd).alias("users"))


def buckets(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events by time bucket and type."""
    return log.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "event_type", "n")


def tail(log: DataFrame, n: int = 500) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def by(log: DataFrame, column: str, missing: str = "N/A") -> DataFrame:
    return log.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def top_users(log: DataFrame, k: int = 20) -> DataFrame:
    g = log.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types"), F.max("ts").alias("last_activity"))
    return g.orderBy(F.desc("n"), "user_id").limit(k)


def top_resources(log: DataFrame, k: int = 20) -> DataFrame:
    g = log.filter("resource_type IS NOT NULL").groupBy("resource_type", "resource_id").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "resource_type", "resource_id").limit(k)


def rates(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and failures a second, and the share of failures, by bucket."""
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    g = log.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count(F.when(F.col("outcome") == "Failure", 1)).alias("failures"))
    return g.select(F.col("w.start").alias("bucket"), "n", "failures", (F.col("n") / seconds).alias("rate"), (F.col("failures") / F.col("n")).alias("failure_ratio"))


def value_quantiles(events: DataFrame, column: str = "value") -> DataFrame:
    """Quantiles of a value by event type, exact; see :func:`weftlake.operators.sketches.exact_quantiles`."""
    return exact_quantiles(events, "event_type", column)


def hourly(events: DataFrame) -> DataFrame:
    """The roll-up by hour and type that reports over any range of hours are read from."""
    return sketch_rollup(events, ["event_type"], "user_id", "value")


def rollup_counts(log: DataFrame) -> DataFrame:
    """Extension: counts by type and outcome with subtotals."""
    return log.rollup("event_type", "outcome").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
