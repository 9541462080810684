"""Audit reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.operators import audit
from weftlake.operators.sketches import merged_rollup, read_rollup
from weftlake.plans.registry import Tables, query

VIEW = """WITH a AS (SELECT event_id, ts, event_type, CASE WHEN event_type = 'error' THEN 'Failure' ELSE 'Success' END AS outcome, user_id,
  CASE WHEN event_type <> 'signup' THEN 'res-' || event_type END AS resource_type, json_extract_string(props, '$.k') AS resource_id FROM events) """


@query("audit_totals", VIEW + "SELECT count(*) AS total, count(*) FILTER (outcome = 'Success') AS successes, count(*) FILTER (outcome = 'Failure') AS failures FROM a WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def audit_totals(t: Tables) -> DataFrame:
    log = audit.audit_view(t.events).filter((F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-05'")) & (F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-20'")))
    return audit.totals(log)


@query("audit_distincts", VIEW + "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS event_types, count(DISTINCT resource_type) AS resource_types FROM a")
def audit_distincts(t: Tables) -> DataFrame:
    return audit.distincts(audit.audit_view(t.events))


@query("audit_approx_users")
def audit_approx_users(t: Tables) -> DataFrame:
    return audit.approx_users(audit.audit_view(t.events))


@query("audit_time_bucket", VIEW + "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n FROM a GROUP BY 1, 2")
def audit_time_bucket(t: Tables) -> DataFrame:
    return audit.buckets(audit.audit_view(t.events))


@query("audit_tail", VIEW + "SELECT event_id, ts, event_type, outcome FROM a ORDER BY ts DESC, event_id DESC LIMIT 500")
def audit_tail(t: Tables) -> DataFrame:
    return audit.tail(audit.audit_view(t.events)).select("event_id", "ts", "event_type", "outcome")


@query("audit_by_type", VIEW + "SELECT event_type, count(*) AS n FROM a GROUP BY 1")
def audit_by_type(t: Tables) -> DataFrame:
    return audit.by(audit.audit_view(t.events), "event_type")


@query("audit_by_resource", VIEW + "SELECT coalesce(resource_type, 'N/A') AS resource_type, count(*) AS n FROM a GROUP BY 1")
def audit_by_resource(t: Tables) -> DataFrame:
    return audit.by(audit.audit_view(t.events), "resource_type")


@query("audit_by_outcome", VIEW + "SELECT outcome, count(*) AS n FROM a GROUP BY 1")
def audit_by_outcome(t: Tables) -> DataFrame:
    return audit.by(audit.audit_view(t.events), "outcome")


@query("audit_top_users", VIEW + "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types, max(ts) AS last_activity FROM a GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def audit_top_users(t: Tables) -> DataFrame:
    return audit.top_users(audit.audit_view(t.events))


@query("audit_top_resources", VIEW + "SELECT resource_type, resource_id, count(*) AS n FROM a WHERE resource_type IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, resource_type, resource_id LIMIT 20")
def audit_top_resources(t: Tables) -> DataFrame:
    return audit.top_resources(audit.audit_view(t.events))


@query("audit_rates", VIEW + "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS n, count(*) FILTER (outcome = 'Failure') AS failures, count(*) / 3600 AS rate, count(*) FILTER (outcome = 'Failure') / count(*) AS failure_ratio FROM a GROUP BY 1")
def audit_rates(t: Tables) -> DataFrame:
    log = audit.audit_view(t.events).withColumn("ts", F.col("ts").cast("timestamp"))
    return audit.rates(log).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("audit_quantiles", "SELECT event_type, quantile_cont(value, 0.5)::DECIMAL(18, 6)::DOUBLE AS p50, quantile_cont(value, 0.9)::DECIMAL(18, 6)::DOUBLE AS p90, quantile_cont(value, 0.99)::DECIMAL(18, 6)::DOUBLE AS p99 FROM events GROUP BY 1")
def audit_quantiles(t: Tables) -> DataFrame:
    q = audit.value_quantiles(t.events)
    return q.select("event_type", *[F.col(c).cast("decimal(18,6)").cast("double").alias(c) for c in ("p50", "p90", "p99")])


@query("audit_rollup", VIEW + "SELECT event_type, outcome, count(*) AS n, CAST(GROUPING(event_type, outcome) AS INTEGER) AS level FROM a GROUP BY ROLLUP (event_type, outcome)")
def audit_rollup(t: Tables) -> DataFrame:
    return audit.rollup_counts(audit.audit_view(t.events))


@query(
    "audit_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
       SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, s""",
)
def audit_sessions(t: Tables) -> DataFrame:
    """Extension: sessions of a user with gaps under half an hour."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query("audit_rollup_range", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1")
def audit_rollup_range(t: Tables) -> DataFrame:
    """Counts of a range of hours out of the stored roll-up alone."""
    return _range(t).select("event_type", "n")


@query("audit_sketches")
def audit_sketches(t: Tables) -> DataFrame:
    """(event_type, n, users, p50, p90, p99) of a range of hours out of the stored sketches alone."""
    return read_rollup(_range(t)).select("event_type", "n", "users", "p50", "p90", "p99")


def _range(t: Tables) -> DataFrame:
    from weftlake.session import stash

    rollup = stash(audit.hourly(t.events), "rollup")
    kept = rollup.filter("bucket >= TIMESTAMP '2024-01-02' AND bucket < TIMESTAMP '2024-01-20 12:00:00'")
    return merged_rollup(kept, ["event_type"])
