"""Queries that run the streaming operators over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import lifecycle as L
from .queries_memory import ACTIONS_SQL, _remarks
from .registry import query
from .streaming import streams as X


#: Rows of the table come in any order within its time; state is kept that long.
LATE = "60 days"


@query(
    "t02_session_windows",
    """WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
      SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 7200000000)::INT, 0) AS new FROM events))
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, session""",
)
def _(spark, d):
    out = X.drain_all(X.session_windows(X.event_stream(spark, d), "user_id", late=LATE), "sessions", lambda s: X.open_sessions(s, "user_id"))
    return out.select("user_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "n")


@query(
    "t03_drop_adjacent",
    "SELECT event_id, user_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)",
)
def _(spark, d):
    return X.drain(X.drop_adjacent(X.event_stream(spark, d), "user_id", "event_id", "event_type"), "adjacent")


@query(
    "t04_upsert_changes",
    """SELECT event_id, user_id, event_type, CASE WHEN b <> event_type THEN b END AS replaced, CASE WHEN b IS NULL THEN 'insert' WHEN b = event_type THEN 'merge' ELSE 'supersede' END AS change
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)""",
)
def _(spark, d):
    return X.drain(X.upsert_changes(X.event_stream(spark, d), "user_id", "event_id", "event_type"), "upsert")


@query("t04_life_cycle", ACTIONS_SQL)
def _(spark, d):
    with X.rocksdb(spark):
        return X.drain(L.stream_actions(_remarks(spark, d, X.event_stream(spark, d))), "memories")


@query(
    "t05_marker_rates",
    "SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS start_us, count(*) AS n, count_if(event_type = 'purchase')::BIGINT AS hits FROM events GROUP BY 1",
)
def _(spark, d):
    flag = F.col("event_type") == "purchase"
    rates = X.marker_rates(X.event_stream(spark, d), flag, "1 day", late=LATE)
    return X.drain_all(rates, "rates", X.open_rates).select(F.unix_micros("start_ts").alias("start_us"), "n", "hits")


@query("t06_validated_batches", "SELECT count(*) AS n FROM events WHERE length(props) > 10")
def _(spark, d):
    out = X.shared_path(spark, "validated")
    X.validate_batches(X.event_stream(spark, d), X.element_issues, lambda b: b.where(F.length("props") <= 10), out)
    return spark.read.parquet(out + "/issues").agg(F.count(F.lit(1)).alias("n"))
