"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import decimal

import pytest
from pyspark.sql import Window

import convlake.catalog  # noqa: F401
from convlake.registry import QUERIES, SQL

from .conftest import SF


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v != v:
        return "null"
    if isinstance(v, (bool, str, datetime.datetime)):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(round(float(v), 6))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_streaming_sessions_agree_with_batch(spark):
    """All sessions that the stream closes are sessions of the batch form."""
    from pyspark.sql import functions as F

    from convlake.operators.sessions import micros, sessionize
    from convlake.registry import table

    live = {tuple(r) for r in QUERIES["t02_session_windows"](spark, SF).select("user_id", "start_us", "n").collect()}
    s = sessionize(table(spark, SF, "events"), "user_id", "event_id", "ts", 120)
    whole = s.groupBy("user_id", "session").agg(micros(F.min("ts")).alias("a"), F.count(F.lit(1)).alias("n"))
    assert live and live <= {(r.user_id, r.a, r.n) for r in whole.collect()}


def test_streaming_windows_are_whole(spark, tmp_path):
    """Sessions and rates of the queries are those of the batch forms, also where files come one by one, the latest first."""
    from pyspark.sql import functions as F

    from convlake.operators.sessions import micros, sessionize
    from convlake.registry import table
    from convlake.streaming import streams as X

    events = table(spark, SF, "events")
    s = sessionize(events, "user_id", "event_id", "ts", 120)
    sessions = s.groupBy("user_id", "session").agg(micros(F.min("ts")).alias("a"), F.count(F.lit(1)).alias("n"))
    sessions = sorted((r.user_id, r.a, r.n) for r in sessions.collect())
    day = F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("a")
    rates = events.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("hits"))
    rates = sorted(tuple(r) for r in rates.collect())
    assert sorted(tuple(r) for r in QUERIES["t02_session_windows"](spark, SF).select("user_id", "start_us", "n").collect()) == sessions
    assert sorted(tuple(r) for r in QUERIES["t05_marker_rates"](spark, SF).collect()) == rates

    (tmp_path / "events.parquet").mkdir()
    parts = events.withColumn("k", F.ntile(3).over(Window.orderBy(F.desc("ts"))))
    for k in (1, 2, 3):
        parts.where(f"k = {k}").drop("k").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = lambda: X.event_stream(spark, str(tmp_path), files=1)
    got = X.drain(X.session_windows(stream(), "user_id", late=None), "sessions", "complete").select("user_id", F.unix_micros("start_ts"), "n")
    assert sorted(tuple(r) for r in got.collect()) == sessions
    got = X.drain(X.marker_rates(stream(), F.col("event_type") == "purchase", late=None), "rates", "complete").select(F.unix_micros("start_ts"), "n", "hits")
    assert sorted(tuple(r) for r in got.collect()) == rates


def test_retrieval_job(spark):
    """Five others for each query, by the whole score; inactive rows stay out; text stands in for missing vectors."""
    import math

    from pyspark.sql import functions as F

    from convlake.operators import memory as M
    from convlake.registry import table

    rows = [(r.vec_id, r.label, [float(x) for x in r.embedding]) for r in table(spark, SF, "embeddings").collect()]
    unit = {k: [x / math.sqrt(sum(y * y for y in v)) for x in v] for k, _, v in rows}
    want = set()
    for q, label, _ in rows:
        if q % 20 == 0:
            scored = []
            for m, other, _ in rows:
                if other == label and m != q:
                    cos = max(0.0, min(1.0, sum(x * y for x, y in zip(unit[q], unit[m]))))
                    s = 0.4 * cos + 0.3 * (m % 2) + 0.2 * (1.0, 0.6, 0.2)[m % 3] + 0.1 * math.exp(-(m % 90) / 30)
                    scored.append((-round(s, 4), -(m % 90), m))
            want |= {(q, x[2], i + 1) for i, x in enumerate(sorted(scored)[:5])}
    assert {tuple(r) for r in QUERIES["m14_retrieval_job"](spark, SF).collect()} == want

    q = spark.createDataFrame([(1, 7, None, " ", "red tea cup", "x"), (2, 7, None, None, " ", "Food")], "q_id long, p long, explicit string, context string, turn string, q_topic string")
    q = q.withColumn("q_text", M.query_text(F.col("explicit"), F.col("context"), F.col("turn"), F.col("q_topic")))
    assert [r.q_text for r in q.orderBy("q_id").collect()] == ["red tea cup", "Food"]
    kept = "m_id long, p long, m_text string, m_topic string, m_importance string, m_age_days double, status string"
    m = [(1, 7, "red tea cup", None, "low", 900.0, "superseded"), (2, 7, "red tea", None, "low", 900.0, "active"), (3, 7, "green", "food", "low", 900.0, "active"), (4, 7, "blue", None, "high", 900.0, "active"), (5, 8, "red tea cup", "food", "high", 0.0, "active")]
    m = spark.createDataFrame(m, kept)
    got = lambda **o: [(r.q_id, r.m_id) for r in M.retrieve(q, m, "p", 2, **o).orderBy("q_id", "rank").collect()]
    assert got() == [(1, 2), (1, 4), (2, 3), (2, 4)]
    assert got(keywords={"food": ["tea"]}) == [(1, 3), (1, 2), (2, 3), (2, 4)]
