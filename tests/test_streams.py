"""The shared folder of streams."""

from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from convlake.operators.sessions import micros, sessionize
from convlake.streaming import streams as X
from convlake.streaming.streams import shared_path

from .conftest import SF


def session(master: str, conf: dict[str, str]):
    """The settings of a session alone."""
    own = dict(conf)
    settings = SimpleNamespace(get=lambda k, d=None: own.get(k, d), set=own.__setitem__)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=settings)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(session(master, {}), "state")
    assert shared_path(session(master, {"spark.checkpoint.dir": "hdfs:///shared/"}), "state").startswith("hdfs:///shared/state-")


def test_local_mode_takes_a_temporary_folder():
    assert shared_path(session("local[4]", {}), "state").startswith("file:///")


def test_sessions_close_as_time_goes_on(spark, tmp_path):
    """Files in order of time with a day of lateness: all sessions and rates, once each, and a state that stays small."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    src = str(tmp_path / "events.parquet")
    start = events.agg(F.min("ts")).first()[0]
    parts = events.withColumn("k", F.floor(F.datediff("ts", F.lit(start)) / 3))
    for k in range(10):
        parts.where(f"k = {k}").drop("k").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: X.event_stream(spark, str(tmp_path), files=1)
    s = sessionize(events.withColumn("o", F.row_number().over(Window.orderBy("ts", "event_id"))), "user_id", "o", "ts", 120)
    want = sorted(tuple(r) for r in s.groupBy("user_id", "session").agg(micros(F.min("ts")), F.count(F.lit(1))).drop("session").collect())
    got = X.drain_all(X.session_windows(stream(), "user_id", late="1 day"), "sessions", lambda s: X.open_sessions(s, "user_id"))
    assert sorted(tuple(r) for r in got.select("user_id", F.unix_micros("start_ts"), "n").collect()) == want
    rates = X.drain_all(X.marker_rates(stream(), F.col("event_type") == "purchase", late="1 day"), "rates", X.open_rates)
    day = F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp")))
    want_rates = sorted(tuple(r) for r in events.groupBy(day).agg(F.count(F.lit(1)), F.count_if(F.col("event_type") == "purchase")).collect())
    assert sorted(tuple(r) for r in rates.select(F.unix_micros("start_ts"), "n", "hits").collect()) == want_rates

    out = shared_path(spark, "metrics")
    q = X.session_windows(stream(), "user_id", late="1 day").writeStream.option("checkpointLocation", out + "-state").trigger(availableNow=True).format("noop").start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len(held) >= 10 and max(held) < 0.3 * len(want)


def test_an_empty_stream_has_no_sessions(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    spark.read.parquet(f"{SF}/events.parquet").limit(0).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    got = X.drain_all(X.session_windows(X.event_stream(spark, str(tmp_path)), "user_id"), "sessions", lambda s: X.open_sessions(s, "user_id"))
    assert got.count() == 0
