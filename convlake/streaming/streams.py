"""Ordered operators on Structured Streaming; each has a batch form in `operators`."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import quality as Q


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Where that is unset, under a temporary one in local mode, an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-convlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB for streams that start inside; then the session's setting as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def json_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """Rows of JSON lines files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def event_stream(spark: SparkSession, sf_dir: str, files: int = 100) -> DataFrame:
    """The events table as a stream with an event time."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path + "*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table in the shared folder.

    complete: each batch writes the whole result so far over that of the last batch but one; the last one counts.
    """
    spark = stream.sparkSession
    out = shared_path(spark, name)
    if mode == "complete":
        last = []

        def write(batch: DataFrame, no: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/{no % 2}")
            last[:] = [f"{out}/{no % 2}"]

        whole = stream.writeStream.outputMode(mode).option("checkpointLocation", out + "-state").trigger(availableNow=True)
        whole.foreachBatch(write).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", out + "-state").trigger(availableNow=True)
    writer.format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_all(stream: DataFrame, name: str, still_open: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a windowed stream with a watermark over all that is there: windows that it closed, and those its state still holds at the end.

    The state holds what the watermark has not passed, and is read once after the last batch (the final flush); rows that come
    later than the watermark allows are dropped. still_open: rows of the result from the state's key and value.
    """
    spark = stream.sparkSession
    out = shared_path(spark, name)
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", out + "-state").trigger(availableNow=True)
    run = writer.format("parquet").option("path", out).start()
    run.awaitTermination()
    done = spark.read.schema(stream.schema).parquet(out)
    if not run.lastProgress or not run.lastProgress["stateOperators"]:
        return done
    return done.unionByName(still_open(spark.read.format("statestore").load(out + "-state")))


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late else events


def session_windows(events: DataFrame, key: str, gap: str = "120 minutes", late: str | None = "1 day") -> DataFrame:
    """Sessions by inactivity; rows later than `late` are dropped, the last sessions wait for the watermark. None: all rows count."""
    w = F.session_window("ts", gap)
    g = _marked(events, late).groupBy(F.col(key), w).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n")


def open_sessions(state: DataFrame, key: str) -> DataFrame:
    """Sessions that `session_windows` still holds."""
    w = "value.session_window."
    return state.select(F.col(f"value.{key}"), F.col(w + "start").alias("start_ts"), F.col(w + "end").alias("end_ts"), F.col("value.count").alias("n"))


def marker_rates(events: DataFrame, flag: str, window: str = "1 day", slide: str | None = None, late: str | None = "1 day") -> DataFrame:
    """Running rate of a flag in tumbling, or with `slide` in sliding, windows; `late` as in session_windows."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = _marked(events, late).groupBy(w).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("hits"))
    return g.select(F.col("window.start").alias("start_ts"), "n", "hits", (F.col("hits") / F.col("n")).alias("rate"))


def open_rates(state: DataFrame) -> DataFrame:
    """Windows that `marker_rates` still holds; the state's two counts stand in the order of the aggregates."""
    fields = state.schema["value"].dataType.fields
    value = F.col("value").cast("struct<" + ", ".join(f"v{i}: {f.dataType.simpleString()}" for i, f in enumerate(fields)) + ">")
    n, hits = value[f"v{len(fields) - 2}"], value[f"v{len(fields) - 1}"]
    window = F.col("key")[state.schema["key"].dataType.names[0]]
    return state.select(window["start"].alias("start_ts"), n.alias("n"), hits.alias("hits"), (hits / n).alias("rate"))


def drop_adjacent(events: DataFrame, key: str, order: str, same: str) -> DataFrame:
    """Rows that differ in `same` from the row of their key before; the last value is the state."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(parts)).sort_values(order)
        last = state.get[0] if state.exists else None
        before = df[same].shift(1)
        before.iloc[0] = last
        state.update((df[same].iloc[-1],))
        yield df[df[same] != before]

    kept = events.select(key, order, same)
    return kept.groupBy(key).applyInPandasWithState(step, kept.schema, "last string", "append", GroupStateTimeout.NoTimeout)


def upsert_changes(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Change rows of a slot in arrival order: inserted, merged, or superseding (with the value it replaces)."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(parts)).sort_values(order)
        held = state.get[0] if state.exists else None
        before = df[value].shift(1)
        before.iloc[0] = held
        first = pd.Series(False, index=df.index)
        first.iloc[0] = held is None
        kind = pd.Series("supersede", index=df.index).mask(df[value] == before, "merge").mask(first, "insert")
        state.update((df[value].iloc[-1],))
        yield pd.DataFrame({key: df[key], order: df[order], value: df[value], "replaced": before.where(kind == "supersede", None), "change": kind})

    schema = f"{key} long, {order} long, {value} string, replaced string, change string"
    return events.select(key, order, value).groupBy(key).applyInPandasWithState(step, schema, "held string", "append", GroupStateTimeout.NoTimeout)


def validate_batches(rows: DataFrame, check: Callable[[DataFrame], DataFrame], good: Callable[[DataFrame], DataFrame], out: str) -> None:
    """Good rows and issue rows of each micro-batch go to two tables."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        check(batch).write.mode("append").parquet(out + "/issues")
        good(batch).write.mode("append").parquet(out + "/good")
        batch.unpersist()

    q = rows.writeStream.foreachBatch(write).option("checkpointLocation", out + "/state").trigger(availableNow=True).start()
    q.awaitTermination()


def element_issues(batch: DataFrame) -> DataFrame:
    """Issues of events that stand for messages."""
    return Q.element_checks(batch, "user_id", "event_id", "event_type", "props", None, 10)
