"""Ordered operators: gap sessions, bursts of one speaker, adjacent duplicates, minimum turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordered import numbered


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sessionize(df: DataFrame, key: str, order: str, ts: str, gap_minutes: float, at: list[float] | None = None) -> DataFrame:
    """Adds session (from 0): a new one where the gap to the row before is strictly over `gap_minutes`.

    A row without time, or after one without, opens none; rows keep file order, so a clock that goes back opens none.
    at: values of `order` that cut a key's rows into ranges for tasks of their own (`ordered.cuts`).
    """
    limit = int(gap_minutes * 60_000_000)
    return numbered(df, [key], order, [ts], lambda now, before: micros(now(ts)) - micros(before(ts)) > limit, "session", at=at)


def bursts(df: DataFrame, keys: list[str], order: str, speaker: str, text: str, ts: str, at: list[float] | None = None) -> DataFrame:
    """Runs of one speaker become a turn: text joined by line ends, first and last time, ids in order. at: as in sessionize."""
    df = numbered(df, keys, order, [speaker], lambda now, before: ~now(speaker).eqNullSafe(before(speaker)), "_turn", at=at)
    part = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    out = df.groupBy(*keys, F.col("_turn").alias("turn")).agg(
        F.first(speaker).alias("speaker"),
        part.alias("_p"),
        F.min_by(ts, order).alias("start_ts"),
        F.max_by(ts, order).alias("end_ts"),
    )
    return out.withColumns(
        {"text": F.array_join(F.transform("_p", lambda p: p["t"]), "\n"), "message_ids": F.transform("_p", lambda p: p["o"])}
    ).drop("_p")


def session_summary(df: DataFrame, keys: list[str], order: str, ts: str, persona: Column) -> DataFrame:
    """First and last time in file order, minutes (not under 0), rows, and whether both sides speak."""
    out = df.groupBy(*keys).agg(
        F.min_by(ts, order).alias("start_ts"),
        F.max_by(ts, order).alias("end_ts"),
        F.count(F.lit(1)).alias("n_messages"),
        F.bool_or(persona).alias("has_persona"),
        F.bool_or(~persona).alias("has_user"),
    )
    minutes = (micros(F.col("end_ts")) - micros(F.col("start_ts"))) / 60_000_000.0
    return out.withColumn("minutes", F.greatest(F.lit(0.0), minutes))


def qualified(summary: DataFrame, min_messages: int) -> DataFrame:
    return summary.where((F.col("n_messages") >= min_messages) & F.col("has_persona") & F.col("has_user"))


def drop_adjacent_duplicates(df: DataFrame, keys: list[str], order: str, same: list[str]) -> DataFrame:
    """Rows that differ from the row before in one of `same`."""
    w = W.partitionBy(*keys).orderBy(order)
    alike = F.lag(F.lit(True)).over(w).isNotNull()
    for c in same:
        alike = alike & F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("_same", alike).where(~F.col("_same")).drop("_same")


def min_turns(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key))).where(F.col("_n") >= n).drop("_n")
