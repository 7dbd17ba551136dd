"""Running numbers along an order, with the rows of one key spread over tasks.

A key's rows are cut into ranges of the order. What opens a run is found within each range; of each range, only its first and last
row and its number of runs meet, in a carry table of one row for each (key, range), which gives the runs before it. A key that
holds a third of all rows is worked on by as many tasks as there are ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cuts(df: DataFrame, order: str, rows: int = 2_000_000) -> list[float]:
    """Values of a numeric order that cut `df` into ranges of about `rows` rows, all keys together; none for a small table."""
    n = df.count()
    k = min(-(-n // rows), 4096)
    return sorted(set(df.approxQuantile(order, [i / k for i in range(1, k)], 0.1 / k))) if k > 1 else []


def _range(order: str, at: list[float]) -> Column:
    if not at:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, at)), lambda c: c <= F.col(order)))


def numbered(
    df: DataFrame, keys: list[str], order: str, seen: list[str], opens: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    name: str, first: int = 0, at: list[float] | None = None,
) -> DataFrame:
    """`df` with `name`: the number of its row's run of the keys, the first run being `first`.

    opens(now, before): whether a row opens a run, from its columns `seen` and those of the row before it; null is no. The first row
    of a key opens none. order: unique within the keys and not null. at: where to cut it (`cuts`); not at all by default.
    """
    df = df.withColumn("_range", _range(order, at or []))
    w = W.partitionBy(*keys, "_range").orderBy(order)
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    new = F.when(F.lag(F.lit(1)).over(w).isNull(), 0).otherwise(yes(opens(F.col, lambda c: F.lag(c).over(w))))
    run = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_new", new).withColumn("_run", run)
    if not at:
        return df.withColumn(name, F.col("_run").cast("long") + first).drop("_range", "_new", "_run")
    row = F.struct(*seen)
    edges = df.groupBy(*keys, "_range").agg(F.min_by(row, order).alias("_a"), F.max_by(row, order).alias("_z"), F.sum("_new").alias("_n"))
    by = W.partitionBy(*keys).orderBy("_range")
    edges = edges.withColumn("_before", F.lag("_z").over(by))
    edges = edges.withColumn("_open", F.when(F.col("_before").isNull(), 0).otherwise(yes(opens(lambda c: F.col("_a")[c], lambda c: F.col("_before")[c]))))
    base = F.sum(F.col("_n") + F.col("_open")).over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    edges = edges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), base.alias("_base"))
    match = F.col("_range") == F.col("_r")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = df.join(edges, match, "left")
    return joined.withColumn(name, (F.col("_run") + F.col("_base")).cast("long") + first).drop("_range", "_new", "_run", "_r", "_base", *[f"_{k}" for k in keys])
