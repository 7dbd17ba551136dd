"""Exact order statistics of groups by repeated binning: no task sorts or holds a group's values.

Equal values are counted together first. A range of values that holds a wanted rank is cut into bins, the bins are counted (with partial
counts before the shuffle), and the range becomes the bin in which the rank falls, narrowed to the values that are there. It ends when a
range is one value: after one round for up to `bins` evenly spread values, and a few more for others. A round moves counts of bins only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _keep(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, so that rounds do not pile up."""
    from ..streaming.streams import shared_path

    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(keys: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: Column, bins: int = 1024) -> DataFrame:
    """keys, n (values of the group), rank and v, the value at each rank from 0.

    ranks: an array of ranks made from the column n. Values count as doubles; null, NaN and infinite ones do not count. Groups without
    values have no row.
    """
    d = df.where(F.abs(F.col(value).cast("double")) < float("inf")).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    d = _keep(d, "quantiles-values")
    groups = d.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    wanted = groups.withColumn("rank", F.explode(F.array_distinct(ranks))).withColumn("before", F.lit(0).cast("long"))
    wanted = _keep(wanted.select(*keys, "n", F.col("rank").cast("long").alias("rank"), "lo", "hi", "before"), "quantiles-ranks")
    while wanted.where("lo < hi").limit(1).count():
        spans = wanted.where("lo < hi").select(*keys, "lo", "hi").distinct()
        within = _same(keys, "d", "s") & F.col("d.v").between(F.col("s.lo"), F.col("s.hi"))
        half = F.col("s.hi") / 2 - F.col("s.lo") / 2  # the width itself could pass the largest double
        part = F.when(half > 0, (F.col("d.v") / 2 - F.col("s.lo") / 2) / half).otherwise((F.col("d.v") > F.col("s.lo")).cast("double"))
        place = F.least(F.lit(bins - 1), F.floor(part * bins)).cast("int")
        cells = d.alias("d").join(spans.alias("s"), within)
        cells = cells.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), place.alias("bin"))
        cells = cells.agg(F.sum("d.c").alias("c"), F.min("d.v").alias("least"), F.max("d.v").alias("most"))
        w = W.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # at most `bins` rows
        cells = cells.withColumn("upto", F.sum("c").over(w))
        inside = _same(keys, "r", "c") & (F.col("r.lo") == F.col("c.lo")) & (F.col("r.hi") == F.col("c.hi"))
        left = F.col("r.rank") - F.col("r.before")
        inside = inside & (left < F.col("c.upto")) & (left >= F.col("c.upto") - F.col("c.c"))
        found = wanted.where("lo < hi").alias("r").join(cells.alias("c"), inside)
        found = found.select(*[F.col(f"r.{k}").alias(k) for k in keys], "r.n", "r.rank", F.col("c.least").alias("lo"), F.col("c.most").alias("hi"), (F.col("r.before") + F.col("c.upto") - F.col("c.c")).alias("before"))
        wanted = _keep(found.unionByName(wanted.where("NOT lo < hi")), "quantiles-ranks")
    return wanted.select(*keys, "n", "rank", F.col("lo").alias("v"))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = 1024) -> DataFrame:
    """keys and a column for each share: percentiles, between two values in proportion to where the share falls."""
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    both = [F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares.values()]
    got = at_ranks(df, keys, value, F.flatten(F.array(*both)), bins)
    of = lambda c: F.max(F.when(F.col("rank") == c, F.col("v")))
    out = got.groupBy(*keys, "n").agg(*[x for name, q in shares.items() for x in (of(F.floor(place(q))).alias(f"{name}_a"), of(F.ceil(place(q))).alias(f"{name}_b"))])
    value_at = lambda name, q: F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * (place(q) - F.floor(place(q)))
    return out.select(*keys, *[value_at(name, q).alias(name) for name, q in shares.items()])
