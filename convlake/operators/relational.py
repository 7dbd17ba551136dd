"""Joins and lookups of the four-table store, and split bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered


def name_join(left: DataFrame, names: DataFrame, key: str, name: str, default: str) -> DataFrame:
    """`left` with the name of its key, `default` where there is none."""
    return left.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def counts_join(left: DataFrame, many: DataFrame, key: str, as_name: str) -> DataFrame:
    """`left` with the number of rows of `many` for its key, 0 where there is none."""
    n = many.groupBy(key).agg(F.count(F.lit(1)).alias(as_name))
    return left.join(n, key, "left").withColumn(as_name, F.coalesce(as_name, F.lit(0)))


def not_deleted(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(F.col(status) != "DELETED")


def search(df: DataFrame, text: list[str], wanted: str, key: str, value: str = "all") -> DataFrame:
    """Case-insensitive substring in any of `text`, and `key` equal to `value` unless that is `all`."""
    hit = F.lit(False)
    for c in text:
        hit = hit | F.coalesce(F.lower(c).contains(wanted.lower()), F.lit(False))
    return df.where(hit if value == "all" else hit & (F.col(key) == value))


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split: one shuffle instead of pairwise intersections."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def reconcile(source: DataFrame, derived: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that miss on one side or differ in `value`."""
    a = source.select(*keys, F.col(value).alias("source_value"), F.lit(True).alias("_s"))
    b = derived.select(*keys, F.col(value).alias("derived_value"), F.lit(True).alias("_d"))
    both = a.join(b, keys, "full")
    kind = F.when(F.col("_d").isNull(), "missing").when(F.col("_s").isNull(), "extra")
    kind = kind.when(~F.col("source_value").eqNullSafe(F.col("derived_value")), "changed")
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).drop("_s", "_d")


def by_place(source: DataFrame, derived: DataFrame, keys: list[str], order: str, values: list[str], at: list[float] | None = None) -> DataFrame:
    """keys, place, kind of what differs between two tables compared row by row: the n-th row of a key with the n-th.

    kind: missing or extra where one side has fewer rows, else `changed_` and a column of `values`, one row for each. Places are counted in
    ranges of the order, so that a hot key is spread (`ordered.numbered`).
    """
    place = lambda df: numbered(df.select(*keys, order, *[v for v in values if v != order]), keys, order, [order], lambda now, before: F.lit(True), "place", at=at)
    a, b = (place(df).select(*[F.col(c).alias(f"{p}_{c}") for c in [*keys, "place", *values]]) for df, p in ((source, "a"), (derived, "b")))
    match = F.col("a_place") == F.col("b_place")
    for k in keys:
        match = match & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    both = a.join(b, match, "full")
    kinds = [F.when(F.col("b_place").isNull(), "missing"), F.when(F.col("a_place").isNull(), "extra")]
    here = F.col("a_place").isNotNull() & F.col("b_place").isNotNull()
    kinds += [F.when(here & ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")), f"changed_{v}") for v in values]
    own = [F.when(F.col("a_place").isNotNull(), F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")).alias(k) for k in keys]
    return both.select(*own, F.coalesce("a_place", "b_place").alias("place"), F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def same_runs(runs: list[DataFrame]) -> DataFrame:
    """n, runs and same: whether the tables have the same rows, whatever their order."""
    prints = [fingerprint(df) for df in runs]
    out = prints[0]
    for p in prints[1:]:
        out = out.unionByName(p)
    return out.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("runs"), ((F.count_distinct("hash") == 1) & (F.count_distinct("n") == 1)).alias("same"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free hash of a table."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("hash"))


def tag_union(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """All parts with their tag."""
    out = None
    for tag, df in parts.items():
        df = df.withColumn(name, F.lit(tag))
        out = df if out is None else out.unionByName(df)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in [0, 1]; 0 for null, empty, unequal or zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    size = norm(a) * norm(b)
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.when(fit, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / size))).otherwise(0.0)
