"""Splits and samples of exact size, ranked by md5 of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def place(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def cuts(df: DataFrame, key: str, seed: int, ranks, digits: int = 4, stratum: str | None = None) -> tuple[int, dict]:
    """Rows of `df`, and the (place, key) that has each of the ranks asked for, by (stratum, rank); ranks is made from the count.

    No task sees all rows: counts by the first digits of the place find the bin of a rank, and only that bin is ordered, up to the
    rank. The driver gets 16 ** digits counts at most for each stratum.
    """
    placed = df.select(place(seed, key).alias("place"), F.col(key).alias("key"), (F.col(stratum) if stratum else F.lit("")).alias("stratum"))
    counts = placed.groupBy("stratum", F.substring("place", 1, digits).alias("bin")).count().collect()
    bins = sorted((r.stratum, r.bin or "", r["count"]) for r in counts)
    found = {}
    for s, rank in ranks(sum(n for *_, n in bins)):
        left = rank
        for name, start, n in bins:
            if name != s or rank <= 0:
                continue
            if left <= n:
                near = placed.where((F.col("stratum") == s) & F.coalesce("place", F.lit("")).startswith(start)).orderBy("place", "key")
                found[s, rank] = tuple(near.offset(left - 1).limit(1).first()[:2])
                break
            left -= n
    return sum(n for *_, n in bins), found


def upto(cut: tuple | None, seed: int, key: str) -> Column:
    """Whether a row stands at or before a cut; none does before the first."""
    if cut is None:
        return F.lit(False)
    at = place(seed, key)
    return (at < cut[0]) | ((at == cut[0]) & (F.col(key) <= F.lit(cut[1])))


def group_split(df: DataFrame, key: str, ratios: tuple[float, float, float], seed: int = 42, buckets: bool = False) -> DataFrame:
    """`df` with split: all rows of an id go together; sizes are round-half-even shares of the ids, at least one each for
    val and test from three ids on. With `buckets` the share is by hash alone, without a global rank (approximate sizes).
    """
    train, val, test = ratios
    if abs(sum(ratios) - 1) > 1e-4:
        raise ValueError("ratios must add up to 1")
    ids = df.select(key).distinct()
    if buckets:
        u = F.conv(F.substring(place(seed, key), 1, 8), 16, 10).cast("double") / float(1 << 32)
        return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))
    sizes = {}

    def ranks(n: int):
        n_val, n_test = round(n * val), round(n * test)
        if n >= 3:
            n_val, n_test = max(1, n_val), max(1, n_test)
        sizes.update(train=n - n_val - n_test, val=n - n_test)
        return [("", r) for r in sizes.values()]

    _, found = cuts(ids, key, seed, ranks)
    train_cut, val_cut = (upto(found.get(("", r)), seed, key) for r in sizes.values())
    return df.withColumn("split", F.when(train_cut, "train").when(val_cut, "val").otherwise("test"))


def row_split(df: DataFrame, key: str, ratios: tuple[float, float, float], seed: int = 42) -> DataFrame:
    """Truncated sizes, at least one train row; what is left is test. Rows that repeat a key stay together."""
    if not 0.99 <= sum(ratios) <= 1.01:
        raise ValueError("ratios must add up to 1")
    sizes = {}

    def ranks(n: int):
        sizes["train"] = max(1, int(n * ratios[0]))
        sizes["val"] = min(n, sizes["train"] + int(n * ratios[1]))
        return [("", min(n, r)) for r in sizes.values()]

    _, found = cuts(df, key, seed, ranks)
    train_cut, val_cut = (upto(found.get(("", r)), seed, key) for r in sizes.values())
    return df.withColumn("split", F.when(train_cut, "train").when(val_cut, "val").otherwise("test"))


def split_summary(df: DataFrame, key: str) -> DataFrame:
    out = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("ids"))
    share = F.round(F.col("rows") * 100.0 / F.sum("rows").over(W.partitionBy()), 4)
    return out.withColumn("percent", share)


def stratified(df: DataFrame, stratum: str, key: str, shares: dict[str, float], total: int, seed: int = 42) -> DataFrame:
    """Exactly `total` rows: each stratum's rounded share, the residue with the first; too small a pool is an error."""
    quota = {s: round(total * share) for s, share in shares.items()}
    quota[next(iter(quota))] += total - sum(quota.values())
    have = {r[0]: r[1] for r in df.where(F.col(stratum).isin(*shares)).groupBy(stratum).count().collect()}
    for s, n in quota.items():
        if have.get(s, 0) < n:
            raise ValueError(f"stratum {s} has {have.get(s, 0)} rows of {n}")
    pool = df.where(F.col(stratum).isin(*shares))
    _, found = cuts(pool, key, seed, lambda _: list(quota.items()), 3, stratum)
    picked = F.lit(False)
    for s, n in quota.items():
        picked = picked | ((F.col(stratum) == s) & upto(found.get((s, n)), seed, key))
    return pool.where(picked)
