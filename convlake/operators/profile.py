"""Profiles: totals, lengths, rates, frequencies, concentration, percentiles."""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from . import quantiles as Q


def top_k(df: DataFrame, term: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.groupBy(term).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), term).limit(k)


def terms(df: DataFrame, text: str, longer: int = 1) -> DataFrame:
    t = F.filter(T.tokens(F.col(text)), lambda w: F.length(w) > longer)
    return df.select(F.explode(t).alias("term"))


def bigrams(df: DataFrame, text: str, among: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs of neighbouring words; with `among`, those of which it takes both words."""
    t = T.tokens(F.col(text))
    one = df.select((F.transform(t, lambda w: F.when(among(w), w)) if among else t).alias("t"))
    after = F.slice("t", 2, F.greatest(F.size("t"), F.lit(1)))
    pairs = F.zip_with("t", after, lambda a, b: F.concat(a, F.lit(" "), b))  # null where a word is, or after the last
    return one.select(F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("term"))


def top_bigrams(df: DataFrame, text: str, k: int, places: int = 1 << 16) -> DataFrame:
    """The k most frequent pairs of neighbouring words; ties by value. Exact, and rare words make no pairs to be counted.

    A pair is no more frequent than its words, and a word no more than all words of its hash, of `places` values. So words are counted
    by hash, then pairs of words with frequent hashes: first those that reach half of what the kth pair would have if words followed
    each other by chance. The kth count found is one that the kth pair has at least; if it is lower, pairs of all words that reach it are counted.
    """
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(places)).cast("int")
    words = df.select(F.explode(T.tokens(F.col(text))).alias("w"))
    seen = [tuple(r) for r in words.groupBy(place("w")).count().collect()]
    first = heapq.nlargest(k, (n for _, n in seen))
    chance = heapq.nlargest(k, (a * b for a in first for b in first))[-1:]

    def top(least: int) -> DataFrame:
        reach = bytearray(places)
        for p, n in seen:
            reach[p] = n >= least
        table, yes = F.lit(bytes(reach)), F.lit(b"\x01")
        return top_k(bigrams(df, text, lambda w: F.substring(table, place(w) + 1, F.lit(1)) == yes), "term", k)

    least = max(sum(chance) // (2 * max(sum(n for _, n in seen), 1)), 1)
    got = top(least)
    found = got.collect()
    reached = found[-1]["n"] if len(found) == k else 1
    if any(reached <= n < least for _, n in seen):
        return top(reached)
    return df.sparkSession.createDataFrame(found, got.schema).orderBy(F.desc("n"), "term")


def length_stats(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rows, means and exact medians of characters and words; for no key, one row."""
    df = df.select(*keys, F.length(text).alias("chars"), F.size(T.words(F.col(text))).alias("words"))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("chars"), 4).alias("mean_chars"), F.round(F.avg("words"), 4).alias("mean_words"))
    for c in ("chars", "words"):
        out = _with(out, Q.percentiles(df, keys, c, {f"median_{c}": 0.5}), keys)
    return out


def rates(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Shares of rows to four places; 0 for no rows."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.agg(*[F.round(F.count_if(c) / n, 4).alias(k) for k, c in flags.items()])


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """`left` with the other columns of `right`, which has a row for each key at most; null keys match."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(right, match, "left").drop(*[f"_{k}" for k in keys])


def percentiles(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, median and interpolated percentiles to two places; zeros for nothing. Exact, without a sort or a buffer of a group."""
    p = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(F.col(value).cast("double")).alias("max"))
    out = _with(out, Q.percentiles(df, keys, value, p), keys)
    return out.select(*keys, *[F.coalesce(F.round(c, 2), F.lit(0.0)).alias(c) for c in ("mean", *p, "max")])


def dominance(df: DataFrame, key: str, ks: list[int]) -> DataFrame:
    """Share of rows in the k largest groups, or in all where there are fewer; only the largest max(ks) groups are ranked."""
    g = df.groupBy(key).count()
    w = W.orderBy(F.desc("count"), key)
    top = g.orderBy(F.desc("count"), key).limit(max(ks))
    top = top.withColumns({"r": F.row_number().over(w), "c": F.sum("count").over(w.rowsBetween(W.unboundedPreceding, 0))})
    total = g.agg(F.sum("count").alias("t"), F.count(F.lit(1)).alias("groups"))
    rows = top.join(F.broadcast(total)).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return rows.where(F.col("r") == F.least("k", "groups")).select("k", F.col("c").alias("rows"), F.round(F.col("c") * 100.0 / F.col("t"), 4).alias("percent"))


def crosstab(df: DataFrame, split: str, category: str) -> DataFrame:
    g = df.groupBy(split, category).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(split)), 4))


def lower_median(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The value at place n div 2 of the sorted rows that have one."""
    got = Q.at_ranks(df, keys, value, F.array(F.floor(F.col("n") / 2)))
    return got.select(*keys, F.col("v").cast(df.schema[value].dataType).alias("lower_median"))


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Counts and accuracy for each expected class, and overall (null class), in one pass."""
    right = F.count_if(F.col(expected) == F.col(predicted))
    n = F.count(F.lit(1))
    return df.rollup(expected).agg(n.alias("n"), right.alias("right"), F.round(right / n, 4).alias("accuracy"))


def confidence_profile(df: DataFrame, by: str, key: str, confidence: str, score: str, samples: int = 10) -> DataFrame:
    """One row for each value of `by`: rows, percent of all, mean, least and highest confidence, mean score, and the keys of the surest rows.

    samples: at most so many keys, by confidence (highest first), then key.
    """
    top = df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(confidence), key))).where(F.col("_r") <= samples)
    top = top.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_r", key))).getField(key).alias("samples"))
    n = F.count(F.lit(1))
    out = df.groupBy(by).agg(
        n.alias("n"), F.round(F.avg(F.col(confidence).cast("decimal(12,6)")), 4).cast("double").alias("mean_confidence"), F.min(confidence).alias("least"), F.max(confidence).alias("most"), F.round(F.avg(score), 4).alias("mean_score")
    )
    whole = F.sum("n").over(W.partitionBy(F.lit(1)))  # of the groups, not of rows
    return out.withColumn("percent", F.round(F.col("n") * 100.0 / whole, 2)).join(top, by, "left")


def ambiguous_prompts(pairs: DataFrame, prompt: str, response: str, priority: list[str], most_words: int = 4, least: int = 2) -> DataFrame:
    """prompt, responses, priority: whole prompts of at most `most_words` words that got `least` or more different responses.

    Prompts are compared without punctuation, blanks folded, every word capitalised. priority: whether one of these words stands in it.
    """
    norm = T.capitalised(T.strip(F.regexp_replace(F.regexp_replace(F.col(prompt), r"[^\p{L}\p{N}\s]", " "), r"\s+", " ")))
    df = pairs.select(norm.alias("prompt"), F.col(response).alias("_r")).where("prompt <> '' AND _r IS NOT NULL").where(F.size(F.split("prompt", " ")) <= most_words)
    out = df.groupBy("prompt").agg(F.count_distinct("_r").alias("responses")).where(F.col("responses") >= least)
    return out.withColumn("priority", F.arrays_overlap(F.split(F.lower("prompt"), " "), F.array(*map(F.lit, priority))))
