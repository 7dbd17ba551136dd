"""Phrases of a lexicon in texts, by a tree of words: one join for each word of the longest phrase, however many phrases there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_SEP = "\x01"


def trie(lexicon: DataFrame, phrase: str = "phrase") -> tuple[DataFrame, int]:
    """(level, node, token, child: the edges of the tree, a node being its path; words of the longest phrase). Phrases without words have none."""
    words = lexicon.select(T.tokens(F.coalesce(phrase, F.lit(""))).alias("w")).where(F.size("w") > 0).distinct()
    path = lambda k: F.array_join(F.slice("w", F.lit(1), k), _SEP)
    steps = words.select("w", F.posexplode("w").alias("level", "token"))
    edges = steps.select("level", path(F.col("level")).alias("node"), "token", path(F.col("level") + 1).alias("child")).distinct()
    return edges, words.agg(F.max(F.size("w"))).first()[0] or 0


def phrase_hits(texts: DataFrame, key: list[str], text: str, lexicon: DataFrame, phrase: str = "phrase", few: int = 200_000) -> DataFrame:
    """key, place (from 0), the lexicon's columns: every occurrence of every phrase as a run of words, overlaps included.

    Words are lower-cased as in `text.tokens`. Phrases of equal words are all reported. Null and empty texts and phrases have no hits.
    few: edges up to which the tree is broadcast; a larger one is joined by shuffle.
    """
    edges, longest = trie(lexicon, phrase)
    small = edges.limit(few + 1).count() <= few
    side = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    names = [F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]
    at = texts.select(*names, T.tokens(F.coalesce(text, F.lit(""))).alias("_t"))
    at = at.select(*[f"_k{i}" for i in range(len(key))], F.posexplode(F.transform("_t", lambda x, i: F.slice("_t", i + 1, max(longest, 1)))).alias("place", "_run"))
    at = at.withColumns({"_node": F.lit(""), "_depth": F.lit(0)})
    for level in range(max(longest, 1)):
        step = edges.where(F.col("level") == level).select(F.col("node").alias("_node"), F.col("token").alias("_word"), "child")
        at = at.withColumn("_word", F.get("_run", F.lit(level))).join(side(step), ["_node", "_word"], "left" if level else "inner")
        # a run that left the tree stays at its depth; its place keeps such rows apart where a large tree is joined by shuffle
        gone = F.concat(F.lit("\x02"), F.col("place").cast("string"))
        at = at.withColumns({"_node": F.coalesce("child", gone), "_depth": F.col("_depth") + F.col("child").isNotNull().cast("int")}).drop("child", "_word")
    paths = F.transform(F.sequence(F.lit(1), F.col("_depth")), lambda n: F.array_join(F.slice("_run", F.lit(1), n), _SEP))
    ends = lexicon.select("*", F.array_join(T.tokens(F.coalesce(phrase, F.lit(""))), _SEP).alias("_node")).where("_node <> ''")
    found = at.select(*[f"_k{i}" for i in range(len(key))], "place", F.explode(paths).alias("_node")).join(side(ends), "_node")
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(key)], "place", *lexicon.columns)


def phrase_topics(texts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """key, topic, score: the topic with the highest sum of weights over its different phrases in the text; ties to the lower rank, then name.

    lexicon: rank, topic, phrase, weight. Texts without a phrase are left out.
    """
    hits = phrase_hits(texts, [key], text, lexicon).select(key, "rank", "topic", "phrase", "weight").distinct()
    score = hits.groupBy(key, "topic").agg(F.round(F.sum("weight"), 6).alias("score"), F.min("rank").alias("rank"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "rank", "topic")).alias("b")
    return score.groupBy(key).agg(best).select(key, F.col("b.topic").alias("topic"), (-F.col("b.s")).alias("score"))
