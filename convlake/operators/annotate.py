"""Rule annotation: language, tone, response type, topic, dialogue state, intent, ambiguity, quality flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import params
from ..functions import text as T
from ..functions.rules import Rule, first_match


def _hits(words: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*lexicon)))


def language_tag(text: Column, primary: list[str], secondary: list[str], distinct: bool) -> Column:
    """primary, secondary, mixed or unknown by counts of lexicon words; of distinct words, or of all."""
    low = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)
    low = F.array_distinct(low) if distinct else low
    one = lambda w: F.struct(F.size(w).alias("n"), _hits(w, primary).alias("p"), _hits(w, secondary).alias("s"))

    def tag(c: Column) -> Column:
        n, p, s = c["n"], c["p"], c["s"]
        out = F.when((n == 0) & text.rlike(T.DEVANAGARI), "other").when(n == 0, "unknown")
        out = out.when((p > 0) & (s > 0), F.when(p >= s, "primary").otherwise("mixed"))
        return out.when(p > 0, "primary").when(s > 0, "secondary").otherwise("unknown")

    # words and counts are made once: each step binds what the next one reads
    return F.transform(F.transform(F.array(low), one), tag)[0]


def tone(text: Column, rules: list[Rule]) -> Column:
    """First matching rule; else neutral for up to four characters, casual for others."""
    short = F.length(T.strip(text)) <= 4
    return F.when(first_match(F.lower(text), rules, "") != "", first_match(F.lower(text), rules, "")).when(short, "neutral").otherwise("casual")


def topic_scores(examples: DataFrame, key: str, prompt: str, target: str, context: str, topics: list[tuple]) -> DataFrame:
    """key, topic, score: each term counts 1.8 times its weight in the prompt, and 1.3 times in the target or else 0.9 in the context.

    Terms meet tokens in one join on the term; no pattern runs over the text.
    """
    lexicon = F.broadcast(examples.sparkSession.createDataFrame(topics, "rank int, topic string, term string, weight double"))
    tokens = None
    for place, c in (("prompt", prompt), ("target", target), ("context", context)):
        part = examples.select(key, F.explode(F.array_distinct(T.tokens(F.coalesce(F.col(c), F.lit(""))))).alias("term"), F.lit(place).alias("place"))
        tokens = part if tokens is None else tokens.unionByName(part)
    hit = tokens.join(lexicon, "term").groupBy(key, "rank", "topic", "term", "weight")
    hit = hit.agg(*[F.bool_or(F.col("place") == p).alias(p) for p in ("prompt", "target", "context")])
    share = F.when(F.col("prompt"), 1.8).otherwise(0.0) + F.when(F.col("target"), 1.3).when(F.col("context"), 0.9).otherwise(0.0)
    return hit.groupBy(key, "rank", "topic").agg(F.sum(F.col("weight") * share).alias("score"))


def classify_topic(examples: DataFrame, key: str, prompt: str, target: str, context: str, topics: list[tuple]) -> DataFrame:
    """The first topic of the highest score; under 1.0 casual_chat for up to four words, else other; confidence in [0.2, 1]."""
    scores = topic_scores(examples, key, prompt, target, context, topics)
    best = scores.groupBy(key).agg(F.max_by("topic", F.struct(F.round("score", 9), -F.col("rank"))).alias("topic"), F.max("score").alias("score"))
    out = examples.select(key, F.size(T.words(F.col(target))).alias("n")).join(best, key, "left")
    score = F.coalesce("score", F.lit(0.0))
    weak = F.when(F.col("n") <= 4, "casual_chat").otherwise("other")
    return out.select(
        key,
        F.when(F.round(score, 9) < 1.0, weak).otherwise(F.col("topic")).alias("topic"),
        F.round(F.greatest(F.lit(0.2), F.least(F.lit(1.0), score / 5.0)), 4).alias("confidence"),
    )


def window_topic(turns: DataFrame, key: str, order: str, topics: list[tuple]) -> DataFrame:
    """Topic of a conversation: keyword weights times recency, 1 + 2 i / max(1, n - 1), the newest turn 1.2 times that."""
    lexicon = F.broadcast(turns.sparkSession.createDataFrame(topics, "rank int, topic string, term string, weight double"))
    w = W.partitionBy(key)
    i = F.row_number().over(w.orderBy(order)) - 1
    n = F.count(F.lit(1)).over(w)
    recency = (1 + 2 * F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1))) * F.when(F.col("_i") == F.col("_n") - 1, 1.2).otherwise(1.0)
    df = turns.withColumns({"_i": i, "_n": n}).withColumn("_r", recency)
    hits = df.select(key, "_r", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).join(lexicon, "term")
    score = hits.groupBy(key, "rank", "topic").agg(F.round(F.sum(F.col("weight") * F.col("_r")), 6).alias("score"))
    best = score.groupBy(key).agg(F.max_by("topic", F.struct("score", -F.col("rank"))).alias("topic"), F.max("score").alias("score"))
    out = turns.select(key).distinct().join(best, key, "left")
    return out.select(key, F.when(F.coalesce("score", F.lit(0.0)) < 1.0, "casual_chat").otherwise(F.col("topic")).alias("topic"))


def dialogue_state(text: Column, n_turns: Column) -> Column:
    """Opening for one message; else the first matching rule; else ongoing."""
    return F.when(n_turns <= 1, "opening").otherwise(first_match(F.lower(T.strip(text)), params.STATE, "ongoing"))


def ambiguity(text: Column, nouns: list[str]) -> Column:
    """high for up to two words without a known noun, medium for up to five, else low."""
    n = F.size(T.words(text))
    known = F.arrays_overlap(T.tokens(text), F.array(*map(F.lit, nouns)))
    return F.when((n <= 2) & ~known, "high").when(n <= 5, "medium").otherwise("low")


def recent_activity(before: Column, phrases: list[tuple[str, str]]) -> Column:
    """The label of the first of `phrases` (phrase, label) that the preceding turns hold, in lower case; null without any."""
    found = [F.when(F.lower(before).contains(phrase.lower()), F.lit(label)) for phrase, label in phrases]
    return F.coalesce(*found, F.lit(None).cast("string"))


def quality_flag(text: Column, longest: int = 500) -> Column:
    """REVIEW for personal data or a long text, else KEEP."""
    return F.when((F.size(T.personal_data(text)) > 0) | (F.length(text) > longest), "REVIEW").otherwise("KEEP")


def behaviour(text: Column, previous: Column) -> Column:
    """All single-message labels as one struct."""
    return F.struct(
        language_tag(text, params.PRIMARY, params.SECONDARY, False).alias("language"),
        tone(text, params.TONE_2).alias("tone"),
        first_match(F.lower(T.strip(text)), params.RESPONSE_2, "answer").alias("response_type"),
        F.length(T.strip(text)).alias("char_count"),
        F.size(T.words(text)).alias("word_count"),
        T.length_class(text).alias("length_class"),
        T.emoji_count(text).alias("emoji_count"),
        F.arrays_overlap(T.tokens(text), F.array(*map(F.lit, params.SLANG))).alias("has_slang"),
        T.is_question(text, params.OPENERS).alias("is_question"),
    )


def likely_language(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """The language with the most different words of the lexicon in the text; the first of equals, `unknown` without any."""
    words = F.array_distinct(T.tokens(F.coalesce(text, F.lit(""))))
    hits = [F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, w)))).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, w) in enumerate(lexicon.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["name"]).otherwise("unknown")
