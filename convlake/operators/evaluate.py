"""Decision rules and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

def similarity(a: Column, b: Column) -> dict[str, Column]:
    """Length ratio, word overlap, emoji and punctuation agreement, and their mean; both empty 1, one empty 0."""
    x, y = F.length(a), F.length(b)
    empty = lambda both: F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(both)
    s, t = F.array_distinct(T.tokens(a)), F.array_distinct(T.tokens(b))
    union = F.size(F.array_union(s, t))
    parts = {
        "length_ratio": empty(F.least(x, y) / F.greatest(x, y, F.lit(1))),
        "word_overlap": empty(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(s, t)) / F.greatest(union, F.lit(1)))),
        "emoji_match": (T.has_emoji(a) == T.has_emoji(b)).cast("double"),
        "punctuation_match": (a.rlike("[?!]") == b.rlike("[?!]")).cast("double"),
    }
    total = sum(parts.values(), F.lit(0.0)) / 4
    return {k: F.round(v, 4) for k, v in parts.items()} | {"composite": F.round(total, 4)}


def correctness(df: DataFrame, names: list[str]) -> DataFrame:
    """Whether each predicted column equals the expected one; a null expectation is right."""
    return df.withColumns({f"{n}_ok": F.coalesce(F.col(f"expected_{n}") == F.col(n), F.col(f"expected_{n}").isNull()) for n in names})


def error_codes(df: DataFrame, names: list[str]) -> DataFrame:
    """Codes of the wrong columns, as an array and joined."""
    codes = F.array_compact(F.array(*[F.when(~F.col(f"{n}_ok"), F.lit(f"wrong_{n}")) for n in names]))
    return df.withColumns({"errors": codes, "explanation": F.array_join(codes, " | ")})


def summary(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Cases and accuracies; 1 where there is no case."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("cases"), *[F.round(F.coalesce(F.try_divide(F.count_if(f"{x}_ok"), n), F.lit(1.0)), 4).alias(f"{x}_accuracy") for x in names])


def sweep(cases: DataFrame, modes: dict[str, dict[str, object]]) -> DataFrame:
    """Each case under each mode, in one pass: the rows are repeated, and a mode puts constants in the place of some columns."""
    df = cases.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    kinds = {f.name: f.dataType for f in cases.schema.fields}
    fixed = {}
    for name in {c: None for m in modes.values() for c in m}:
        out = F.col(name)
        for mode, given in modes.items():
            if name in given:
                out = F.when(F.col("mode") == mode, F.lit(given[name]).cast(kinds[name])).otherwise(out)
        fixed[name] = out
    return df.withColumns(fixed)


#: Codes of errors, in the order in which they are given.
ERRORS = ["context", "intent", "strategy", "contamination", "memory"]


def judge(results: DataFrame, ambiguous: str | None = None) -> DataFrame:
    """`results` with topic_ok, intent_ok, strategy_ok, ambiguity_ok, memory_ok, contaminated, unclear, errors and explanation.

    results: topic, intent, strategy, ambiguity, use_memory, memory_topics (of the selected memories) and expected_topic, expected_intent,
    expected_strategy, expected_memory; a null expectation is met. unclear: ambiguity is high, or the category column is `ambiguous`;
    only there ambiguity_ok asks for the right strategy. contaminated: a memory that is used has a topic other than the predicted one,
    unless that is small talk.
    """
    met = lambda c, name: F.coalesce(F.col(c) == F.col(f"expected_{name}"), F.col(f"expected_{name}").isNull(), F.lit(False))
    df = results.withColumns({f"{n}_ok": met(n, n) for n in ("topic", "intent", "strategy")} | {"memory_ok": met("use_memory", "memory")})
    unclear = F.lower("ambiguity").eqNullSafe("high")
    if ambiguous is not None:
        unclear = unclear | F.col("category").eqNullSafe(ambiguous)
    odd = F.exists("memory_topics", lambda t: F.coalesce(t != "", F.lit(False)) & ~F.lower(t).eqNullSafe(F.lower("topic")))
    odd = F.coalesce(odd, F.lit(False)) & F.coalesce("use_memory", F.lit(False)) & ~F.lower("topic").eqNullSafe("casual_chat")
    df = df.withColumns({"unclear": unclear, "ambiguity_ok": ~unclear | F.col("strategy_ok"), "contaminated": odd})
    missed = F.coalesce(F.col("expected_memory") & ~F.coalesce("use_memory", F.lit(False)), F.lit(False))
    wrong = dict(zip(ERRORS, (~F.col("topic_ok"), ~F.col("intent_ok"), ~F.col("strategy_ok"), F.col("contaminated"), missed)))
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(e)) for e, c in wrong.items()]))).withColumn("explanation", F.array_join("errors", " | "))


def benchmark(judged: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group: accuracies, that of the unclear cases alone, precision and recall of memory use, rates.

    Shares of nothing are 1 for accuracies, precision and recall. Memory use is precise where it was not unwanted and not contaminated.
    """
    n, used, wanted = F.count(F.lit(1)), F.count_if("use_memory"), F.count_if("expected_memory")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(1.0)), 4)
    fine = F.col("use_memory") & F.coalesce("expected_memory", F.lit(True)) & ~F.col("contaminated")
    return judged.groupBy(*keys).agg(
        n.alias("cases"), *[share(F.count_if(f"{x}_ok"), n).alias(f"{x}_accuracy") for x in ("topic", "intent", "strategy", "memory")],
        share(F.count_if(F.col("unclear") & F.col("ambiguity_ok")), F.count_if("unclear")).alias("ambiguity_accuracy"),
        share(F.count_if(fine), used).alias("memory_precision"), share(F.count_if(F.col("use_memory") & F.col("expected_memory")), wanted).alias("memory_recall"),
        share(F.count_if("contaminated"), n).alias("contamination_rate"), share(used, n).alias("utilization_rate"),
    )


def error_histogram(judged: DataFrame, keys: list[str], codes: list[str] = ERRORS) -> DataFrame:
    """keys, error, n: how many cases of each group have each code, 0 included; one aggregate, no join."""
    wide = judged.groupBy(*keys).agg(*[F.count_if(F.array_contains("errors", c)).alias(c) for c in codes])
    return wide.unpivot(keys, codes, "error", "n")


def response_metrics(responses: DataFrame, keys: list[str], seen: DataFrame, first: list[str], second: list[str], markers: str) -> DataFrame:
    """keys, cases and what a set of responses is like, in percent: exact matches, mixed languages, emoji, casual, unrelated, memorised; mean sizes.

    responses: response, expected. seen: a column target, texts of the training split. first, second: words of two languages, both of
    which a mixed response has. markers: a pattern of formal phrases; such or empty responses are unrelated; casual ones have none and
    are mixed or of up to 15 words. Texts are compared in lower case and trimmed, and join on a digest of distinct targets.
    """
    low = lambda c: F.lower(T.strip(F.coalesce(c, F.lit(""))))
    known = seen.select(F.md5(low("target")).alias("_h")).distinct().withColumn("_seen", F.lit(True))
    df = responses.withColumn("_low", low("response")).withColumn("_h", F.md5("_low")).join(known, "_h", "left")
    words, of = F.col("_w"), lambda xs: F.arrays_overlap(T.tokens(F.col("_low")), F.array(*map(F.lit, xs)))
    df = df.withColumns({"_w": F.size(T.words(F.col("_low"))), "_mixed": of(first) & of(second), "_formal": F.col("_low").rlike(T.portable(markers))})
    n = F.count(F.lit(1))
    percent = lambda c: F.round(F.count_if(c) * 100.0 / n, 2)
    return df.groupBy(*keys).agg(
        n.alias("cases"), percent((F.col("_low") != "") & (F.col("_low") == low("expected"))).alias("exact"), F.round(F.avg(F.length("_low")), 2).alias("chars"), F.round(F.avg(words), 2).alias("words"),
        percent("_mixed").alias("mixed"), percent(T.has_emoji(F.col("_low"))).alias("emoji"), percent(~F.col("_formal") & ((words <= 15) | F.col("_mixed"))).alias("casual"),
        percent(F.col("_formal") | (F.col("_low") == "")).alias("unrelated"), percent(F.col("_seen") & (F.col("_low") != "")).alias("memorised"),
    )


def sensitivity(responses: DataFrame, keys: list[str], case: list[str], source: str, one: str, other: str) -> DataFrame:
    """keys, cases, differ: the percentage of cases whose responses by `one` and by `other` differ; cases without both are left out."""
    of = lambda name: F.max(F.when(F.col(source) == name, F.col("response")))
    both = responses.where(F.col(source).isin(one, other)).groupBy(*keys, *case).agg(of(one).alias("_a"), of(other).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.round(F.count_if(F.col("_a") != F.col("_b")) * 100.0 / F.count(F.lit(1)), 2).alias("differ"))


def compare(summaries: DataFrame, by: str, full: str, base: str, metrics: list[str]) -> DataFrame:
    """metric, full, baseline, delta."""
    rows = summaries.select(by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    wide = rows.groupBy("metric").pivot(by, [full, base]).agg(F.first("v"))
    return wide.select("metric", F.col(full).alias("full"), F.col(base).alias("baseline"), F.round(F.col(full) - F.col(base), 4).alias("delta"))
