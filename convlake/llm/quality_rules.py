"""Document quality rules with host verdicts, in DataFrame functions only.

Base figures of every document come from one narrow pass over the whole texts and are written to the shared
folder. Failures are then counted by host (partial counts before the shuffle), each host's failure rate is shrunk
towards an empirical beta prior fitted by moments over all hosts, and documents of hosts whose shrunken rate is over
`max_rate` are rejected with the host. Only the rejected hosts are joined back.

Nulls: a null text has no words and fails; a null host is a host of its own. Empty texts fail. Very long texts are
handled in array functions of n log n time. Repeated rows each count and each get their row. An empty table gives an
empty result. Extra columns of the input are left out of the work; figures take their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words inside windows of `window` words that occur twice or more in the text."""

    def covered(grams: Column) -> Column:
        def flagged(s: Column) -> Column:
            def at(x: Column, i: Column) -> Column:
                same = F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                return F.when(same | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)), x["i"])

            return F.array_sort(F.array_compact(F.transform(s, at)))

        pairs = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(
            let(F.sort_array(pairs), flagged),
            start,
            lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    def of(hashes: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window))
        )
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))

    many = F.size(words) > window
    return F.when(many, let(F.transform(words, lambda w: F.xxhash64(w)), of)).otherwise(F.lit(0))


def base_figures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def figures(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    return let(words, figures)


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def beta_prior(mean: float | None, var: float | None) -> tuple[float, float]:
    """Moments of the host rates to the prior's two parameters; a weak uniform prior where they say nothing."""
    if mean is None or not 0 < mean < 1:
        return 1.0, 1.0
    strength = min(max(mean * (1 - mean) / var - 1, 2.0), 1000.0) if var else 1000.0
    return mean * strength, (1 - mean) * strength


def judge(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5
) -> DataFrame:
    """id, host, the base figures, base_failed, host_rate of rejected hosts, kept."""
    base = docs.select(F.col(id_col), F.col(host).alias("host"), base_figures(F.col(text)).alias("_f"))
    base = base.select(id_col, "host", *[F.col(f"_f.{c}") for c in FIGURES])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    base = stash(base.withColumn("base_failed", failed), "quality-rules")
    hosts = base.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("bad"))
    seen = hosts.agg(F.avg(F.col("bad") / F.col("n")).alias("mean"), F.var_pop(F.col("bad") / F.col("n")).alias("var"))
    a, b = beta_prior(*seen.first())
    rate = (F.col("bad") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    out = hosts.select(F.col("host").alias("_host"), rate.alias("host_rate")).where(F.col("host_rate") > max_rate)
    joined = base.join(out, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_rate").isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", *FIGURES, "base_failed", "kept")


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), grams AS (
  SELECT k, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) > 8
), named AS (
  SELECT k, i, array_to_string(words[i : i + 7], ' ') AS g FROM grams
), twice AS (
  SELECT k, i FROM named QUALIFY count(*) OVER (PARTITION BY k, g) > 1
), covered AS (
  SELECT k, count(DISTINCT i + o) AS n FROM twice, range(0, 8) AS r(o) GROUP BY k
), lines AS (
  SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w
), base AS (
  SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (k) LEFT JOIN covered c ON c.k = w.k
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, count_if(base_failed) AS bad FROM judged GROUP BY source
), moments AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM hosts),
strength AS (
  SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM moments
), prior AS (
  SELECT CASE WHEN m > 0 AND m < 1 THEN m * s ELSE 1.0 END AS a, CASE WHEN m > 0 AND m < 1 THEN (1 - m) * s ELSE 1.0 END AS b
  FROM strength
), verdicts AS (SELECT source, (bad + a) / (n + a + b) > 0.5 AS rejected FROM hosts, prior)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT v.rejected AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""
