"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions only.

1. The index is stored in the shared folder: a posting (document key, term, position) for every document word that
   the benchmark uses, and one length record for each document.
2. Each benchmark window (`window` consecutive words; a shorter item is one window) names its two rarest terms by
   posting count. The rarest term's list, moved by the term's place in the item, gives candidate diagonals
   (document, item, position minus item position); they are intersected with the moved list of the second.
3. Candidates are compared word by word along their diagonal, so phrase matches are exact. Proximity counts the words of an
   item that stand within `slack` words of where the diagonal has them: items with at least the share `least_near` of their words
   there are near, whether or not a whole window occurs.

Texts meet their candidates in stretches of `STRETCH` words, so that a very long text that repeats a phrase is not gathered.

Joins are on terms or document keys. The benchmark side is written first, so Spark knows its size and broadcasts it
only under its own threshold, else it shuffles and splits skewed terms. No list is gathered for a term.

Nulls: a null text has no words; a null item is ignored; an item without id counts under the empty string. Documents
with the same id and text share a result and each get their row. An empty benchmark contaminates nothing. Extra columns are
kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stash
from .quality_rules import let

NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["h", "g"]
STRETCH = 4096


def words_of(text: Column) -> Column:
    """Words as they stand; A-Z is lower-cased later, word by word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NO_WORD), lambda w: w != "")


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Document keys of 96 bits from id and text; no row number, so a lost task is redone alike."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(id_col), F.col(text)).alias("h"),
        F.hash(F.col(text), F.col(id_col)).alias("g"),
    )


def benchmark_items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """item (key), item_id (string), words, n."""
    words = F.transform(words_of(F.col(text)), ascii_lower)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), words.alias("words"))
    items = items.where(F.size("words") > 0).distinct()
    return items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.size("words").alias("n"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings of vocabulary terms, and length records (with the id) under the empty term."""
    words = F.concat(words_of(F.col("text")), F.array(F.lit("")))
    rows = docs.select("id", *KEY, F.posexplode(words).alias("pos", "word"))
    rows = rows.select("id", *KEY, "pos", ascii_lower(F.col("word")).alias("term"))
    rows = rows.join(vocabulary, "term", "left_semi")
    return rows.select(F.when(F.col("term") == "", F.col("id")).alias("id"), *KEY, "pos", "term")


def anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """The two rarest terms of every window that can occur: item, n, p1, term1, p2, term2."""
    terms = items.select("item", "n", F.posexplode("words").alias("p", "term"))
    terms = terms.join(counts, "term", "left").groupBy("item", "n")
    entry = F.struct(F.col("p"), F.coalesce("count", F.lit(0)).alias("c"), F.col("term"))
    terms = terms.agg(F.sort_array(F.collect_list(entry)).alias("all"))
    size = F.least(F.lit(window), F.col("n"))
    ranked = F.transform(
        F.sequence(F.lit(1), F.col("n") - size + 1),
        lambda j: F.sort_array(F.transform(F.slice("all", j, size), lambda e: F.struct(e["c"].alias("c"), e["p"].alias("p"), e["term"].alias("term")))),
    )
    rows = terms.select("item", "n", F.explode(ranked).alias("r")).where(F.col("r")[0]["c"] > 0)
    second = F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    first = F.col("r")[0]
    return rows.select(
        "item", "n", first["p"].alias("p1"), first["term"].alias("term1"), second["p"].alias("p2"), second["term"].alias("term2")
    ).distinct()


def candidates(index: DataFrame, marks: DataFrame) -> DataFrame:
    """Diagonals on which both anchors of some window stand: h, g, item, n, diag."""
    posts = index.where(F.col("term") != "").select(*KEY, "pos", "term")
    first = posts.join(marks, F.col("term") == F.col("term1")).select(
        *KEY, "item", "n", (F.col("pos") - F.col("p1")).alias("diag"), F.col("term2").alias("term"),
        (F.col("pos") - F.col("p1") + F.col("p2")).alias("pos"),
    )
    rare = stash(marks.select(F.col("term2").alias("term")).distinct(), "decontaminate-second")
    second = posts.join(rare, "term", "left_semi")
    return first.join(second, [*KEY, "term", "pos"], "left_semi").select(*KEY, "item", "n", "diag").distinct()


def compared(docs: DataFrame, items: DataFrame, found: DataFrame, longest: int, window: int, slack: int) -> DataFrame:
    """h, g, item_id, starts (places in the item of the windows that occur), diag, size, share (of words near the diagonal)."""
    at = F.floor(F.greatest("diag", F.lit(0)) / STRETCH).cast("int").alias("stretch")
    found = found.groupBy(*KEY, at).agg(F.collect_list(F.struct("item", "n", "diag")).alias("found"))
    found = stash(found, "decontaminate-candidates")
    near = docs.select(*KEY, "text").join(found.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY)

    def stretches(w: Column) -> Column:
        """Words from `slack` before a stretch to the end of the longest item that can begin in it."""
        one = lambda i: F.struct(
            i.cast("int").alias("stretch"),
            F.slice(w, F.greatest(i * STRETCH - slack, F.lit(0)).cast("int") + 1, F.lit(STRETCH + longest + 2 * slack)).alias("w"),
        )
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / STRETCH).cast("int")), one)

    near = near.select(*KEY, F.explode(let(words_of(F.col("text")), stretches)).alias("s")).select(*KEY, "s.*").join(found, [*KEY, "stretch"])

    def one(c: Column) -> Column:
        first = F.greatest(F.col("stretch") * STRETCH - slack, F.lit(0))  # the place in the text of the stretch's first word
        start = F.greatest(c["diag"] - slack, F.lit(0))
        size = F.greatest(c["diag"] + c["n"] + slack - start, F.lit(0))
        here = F.transform(F.slice("w", (start - first + 1).cast("int"), size.cast("int")), ascii_lower)
        return F.struct(c["item"].alias("item"), c["diag"].alias("diag"), (start - c["diag"]).cast("int").alias("cut"), here.alias("here"))

    near = near.select(*KEY, F.explode(F.transform("found", one)).alias("c")).select(*KEY, "c.*").join(items, "item")
    size = F.least(F.lit(window), F.col("n"))
    equal = F.transform("words", lambda w, q: F.coalesce(F.when(q >= F.col("cut"), F.get("here", q - F.col("cut"))) == w, F.lit(False)))
    starts = let(
        equal,
        lambda e: F.filter(F.sequence(F.lit(0), F.col("n") - size), lambda j: F.forall(F.slice(e, j + 1, size), lambda x: x)),
    )

    def by(q: Column) -> Column:
        low = q - F.col("cut") - slack
        return F.slice("here", F.greatest(low, F.lit(0)) + 1, F.greatest(low + 2 * slack + 1 - F.greatest(low, F.lit(0)), F.lit(0)))

    count = F.size(F.filter("words", lambda w, q: F.array_contains(by(q), w)))
    return near.select(*KEY, "item_id", starts.alias("starts"), "diag", size.alias("size"), (count / F.col("n")).alias("share"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    slack: int = 2,
    least_near: float = 0.5,
) -> DataFrame:
    """id, h, g (key), n_words, hits (start, length of each matched window), items (their ids), near_items, near, of every document.

    near: the greatest share of an item's words that stand close to where they would in a copy; null under `least_near`.
    """
    docs = keyed(docs, id_col, text)
    items = stash(benchmark_items(benchmark, item_id, item_text), "decontaminate-items")
    longest = items.agg(F.max("n")).first()[0] or 0
    vocabulary = items.select(F.explode(F.concat("words", F.array(F.lit("")))).alias("term")).distinct()
    blank = docs.sparkSession.range(1).select(F.lit("").alias("term"))
    vocabulary = stash(vocabulary.union(blank).distinct(), "decontaminate-terms")
    index = stash(build_index(docs, vocabulary), "decontaminate-index")
    counts = index.where(F.col("term") != "").groupBy("term").count()
    marks = stash(anchors(items, counts, window), "decontaminate-anchors")
    near = compared(docs, items, candidates(index, marks), longest, window, slack)
    whole, close = F.size("starts") > 0, F.col("share") >= least_near
    near = near.where(whole | close)
    spans = F.transform("starts", lambda j: F.struct((j + F.col("diag")).alias("start"), F.col("size").alias("length")))
    hits = near.groupBy(*KEY).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(spans)))).alias("hits"),
        F.sort_array(F.collect_set(F.when(whole, F.col("item_id")))).alias("items"),
        F.sort_array(F.collect_set(F.when(close, F.col("item_id")))).alias("near_items"),
        F.max(F.when(close, F.col("share"))).alias("near"),
    )
    lengths = index.where(F.col("term") == "").select("id", *KEY, F.col("pos").cast("long").alias("n_words"))
    out = lengths.join(hits, KEY, "left")
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return out.select(F.col("id").alias(id_col), *KEY, "n_words", some("hits"), some("items"), some("near_items"), "near")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` without a benchmark window."""
    found = decontaminate(docs, benchmark, id_col, text, **options).where(F.col("hits").isNotNull())
    mark = "_found"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    found = found.select(F.col("h").alias(mark + "h"), F.col("g").alias(mark + "g"))
    keys = (F.xxhash64(F.col(id_col), F.col(text)) == F.col(mark + "h")) & (F.hash(F.col(text), F.col(id_col)) == F.col(mark + "g"))
    return docs.join(found, keys, "left_anti")


def covered(hits: Column) -> Column:
    """Words under any of the sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        hits,
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n"),
            F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
        ),
        lambda a: a["n"],
    )


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.coalesce(covered(F.col("hits")), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return digest(decontaminate(docs, benchmark))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[j : j + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)
), dw AS (
  SELECT k, l, i, array_to_string(w[i : i + l - 1], ' ') AS g
  FROM (SELECT k, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw))
), m AS (
  SELECT DISTINCT k, i, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g
), hit AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + l)) AS p FROM m) GROUP BY k
), its AS (
  SELECT k, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k)
"""
