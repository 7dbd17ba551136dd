"""Corpus pipeline: quality, near-duplicates, repeated substrings, benchmark leaks, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.llm import decontaminate, jaccard_join, packing, quality_classifier, suffix_dedup
from convlake.llm.common import discard, key_slices, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, few: int = 500_000) -> DataFrame:
    """One row of each group: the one of the smallest id, rows without id last. Null and wordless texts stay.

    Rows are told apart by a key of id and text, so repeated and null ids are no matter. Of rows with one key, the
    smallest is left. few: so many keys of rows that go, or of repeated rows, are broadcast at a time; the join shuffles beyond 16 times as many
    that go, or as many repeated ones.
    """
    rows = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = jaccard_join.group_documents(rows, "row_key")
    groups = found.where("n > 0").groupBy("row_key").agg(F.first("component").alias("component"))
    ids = rows.groupBy("row_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    groups = stash(groups.join(ids, "row_key"), "pipeline-groups")
    discard(found)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    first = groups.groupBy("component").agg(best.alias("best")).select("best.row_key")
    first = stash(first.withColumn("first", F.lit(True)), "pipeline-first")
    spare = groups.join(first, "row_key", "left").where("first IS NULL OR copies > 1")
    spare = stash(spare.select("row_key", F.col("first").isNotNull().alias("again")), "pipeline-spare")
    discard(groups, first)
    gone = spare.select("row_key")
    slices = key_slices(gone, "row_key", few)
    kept = rows
    for keys in [gone] if slices is None else map(F.broadcast, slices):
        kept = kept.join(keys, "row_key", "left_anti")
    kept = kept.select(*docs.columns)
    again = spare.where("again").select("row_key")
    n = again.count()
    if not n:
        return kept
    copies = rows.join(F.broadcast(again) if n <= few else again, "row_key", "left_semi")
    one = copies.groupBy("row_key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.unionByName(one.select("row.*"))


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings that repeat; n_chars follows the text."""
    keep = [c for c in docs.columns if c != "text"]
    cut = suffix_dedup.dedup(docs, keep, as_text=True).withColumnRenamed("kept", "text")
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", pack),
]

#: A trained classifier cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
