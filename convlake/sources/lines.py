"""Numbered lines of text files, read in splits: a large file is many tasks, and its line numbers are exact.

Spark's text reader cuts files into byte ranges and gives each line to one of them; the range's first byte tells their order, and the
reader's order that of lines within one. Lines are counted by range, and the sums of the ranges before are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1) and line of every line of the files at `path`, without line ends; bad bytes become replacement characters.

    A line end at the end of a file opens no further line. A compressed file is one task.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.make_valid_utf8("value"))
    rows = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_place"),
        F.regexp_replace(text, r"\r$", "").alias("line"),
    )
    counts = raw.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at")).groupBy("_path", "_at").count()
    upto = F.sum("count").over(W.partitionBy("_path").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")
    before = counts.select("_path", "_at", upto.alias("_before"))
    within = F.row_number().over(W.partitionBy("path", "_start").orderBy("_place"))
    out = rows.withColumn("_n", within).join(before, (F.col("path") == F.col("_path")) & (F.col("_start") == F.col("_at")))
    return out.select("path", (F.col("_before") + F.col("_n")).alias("line_no"), "line")
