"""Queries of the readers and writers: the given tables are written as files of each format and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans.build_corpus import build
from .registry import query, table
from .schemas import CONVERSATION_INPUT, TRAINING_EXAMPLE
from .sources import chat_export, files
from .streaming import streams as X

_TEXTS = "SELECT doc_id::VARCHAR AS id, md5(text) AS text, lang AS split FROM documents"


def _examples(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("conversation_id"), "text", F.col("lang").alias("split"))


def _digest(df):
    return df.select(F.col("conversation_id").alias("id"), F.md5("text").alias("text"), "split")


@query("s01_jsonl_round_trip", _TEXTS)
def _(spark, d):
    path = X.shared_path(spark, "jsonl")
    files.write_jsonl(_examples(spark, d), path)
    return _digest(files.read_jsonl(spark, path, TRAINING_EXAMPLE))


@query("s02_jsonl_stream", _TEXTS)
def _(spark, d):
    path = X.shared_path(spark, "jsonl")
    files.write_jsonl(_examples(spark, d), path)
    return _digest(X.drain(X.json_stream(spark, path, TRAINING_EXAMPLE), "jsonl-stream"))


@query("s04_json_document", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    """The regions as one document: a list is for small tables."""
    path, df = X.shared_path(spark, "json"), table(spark, d, "region").select("r_regionkey", "r_name")
    files.write_json(df, path)
    return files.read_json(spark, path, df.schema)


#: Every seventh record is cut off.
_CUT = "SELECT doc_id::VARCHAR AS id, doc_id % 7 = 0 AS broken FROM documents"


def _broken(spark, d):
    rows = _examples(spark, d).select(F.col("conversation_id").alias("k"), F.to_json(F.struct("conversation_id", "split")).alias("r"))
    path = X.shared_path(spark, "broken") + ".jsonl"
    rows.select(F.when(F.col("k").cast("long") % 7 == 0, F.substring_index("r", ",", 1)).otherwise(F.col("r")).alias("value")).write.text(path)
    return path


@query("s05_validated_file", f"SELECT broken, count(*) AS n FROM ({_CUT}) GROUP BY 1")
def _(spark, d):
    good, bad = files.read_any(spark, _broken(spark, d), TRAINING_EXAMPLE)
    rows = good.select(F.lit(False).alias("broken")).unionByName(bad.where("severity = 'ERROR'").select(F.lit(True).alias("broken")))
    return rows.groupBy("broken").agg(F.count(F.lit(1)).alias("n"))


@query("s06_line_errors", f"SELECT id, broken FROM ({_CUT})")
def _(spark, d):
    good, bad = files.line_errors(spark, _broken(spark, d), TRAINING_EXAMPLE)
    lost = bad.where("line_no > 0").select(F.regexp_extract("line", r'"conversation_id":"(\d+)"', 1).alias("id"), F.lit(True).alias("broken"))
    return good.select(F.col("conversation_id").alias("id"), F.lit(False).alias("broken")).unionByName(lost)


@query("s10_file_hashes", "SELECT 'splits' AS name, count(*) AS n FROM (SELECT DISTINCT lang FROM documents)")
def _(spark, d):
    """Files of each split, of bounded size, and their hashes: splits with a hash. No task reads a whole split."""
    path = X.shared_path(spark, "hashed")
    _examples(spark, d).write.partitionBy("split").option("maxRecordsPerFile", 10_000).json(path)
    hashed = files.file_hashes(spark, f"{path}/*/*.json").groupBy(F.regexp_extract("path", "split=([^/]+)", 1).alias("split")).agg(F.count_distinct("sha256").alias("n"))
    return hashed.agg(F.lit("splits").alias("name"), F.count_if(F.col("n") >= 1).alias("n"))


# Exports: a message for each turn, stamped by conversation and turn, in one of the two grammars.
_STAMP = "epoch(TIMESTAMP '2000-01-01') + (conv_id % 9000) * 86400 + turn * 60"


def _export(spark, d) -> str:
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2000-01-01"), "yyyy-MM-dd") + F.col("conv_id") % 9000 * 86400 + F.col("turn") * 60)
    plain = F.concat(F.date_format(at, "yyyy-MM-dd, H:mm"), F.lit(" - "))
    boxed = F.concat(F.lit("["), F.date_format(at, "d/M/yyyy, H:mm:ss"), F.lit("] "))
    df = table(spark, d, "conversations")
    line = F.concat(F.when(F.col("conv_id") % 2 == 0, plain).otherwise(boxed), "role", F.lit(": "), "text")
    path = X.shared_path(spark, "export")
    df.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select(line.alias("value")).write.text(path)
    return path


@query(
    "w01_export_messages",
    f"""SELECT {_STAMP} AS at, role AS speaker, md5(regexp_replace(text, '\\s+$', '')) AS text, CASE WHEN trim(text) = '' THEN 'empty' ELSE 'text' END AS message_type,
    regexp_matches(text, 'https?://\\S+|www\\.\\S+') AS contains_url, role = 'assistant' AS is_persona FROM conversations""",
)
def _(spark, d):
    """Headers, times, speakers and continued lines of exports of all conversations."""
    messages, _ = chat_export.parse(chat_export.lines(spark, _export(spark, d)), "assistant")
    text = F.regexp_replace("text", r"\s+$", "")
    return messages.select(F.unix_timestamp("timestamp").cast("double").alias("at"), "speaker", F.md5(text).alias("text"), "message_type", "contains_url", "is_persona")


@query("w05_export_orphans", "SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '\\S')")
def _(spark, d):
    """Texts that are no exports: every line is an orphan."""
    path = X.shared_path(spark, "orphans")
    table(spark, d, "documents").select("text").where("text IS NOT NULL").write.text(path)
    return chat_export.parse(chat_export.lines(spark, path))[1].agg(F.count(F.lit(1)).alias("n"))


@query(
    "p01_three_forms",
    """WITH m AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS t FROM conversations GROUP BY 1)
    SELECT conv_id::VARCHAR AS id, len(t) + (conv_id % 3 < 2)::INT AS n,
      array_to_string(list_transform(r, lambda x: CASE WHEN x = 'assistant' AND conv_id % 3 > 0 THEN 'persona' ELSE x END), ',') || CASE conv_id % 3 WHEN 0 THEN ',bot' WHEN 1 THEN ',persona' ELSE '' END AS speakers,
      md5(array_to_string(t, chr(10)) || CASE WHEN conv_id % 3 < 2 THEN chr(10) || 'the end' ELSE '' END) AS texts FROM m""",
)
def _(spark, d):
    """Conversations as context and response, as roles with a target, and as they are; all written as JSON lines and read by one schema."""
    part = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(part.alias("m")).withColumn("k", F.col("conv_id") % 3)
    said = lambda who, what: F.transform("m", lambda x: F.struct(x["role"].alias(who), x["text"].alias(what)))
    path = X.shared_path(spark, "forms")
    forms = [
        rows.where("k = 0").select(F.col("conv_id").cast("string").alias("conversation_id"), said("speaker", "text").alias("context"), F.lit("the end").alias("response"), F.lit("bot").alias("persona_speaker")),
        rows.where("k = 1").select(F.col("conv_id").cast("string").alias("example_id"), said("role", "content").alias("messages"), F.lit("the end").alias("target")),
        rows.where("k = 2").select(F.col("conv_id").cast("string").alias("conversation_id"), said("role", "text").alias("messages")),
    ]
    for df in forms:
        df.write.mode("append").json(path)
    out = files.standard(files.read_jsonl(spark, path, CONVERSATION_INPUT))
    join = lambda c, by: F.array_join(F.transform("messages", lambda x: x[c]), by)
    return out.select(F.col("conversation_id").alias("id"), F.size("messages").cast("long").alias("n"), join("speaker", ",").alias("speakers"), F.md5(join("text", "\n")).alias("texts"))


@query("s11_corpus_table", "SELECT count(DISTINCT conv_id)::BIGINT AS conversations, 0::BIGINT AS leaks FROM conversations c WHERE role = 'assistant' AND EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = c.conv_id AND u.turn = c.turn - 1 AND u.role = 'user')")
def _(spark, d):
    """The built table: conversations with an example, and those in more than one split."""
    path = X.shared_path(spark, "corpus")
    build(table(spark, d, "conversations"), path)
    each = spark.read.parquet(path).groupBy("conv_id").agg(F.count_distinct("split").alias("splits"))
    return each.agg(F.count(F.lit(1)).alias("conversations"), F.count_if(F.col("splits") > 1).alias("leaks"))
