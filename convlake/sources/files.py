"""JSON lines, JSON documents and file fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..schemas import CONVERSATION_INPUT
from .lines import numbered_lines


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All records; blank lines are skipped, a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def stream_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One document to a file: an object or a list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document: a list of all rows, in one file. For small results; `write_jsonl` is for large ones."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r"))
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_any(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Records by the path's suffix, and an issue row for each line (.jsonl) or document (else) that cannot be read.

    A document is an object or a list of objects; it is read as a whole, as JSON documents are.
    """
    issue = lambda text: [F.lit("ERROR").alias("severity"), F.lit("unreadable").alias("rule"), F.col(text).alias("message")]
    if path.rstrip("/").endswith(".jsonl"):
        good, bad = line_errors(spark, path, schema)
        return good, bad.select(*issue("line"))
    docs = spark.read.text(path, wholetext=True).withColumn("ok", F.try_parse_json("value").isNotNull())
    many = F.from_json("value", ArrayType(schema))
    rows = F.when(F.ltrim("value").startswith("["), many).otherwise(F.array(F.from_json("value", schema)))
    return docs.where("ok").select(F.inline(rows)), docs.where("NOT ok").select(*issue("value"))


def line_errors(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Parsed records, and path, line_no, line of each line that is no JSON object; the rest goes on. Large files are read in splits."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    parsed = lines.withColumn("r", F.from_json("line", schema)).withColumn("ok", F.json_object_keys("line").isNotNull())
    return parsed.where("ok").select("r.*"), parsed.where("NOT ok").select("path", "line_no", "line")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of each file."""
    df = spark.read.format("binaryFile").load(path)
    return df.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def standard(df: DataFrame) -> DataFrame:
    """The three input forms of a conversation as conversation_id and messages (speaker, text)."""
    given = F.coalesce("context", F.array().cast(CONVERSATION_INPUT["context"].dataType))
    plain = F.transform(given, lambda m: F.struct(F.coalesce(m["speaker"], m["role"], F.lit("user")).alias("speaker"), F.coalesce(m["text"], m["content"]).alias("text")))
    answer = F.array(F.struct(F.coalesce("target_speaker", "persona_speaker", F.lit("persona")).alias("speaker"), F.col("response").alias("text")))
    name = lambda r: F.when(r == "assistant", "persona").otherwise(r)
    chat = F.transform("messages", lambda m: F.struct(F.coalesce(m["speaker"], name(m["role"])).alias("speaker"), F.coalesce(m["text"], m["content"]).alias("text")))
    target = F.array(F.struct(F.lit("persona").alias("speaker"), F.col("target").alias("text")))
    messages = F.when(F.col("response").isNotNull(), F.concat(plain, answer)).when(F.col("target").isNotNull(), F.concat(chat, target)).otherwise(chat)
    return df.select(F.coalesce("conversation_id", "example_id", F.lit("conv-unknown")).alias("conversation_id"), messages.alias("messages"))
