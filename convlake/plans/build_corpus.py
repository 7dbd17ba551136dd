"""Corpus building: messages to sessions, turns, examples, annotation, split and output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params
from ..functions import text as T
from ..operators import annotate as A
from ..operators import sessions as S
from ..operators import splits as D
from ..operators import windows as N
from ..sources import chat_export


def annotate_examples(examples: DataFrame) -> DataFrame:
    """Behaviour, topic and context labels for each example."""
    n = F.size("context")
    prompt = F.element_at("context", -1)["text"]
    df = examples.withColumns({"prompt": prompt, "before": F.array_join(F.transform("context", lambda m: m["text"]), " ")})
    topic = A.classify_topic(df, "example_id", "prompt", "text", "before", params.TOPICS)
    df = df.select("example_id", "conv_id", "depth", A.behaviour(F.col("text"), F.col("prompt")).alias("b"), A.quality_flag(F.col("text")).alias("quality_flag"), n.cast("long").alias("n_context"))
    return df.select("example_id", "conv_id", "depth", "b.*", "quality_flag", "n_context").join(topic, "example_id")


def from_exports(spark: SparkSession, path: str, persona: str, gap_minutes: float = 120, min_messages: int = 2) -> DataFrame:
    """Turns of qualified sessions of chat exports: session_id, turn, role, text, start and end."""
    messages, _ = chat_export.parse(chat_export.lines(spark, path), persona)
    usable = messages.where((F.col("message_type") == "text") & (T.strip(F.col("text")) != ""))
    s = S.sessionize(usable, "path", "line_number", "timestamp", gap_minutes)
    good = S.qualified(S.session_summary(s, ["path", "session"], "line_number", "timestamp", F.col("is_persona")), min_messages)
    turns = S.bursts(s.join(good.select("path", "session"), ["path", "session"], "left_semi"), ["path", "session"], "line_number", "speaker", "text", "timestamp")
    role = F.when(F.col("speaker") == persona, "assistant").otherwise("user")
    name = F.concat(F.lit("conv-"), F.substring(F.md5("path"), 1, 8), F.lit("-"), F.lpad(F.col("session").cast("string"), 6, "0"))
    return turns.withColumns({"role": role, "conv_id": name}).drop("path", "session")


def build(turns: DataFrame, out: str, ratios=(0.7, 0.1, 0.2), seed: int = 42) -> None:
    """Annotated examples in one Parquet table, partitioned by split; REVIEW rows stay, EXCLUDE rows would go."""
    examples = annotate_examples(N.context_windows(turns)).where("quality_flag <> 'EXCLUDE'")
    D.group_split(examples, "conv_id", ratios, seed).write.mode("overwrite").partitionBy("split").parquet(out)
