"""Explicit schemas and enum domains; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, StringType, StructField, StructType, TimestampType


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


MESSAGE = StructType(_strings("speaker", "role", "text", "content", "timestamp"))
#: All input forms of a conversation, read at once.
CONVERSATION_INPUT = StructType(
    _strings("conversation_id", "example_id", "persona_id", "persona_speaker", "target_speaker", "source", "target", "response")
    + [StructField("context", ArrayType(MESSAGE)), StructField("messages", ArrayType(MESSAGE)), StructField("metadata", StringType())]
)
TRAINING_EXAMPLE = StructType(_strings("conversation_id", "text", "persona_id", "split", "metadata"))
MEMORY = StructType(
    _strings("id", "persona_id", "memory_type", "content", "importance", "topic", "source_conversation_id", "source_message_id", "status", "superseded_by")
    + [StructField(n, TimestampType()) for n in ("created_at", "updated_at", "last_accessed_at")]
)
DOMAINS = {
    "split": ["train", "val", "test"],
    "role": ["user", "assistant", "system"],
    "importance": ["high", "medium", "low"],
    "status": ["active", "superseded"],
    "ambiguity": ["high", "medium", "low"],
}
