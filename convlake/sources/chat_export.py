"""Chat-export text files as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ordered import numbered
from .lines import numbered_lines

# The two line grammars, time formats in the order in which they are tried, and notice patterns.
PLAIN = r"^(\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4},? \d{1,2}:\d{2}(?::\d{2})?(?: ?[AaPp][Mm])?) [-\x{2013}\x{2014}] (.*)$"
BRACKET = r"^\[(\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4},? \d{1,2}:\d{2}(?::\d{2})?(?: ?[AaPp][Mm])?)\] (.*)$"
FORMATS = [
    "M/d/yy, h:mm a", "M/d/yyyy, h:mm a", "d/M/yy, h:mm a", "d/M/yyyy, h:mm a", "M/d/yy, h:mm:ss a", "d/M/yy, h:mm:ss a",
    "d/M/yy, H:mm", "d/M/yyyy, H:mm", "M/d/yy, H:mm", "M/d/yyyy, H:mm", "d/M/yy, H:mm:ss", "d/M/yyyy, H:mm:ss",
    "yyyy-MM-dd, H:mm", "yyyy-MM-dd H:mm:ss",
]
#: Whole messages of these kinds, and what a notice holds; matched without regard to case.
MEDIA = [
    "<Media omitted>", "image omitted", "video omitted", "audio omitted", "sticker omitted", "GIF omitted", "document omitted",
    "Contact card omitted", r"Location: https://maps\.google\.com.*",
]
DELETED = ["This message was deleted", "You deleted this message"]
SYSTEM = [
    "Messages and calls are end-to-end encrypted", "^Waiting for this message", "security code changed", "changed their phone number",
    "changed the subject to", "created group", "added you",
]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of chat exports; large files are read in splits."""
    return numbered_lines(spark, path)


def timestamp(raw: Column) -> Column:
    """The first format that fits; two-digit years from 69 on are of the last century."""
    raw = F.upper(F.regexp_replace(raw, r"[\x{202F}\x{00A0}]", " "))
    found = F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in FORMATS])
    late = raw.rlike(r"^\d{1,2}/\d{1,2}/\d{2},") & (F.year(found) >= 2069)
    return F.when(late, F.timestamp_add("YEAR", F.lit(-100), found)).otherwise(found)


def message_type(speaker: Column, text: Column) -> Column:
    body = T.strip(F.coalesce(text, F.lit("")))
    whole = lambda xs: body.rlike(r"(?is)^(?:" + "|".join(xs) + r")\z")
    return (
        F.when(speaker == "SYSTEM", "system")
        .when(body == "", "empty")
        .when(whole(MEDIA), "media")
        .when(whole(DELETED), "deleted")
        .when(body.rlike("(?i)" + "|".join(SYSTEM)), "system")
        .when(body.rlike(r"^https?://\S+$"), "url")
        .otherwise("text")
    )


def parse(lines: DataFrame, persona: str | None = None, at: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages, and orphan lines before the first header.

    A header starts a message; other lines belong to the message before. at: line numbers that cut a large file's lines into ranges
    for tasks of their own (`ordered.cuts`).
    """
    clean = F.regexp_replace("line", r"[\x{200E}\x{200F}\x{202F}\x{00A0}]", " ")
    raw = F.coalesce(F.nullif(F.regexp_extract(clean, PLAIN, 1), F.lit("")), F.nullif(F.regexp_extract(clean, BRACKET, 1), F.lit("")))
    rest = F.coalesce(F.nullif(F.regexp_extract(clean, PLAIN, 2), F.lit("")), F.nullif(F.regexp_extract(clean, BRACKET, 2), F.lit("")), F.lit(""))
    df = numbered(lines.withColumns({"_raw": raw, "_rest": rest}), ["path"], "line_no", ["_raw"], lambda now, before: now("_raw").isNotNull(), "_m", at=at)
    first = df.where("_raw IS NOT NULL").groupBy(F.col("path").alias("_path")).agg(F.min("line_no").alias("_first"))
    df = df.join(first, F.col("path") == F.col("_path"), "left")
    early = F.col("_first").isNull() | (F.col("line_no") < F.col("_first"))
    orphans = df.where(early & (T.strip(F.col("line")) != "")).select("path", "line_no", F.col("line").alias("content"), F.lit("no header before this line").alias("error"))
    parts = F.sort_array(F.collect_list(F.struct("line_no", F.when(F.col("_raw").isNotNull(), F.col("_rest")).otherwise(F.col("line")).alias("t"))))
    out = df.where(~early).groupBy("path", "_m").agg(F.min("line_no").alias("line_number"), F.min_by("_raw", "line_no").alias("raw_timestamp"), parts.alias("_p"))
    body = F.array_join(F.transform("_p", lambda p: p["t"]), "\n")
    out = out.withColumn("_b", body)
    # the speaker stands on the header's line, whatever follows it
    out = out.withColumn("_h", F.col("_p")[0]["t"])
    named = F.instr("_h", ": ") > 0
    speaker = F.when(named, F.split_part("_h", F.lit(": "), F.lit(1))).otherwise("SYSTEM")
    text = F.when(named, F.expr("substring(_b, instr(_h, ': ') + 2)")).otherwise(F.col("_b"))
    out = out.withColumns({"speaker": speaker, "text": text, "timestamp": timestamp(F.col("raw_timestamp"))})
    out = out.withColumns({
        "message_type": message_type(F.col("speaker"), F.col("text")),
        "contains_url": F.col("text").rlike(T.URL),
        "contains_emoji": T.has_emoji(F.col("text")),
        "contains_devanagari": F.col("text").rlike(T.DEVANAGARI),
        "is_persona": F.col("speaker").eqNullSafe(F.lit(persona)),
    })
    return out.drop("_p", "_m", "_b", "_h"), orphans
