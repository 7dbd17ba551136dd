"""Substring dedup by hashing lines, paragraphs or sentences.

A text is parted into units at white space: a line ends where the space holds a line break, a paragraph where it holds two, a
sentence also after a word that ends in . ! or ?. A unit reaches to the start of the next one, so units together are the text.
Units are normalised (A-Z lower-cased, white space runs to one blank, trimmed) and reduced to 128-bit digests. Digests are
grouped globally, with minimum and count combined before the shuffle; the occurrence of lowest rank (id, then place in the
document) is kept, every other one is spare. Runs of neighbouring spare units with `min_words` words or more together are
removed and reported with their offsets in the original text; a shorter run is usage that texts share by chance, and stays.
With `min_words` 1 every spare unit goes.

Units are written once, and only digests that occur twice or more are joined back, from a written table, so a line that a
third of all documents has is one skewed side of a plain join, which adaptive execution splits. Texts without a spare run are
not shuffled where the keys of the others are few enough to broadcast.

Nulls: a null text has no unit and stays null. A null id ranks first. Rows with the same id and text are one document and
share their result. A text of white space alone has no unit and stays. Very long texts follow the same way. An empty table
gives an empty result. Extra columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, SPACE, lean, mix, powers, prefix_hash, small_batches, span_hash, stash, text_chunks, with_spans

#: Line breaks that end a unit, and whether a sentence mark does.
UNITS = {"line": (1, False), "paragraph": (2, False), "sentence": (1, True)}
MARKS = np.isin(np.arange(256), list(b".!?"))


def units_of(texts: list[bytes], unit: str):
    """Units of all texts in order: text, start and end (bytes in the text), words, two digests."""
    breaks, marks = UNITS[unit]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    base = np.concatenate(([0], np.cumsum(lengths)))
    buf = LOWER_TABLE[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    space = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return [np.zeros(0, dtype=np.int64)] * 4 + [np.zeros(0, dtype=np.uint64)] * 2
    of = np.searchsorted(base[1:], starts, side="right")
    lines = np.concatenate(([0], np.cumsum(buf == 10)))
    stop = np.ones(len(starts), dtype=bool)
    stop[:-1] = (of[1:] != of[:-1]) | (lines[starts[1:]] - lines[ends[:-1]] >= breaks)
    if marks:
        stop |= MARKS[buf[ends - 1]]
    last = np.flatnonzero(stop)
    head = np.concatenate(([0], last[:-1] + 1))
    p, _ = powers(len(starts) + 1)
    word = mix(span_hash(prefix_hash(buf), starts, ends))
    sums = []
    for seed in (0, 11):
        h = np.zeros(len(word) + 1, dtype=np.uint64)
        np.cumsum((mix(word, seed) | np.uint64(1)) * p[: len(word)], out=h[1:])
        sums.append(mix(span_hash(h, head, last + 1), seed + 1))
    of = of[head]
    begin = starts[head] - base[of]
    begin[np.concatenate(([True], of[1:] != of[:-1]))] = 0
    end = lengths[of] - 1
    end[:-1] = np.where(of[1:] == of[:-1], begin[1:], end[:-1])
    return of, begin, end, last + 1 - head, *sums


def unit_table(docs: DataFrame, unit: str) -> DataFrame:
    """id, h, g, unit (place in the text), words, d1, d2 of every unit."""

    @lean
    def run(batches):
        for b in batches:
            for first, part in text_chunks(b.column(3).to_pylist()):
                of, _, _, words, d1, d2 = units_of(part, unit)
                if not len(of):
                    continue
                head = np.searchsorted(of, of, side="left")
                at = pa.array(of + first)
                made = [pa.array((np.arange(len(of)) - head).astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), *made], names=["id", "h", "g", "unit", "words", "d1", "d2"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "h", "g", "text").mapInArrow(run, f"id {kind}, h long, g int, unit int, words int, d1 long, d2 long")


def spare_runs(unit: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """The units of runs of neighbours with at least so many words together."""
    order = np.argsort(unit)
    unit, words = unit[order], words[order]
    run = np.cumsum(np.concatenate(([True], np.diff(unit) != 1))) - 1
    return unit[np.bincount(run, weights=words)[run] >= least]


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", unit: str = "sentence", min_words: int = 30, few: int = 500_000) -> DataFrame:
    """id, text (what is kept), n_units, removed (unit, start and end in characters of the original text).

    few: up to so many documents with spare units, their keys are broadcast; beyond, the join shuffles.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(
        F.col(id_col).alias("id"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(id_col), F.col(text)).alias("h"),
        F.hash(F.col(text), F.col(id_col)).alias("g"),
    )
    units = stash(unit_table(docs, unit), "lines-units")
    rank = F.struct("id", "h", "g", "unit")
    first = units.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stash(first.select("d1", "d2", "first"), "lines-first")
    spare = units.join(first, ["d1", "d2"]).where(~F.col("first").eqNullSafe(rank)).select("h", "g", "unit", "words").distinct()
    spare = spare.groupBy("h", "g").agg(F.collect_list("unit").alias("units"), F.collect_list("words").alias("words"))
    spare = spare.where(F.aggregate("words", F.lit(0), lambda a, x: a + x) >= min_words)
    joined = with_spans(docs, stash(spare, "lines-spare"), "left", few).select("id", "text", "units", "words")

    @lean
    def cut(batches):
        kind = pa.list_(pa.struct([("unit", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            whole, spare, counts = (b.column(i).to_pylist() for i in (1, 2, 3))
            texts, sizes, removed = list(whole), [0] * len(whole), [[] for _ in whole]
            for first, part in text_chunks(whole):
                of, begin, end, *_ = units_of(part, unit)
                at = np.searchsorted(of, np.arange(len(part) + 1))
                for i, raw in enumerate(part):
                    k, lo = first + i, int(at[i])
                    sizes[k] = int(at[i + 1]) - lo
                    gone = spare_runs(np.array(spare[k]), np.array(counts[k]), min_words) if spare[k] else ()
                    if not len(gone):
                        continue
                    a, z = begin[lo + gone], end[lo + gone]
                    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
                    removed[k] = [{"unit": u, "start": s, "end": e} for u, s, e in zip(gone.tolist(), chars[a].tolist(), chars[z].tolist())]
                    edges = [0, *np.stack((a, z), axis=1).ravel().tolist(), len(raw)]
                    texts[k] = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, kind)],
                names=["id", "text", "n_units", "removed"],
            )

    kind = joined.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(cut, f"id {kind}, text string, n_units long, removed array<struct<unit: int, start: long, end: long>>")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), gone.alias("removed_chars"), "text")


SQL = r"""
WITH u AS (
  SELECT doc_id, i, l, trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+', ' ', 'g')) AS n
  FROM (SELECT doc_id, unnest(p) AS l, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text,
    '[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09\x0B-\x0D]+)*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS p FROM documents))
), r AS (
  SELECT *, len(string_split(n, ' ')) AS words, row_number() OVER (PARTITION BY n ORDER BY doc_id, i) > 1 AS spare FROM u
), g AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, spare ORDER BY i) AS run FROM r
), k AS (
  SELECT *, spare AND sum(words) OVER (PARTITION BY doc_id, spare, run) >= 30 AS gone FROM g
), t AS (
  SELECT doc_id, count(*) AS n_units, count_if(gone)::BIGINT AS n_removed, coalesce(sum(length(l)) FILTER (gone), 0)::BIGINT AS removed_chars,
    coalesce(string_agg(l, '' ORDER BY i) FILTER (NOT gone), '') AS text FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0) AS removed_chars,
  coalesce(t.text, d.text) AS text
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
"""
