"""Helpers shared by the training-data operators: shared-folder tables and array hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Has Spark remove the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where that is unset, a temporary one in local mode, an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-convlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there, on any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/convlake-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    with contextlib.suppress(AnalysisException):  # elsewhere shuffle files go when the driver collects its garbage
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = [path]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `stash` that nothing reads any more; other tables are left alone."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for path in df.__dict__.pop("_stashed", []):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def reads(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """`df`, which reads stashed tables: `discard(df)` deletes them, too."""
    df._stashed = [p for t in tables for p in t.__dict__.get("_stashed", [])]
    return df


def key_slices(keys: DataFrame, col: str, few: int, most: int = 16) -> list[DataFrame] | None:
    """Parts of `keys` (distinct in `col`) of about `few` rows at most, each to broadcast; None where there would be more than `most`."""
    n = -(-keys.count() // few) if few > 0 else most + 1
    if n > most:
        return None
    return [keys.where(F.pmod(F.xxhash64(F.lit(3), col), F.lit(n)) == i) for i in range(n)] if n > 1 else [keys]


def small_batches(spark: SparkSession, rows: int = 400, mb: int = 8) -> None:
    """Bound what one Arrow batch holds, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def release() -> None:
    """Give memory that is free in this Python worker back to the system, the tables of powers included."""
    global _pow, _inv
    _pow = _inv = np.ones(1, dtype=np.uint64)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: What a worker holds for the next task of the same kind, by name; a task of another kind drops it.
CACHES: dict[str, dict] = {}


def forget(keeps: str | None) -> None:
    """Drop the caches of other kinds of tasks."""
    if other := CACHES.keys() - {keeps}:
        for name in other:
            del CACHES[name]
        release()


def lean(run, keeps: str | None = None):
    """`run` for mapInArrow or mapInPandas, which gives its memory back at the end of each task. keeps: the name of its cache.

    Workers wait for the next task with all that the allocators keep for themselves, beside an executor whose heap is full.
    """

    @functools.wraps(run)
    def task(batches):
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            release()

    return task


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. The fast built-in is used where it changes nothing else."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def with_spans(docs: DataFrame, spans: DataFrame, how: str, few: int) -> DataFrame:
    """`docs` joined with `spans` on (h, g). Texts without spans are not shuffled if the keys are few enough to broadcast."""
    if spans.count() > few:
        return docs.join(spans, ["h", "g"], how)
    keys = F.broadcast(spans.select("h", "g"))
    near = docs.join(keys, ["h", "g"], "left_semi").join(spans, ["h", "g"])
    if how == "inner":
        return near
    other = docs.join(keys, ["h", "g"], "left_anti")
    for c in spans.columns[2:]:
        other = other.withColumn(c, F.lit(None).cast(spans.schema[c].dataType))
    return near.unionByName(other)


# --- array hashing -----------------------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)
_pow = _inv = np.ones(1, dtype=np.uint64)
#: One random 64-bit value per byte.
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 21)
        _pow = np.full(size, BASE, dtype=np.uint64)
        _inv = np.full(size, _INV, dtype=np.uint64)
        _pow[0] = _inv[0] = 1
        _pow, _inv = np.cumprod(_pow, dtype=np.uint64), np.cumprod(_inv, dtype=np.uint64)
    return _pow, _inv


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial sum of buf[:i] modulo 2**64."""
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(BYTES[buf] * p[: len(buf)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of buf[start:end], free of where they stand."""
    _, inv = powers(len(h))
    return (h[end] - h[start]) * inv[start]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(texts, limit: int = 1 << 20):
    """Groups of whole texts: (first index, list of UTF-8 bytes) with about `limit` bytes together."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t is not None else b""
        held.append(b)
        size += len(b)
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of every text as 64-bit hashes: (sorted by text then hash, bounds of each text).

    Words are runs without ASCII white space, with A-Z lower-cased. A text of fewer words than `size`
    has its whole sequence as one shingle; a text without words has none.
    """
    buf = LOWER_TABLE[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    space = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    of = np.searchsorted(np.cumsum(lengths), starts, side="right")
    wh = mix(span_hash(prefix_hash(buf), starts, ends))
    n_words = np.bincount(of, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n_words)[:-1]))
    n = len(wh) - size + 1
    if n > 0:
        full = of[:n] == of[size - 1 :]
        h = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            h = h * np.uint64(BASE) + wh[k : k + n]
        hashes, owner = mix(h[full], 1), of[:n][full]
    else:
        hashes, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        own = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = n_words[short] > k
            own[has] = own[has] * np.uint64(BASE) + wh[first[short[has]] + k]
        hashes = np.concatenate((hashes, mix(own + n_words[short].astype(np.uint64), 2)))
        owner = np.concatenate((owner, short))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))
