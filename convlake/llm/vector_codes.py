"""Vector code compression: product quantisation over Hilbert-sorted blocks with exact integers.

Vectors become integers floor(256 * x) and are cut into equal consecutive parts. Each task puts its vectors into chunks; in a chunk, each
part's points are sorted along a Hilbert curve and cut into flat blocks that store a box (smallest and largest components) and sums.
In a round, distances between a block's box and the codebook entries leave a shortlist: entries whose nearest point of the box is no
farther than the farthest point of the box is from some entry. A block with one entry left adds its sums and count whole; the others
go through an integer kernel over their shortlist. Partial sums of (part, entry) are merged by tasks, so the driver sees a codebook only.

Chunks are written once to the shared folder and read for each round; nothing is shuffled but partial sums and label totals. No task
holds more than a chunk. A chunk's integers have the smallest type that holds them; where squares could pass 64 bits, kernels use Python's integers.

Nulls: rows with a null vector, a null or a non-finite component (also if 256 times it is not finite) are dropped; a null id comes after all
others; null labels are one label. Vectors of another length than the first kept one that is not empty are dropped as malformed; a
length that the parts do not divide is an error. Ties go to the lower entry, between equal ids to the smaller vector. Repeated rows
each get a row and count in the codebook. Fewer vectors than entries give a smaller codebook, none an empty result. An error over 64 bits is null, and so is
the sum of its label, or a sum over 64 bits. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, small_batches, stash

KINDS = ["<i2", "<i4", "<i8", "<f8"]


def hilbert(points: np.ndarray) -> np.ndarray:
    """Places of integer points (rows) along a Hilbert curve through their box; up to eight leading components, 62 bits in all."""
    x = points[:, :8].astype(np.float64)
    n = x.shape[1]
    bits = min(16, 62 // n)
    low, span = x.min(axis=0), np.maximum(x.max(axis=0) - x.min(axis=0), 1)
    x = ((x - low) / span * ((1 << bits) - 1)).astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):  # undo the excess work of the curve's turns, from the highest bit
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def packed(values: np.ndarray) -> tuple[int, bytes]:
    """Number and bytes of the smallest kind that holds integer-valued floats."""
    most = np.abs(values).max(initial=0)
    kind = 0 if most < 2**15 else 1 if most < 2**31 else 2 if most < 2**53 else 3
    return kind, values.astype(KINDS[kind]).tobytes()


def whole(values: np.ndarray, wide: bool) -> np.ndarray:
    """As 64-bit integers, or as Python's."""
    return np.array([int(v) for v in values.ravel()], dtype=object).reshape(values.shape) if wide else values.astype(np.int64)


def chunked(kept: DataFrame, dims: int, parts: int, size: int, width: int) -> DataFrame:
    """Rows of up to `size` vectors: ids, labels, and for each part the blocks' points in Hilbert order, that order, boxes and sums."""
    d = dims // parts
    ids, labels = kept.schema["id"].dataType, kept.schema["label"].dataType
    kind = T.StructType([T.StructField("ids", T.ArrayType(ids)), T.StructField("labels", T.ArrayType(labels)), T.StructField("n", T.IntegerType()), T.StructField("kind", T.IntegerType())])
    for c in ("points", "place", "low", "high", "sums"):
        kind.add(c, T.BinaryType())

    def chunk(held: list[pd.DataFrame]) -> dict:
        df = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        v = np.floor(256 * np.array(df["vec"].tolist(), dtype=np.float64)).reshape(len(df), parts, d)
        place, points, low, high, sums = [], [], [], [], []
        edge = np.arange(0, len(df), width)
        for p in range(parts):
            order = np.argsort(hilbert(v[:, p]), kind="stable")
            x = v[order, p]
            place.append(order)
            points.append(x)
            low.append(np.minimum.reduceat(x, edge))
            high.append(np.maximum.reduceat(x, edge))
            sums.append(np.add.reduceat(x, edge))
        code, data = packed(np.stack(points))
        if code == 3:  # floats of that size do not add up exactly
            sums = [np.zeros_like(s) for s in sums]
        put = lambda x, k=KINDS[code]: np.stack(x).astype(k).tobytes()
        null = lambda s: [None if pd.isna(x) else x for x in s]
        return {"ids": null(df["id"].tolist()), "labels": null(df["label"].tolist()), "n": len(df), "kind": code, "points": data, "place": put(place, "<u2"), "low": put(low), "high": put(high), "sums": put(sums, KINDS[2] if code < 3 else KINDS[3])}

    def run(batches):
        held, n = [], 0
        for df in batches:
            for a in range(0, len(df), size):
                held.append(df.iloc[a : a + size])
                n += len(held[-1])
                if n >= size:
                    every = pd.concat(held, ignore_index=True)
                    yield pd.DataFrame([chunk([every.iloc[:size]])])
                    held, n = [every.iloc[size:]], n - size
        if n:
            yield pd.DataFrame([chunk(held)])

    return kept.mapInPandas(lean(run), kind)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, entry) pairs, in this order, that may hold a nearest entry of some point in the block's box."""
    near = far = 0
    for k in range(low.shape[1]):
        e, a, b = entries[None, :, k], low[:, k, None], high[:, k, None]
        gap = np.maximum(np.maximum(a - e, e - b), 0)
        wide = np.maximum(abs(e - a), abs(b - e))
        near, far = near + gap * gap, far + wide * wide
    return np.nonzero((near <= far.min(axis=1)[:, None]).astype(bool))


def kernel(x: np.ndarray, size: np.ndarray, block: np.ndarray, entry: np.ndarray, entries: np.ndarray, blocks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lowest of equals) and squared distance of every point of `blocks`, over their shortlists only."""
    use = np.isin(block, blocks)
    block, entry = block[use], entry[use]
    edge = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    rows = np.minimum(block[:, None] * width + np.arange(width), len(x) - 1)
    dist = 0
    for k in range(x.shape[1]):
        gap = x[rows, k] - entries[entry, k][:, None]
        dist = dist + gap * gap
    best = np.minimum.reduceat(dist * len(entries) + entry[:, None], edge)
    best = best[np.arange(width)[None, :] < size[blocks][:, None]]
    return (best % len(entries)).astype(np.int64), best // len(entries)


def parts_of(row, parts: int, d: int, books: list, width: int):
    """For each part: its number, points, block sizes, shortlist pairs, blocks with one entry, sums, entries; integers all."""
    n, name = int(row.n), KINDS[row.kind]
    blocks = -(-n // width)
    size = np.full(blocks, width)
    size[-1] = n - width * (blocks - 1)
    x, low, high = (np.frombuffer(b, dtype=name).reshape(parts, -1, d) for b in (row.points, row.low, row.high))
    sums = np.frombuffer(row.sums, dtype=KINDS[2] if row.kind < 3 else name).reshape(parts, -1, d)
    for p in range(parts):
        book = np.array(books[p], dtype=object)
        most = max(int(max(abs(book.min()), abs(book.max()))), int(np.abs(x[p]).max()))
        wide = row.kind == 3 or 4 * most * most * d * len(book) >= 1 << 62
        entries = book if wide else book.astype(np.int64)
        points, a, b = (whole(y[p], wide) for y in (x, low, high))
        yield p, points, size, *shortlists(a, b, entries), sums[p], entries


def refined(chunks: DataFrame, parts: int, d: int, books: list, width: int) -> list:
    """The codebooks after one round: entries replaced by the floor of their parts' mean, unused ones as they were."""

    def run(batches):
        total: dict[tuple[int, int], list[int]] = {}

        def add(p, e, count, sums):
            held = total.setdefault((p, int(e)), [0] * (d + 1))
            held[0] += int(count)
            for k in range(d):
                held[k + 1] += int(sums[k])

        for df in batches:
            for row in df.itertuples(index=False):
                for p, x, size, block, entry, sums, entries in parts_of(row, parts, d, books, width):
                    listed = np.bincount(block, minlength=len(size))
                    alone = (listed == 1) if row.kind < 3 else np.zeros(len(size), dtype=bool)
                    for b, e in zip(block[alone[block]], entry[alone[block]], strict=True):
                        add(p, e, size[b], sums[b])
                    rest = np.flatnonzero(~alone)
                    if len(rest):
                        found, _ = kernel(x, size, block, entry, entries, rest, width)
                        own = x[np.repeat(~alone, size)]
                        for e in np.unique(found):
                            mine = own[found == e]
                            add(p, e, len(mine), mine.sum(axis=0))
        rows = [(p, e, v[0], [str(s) for s in v[1:]]) for (p, e), v in total.items()]
        yield pd.DataFrame(rows, columns=["part", "entry", "n", "sums"])

    def merge(batches):
        total: dict[tuple[int, int], list[int]] = {}
        for df in batches:
            for p, e, n, sums in df.itertuples(index=False):
                held = total.setdefault((p, e), [0] * (d + 1))
                for k, v in enumerate([n, *sums]):
                    held[k] += int(v)
        rows = [(p, e, v[0], [str(s) for s in v[1:]]) for (p, e), v in total.items()]
        yield pd.DataFrame(rows, columns=["part", "entry", "n", "sums"])

    kind = "part int, entry int, n long, sums array<string>"
    partial = chunks.select("n", "kind", "points", "low", "high", "sums").mapInPandas(lean(run), kind)
    new = [[list(e) for e in book] for book in books]
    for r in partial.repartition("part", "entry").mapInPandas(lean(merge), kind).collect():
        new[r.part][r.entry] = [int(s) // r.n for s in r.sums]
    return new


def coded(chunks: DataFrame, parts: int, d: int, books: list, width: int) -> DataFrame:
    """id, label, code and error of every vector."""
    kind = T.StructType([T.StructField("id", chunks.schema["ids"].dataType.elementType), T.StructField("label", chunks.schema["labels"].dataType.elementType)])
    kind.add("code", T.StringType()).add("error", T.LongType())
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for df in batches:
            for row in df.itertuples(index=False):
                place = np.frombuffer(row.place, dtype="<u2").reshape(parts, -1)
                codes, error = np.zeros((int(row.n), parts), dtype=np.int64), np.zeros(int(row.n), dtype=object)
                for p, x, size, block, entry, _, entries in parts_of(row, parts, d, books, width):
                    found, dist = kernel(x, size, block, entry, entries, np.arange(len(size)), width)
                    codes[place[p], p] = found
                    error[place[p]] += dist
                code = ["".join(c) for c in digits[codes]]
                fits = [int(e) if e < 1 << 63 else None for e in error]
                out = pd.DataFrame({"id": pd.Series(list(row.ids), dtype=object), "label": pd.Series(list(row.labels), dtype=object), "code": code, "error": pd.Series(fits, dtype=object)})
                yield out

    return chunks.select("ids", "labels", "n", "kind", "points", "place", "low", "high", "sums").mapInPandas(lean(run), kind)


def finite(vec: Column) -> Column:
    """Whether a vector and all its components are there, and 256 times each is finite."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) < float("inf")))


def fit_codes(
    vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, few: int = 500_000,
    chunk: int = 32_768, width: int = 16,
) -> tuple[DataFrame, list]:
    """(id, code, error, label_error; the codebooks as lists of entries of integers for each part).

    few: up to so many labels are broadcast with their totals; beyond, the join shuffles. chunk, width: vectors of a chunk (65,536 at
    most) and points of a block.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    small_batches(vectors.sparkSession, rows=2000)
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vec).alias("vec"))
    kept = kept.where(finite(F.col("vec")) & (F.size("vec") > 0))
    by_id = [F.col("id").asc_nulls_last(), F.transform("vec", lambda x: F.floor(x.cast("double") * 256))]
    first = kept.orderBy(*by_id).limit(1).select(F.size("vec").alias("n")).first()
    dims = first.n if first else parts
    if dims % parts:
        raise ValueError(f"{parts} equal parts of {dims} components")
    kept, d = kept.where(F.size("vec") == dims), dims // parts
    start = [[int(np.floor(256 * float(x))) for x in r.vec] for r in kept.orderBy(*by_id).limit(entries).select("vec").collect()]
    books = [[v[p * d : (p + 1) * d] for v in start] for p in range(parts)]
    chunks = stash(chunked(kept, dims, parts, chunk, width), "vector-chunks")
    for _ in range(rounds if start else 0):
        books = refined(chunks, parts, d, books, width)
    out = stash(coded(chunks, parts, d, books, width), "vector-codes")
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    totals = out.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label")
    totals = F.broadcast(totals) if totals.count() <= few else totals
    joined = out.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def digest(books: list) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = fit_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))


def _nearest(book: str) -> str:
    dist = "list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    return f"SELECT key, parts.p, any_value(x) AS x, min({dist} * 64 + e)::BIGINT AS best FROM parts JOIN {book} c ON c.p = parts.p GROUP BY key, parts.p"


_ROUNDS = "".join(
    f""", a{k} AS MATERIALIZED ({_nearest(f"c{k}")}), s{k} AS (
  SELECT p, e, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY i) AS c FROM (
    SELECT p, best % 64 AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, range(1, 1000) AS places(i) WHERE i <= len(x) GROUP BY ALL
  ) GROUP BY p, e
), c{k + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(s{k}.c, o.c) AS c FROM c{k} o LEFT JOIN s{k} ON s{k}.p = o.p AND s{k}.e = o.e)"""
    for k in range(2)
)
SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS key, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT key, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(0, 16) AS ps(p)
), c0 AS MATERIALIZED (SELECT p, key - 1 AS e, x AS c FROM parts WHERE key <= 64){_ROUNDS}
, a2 AS MATERIALIZED ({_nearest("c2")}), coded AS (
  SELECT key, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY key
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (key), books
"""
