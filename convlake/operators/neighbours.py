"""Pairs of like vectors and the best matches of queries, without all pairs of a key in one task.

Near pairs: the vectors of a group are dealt into blocks, and each two blocks are compared, exactly, in one bounded task. Where a caller asks
for buckets instead, each vector gets, in several tables, the signs of its products with random directions as a bucket; a query side also looks
into the buckets whose bit is nearest to turning. Like vectors share a bucket in some table with a stated probability, and only pairs
that do are compared, exactly. Exact copies are one vector before that; buckets with many vectors are split by salt.

Search: the queries and the memories of a key are dealt into blocks; each pair of blocks is one bounded task, which gives the k best of
its memories for each of its queries, and the k best of those are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .relational import cosine


def tables_for(threshold: float, bits: int, miss: float) -> int:
    """Tables with which a pair at `threshold` shares no bucket with a probability of `miss` at most."""
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log(1 - hit))) if hit < 1 else 1


def _buckets(vectors: DataFrame, bits: int, tables: int, probes: int, seed: int) -> DataFrame:
    """keys, id, t, bucket, own: a row for each table, and `probes` more for the bits that turn most easily."""
    kept = [f for f in vectors.schema.fields if f.name != "vec"]
    kind = T.StructType([*kept, T.StructField("t", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("own", T.BooleanType())])

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for df in batches:
            for size, part in df.groupby(df["vec"].map(len)):
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).normal(size=(size, tables * bits))
                v = np.array(part["vec"].tolist(), dtype=np.float64)
                away = (v @ planes[size]).reshape(len(v), tables, bits)
                signs = (away > 0).astype(np.int64)
                bucket = (signs << np.arange(bits)).sum(axis=2)
                easy = np.argsort(np.abs(away), axis=2)[:, :, :probes]
                keys = np.concatenate([bucket[:, :, None], bucket[:, :, None] ^ (np.int64(1) << easy)], axis=2)
                n = keys.shape[2]
                out = part.drop(columns="vec").loc[part.index.repeat(tables * n)].reset_index(drop=True)
                out["t"] = np.tile(np.repeat(np.arange(tables, dtype=np.int32), n), len(v))
                out["bucket"] = keys.ravel()
                out["own"] = np.tile(np.arange(n) == 0, len(v) * tables)
                yield out

    return vectors.mapInPandas(run, kind)


def _all_pairs(own: DataFrame, keys: list[str], threshold: float, rows: int = 4096, undefined: bool = False) -> DataFrame:
    """a < b and similarity of all pairs of rows of a group at `threshold` or over: blocks of `rows` rows with each other, each two blocks once.

    Rows of one id make no pair. undefined: a pair of which a vector is zero or not finite has SQL's NaN, which is over every threshold.
    """
    group = F.struct(F.lit(0).alias("_"), *keys)
    per = own.groupBy(group.alias("_g")).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_n"))
    at = F.pmod(F.xxhash64("id", "vec"), F.col("_n")).cast("int")
    placed = own.select(group.alias("_g"), "id", "vec").join(per, "_g").withColumn("_at", at)
    dealt = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("_g", F.least("_at", "_with").alias("_i"), F.greatest("_at", "_with").alias("_j"), "_at", "id", "vec")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(batches), ignore_index=True)
        same = df["_i"].iat[0] == df["_j"].iat[0]
        x, y = (df, df) if same else (df[df["_at"] == df["_i"]], df[df["_at"] == df["_j"]])
        a, b, right = x["id"].to_numpy(), y["id"].to_numpy(), _by_length(y["vec"])
        for size, (left_at, v, v_norm) in _by_length(x["vec"]).items():
            if size not in right:
                continue
            right_at, w, w_norm = right[size]
            v_fit, w_fit = v_norm > 0, w_norm > 0
            unit = np.where(w_fit[:, None], w, 0) / np.where(w_fit, w_norm, 1)[:, None]
            for k in range(0, len(v), 256):
                part, fit = v[k : k + 256], v_fit[k : k + 256]
                values = np.where(fit[:, None], part, 0) / np.where(fit, v_norm[k : k + 256], 1)[:, None] @ unit.T
                fit = fit[:, None] & w_fit[None, :]
                hit = (values >= threshold - 1e-9) & fit | (~fit if undefined else False)
                if same:
                    hit &= right_at[None, :] > left_at[k : k + 256, None]
                i, j = np.nonzero(hit)
                found = np.where(fit[i, j], np.clip(values[i, j], 0, 1), np.nan)
                # what is next to the threshold is summed one by one, as SQL does
                edge = np.flatnonzero(np.abs(found - threshold) <= 1e-9)
                found[edge] = np.clip(_sums(part[i[edge]] * w[j[edge]]) / (v_norm[k + i[edge]] * w_norm[j[edge]]), 0, 1)
                one, other = a[left_at[k + i]], b[right_at[j]]
                keep = (one != other) & ~(found < threshold)
                yield pd.DataFrame({"a": np.minimum(one, other), "b": np.maximum(one, other), "similarity": found})[keep]

    kind = T.StructType([T.StructField(c, own.schema["id"].dataType) for c in "ab"] + [T.StructField("similarity", T.DoubleType())])
    pairs = dealt.groupBy("_g", "_i", "_j").applyInPandas(near, kind)
    return pairs.withColumn("similarity", F.coalesce("similarity", F.lit(math.nan)))  # pandas has NaN as null


def near_rows(vectors: DataFrame, keys: list[str], id_col: str, vec: str, threshold: float = 0.98) -> DataFrame:
    """a < b and similarity of all pairs of rows of one group of `keys` with a cosine of `threshold` or more, as a self-join in SQL gives them.

    Exact copies are pairs, too, and no pair is missed; rows with a null key or id, or without a whole vector, have none. A zero vector or one
    that is not finite has no cosine: its pairs have NaN, which SQL holds to be over every threshold.
    """
    rows = vectors.select(*keys, F.col(id_col).alias("id"), F.col(vec).alias("vec")).where(F.size("vec") > 0).where(F.forall("vec", lambda x: x.isNotNull()))
    return _all_pairs(rows.dropna(subset=[*keys, "id"]), keys, threshold, undefined=True)


def near_pairs(
    vectors: DataFrame, keys: list[str], id_col: str, vec: str, threshold: float = 0.98, miss: float = 1e-3, bits: int | None = None,
    probes: int = 1, crowd: int = 1000, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b of one group of `keys` with a cosine of `threshold` or more, and their similarity; classes: id and the smallest id of its exact copies).

    Pairs are between classes; `near_rows` has those of copies, too. By default all pairs of a group are compared in blocks, and none is missed.
    bits: compare only what shares a bucket of so many bits instead. Then, miss: the largest share of pairs at the threshold that may stay
    unfound; crowd: vectors of a bucket from which on it is split. Null, empty and zero vectors pair with nothing.
    """
    rows = vectors.select(*keys, F.col(id_col).alias("id"), F.col(vec).alias("vec")).where(F.size("vec") > 0)
    rows = rows.where(F.exists("vec", lambda x: x != 0) & F.forall("vec", lambda x: x.isNotNull()))
    named = rows.groupBy(*keys, "vec").agg(F.min("id").alias("rep"))
    alike = F.lit(True)
    for k in [*keys, "vec"]:
        alike = alike & F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}"))
    classes = rows.alias("r").join(named.alias("n"), alike).select(F.col("r.id").alias("id"), "rep")
    own = named.withColumnRenamed("rep", "id")
    if bits is None:
        return _all_pairs(own, keys, threshold), classes
    found = _buckets(own, bits, tables_for(threshold, bits, miss), probes, seed)
    at = [*keys, "t", "bucket"]
    many = found.where("own").groupBy(*at).count().where(F.col("count") > crowd)
    many = many.select(*[F.col(c).alias(f"_{c}") for c in at], F.ceil(F.col("count") / crowd).cast("int").alias("salts"))
    same = F.lit(True)
    for c in at:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = found.join(many, same, "left").withColumn("salts", F.coalesce("salts", F.lit(1))).drop(*[f"_{c}" for c in at])
    left = found.where("own").select(*[F.col(c).alias(f"l_{c}") for c in at], F.col("id").alias("l"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("l_salt"))
    right = found.select(*at, F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    match = F.col("l_salt") == F.col("salt")
    for c in at:
        match = match & F.col(c).eqNullSafe(F.col(f"l_{c}"))
    pairs = left.join(right, match).where("l <> r").select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct()
    side = lambda name: own.select(F.col("id").alias(name), F.col("vec").alias(f"{name}_vec"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", cosine(F.col("a_vec"), F.col("b_vec")))
    return pairs.where(F.col("similarity") >= threshold).select("a", "b", "similarity"), classes


def blocked(
    queries: DataFrame, memories: DataFrame, key: str, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], kind: T.StructType,
    query_block: int = 1024, memory_block: int = 8192,
) -> DataFrame:
    """Rows that `work` makes of each block of queries and each block of memories of one `key`, as `kind`; a pair of rows meets once.

    query_block, memory_block: rows of each that one task holds, on average, however many a key has. Null keys meet nothing.
    """
    nq, nm = (df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias(n)) for df, n in ((queries, "nq"), (memories, "nm")))
    blocks = nq.join(nm, "_key").select("_key", F.ceil(F.col("nq") / query_block).cast("int").alias("_qb"), F.ceil(F.col("nm") / memory_block).cast("int").alias("_mb"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(blocks, F.col(key) == F.col("_key")).withColumns({"_i": F.pmod(F.xxhash64("q_id"), F.col("_qb")).cast("int"), "_j": spread("_mb")})
    m = memories.join(blocks, F.col(key) == F.col("_key")).withColumns({"_j": F.pmod(F.xxhash64("m_id"), F.col("_mb")).cast("int"), "_i": spread("_qb")})
    own = lambda df: [c for c in df.columns if c != key]
    q = q.select(F.col("_key").alias("_qk"), F.col("_i").alias("_qi"), F.col("_j").alias("_qj"), *own(queries))
    m = m.select(F.col("_key").alias("_mk"), F.col("_i").alias("_mi"), F.col("_j").alias("_mj"), *own(memories))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return work(a, b) if len(a) and len(b) else none

    none = pd.DataFrame({f.name: [] for f in kind.fields})
    return q.groupBy("_qk", "_qi", "_qj").cogroup(m.groupBy("_mk", "_mi", "_mj")).applyInPandas(pair, kind)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the rows, one number after the other."""
    return np.add.accumulate(x, axis=1)[:, -1]


def _by_length(col: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: places, vectors and their norms; 0 for those that are not finite."""
    lengths = col.map(lambda v: 0 if v is None else len(v))
    out = {}
    for size in set(lengths) - {0}:
        at = np.flatnonzero(lengths == size)
        v = np.array(col.iloc[at].tolist(), dtype=np.float64)
        norm = np.sqrt(_sums(v * v))
        out[size] = (at, v, np.where(np.isfinite(norm), norm, 0))
    return out


def _unit(col: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places and unit vectors."""
    lengths = col.map(lambda v: 0 if v is None else len(v))
    out = {}
    for size in set(lengths) - {0}:
        at = np.flatnonzero(lengths == size)
        v = np.array(col.iloc[at].tolist(), dtype=np.float64)
        norm = np.sqrt((v * v).sum(axis=1))
        at, v, norm = at[norm > 0], v[norm > 0], norm[norm > 0]
        out[size] = (at, v / norm[:, None])
    return out


def cosines(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Cosines in [0, 1] of each vector of `a` with each of `b`; 0 for missing, empty, zero and unlike vectors, as `relational.cosine`."""
    out, right = np.zeros((len(a), len(b))), _unit(b)
    for size, (at, v) in _unit(a).items():
        if size in right:
            out[np.ix_(at, right[size][0])] = np.clip(v @ right[size][1].T, 0, 1)
    return out


def overlaps(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Shares of words in common of each word list of `a` with each of `b`; 0 where one is missing or empty."""
    out, sizes, postings = np.zeros((len(a), len(b))), np.zeros(len(b)), {}
    for x, words in enumerate(b):
        for w in (own_words := set(words) if words is not None else ()):
            postings.setdefault(w, []).append(x)
        sizes[x] = len(own_words)
    for y, words in enumerate(a):
        if postings and words is not None and len(words):
            words, common = set(words), np.zeros(len(b))
            for w in words & postings.keys():
                common[postings[w]] += 1
            out[y] = common / np.maximum(len(words) + sizes - common, 1)
    return out


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded as SQL rounds: halves of the shortest decimal form away from zero; for numbers from 0 on."""
    y = x * 10.0**places
    out = np.round(y) / 10.0**places
    for at in zip(*np.nonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6)):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return out


def compared(queries: DataFrame, memories: DataFrame, key: str) -> DataFrame:
    """q_id, m_id and the cosine (semantic) of every query with every other memory of its `key`: as many rows as there are such pairs."""
    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        q, m = np.repeat(a["q_id"].to_numpy(), len(b)), np.tile(b["m_id"].to_numpy(), len(a))
        other = q != m
        return pd.DataFrame({"q_id": q[other], "m_id": m[other], "semantic": cosines(a["q_embedding"], b["m_embedding"]).ravel()[other]})

    kind = T.StructType([queries.schema["q_id"], memories.schema["m_id"], T.StructField("semantic", T.DoubleType())])
    return blocked(queries.select(key, "q_id", "q_embedding"), memories.select(key, "m_id", "m_embedding"), key, work, kind, 512, 1024)


def met_before(queries: DataFrame, memories: DataFrame, key: str, over: float) -> DataFrame:
    """q_id and whether a memory of its `key` with a smaller id has a cosine over `over` (met); for queries with another memory."""
    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        q, m = a["q_id"].to_numpy()[:, None], b["m_id"].to_numpy()[None, :]
        hit = ((m < q) & (cosines(a["q_embedding"], b["m_embedding"]) > over)).any(axis=1)
        return pd.DataFrame({"q_id": a["q_id"].to_numpy(), "met": hit})[(m != q).any(axis=1)]

    kind = T.StructType([queries.schema["q_id"], T.StructField("met", T.BooleanType())])
    found = blocked(queries.select(key, "q_id", "q_embedding"), memories.select(key, "m_id", "m_embedding"), key, work, kind)
    return found.groupBy("q_id").agg(F.bool_or("met").alias("met"))


def search(
    queries: DataFrame, memories: DataFrame, key: str, k: int = 10, own: bool = False, cos: float = 0.7, overlap: float = 0.3,
    query_block: int = 1024, memory_block: int = 8192,
) -> DataFrame:
    """q_id, m_id, score, rank: the k best memories of each query's `key`, by `cos` times the cosine in [0, 1] plus `overlap` times the share of words in common.

    queries: `key`, q_id, q_embedding, q_words; memories: `key`, m_id, m_embedding, m_words. A missing or unlike vector and a missing word list
    count 0. Scores have nine places; ties go to the smaller m_id. own: queries are memories, too, and do not find themselves. query_block,
    memory_block: rows that one task holds, on average.
    """
    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        score = cos * cosines(a["q_embedding"], b["m_embedding"])
        score += overlap * overlaps(a["q_words"], b["m_words"])
        score, ids = np.round(score, 9), b["m_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        out = []
        for y, name in enumerate(a["q_id"]):
            order = by_id[np.argsort(-score[y][by_id], kind="stable")]
            order = [x for x in order[: k + 1] if not (own and ids[x] == name)]
            out += [(name, ids[x], score[y, x]) for x in order[:k]]
        return pd.DataFrame(out, columns=["q_id", "m_id", "score"])

    kind = T.StructType([queries.schema["q_id"], memories.schema["m_id"], T.StructField("score", T.DoubleType())])
    q, m = (df.select(key, f"{x}_id", f"{x}_embedding", f"{x}_words") for df, x in ((queries, "q"), (memories, "m")))
    part = blocked(q, m, key, best, kind, query_block, memory_block)
    w = W.partitionBy("q_id").orderBy(F.desc("score"), "m_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
