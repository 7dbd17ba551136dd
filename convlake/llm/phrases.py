"""Phrase collocation mining by stripes: each prefix keys an associative counter of what follows it.

The stripe of a phrase of m - 1 words holds how often each next word follows it inside a piece, and in one more cell (suffix 0)
how often none that matters does. Merged element by element over all tasks, it gives the phrases of m words (its cells), the
frequency of the prefix (its sum) and the largest extension (its maximum), which is one half of what subsumption asks; the other
half is the largest cell that ends in a phrase, over all stripes. The stripe of the empty prefix is the vocabulary.

Levels 1 to `longest` each pass over the whole texts. A phrase can only be frequent if its first and its last m - 1 words are,
so a task keeps cells between frequent ones; it asks a bit table of a fixed size (`bits`; a wrong yes costs a cell in the
shuffle and changes no result, as the merged counts decide). Tasks merge their own stripes and hold up to `held` cells. Stripes
go through the shuffle in packs, by buckets of prefixes, sorted by bucket; a task merges one bucket at a time as packs stream
by. A prefix with more than one in `share` of all words (there are at most `share` of them) is split by suffix into 16
segments in buckets of their own, each with a sum and a maximum.

Phrases are 64-bit hashes of language and words until the end; words, counted as strings, give their names. Scores are
computed in decimals of 38 digits.

Nulls: a null text has no words, a null language is `und` (as the language of that name). Empty texts and pieces have no words.
Very long texts are cut at separators into stretches of about a megabyte. Ties in score, count and phrase cannot be, as phrases differ.
Repeated rows count as often as they stand there. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BASE, LOWER, LOWER_TABLE, UPPER, lean, mix, prefix_hash, small_batches, span_hash, stash

STOPS = b".,;:!?\n\x0b\x0c\r"
STOP, GAP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
STOP[list(STOPS)] = GAP[list(STOPS + b" \t")] = True
ROW = 1 << 16


def join_hash(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Of a phrase, from its words but the last and its words but the first."""
    return mix(prefix * np.uint64(BASE) + suffix, 4)


def stretches(texts: list[bytes | None], limit: int = 1 << 20):
    """Lists of (row, bytes) with about `limit` bytes together; longer texts are cut where a piece ends."""
    held, size = [], 0
    for row, t in enumerate(texts):
        t, at = t or b"", 0
        while at < len(t):
            end = len(t)
            if end - at > limit:
                near = STOP[np.frombuffer(t, dtype=np.uint8, count=end - at - limit, offset=at + limit)]
                end = at + limit + int(near.argmax()) + 1 if near.any() else end
            held.append((row, t[at:end]))
            size, at = size + end - at, end
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def spoken(batch: pa.RecordBatch, seen: dict[str, int]):
    """For each stretch: lower-cased bytes, word starts and ends, word hashes with the language in them, pieces, languages."""
    col = batch.column("text")
    texts = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()
    langs = ["und" if x is None else x for x in batch.column("lang").to_pylist()]
    for x in set(langs) - seen.keys():
        seen[x] = int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    for held in stretches(texts):
        buf = LOWER_TABLE[np.frombuffer(b"\n".join(t for _, t in held) + b"\n", dtype=np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], GAP[buf])).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        piece = np.cumsum(STOP[buf])[starts]
        of = np.searchsorted(np.cumsum([len(t) + 1 for _, t in held]), starts, side="right")
        own = np.array([seen[langs[r]] for r, _ in held], dtype=np.uint64)[of]
        yield buf, starts, ends, mix(mix(span_hash(prefix_hash(buf), starts, ends)) ^ own, 3), piece, [langs[r] for r, _ in held], of


def vocabulary(docs: DataFrame, held: int) -> DataFrame:
    """lang, word, h, f of every word; the row with a null word has all words of the language."""

    def count(batches):
        seen: dict[str, int] = {}
        words: dict[int, list] = {}
        totals: dict[str, int] = {}

        def rows():
            out = [(x, w, h if h < 1 << 63 else h - (1 << 64), n) for h, (x, w, n) in words.items()] + [(x, None, 0, n) for x, n in totals.items()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "word", "h", "f"])
            words.clear()
            totals.clear()

        for batch in batches:
            for buf, starts, ends, h, _, langs, of in spoken(batch, seen):
                for lang, k in zip(langs, np.bincount(of, minlength=len(langs)).tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + k
                keys, first, n = np.unique(h, return_index=True, return_counts=True)
                for key, i, k in zip(keys.tolist(), first.tolist(), n.tolist(), strict=True):
                    if (row := words.get(key)) is None:
                        words[key] = [langs[of[i]], buf[starts[i] : ends[i]].tobytes().decode("utf-8", "replace"), k]
                    else:
                        row[2] += k
                if len(words) > held:
                    yield from rows()
        yield from rows()

    parts = docs.mapInArrow(lean(count), "lang string, word string, h long, f long")
    return parts.groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def merged(p: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of equal prefix and suffix added, sorted by both."""
    order = np.lexsort((s, p))
    p, s, n = p[order], s[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])))) if len(p) else np.zeros(0, np.int64)
    return p[new], s[new], np.add.reduceat(n, new) if len(new) else n


def partial_stripes(docs: DataFrame, level: int, table, hot: list[int], buckets: int, held: int) -> DataFrame:
    """Packs of stripes of frequent phrases of level - 1 words, merged within tasks: prefixes p with k cells each, cells (s, n)."""
    width = level - 1
    heavy = np.array(sorted(x & (2**64 - 1) for x in hot), dtype=np.uint64)

    def rows(p, s, n):
        if not len(p):
            return
        seg = np.where(np.isin(p, heavy), s >> np.uint64(60), np.uint64(0))
        bucket = (mix(p ^ seg, 5) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((s, p, bucket))
        p, s, n, bucket = p[order], s[order], n[order], bucket[order]
        new = np.concatenate(([True], (p[1:] != p[:-1]) | (bucket[1:] != bucket[:-1])))
        start = np.flatnonzero(new | (np.arange(len(p)) % ROW == 0))
        size = np.diff(np.append(start, len(p))).astype(np.int32)
        row = np.flatnonzero(np.concatenate(([True], (bucket[start[1:]] != bucket[start[:-1]]) | (start[1:] // ROW != start[:-1] // ROW))))
        by_prefix = np.append(row, len(start)).astype(np.int32)
        by_cell = np.append(start, len(p))[by_prefix].astype(np.int32)
        lists = [(by_prefix, p[start].view(np.int64)), (by_prefix, size), (by_cell, s.view(np.int64)), (by_cell, n)]
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for cut, x in lists]
        out = pa.RecordBatch.from_arrays([pa.array(bucket[start[row]]), *lists], names=["bucket", "p", "k", "s", "n"])
        for at in range(0, len(row), 256):
            yield out.slice(at, 256)

    def count(batches):
        bits, seen, own, cells = np.frombuffer(table.value, dtype=np.uint8), {}, [], 0
        mask = np.uint64(len(bits) * 8 - 1)
        for batch in batches:
            for _, _, _, u, piece, _, _ in spoken(batch, seen):
                p = u
                for k in range(1, width):
                    p = join_hash(p[:-1], p[1:])
                if len(u) < width:
                    continue
                slot = p & mask
                is_hit = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & (piece[: len(p)] == piece[width - 1 :])
                goes_on = np.zeros(len(p), dtype=bool)
                goes_on[:-1] = is_hit[:-1] & is_hit[1:] & (piece[: len(p) - 1] == piece[width:])
                at, rest = np.flatnonzero(goes_on), np.flatnonzero(is_hit & ~goes_on)
                own.append(merged(np.concatenate((p[at], p[rest])), np.concatenate((p[at + 1], np.zeros(len(rest), np.uint64))), np.ones(len(at) + len(rest), np.int64)))
                cells += len(own[-1][0])
                if cells > held:
                    own = [merged(*(np.concatenate(x) for x in zip(*own, strict=True)))]
                    cells = len(own[0][0])
                    if cells > held // 2:
                        yield from rows(*own[0])
                        own, cells = [], 0
        if own:
            yield from rows(*merged(*(np.concatenate(x) for x in zip(*own, strict=True))))

    return docs.mapInArrow(lean(count), "bucket int, p array<long>, k array<int>, s array<long>, n array<long>")


def merge_stripes(parts: DataFrame, least: int) -> DataFrame:
    """p, total and best (of a segment) and its frequent cells: h of the longer phrase, s, n."""

    def finish(p, s, n):
        edge = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        longer = (s != 0) & (n >= least)
        cut = np.concatenate(([0], np.cumsum(longer)))[np.append(edge, len(p))].astype(np.int32)
        lists = [x[longer].view(np.int64) for x in (join_hash(p, s), s, n)]
        best = np.maximum.reduceat(np.where(longer, n, 0), edge)
        return pa.RecordBatch.from_arrays(
            [pa.array(p[edge].view(np.int64)), pa.array(np.add.reduceat(n, edge)), pa.array(best), *[pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in lists]],
            names=["p", "total", "best", "h", "s", "n"],
        )

    def merge(batches):
        own, cells, least_cells, now = [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for a, b in zip(edge, np.append(edge[1:], len(bucket)), strict=True):
                if now is not None and bucket[a] != now:
                    yield finish(*merged(*(np.concatenate(x) for x in zip(*own, strict=True))))
                    own, cells, least_cells = [], 0, 0
                now, part = bucket[a], batch.slice(a, b - a)
                p, k, s, n = (part.column(c).flatten().to_numpy() for c in ("p", "k", "s", "n"))
                own.append((np.repeat(p, k).view(np.uint64), s.view(np.uint64), n))
                cells += len(s)
                if cells > 2 * least_cells + (1 << 19):
                    own = [merged(*(np.concatenate(x) for x in zip(*own, strict=True)))]
                    cells = least_cells = len(own[0][0])
        if own:
            yield finish(*merged(*(np.concatenate(x) for x in zip(*own, strict=True))))

    parts = parts.repartition("bucket").sortWithinPartitions("bucket")
    return parts.mapInArrow(lean(merge), "p long, total long, best long, h array<long>, s array<long>, n array<long>")


def bit_table(hashes: DataFrame, bits: int) -> bytes:
    """One bit for each value modulo `bits`, set where a hash of `h` has it; built in blocks by tasks, never larger."""
    per = min(bits, 1 << 18)

    def build(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            block, slot = (batch.column(c).to_numpy() for c in ("block", "slot"))
            for b in np.unique(block).tolist():
                own = blocks.setdefault(b, np.zeros(per, dtype=np.uint8))
                own[slot[block == b] % per] = 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in blocks.values()], pa.binary())], names=["block", "part"]
        )

    slots = hashes.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("slot"))
    slots = slots.select((F.col("slot") / per).cast("long").alias("block"), "slot").repartition("block")
    table = bytearray(bits // 8)
    for r in slots.mapInArrow(lean(build), "block long, part binary").collect():
        table[r.block * per // 8 : (r.block + 1) * per // 8] = r.part
    return bytes(table)


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 * a / (left + right)) in decimals, which hold 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(7,0)"), wide(left) + wide(right))


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, covered: int = 80,
    bits: int = 1 << 27, share: int = 1024, held: int = 1_000_000, buckets: int | None = None,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best `top` phrases of each language.

    least: occurrences of a candidate; longest: its most words; covered: percent of its occurrences that a longer candidate with
    its words must have to displace it. bits, share, held: sizes of the bit table, of the list of hot prefixes, of a task's stripes.
    buckets: of prefixes, merged one at a time; 4,096, or eight for each shuffle partition if that is more.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    words = stash(vocabulary(docs, held // 4).where(F.col("word").isNull() | (F.col("f") >= least)), "phrases-words")
    n = words.where("word IS NULL").select("lang", F.col("f").alias("n"))
    buckets = buckets or max(4096, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = n.agg(F.sum("n")).first()[0] or 0
    none = F.array().cast("array<long>")
    phrases = words.where("word IS NOT NULL").select("lang", "h", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("lefts"), none.alias("rights"))
    found = []
    for level in range(2, longest + 1):
        hot = [r.h for r in phrases.where(F.col("f") * share >= whole).select("h").collect()]
        table = spark.sparkContext.broadcast(bit_table(phrases, bits))
        stripes = stash(merge_stripes(partial_stripes(docs, level, table, hot, buckets, held), least), f"phrases-stripes-{level}")
        table.destroy()
        longer = stripes.select("p", F.inline(F.arrays_zip("h", "s", "n")))
        whole_stripes = stripes.groupBy("p").agg(F.sum("total").alias("total"), F.max("best").alias("best"))
        before = longer.groupBy("s").agg(F.max("n").alias("best_before"))
        known = phrases.join(whole_stripes, F.col("h") == F.col("p"), "left").join(before, F.col("h") == F.col("s"), "left").drop("p", "s")
        if level > 2:
            best = F.greatest(F.coalesce("best", F.lit(0)), F.coalesce("best_before", F.lit(0))).cast("decimal(19,0)")
            found.append(known.where(best * 100 < F.col("f").cast("decimal(19,0)") * covered))
        first = known.select(F.col("h").alias("p"), "lang", F.col("phrase").alias("start"), F.concat("lefts", F.array("total")).alias("lefts"))
        rest = phrases.select(F.col("h").alias("s"), "last", F.concat(F.array("f"), "rights").alias("rights"))
        phrases = longer.join(first, "p").join(rest, "s")
        phrases = phrases.select("lang", "h", F.concat_ws(" ", "start", "last").alias("phrase"), "last", F.col("n").alias("f"), "lefts", "rights")
        phrases = stash(phrases, f"phrases-{level}")
    cols = ["lang", "phrase", "f", "lefts", "rights"]
    kept = reduce(DataFrame.unionByName, [x.select(cols) for x in [*found, phrases]])

    def cut(left: Column, k: Column) -> Column:
        right = F.get("rights", k)
        return F.struct(cut_score(F.col("f"), left, right).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    low = kept.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.transform("lefts", cut)).alias("low"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    out = low.select("lang", "phrase", "a", "low.l", "low.r", "low.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    for groups in (["lang", "salt"], ["lang"]):  # at most 64 * top rows of a language meet in one task
        out = out.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= top)
    return out.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM w, range(1, 5) AS sizes(m) WHERE len(w) >= m
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), parts AS MATERIALIZED (
  SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS tail
  FROM f, range(1, 4) AS ks(k) WHERE k < m
), cuts AS (
  SELECT p.lang, p.m, p.phrase, p.a, p.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * p.a) // (l.f + r.f))::BIGINT AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.head JOIN f r ON r.lang = p.lang AND r.phrase = p.tail
), low AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM low c WHERE NOT EXISTS (
    SELECT 1 FROM f d WHERE d.lang = c.lang AND d.m > c.m AND 100 * d.f >= 80 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
