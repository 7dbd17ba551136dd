"""Exact substring dedup by prefix-free parsing: bytes under a string of `width` bytes that starts twice or more go.

Rolling-hash triggers (on 8 bytes, so on content alone) cut every text into phrases; long phrases are cut again by a
second, denser trigger. Positions whose next trigger is the same one are a family: their suffixes, cut at `width`, are fixed
by the phrase before the trigger (dictionary) and what follows it (parse).

1. Parse. Each family sends a fingerprint of the parse suffix behind its trigger (K) and one of its whole context
   (L: phrase and look-ahead). A task sends one row for each K at most: repeats it sees by itself are settled there.
2. Order of parse suffixes. Rows meet by K. An L seen twice makes its family duplicate as a whole; a K seen once makes it
   unique as a whole. Only families with a shared K and an own L remain, the edges of repeated regions.
3. Order of dictionary suffixes. For these, the texts are read again and every suffix of the phrase, cut at `width`,
   is fingerprinted; a task sends each value once, and values seen twice mark their start.
4. Marked starts become removed bytes.

Order is by 64-bit fingerprint instead of by byte, which tells equal suffixes apart from others alike; a lexicographic
rank of all suffixes is not needed for that and would have to move them. What is moved is about one row for each phrase, and
for edges one for each byte.

Nulls: a null text is empty, as is one shorter than `width`: nothing goes. Copies of a text, in other rows or in the same task,
are occurrences elsewhere. Very long and periodic texts are handled whole. Repeated ids each get their row. An empty table
gives an empty result. Extra columns stay out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mix, prefix_hash, small_batches, span_hash, stash, text_chunks, with_spans

GRAM, SPARSE, DENSE, TAIL = 8, 48, 16, 50
HOT, MOST = 8, 400_000  # contexts of one K that a task sends; rows that a task holds before it packs them
FULL, TEST, OFFER = 0, 1, 2  # a family is duplicate; is to be tested; is duplicate and offers its suffixes
SINGLE, MANY, SETTLED = 0, 1, 2  # what a task knows of the row that it sends


def families(buf: np.ndarray, h: np.ndarray, lo: int, hi: int, width: int):
    """Families of the text buf[lo:hi]: first and last start, and trigger (-1 where there is none in reach)."""
    starts = np.arange(lo, hi - width + 1)
    reach = width - TAIL
    at = np.arange(lo, hi - GRAM + 1)
    v = mix(span_hash(h, at, at + GRAM), 6)
    far = np.int64(1 << 60)
    nearest = []
    for modulus, shift in ((SPARSE, 8), (DENSE, 20)):
        spots = at[(v >> np.uint64(shift)) % np.uint64(modulus) == 0]
        i = np.searchsorted(spots, starts)
        nearest.append(np.append(spots, far)[i])
    first, second = nearest
    anchor = np.where(first - starts < reach, first, np.where(second - starts < reach, second, -1))
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return starts[new], np.append(starts[new[1:] - 1], starts[-1]), anchor[new]


def _texts(rows):
    """(index, buffer, prefix hashes, start, end) of every text, chunk by chunk."""
    for first, part in text_chunks(rows):
        buf = np.frombuffer(b"".join(part), dtype=np.uint8)
        h = prefix_hash(buf)
        end = 0
        for i, t in enumerate(part):
            start, end = end, end + len(t)
            yield first + i, buf, h, start, end


def parse(docs: DataFrame, width: int, parts: int, buckets: int) -> DataFrame:
    """kind, task, doc, h, g, data: names of documents, and families that are duplicate (full) or to be tested (test)."""
    schema = "bucket int, kind string, task int, data binary"

    @lean
    def phrases(batches):
        task = TaskContext.get().partitionId()
        seen: dict[tuple[int, int], int] = {}
        names, cols, copies, held, sent = [], [], {}, 0, 0

        def rows():
            out = [(task, "map", task, np.array([(sent + i, *n) for i, n in enumerate(names)], dtype=np.int64).tobytes())]
            k, whole, doc, lo, hi, has = (np.concatenate(x) for x in zip(*cols)) if cols else [np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, int, int, int, bool)]
            spans = [np.stack([doc[~has], np.full((~has).sum(), TEST), lo[~has], hi[~has]], axis=1)]
            if copies:
                spans.append(np.array([(d, FULL, 0, n) for d, n in copies.items()], dtype=np.int64))
            k, whole, doc, lo, hi = (x[has] for x in (k, whole, doc, lo, hi))
            order = np.lexsort((whole, k))
            k, whole, doc, lo, hi = (x[order] for x in (k, whole, doc, lo, hi))
            if len(k):
                head_k = np.concatenate(([True], k[1:] != k[:-1]))
                head_l = head_k | np.concatenate(([True], whole[1:] != whole[:-1]))
                of_k, of_l = np.cumsum(head_k) - 1, np.cumsum(head_l) - 1
                # a family of a copied text is seen twice or more, too
                many = (np.bincount(of_l)[of_l] > 1) | np.isin(doc, list(copies))
                many = np.bincount(of_l, weights=many)[of_l] > 0
                hot = np.bincount(of_k, weights=head_l)[of_k] > HOT
                told = many | hot
                spans.append(np.stack([doc, np.where(many, FULL, TEST), lo, hi], axis=1)[told])
                spans.append(np.stack([doc, np.full(len(doc), OFFER), lo, hi], axis=1)[hot & many & head_l])
                state = np.where(hot, SETTLED, np.where(many, MANY, SINGLE))
                send = np.flatnonzero(np.where(hot, head_k, head_l))
                to = (k[send] % np.uint64(buckets)).astype(np.int64)
                by, to = send[np.argsort(to, kind="stable")], np.sort(to)
                record = np.zeros(len(by), dtype=ROW)
                record["k"] = (k[by] >> np.uint64(32)).astype(np.uint32)
                record["l"], record["doc"], record["lo"], record["state"] = whole[by], doc[by], lo[by], state[by]
                record["more"] = hi[by] - lo[by]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)]))
                out.extend((int(to[a]), "list", task, record[a:z].tobytes()) for a, z in zip(cuts[:-1], cuts[1:]))
            out.append((task, "span", task, np.concatenate(spans).astype(np.int64).tobytes()))
            kinds = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("task", pa.int32()), ("data", pa.binary())])
            for i in range(0, len(out), 512):
                part = pd.DataFrame(out[i : i + 512], columns=kinds.names)
                yield pa.RecordBatch.from_pandas(part, schema=kinds, preserve_index=False)

        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for i, buf, h, start, end in _texts(b.column(2).to_pylist()):
                if end - start < width:
                    continue
                if keys[i] in seen:
                    copies[seen[keys[i]]] = end - start - width
                    continue
                doc = seen[keys[i]] = sent + len(names)
                names.append(keys[i])
                lo, hi, anchor = families(buf, h, start, end, width)
                has = anchor >= 0
                at = np.maximum(anchor, 0)
                k = np.where(has, mix(span_hash(h, at, np.minimum(at + TAIL, len(buf))), 7), np.uint64(0))
                whole = span_hash(h, lo, hi + width) + (anchor - lo).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
                cols.append((k, mix(whole, 8), np.full(len(lo), doc), lo - start, hi - start, has))
                held += len(lo)
            if held > MOST:
                yield from rows()
                sent += len(names)
                names, cols, copies, held = [], [], {}, 0
        if names or copies:
            yield from rows()

    @lean
    def meet(batches):
        lists, tasks, buckets_of = [], [], []
        for b in batches:
            for bucket, kind, task, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                if kind == "map":
                    x = np.frombuffer(data, dtype=np.int64).reshape(-1, 3)
                    yield named(task, x)
                elif kind == "span":
                    yield from spread(np.full(len(data) // 32, task), np.frombuffer(data, dtype=np.int64).reshape(-1, 4))
                else:
                    lists.append(np.frombuffer(data, dtype=ROW))
                    tasks.append(np.full(len(lists[-1]), task))
                    buckets_of.append(np.full(len(lists[-1]), bucket))
        if not lists:
            return
        x, task = np.concatenate(lists), np.concatenate(tasks)
        k = (np.concatenate(buckets_of).astype(np.uint64) << np.uint64(32)) | x["k"].astype(np.uint64)
        order = np.lexsort((x["l"], k))
        x, task, k = x[order], task[order], k[order]
        head_k = np.concatenate(([True], k[1:] != k[:-1]))
        head_l = head_k | np.concatenate(([True], x["l"][1:] != x["l"][:-1]))
        of_k, of_l = np.cumsum(head_k) - 1, np.cumsum(head_l) - 1
        twice = (np.bincount(of_l)[of_l] > 1) | (x["state"] == MANY)
        twice = np.bincount(of_l, weights=twice)[of_l] > 0
        edge = (np.bincount(of_k, weights=head_l)[of_k] > 1) | (np.bincount(of_k, weights=(x["state"] == SETTLED))[of_k] > 0)
        single = x["state"] == SINGLE
        spans = np.stack([x["doc"].astype(np.int64), np.zeros(len(x), dtype=np.int64), x["lo"].astype(np.int64), x["lo"].astype(np.int64) + x["more"]], axis=1)
        for chosen, kind in ((single & twice, FULL), (single & ~twice & edge, TEST), (twice & edge & head_l, OFFER)):
            spans[:, 1] = kind
            yield from spread(task[chosen], spans[chosen].copy())

    packed = docs.select("h", "g", "text").mapInArrow(phrases, schema)
    return packed.repartition(parts, "bucket").mapInArrow(meet, "kind string, task int, doc int, h long, g int, data binary")


#: A family as it is sent: part of K (the bucket has more of it), L, document, first start, number of further starts, state.
ROW = np.dtype([("k", "<u4"), ("l", "<u8"), ("doc", "<u4"), ("lo", "<u4"), ("more", "<u2"), ("state", "u1")])
OUT = pa.schema([("kind", pa.string()), ("task", pa.int32()), ("doc", pa.int32()), ("h", pa.int64()), ("g", pa.int32()), ("data", pa.binary())])


def named(task: int, x: np.ndarray) -> pa.RecordBatch:
    n = len(x)
    return pa.RecordBatch.from_arrays(
        [pa.array(["map"] * n), pa.array([task] * n, pa.int32()), pa.array(x[:, 0].astype(np.int32)), pa.array(x[:, 1]), pa.array(x[:, 2].astype(np.int32)), pa.nulls(n, pa.binary())],
        schema=OUT,
    )


def spread(task: np.ndarray, spans: np.ndarray):
    """Spans (document, kind, first, last) as one row for each parsing task and purpose."""
    for kind, chosen in (("full", spans[:, 1] == FULL), ("test", spans[:, 1] != FULL)):
        t, s = task[chosen], spans[chosen]
        if not len(s):
            continue
        order = np.argsort(t, kind="stable")
        t, s = t[order], s[order]
        head = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        data = [x.astype("<i4").tobytes() for x in np.split(s, head[1:])]
        n = len(head)
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * n), pa.array(t[head].astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(data, pa.binary())],
            schema=OUT,
        )


def by_document(rows: DataFrame, parts: int) -> DataFrame:
    """task, doc, data (kind, first, last): the spans of a parsing task's documents meet, one row for each document."""

    @lean
    def gather(batches):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for task, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(task, []).append(np.frombuffer(data, dtype="<i4").reshape(-1, 4))
        for task, parts in held.items():
            s = np.concatenate(parts)
            s = s[np.argsort(s[:, 0], kind="stable")]
            head = np.flatnonzero(np.concatenate(([True], s[1:, 0] != s[:-1, 0])))
            ends = np.append(head[1:], len(s))
            for i in range(0, len(head), 2000):
                data = [s[a:z, 1:].tobytes() for a, z in zip(head[i : i + 2000], ends[i : i + 2000])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(data), pa.int32()), pa.array(s[head[i : i + 2000], 0]), pa.array(data, pa.binary())],
                    names=["task", "doc", "data"],
                )

    return rows.select("task", "data").repartition(parts, "task").mapInArrow(gather, "task int, doc int, data binary")


#: A tested suffix: its fingerprint, its document (task and number) and start; start -1 for one that is known to repeat.
SUFFIX = np.dtype([("v", "<u8"), ("task", "<i4"), ("doc", "<i4"), ("at", "<i4")])


def test_suffixes(texts: DataFrame, width: int, parts: int, buckets: int) -> DataFrame:
    """task, data (spans of duplicate starts) for texts with their spans to test (`tests`)."""

    @lean
    def suffixes(batches):
        kinds = pa.schema([("bucket", pa.int32()), ("told", pa.bool_()), ("data", pa.binary())])

        def rows(x):
            x = x[np.argsort(x["v"], kind="stable")]
            head = np.concatenate(([True], x["v"][1:] != x["v"][:-1]))
            of = np.cumsum(head) - 1
            # twice here, or offered: settled here, and one row tells the others
            settled = (np.bincount(of)[of] > 1) | (np.bincount(of, weights=x["at"] < 0)[of] > 0)
            mine = x[settled & (x["at"] >= 0)]
            out = [(int(mine["task"][0]), True, mine.tobytes())] if len(mine) else []
            x["at"][settled] = -1
            x = x[head]
            to = (x["v"] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[by])) + 1
            out.extend((int(to[p[0]]), False, x[p].tobytes()) for p in np.split(by, cuts) if len(p))
            for i in range(0, len(out), 512):
                part = pd.DataFrame(out[i : i + 512], columns=kinds.names)
                yield pa.RecordBatch.from_pandas(part, schema=kinds, preserve_index=False)

        held, size = [], 0
        for b in batches:
            tests = b.column(1).to_pylist()
            for i, _, h, start, _ in _texts(b.column(0).to_pylist()):
                for t in tests[i]:
                    s = np.frombuffer(t["data"], dtype="<i4").reshape(-1, 3).astype(np.int64)
                    n = s[:, 2] - s[:, 1] + 1
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s[:, 1], n)
                    r = np.zeros(len(at), dtype=SUFFIX)
                    r["v"] = mix(span_hash(h, start + at, start + at + width), 9)
                    r["task"], r["doc"] = t["task"], t["doc"]
                    r["at"] = np.where(np.repeat(s[:, 0], n) == OFFER, -1, at)
                    held.append(r)
                    size += len(r)
                if size > MOST:
                    whole, held, size = np.concatenate(held), [], 0
                    yield from rows(whole)
        if held:
            yield from rows(np.concatenate(held))

    @lean
    def meet(batches):
        told, lists = [], []
        for b in batches:
            for is_told, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                (told if is_told else lists).append(np.frombuffer(data, dtype=SUFFIX))
        found = told
        if lists:
            x = np.concatenate(lists)
            x = x[np.argsort(x["v"], kind="stable")]
            of = np.cumsum(np.concatenate(([True], x["v"][1:] != x["v"][:-1]))) - 1
            found = told + [x[(np.bincount(of)[of] > 1) & (x["at"] >= 0)]]
        if not found:
            return
        x = np.concatenate(found)
        x = x[np.lexsort((x["at"], x["doc"], x["task"]))]
        if not len(x):
            return
        run = (x["task"][1:] == x["task"][:-1]) & (x["doc"][1:] == x["doc"][:-1]) & (x["at"][1:] - x["at"][:-1] <= 1)
        head = np.flatnonzero(np.concatenate(([True], ~run)))
        last = np.append(head[1:], len(x)) - 1
        spans = np.stack([x["doc"][head], np.zeros(len(head)), x["at"][head], x["at"][last]], axis=1).astype(np.int64)
        for b in spread(x["task"][head], spans):
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(5)], names=["task", "data"])

    packed = texts.select("text", "tests").mapInArrow(suffixes, "bucket int, told boolean, data binary")
    return packed.repartition(parts, "bucket").mapInArrow(meet, "task int, data binary")


def dedup(
    docs: DataFrame, keep: list[str], text: str = "text", width: int = 200, few: int = 500_000, as_text: bool = False
) -> DataFrame:
    """`keep`, n_bytes, spans (removed [start, end) bytes), kept (the remaining bytes) of every row.

    as_text: kept is a string, without what is left of a character that a removed run cuts through.

    few: up to so many distinct texts with repeats, their keys (12 bytes each) are broadcast; beyond, joins shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = max(256, 4 * parts)
    clean = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*keep).alias("row")  # a column of their own, whatever they are called
    docs = docs.select(row, clean.alias("text"), F.xxhash64(clean).alias("h"), F.hash(clean).alias("g"))
    source = docs.select("h", "g", "text")
    parsed = stash(parse(source, width, parts, buckets), "suffix-parse")
    names = parsed.where("kind = 'map'").select("task", "doc", "h", "g")
    tests = by_document(parsed.where("kind = 'test'"), parts)
    tests = tests.join(names, ["task", "doc"]).groupBy("h", "g")
    tests = tests.agg(F.collect_list(F.struct("task", "doc", "data")).alias("tests"))
    tests = stash(tests, "suffix-tests")
    texts = with_spans(source, tests, "inner", few)
    more = stash(test_suffixes(texts, width, parts, buckets), "suffix-tested")
    full = by_document(parsed.where("kind = 'full'").select("task", "data").unionByName(more), parts)
    full = full.join(names, ["task", "doc"]).groupBy("h", "g").agg(F.collect_list("data").alias("data"))
    full = stash(full, "suffix-spans")
    joined = with_spans(docs, full, "left", few).select("row", "text", "data")

    @lean
    def cut(batches):
        for b in batches:
            sizes, removed, kept = [], [], []
            for t, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                runs = []
                if data:
                    s = np.concatenate([np.frombuffer(x, dtype="<i4").reshape(-1, 3) for x in data])
                    s = s[np.argsort(s[:, 1], kind="stable")]
                    end = np.maximum.accumulate(s[:, 2] + width)
                    head = np.flatnonzero(np.concatenate(([True], s[1:, 1] > end[:-1])))
                    runs = list(zip(s[head, 1].tolist(), end[np.append(head[1:], len(s)) - 1].tolist()))
                edges = [0, *(x for r in runs for x in r), len(raw)]
                sizes.append(len(raw))
                removed.append([{"start": a, "end": z} for a, z in runs])
                left = [raw[a:z] for a, z in zip(edges[::2], edges[1::2])]
                kept.append("".join(x.decode("utf-8", "ignore") for x in left) if as_text else b"".join(left))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            made = [pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["row", "n_bytes", "spans", "kept"])

    fields = joined.schema["row"].dataType.simpleString()
    kind = "string" if as_text else "binary"
    schema = f"row {fields}, n_bytes long, spans array<struct<start: long, end: long>>, kept {kind}"
    return joined.mapInArrow(cut, schema).select("row.*", "n_bytes", "spans", "kept")


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]))
