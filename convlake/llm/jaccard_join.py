"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), and its groups.

1. Every text becomes its set of distinct word shingles (64-bit). Equal sets form a class, whose smallest id stands for it.
2. Two sets of n and m shingles link only if they have o = ceil(4 (n + m) / 9) in common, so their first n - o + l and m - o + l
   shingles, in one order for all, have l in common, whatever l. Every set shows its n - T + `depth`(n) smallest hashes,
   T = ceil(0.8 n), and a class with fewer of them among those that others show than the least depth of any partner
   leaves: it cannot link. The bound is exact, for all sizes. Shared passages alone rarely reach it.
3. The sets of a size class are cut by hash into the same k parts, of 1.8 shingles on average. Linked sets of n and m shingles
   have at most d = (n + m) / 9 that are not common, so at least k - d of their parts are equal. A set marks its d + 1 best
   parts, in an order of parts that is one for all: fewer than k - d are left out of either set, so the best of the equal parts
   is marked in both. The order puts parts first that hold more shingles which a bounded sample of documents does not share, then
   goes by their number: it decides speed only. One shingle or two that long texts have in common by chance so tie nothing.
   Postings of marks are combined in each task before the shuffle: documents of a
   task with one mark and near sizes become a chain and send one interval, so a mark that a third of all
   documents has sends one row for each task. Shared marks tie documents to families (too large rather than too small).
4. The texts of families meet, some families to a block. In a block, DivideSkip parts the inverted lists of a query document:
   the short ones are merged by a heap that skips what cannot reach the overlap any more (counted at once where they
   hold more than `MERGED` entries), the long ones are probed by binary search for the candidates left; each is decided on exact counts. Documents of one known group are not compared again.
5. A family beyond `block` documents or `heavy` shingles is split into blocks, each with a few pivots of the whole family. Afterwards every
   document outside the family's largest group is a query against all blocks. So no group is one task's work, and no
   link between different groups is lost.

Nulls: a null or wordless text has an empty set, links with nothing and is its own component. Rows without id link nothing
and have a null component. Rows that repeat an id share its component. An empty table gives an empty result. Extra columns are
kept out. Whole texts count, however long.
"""

from __future__ import annotations

import functools
import heapq
import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, forget, key_slices, lean, mix, reads, release, shingle_sets, small_batches, stash, text_chunks
from .graph import connected_components, forest


def _sets(texts, size: int):
    """(index of the text, its sorted shingle array) for each text."""
    for first, part in text_chunks(texts):
        hashes, bounds = shingle_sets(part, size)
        for i in range(len(part)):
            yield first + i, hashes[bounds[i] : bounds[i + 1]]


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """id, n (set size), s1 and s2 (128-bit signature of the set)."""

    @lean
    def run(batches):
        for b in batches:
            n, s1, s2 = (np.zeros(b.num_rows, dtype=t) for t in (np.int64, np.uint64, np.uint64))
            for i, s in _sets(b.column(1).to_pylist(), size):
                n[i] = len(s)
                s1[i], s2[i] = mix(s, 3).sum(dtype=np.uint64), mix(s, 4).sum(dtype=np.uint64)
            made = [pa.array(x) for x in (n, s1.view(np.int64), s2.view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["id", "n", "s1", "s2"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, s1 long, s2 long")


def depth(n: int) -> int:
    """How many common shingles a set of n shows for."""
    return n // 8 + 1


def shown(s: np.ndarray) -> np.ndarray:
    """The smallest hashes of a sorted set that must hold depth(n) of those it shares with a linked set."""
    n = len(s)
    return s[: n - (4 * n + 4) // 5 + depth(n)]


def partner_depth(n: Column) -> Column:
    """The least depth of a set that one of n shingles can link to: that of ceil(0.8 n) shingles."""
    return F.floor(F.floor((4 * n + 4) / 5) / 8) + 1


def _packed(columns: list[str], rows: list[tuple]):
    for i in range(0, len(rows), 512):
        yield pd.DataFrame(rows[i : i + 512], columns=columns)


def _shuffle_size(spark: SparkSession) -> tuple[int, int]:
    """Partitions and, more of them, buckets of what tasks pack for each other."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return parts, max(1024, 8 * parts)


def shown_counts(docs: DataFrame, size: int) -> DataFrame:
    """s1, shared: how many of the hashes that a set shows are shown by other sets, too."""
    parts, buckets = _shuffle_size(docs.sparkSession)

    @lean
    def show(batches):
        seen, held = set(), []
        for b in batches:
            for _, s in _sets(b["text"], size):
                if len(s) and (name := int(mix(s, 3).sum(dtype=np.uint64))) not in seen:
                    seen.add(name)
                    held.append((shown(s), name))
        if not held:
            return
        hashes = np.concatenate([x for x, _ in held])
        node = np.repeat(np.array([x for _, x in held], dtype=np.uint64), [len(x) for x, _ in held])
        order = np.argsort(hashes, kind="stable")
        hashes, node = hashes[order], node[order]
        head = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        of = np.cumsum(head) - 1
        told = np.bincount(of)[of] > 1
        names, counts = np.unique(node[told], return_counts=True)
        out = [(int(names[0] % np.uint64(buckets)), True, names.tobytes() + counts.astype(np.int64).tobytes())] if len(names) else []
        # one row for each hash: its set awaits the answer, or (0) the task knows it already
        hashes, node = hashes[head], np.where(told, np.uint64(0), node)[head]
        to = (mix(hashes, 5) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[by])) + 1
        out.extend((int(to[p[0]]), False, hashes[p].tobytes() + node[p].tobytes()) for p in np.split(by, cuts))
        yield from _packed(["bucket", "told", "data"], out)

    @lean
    def meet(batches):
        told, lists = [], []
        for b in batches:
            for is_told, data in zip(b["told"], b["data"]):
                (told if is_told else lists).append(np.frombuffer(data, dtype=np.uint64).reshape(2, -1))
        node, count = (np.concatenate([x[i] for x in told]) if told else np.zeros(0, dtype=np.uint64) for i in (0, 1))
        if lists:
            h, n = (np.concatenate([x[i] for x in lists]) for i in (0, 1))
            order = np.lexsort((n, h))
            h, n = h[order], n[order]
            head = np.concatenate(([True], h[1:] != h[:-1]))
            of = np.cumsum(head) - 1
            other = np.bincount(of, weights=head | (np.concatenate(([True], n[1:] != n[:-1]))))[of] > 1
            got = n[((n[head] == 0)[of] | other) & (n != 0)]
            node, count = np.append(node, got), np.append(count, np.ones(len(got), dtype=np.uint64))
        if len(node):
            names, of = np.unique(node, return_inverse=True)
            count = np.bincount(of, weights=count).astype(np.uint64)
            to = (names % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[by])) + 1
            yield from _packed(["bucket", "data"], [(int(to[p[0]]), names[p].tobytes() + count[p].tobytes()) for p in np.split(by, cuts)])

    @lean
    def total(batches):
        got = [np.frombuffer(data, dtype=np.uint64).reshape(2, -1) for b in batches for data in b["data"]]
        if got:
            names, of = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
            yield pd.DataFrame({"s1": names.view(np.int64), "shared": np.bincount(of, weights=np.concatenate([x[1] for x in got])).astype(np.int64)})

    packed = docs.select("text").mapInPandas(show, "bucket int, told boolean, data binary")
    counts = packed.repartition(parts, "bucket").mapInPandas(meet, "bucket int, data binary")
    return counts.repartition(parts, "bucket").mapInPandas(total, "s1 long, shared long")


def shared_shingles(docs: DataFrame, size: int, rows: int, longest: int, most: int) -> np.ndarray:
    """Up to `most` shingles that two or more of about `rows` hash-picked documents have; used for an order only."""
    total = docs.count()
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    some = docs.where((place < rows / max(total, 1)) & (F.length("text") <= longest)).select("text")

    @lean
    def run(batches):
        got = [s for b in batches for _, s in _sets(b["text"], size)]
        if got:
            h, c = np.unique(np.concatenate(got), return_counts=True)
            yield pd.DataFrame({"h": h.view(np.int64), "c": c.astype(np.int64)})

    counts = some.mapInPandas(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    found = counts.orderBy(F.desc("c"), "h").limit(most).select("h").toPandas()["h"]
    return np.sort(found.to_numpy(dtype=np.int64).view(np.uint64))


def _chain(shingle, node, low, high):
    """Links along each shingle's intervals of near sizes, and the merged intervals (shingle, node, low, high)."""
    order = np.lexsort((node, low, shingle))
    shingle, node, low, high = shingle[order], node[order], low[order], high[order]
    same = shingle[1:] == shingle[:-1]
    group = np.concatenate(([0], np.cumsum(~same)))
    reach = np.maximum.accumulate((group << 32) + high) - (group << 32)
    tie = same & (4 * low[1:] <= 5 * reach[:-1])
    first = np.concatenate(([True], ~tie))
    at = np.flatnonzero(first)
    last = np.concatenate((at[1:], [len(first)])) - 1
    return node[:-1][tie], node[1:][tie], (shingle[first], node[first], low[first], reach[last])


def classes_of(n: int) -> tuple[int, int]:
    """The size classes of a set of n shingles: each holds the sets of two steps of 1.25; linked sets have a step's class in common."""
    step = int(math.log(n) / math.log(1.25) + 1e-9)
    return step, step + 1


def marks(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """What two linked sets have one of in common at least: 64-bit marks of equal parts of theirs. See 3. above; late: shingles that tell little."""
    n, own, out = len(s), mix(s, 7), []
    rare = np.ones(n, dtype=np.int64)
    if len(late):
        rare[late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s] = 0
    for t in classes_of(n):
        parts = int(1.25**t / 1.8) + 1
        # of two linked sets of n and m shingles at most (n + m) / 9 are not common, and m <= 1.25 n
        need = min((n + 5 * n // 4) // 9 + 1, parts)
        of = (mix(s, 8 + t) % np.uint64(parts)).astype(np.int64)
        size, value = np.bincount(of, minlength=parts), np.bincount(of, weights=rare, minlength=parts).astype(np.int64)
        total = np.zeros(parts, dtype=np.uint64)
        np.add.at(total, of, own)
        mark = mix(total + mix(np.array([t], dtype=np.uint64), 9))
        # one order for all sets, by what a part holds: rare shingles first, then shingles, then the mark
        out.append(mark[np.lexsort((mark, -size, -value))[:need]])
    return np.concatenate(out)


def family_links(docs: DataFrame, size: int, shared: np.ndarray, most: int = 1 << 20) -> DataFrame:
    """Links (a, b) between s1 of sets that share a mark and have near sizes, as forests. most: marks that a task holds, about."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(shared)
    parts, buckets = _shuffle_size(spark)
    schema = "bucket int, links boolean, data binary"

    def pack(bucket, links, *arrays):
        return bucket, links, np.concatenate([np.asarray(x).astype(np.int64, copy=False) if x.dtype != np.uint64 else x.view(np.int64) for x in arrays]).tobytes()

    def packed(held):
        sizes = [len(x) for x, _, _ in held]
        shingle = np.concatenate([x for x, _, _ in held])
        node = np.repeat(np.array([x for _, x, _ in held], dtype=np.uint64), sizes)
        n = np.repeat(np.array([x for _, _, x in held], dtype=np.int64), sizes)
        a, b, (shingle, node, low, high) = _chain(shingle, node, n, n)
        out = []
        if len(a):
            nodes, roots = forest(a, b)
            out.append(pack(int(nodes[0] % np.uint64(buckets)), True, nodes, roots))
        to = (mix(shingle, 5) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[by])) + 1
        for part in np.split(by, cuts):
            if len(part):
                out.append(pack(int(to[part[0]]), False, shingle[part], node[part], low[part], high[part]))
        yield from _packed(["bucket", "links", "data"], out)

    @lean
    def postings(batches):
        seen, held, n_held = set(), [], 0
        for b in batches:
            for _, s in _sets(b["text"], size):
                if not len(s) or (name := int(mix(s, 3).sum(dtype=np.uint64))) in seen:
                    continue
                seen.add(name)
                held.append((marks(s, order.value), name, len(s)))
                n_held += len(held[-1][0])
                if n_held >= most:
                    yield from packed(held)
                    held, n_held = [], 0
        if held:
            yield from packed(held)

    @lean
    def meet(batches):
        links, lists = [], []
        for b in batches:
            for is_link, data in zip(b["links"], b["data"]):
                x = np.frombuffer(data, dtype=np.int64)
                (links if is_link else lists).append(x.reshape(2 if is_link else 4, -1))
        a, b = (np.concatenate([x[i] for x in links]) if links else np.zeros(0, dtype=np.int64) for i in (0, 1))
        if lists:
            s, node, low, high = (np.concatenate([x[i] for x in lists]) for i in range(4))
            more_a, more_b, _ = _chain(s, node, low, high)
            a, b = np.concatenate((a, more_a)), np.concatenate((b, more_b))
        if len(a):
            nodes, roots = forest(a, b)
            keep = nodes != roots
            yield pd.DataFrame({"a": nodes[keep], "b": roots[keep]})

    dealt = docs.select("text").mapInPandas(postings, schema)
    return dealt.repartition(parts, "bucket").mapInPandas(meet, "a long, b long")


def merge_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Numbers that occur in `least` or more of the sorted lists, with their counts, by a heap over the lists' heads.

    A number that occurs too rarely is passed over together with all below the head that `least` lists must reach.
    """
    at = [0] * len(lists)
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    found: dict[int, int] = {}
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            found[top] = len(popped)
            to = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            to = heap[0][0]
        for i in popped:
            x = lists[i]
            at[i] = bisect_left(x, to, at[i])
            if at[i] < len(x):
                heapq.heappush(heap, (x[at[i]], i))
    return found


MERGED = 2000  # so many entries of short lists are merged by a heap; more are counted in one go, with the same result


class Lists:
    """Inverted lists of the sets of one block, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        values, names = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.lexsort((owner, names))
        self.owner = owner[order]
        self.keys = names[order] * len(sets) + self.owner  # sorted: (shingle, document)
        self.start = np.searchsorted(names[order], np.arange(len(values) + 1))
        self.names = np.split(names, np.cumsum(self.sizes)[:-1])

    def links(self, x: int, group: np.ndarray) -> np.ndarray:
        """Documents of other groups than x's whose overlap with x reaches the threshold."""
        n, names = len(self.sets[x]), self.names[x]
        need = (4 * n + 4) // 5
        length = self.start[names + 1] - self.start[names]
        order = np.argsort(length, kind="stable")
        # the longest lists are probed, not merged; a quarter of the needed occurrences must still come from short ones
        long = min(need - 1, 3 * need // 4)
        short, rest = names[order[: n - long]], names[order[n - long :]]
        runs = self.start[short + 1] - self.start[short]
        last = np.cumsum(runs)
        at = np.arange(last[-1]) - np.repeat(last - runs, runs) + np.repeat(self.start[short], runs)
        able = (group != group[x]) & (5 * self.sizes >= 4 * n) & (4 * self.sizes <= 5 * n)
        owner = self.owner[at]
        keep = able[owner]
        owner, least = owner[keep], need - long
        if len(owner) <= MERGED:
            ends = np.cumsum(np.concatenate(([0], keep)))[last].tolist()
            owner = owner.tolist()
            merged = merge_skip([owner[i:j] for i, j in zip([0, *ends[:-1]], ends) if i < j], least)
            found, overlap = (np.array(list(v), dtype=np.int64) for v in (merged.keys(), merged.values()))
        else:
            count = np.bincount(owner, minlength=len(self.sets))
            found = np.flatnonzero(count >= least)
            overlap = count[found]
        if len(found) and len(rest):
            want = rest[:, None] * len(self.sets) + found[None, :]
            place = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            overlap = overlap + (self.keys[place] == want).sum(axis=0)
        return found[9 * overlap >= 4 * (n + self.sizes[found])]


def local_groups(sets: list[np.ndarray], queries: np.ndarray | None = None, pivots: int = 8) -> np.ndarray:
    """The group number of every set: linked sets have one. With `queries`, only pairs with a query are looked for."""
    m = len(sets)
    group = np.arange(m)
    lists = Lists(sets)

    def ask(x: int) -> None:
        found = lists.links(x, group)
        if len(found):
            old = np.unique(group[np.append(found, x)])
            group[np.isin(group, old)] = old[0]

    todo = np.arange(m) if queries is None else np.flatnonzero(queries)
    if queries is None:
        for _ in range(min(pivots, m)):
            # a pivot from the largest group so far; its own group is not compared again
            big = np.bincount(group).argmax()
            inside = np.flatnonzero(group == big)
            if len(inside) == m:
                break
            ask(int(inside[(_ * 7919) % len(inside)]))
        big = np.bincount(group).argmax()
        todo = np.flatnonzero(group != big)
    for x in todo:
        ask(int(x))
    return group


def _block_links(size: int):
    """Links (a, b) of the documents of one block: `family`, `id`, `text`, `ask` (whether a pair needs this row's partner)."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["family", "id"], kind="stable").drop_duplicates(["family", "id", "ask"])
        all_sets = [s for _, s in _sets(pdf["text"], size)]
        ids, fam, asks = pdf["id"].to_numpy(), pdf["family"].to_numpy(), pdf["ask"].to_numpy()
        out_a, out_b = [], []
        edges = np.concatenate(([0], np.flatnonzero(np.diff(fam)) + 1, [len(fam)]))
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo < 2:
                continue
            group = local_groups(all_sets[lo:hi], asks[lo:hi] if asks[lo:hi].any() else None)
            part = ids[lo:hi]
            order = np.lexsort((part, group))
            g, p = group[order], part[order]
            head = np.concatenate(([True], g[1:] != g[:-1]))
            root = p[head][np.cumsum(head) - 1]
            out_a.append(p[~head])
            out_b.append(root[~head])
        none = np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"a": np.concatenate(out_a or [none]), "b": np.concatenate(out_b or [none])})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        forget(None)
        found = links(pdf)
        release()
        return found

    return run


def group_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    size: int = 5,
    block: int = 3000,
    pivots: int = 24,
    sample_rows: int = 8000,
    sample_longest: int = 50_000,
    sample_shingles: int = 100_000,
    few: int = 500_000,
    heavy: int = 2_000_000,
) -> DataFrame:
    """id, n (shingles), component (smallest id reachable over links of Jaccard similarity 0.8 or more).

    block, heavy: documents and shingles of a block, on average. few: so many ids of classes that may link are broadcast at a time to fetch the
    texts, in up to 16 passes over the documents; beyond, the join shuffles. `discard` of the result deletes the tables that it reads.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    named = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    signed = stash(signatures(docs, size), "jaccard-signatures")
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    near = classes.join(shown_counts(named, size), "s1").where(F.col("shared") >= partner_depth(F.col("n")))
    near = stash(near.select(F.col("rep").alias("id"), "s1", "n"), "jaccard-near")
    # texts that may link, one of each class
    slices = key_slices(near.select("id", "s1"), "id", few)
    parts = [named.join(near.select("id", "s1"), "id")] if slices is None else [named.join(F.broadcast(x), "id") for x in slices]
    fetched = [stash(x.select("id", "s1", "text"), "jaccard-texts") for x in parts]
    texts = functools.reduce(DataFrame.unionByName, fetched)
    shared = shared_shingles(texts, size, sample_rows, sample_longest, sample_shingles)
    families = connected_components(family_links(texts, size, shared), "jaccard-families")
    member = stash(near.join(families, F.col("s1") == F.col("node")).select("id", "n", F.col("root").alias("family")), "jaccard-members")
    discard(families, near)
    sizes = member.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight"))
    # blocks that a family is cut into
    sizes = sizes.withColumn("cuts", F.ceil(F.greatest(F.col("m") / block, F.col("weight") / heavy)).cast("int"))
    whole = member.agg(F.count(F.lit(1)), F.sum("n")).first()
    groups = max(1, -(-whole[0] // 1000), -(-3 * (whole[1] or 0) // heavy))
    # block: several small families, or a part of a large one
    own = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("family"), F.lit(groups))).otherwise(
        F.xxhash64("family", F.pmod(F.xxhash64("id"), F.col("cuts")))
    )
    placed = stash(member.join(sizes.drop("weight"), "family").where("m > 1").withColumn("block", own), "jaccard-blocks")
    discard(member)

    def links_of(rows: DataFrame) -> DataFrame:
        whole = rows.select("block", "family", "id", "ask").join(texts.select("id", "text"), "id")
        return stash(whole.groupBy("block").applyInPandas(_block_links(size), "a long, b long"), "jaccard-links")

    rows = placed.withColumn("ask", F.lit(False))
    large = placed.where("cuts > 1")
    has_large = large.limit(1).count() > 0
    if has_large:
        parts = stash(large.select("family", "block").distinct(), "jaccard-parts")
        some = rows.where((F.col("cuts") > 1) & (F.pmod(F.xxhash64("id", F.lit(1)), F.col("m")) < pivots))
        rows = rows.unionByName(some.drop("block").join(parts, "family").select(*rows.columns))
    found = links_of(rows)
    if has_large:
        tied = connected_components(found, "jaccard-tied")
        big = large.join(tied, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
        big = stash(big.drop("node"), "jaccard-large")
        discard(tied)
        top = big.groupBy("family", "root").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("weight")).groupBy("family")
        left_over = lambda c: F.sum(c) - F.max_by(c, F.struct("count", "root"))
        top = top.agg(F.max_by("root", F.struct("count", "root")).alias("top"), left_over("count").alias("out"), left_over("weight").alias("out_n"))
        asking = big.join(top, "family").where("out > 0")
        asking = asking.withColumn("chunks", F.ceil(F.greatest(F.col("out") / block, F.col("out_n") / heavy)).cast("int"))
        asks = asking.where("root <> top").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(2)), F.col("chunks")).cast("int"))
        asks = asks.drop("block").join(parts, "family").withColumn("ask", F.lit(True))
        rest = asking.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("ask", F.lit(False))
        pick = [F.xxhash64("block", "chunk").alias("block"), "family", "id", "ask"]
        more = links_of(asks.select(*pick).unionByName(rest.select(*pick)))
        discard(big, parts)
        both = connected_components(found.unionByName(more), "jaccard-groups")
        discard(found, more)
        links = both.select(F.col("node").alias("rep"), F.col("root").alias("component"))
    else:
        both = found
        links = found.select(F.col("a").alias("rep"), F.col("b").alias("component"))
    discard(placed, *fetched)
    # each class takes its group, each document its class
    groups = classes.join(links, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    groups = stash(groups, "jaccard-classes")  # read anew, so that a class with very many copies is a side that can be split
    discard(both)
    out = signed.join(groups, ["s1", "s2"], "left")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return reads(out.select(F.col("id").alias(id_col), "n", own.alias("component")), signed, groups)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return group_documents(docs).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w
), c AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY 2
), p AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM c),
pairs AS (
  SELECT x.rep AS a, y.rep AS b FROM p x JOIN p y ON x.g = y.g AND x.rep <> y.rep
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT rep AS a, rep AS b FROM c
  UNION
  SELECT r.a, q.b FROM reach r JOIN pairs q ON q.a = r.b
), least AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN least l ON l.rep = c.rep
"""
