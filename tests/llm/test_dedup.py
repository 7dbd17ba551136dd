"""Line, substring and near-duplicate operators against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest

from convlake.llm import graph, jaccard_join, line_dedup, suffix_dedup
from convlake.llm.common import shingle_sets

from .helpers import corpus, documents, prose


def brute_substrings(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append((sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_suffix_dedup(spark):
    rows = corpus()
    want = collections.Counter((r[0], *w) for r, w in zip(rows, brute_substrings([r[1] for r in rows], 200)))
    found = suffix_dedup.dedup(documents(spark), ["doc_id"]).collect()
    got = collections.Counter((r.doc_id, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in found)
    assert got == want


def test_suffix_dedup_many_contexts(spark):
    """A passage in more contexts than a task sends, edits at random places, and plain joins instead of broadcasts."""
    rng = np.random.default_rng(0)
    passage = prose(9, 120)
    texts = []
    for k in range(60):
        t = list(prose(100 + k, 20) + " " + passage + " " + prose(200 + k, 20))
        for i in rng.integers(0, len(t), 2):
            t[i] = "#"
        texts.append("".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix_dedup.dedup(df, ["doc_id"], few=0).collect()}
    assert got == dict(enumerate(brute_substrings(texts, 200)))


def test_suffix_dedup_as_text_and_empty(spark):
    out = suffix_dedup.dedup(documents(spark), ["doc_id", "h", "g"], as_text=True)
    assert out.schema["kept"].dataType.simpleString() == "string" and out.count() == len(corpus())
    assert suffix_dedup.dedup(documents(spark, []), ["doc_id"]).count() == 0


def brute_units(text, unit):
    """Units by words: (start, end, normal form, words)."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", text)]
    heads, norm = [], []
    for k, (a, z) in enumerate(words):
        gap = text[words[k - 1][1] : a] if k else ""
        ends = gap.count("\n") >= (2 if unit == "paragraph" else 1) or unit == "sentence" and text[words[k - 1][1] - 1] in ".!?"
        if k == 0 or ends:
            heads.append(a if k else 0)
            norm.append([])
        norm[-1].append(text[a:z].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return [(a, z, tuple(n)) for a, z, n in zip(heads, [*heads[1:], len(text)], norm)]


def brute_lines(rows, unit="sentence", least=30):
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for k, t in docs:
        parts = brute_units(t, unit)
        spare = []
        for _, _, n in parts:
            spare.append(n in seen)
            seen.add(n)
        kept, i = "", 0
        while i < len(parts):
            j = i
            while j < len(parts) and spare[j]:
                j += 1
            run = parts[i : j or None] if j > i else []
            if run and sum(len(n) for _, _, n in run) >= least:
                i = j
                continue
            for a, z, _ in run or parts[i : i + 1]:
                kept += t[a:z]
            i = max(j, i + 1)
        out[k, t] = kept if parts else t
    return out


SENTENCES = [prose(700 + k, 4 + k % 9).capitalize() + (". " if k % 5 else ".\n" if k % 3 else "!\n \n") for k in range(60)]


def sentence_rows():
    """Documents of shared sentences, so that runs of all lengths repeat; upper case, odd spaces and accents among them."""
    rng = np.random.default_rng(5)
    rows = corpus()
    for k in range(40):
        parts = [prose(5000 + 10 * k + i, 9) + ". " for i in range(4)]
        at = int(rng.integers(0, 50))
        parts[2:2] = SENTENCES[at : at + int(rng.integers(1, 9))]
        text = ("  \u00e9 " if k % 4 == 0 else "") + "".join(parts)
        rows.append((1000 + k, text.upper() if k % 7 == 0 else text.replace(". ", ".\t \x0b"), "en", "s", 1, "", "", ""))
    return rows


@pytest.mark.parametrize("unit, least, few", [("sentence", 30, 500_000), ("sentence", 1, 0), ("line", 12, 500_000), ("paragraph", 1, 0)])
def test_line_dedup(spark, unit, least, few):
    rows = sentence_rows()
    want = brute_lines(rows, unit, least)
    found = line_dedup.dedup(documents(spark, rows), unit=unit, min_words=least, few=few).collect()
    assert collections.Counter((r.doc_id, r.text) for r in found) == collections.Counter((r[0], want.get((r[0], r[1]))) for r in rows)
    by_id = {r[0]: r[1] for r in rows}
    cut = 0
    for r in found:
        if r.doc_id is None:
            continue
        left, at = "", 0
        for s in r.removed:  # offsets are of the original
            assert (s.start, s.end) == brute_units(by_id[r.doc_id], unit)[s.unit][:2]
            left, at = left + by_id[r.doc_id][at : s.start], s.end
        assert not r.removed or left + by_id[r.doc_id][at:] == r.text
        cut += bool(r.removed)
    assert cut > 3
    assert line_dedup.dedup(documents(spark, []), unit=unit).count() == 0


def test_line_dedup_short_lines(spark):
    """With min_words=1 every unit is judged, the space after it goes with it."""
    rows = [(1, "Menu\n\nfirst text\nMENU "), (2, "menu\n \n\nsecond\nfirst  text"), (3, "\nthird\nMenu"), (4, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs, unit="line", min_words=1).collect()}
    assert got == {1: "Menu\n\nfirst text\n", 2: "second\n", 3: "\nthird\n", 4: " \n "}


def brute_groups(rows, least=0.8):
    def shingles(t):
        w = [x for x in re.split(r"[ \t-\r]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    docs = [(r[0], shingles(r[1])) for r in rows]
    root = {k: k for k, _ in docs if k is not None}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(docs):
        for b, y in docs[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 100 * least * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(x), find(k) if k is not None else None) for k, x in docs}


def groups(df, **options):
    return {r.doc_id: (r.n, r.component) for r in jaccard_join.group_documents(df, **options).collect()}


def test_jaccard_groups(spark):
    assert groups(documents(spark)) == brute_groups(corpus())
    assert groups(documents(spark, [])) == {}


@pytest.mark.parametrize("block", [3000, 7])
def test_jaccard_near_copies(spark, block):
    """Chains of edits, short documents, and families over several blocks."""
    rng = np.random.default_rng(3)
    rows = []
    for family in range(6):
        words = prose(50 + family, int(rng.integers(6, 160))).split()
        for k in range(20):
            w = list(words)
            for i in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 20 + 1))):
                w[i] = f"x{rng.integers(0, 5)}"
            rows.append((len(rows), " ".join(w), "en", "s", 1, "", "", ""))
            if k % 6 == 0:
                words = w
    few = {"block": block, "pivots": 3}
    assert groups(documents(spark, rows, 5), **few) == brute_groups(rows)
    assert groups(documents(spark, rows, 2), few=0, **few) == brute_groups(rows)


def test_jaccard_small_set_in_a_larger_one(spark):
    """A set of at most 64 shingles whose partner has more than its sketch shows."""
    rows = []
    for seed in range(60):
        n, more = [(68, 16), (68, 15), (67, 15), (66, 15)][seed % 4]
        long = prose(3000 + seed, n + more)
        rows += [(len(rows) + i, t, "en", "s", 1, "", "", "") for i, t in enumerate((" ".join(long.split()[:n]), long))]
    want = brute_groups(rows)
    assert len({c for _, c in want.values()}) == 60
    assert groups(documents(spark, rows)) == want


def test_shingles_and_components(spark):
    h, b = shingle_sets([b"", b"a b", b"A  B", b"a b c d e f", b"a b c d e a b c d e"])
    sizes = np.diff(b).tolist()
    assert sizes == [0, 1, 1, 2, 5] and h[b[1]] == h[b[2]]
    edges = [(1, 2), (2, 3), (7, 8), (9, 9), (3, 10), (10, 4)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 1, 7: 7, 8: 7}
    nodes, roots = graph.forest(np.array([5, 6, 1]), np.array([6, 9, 2]))
    assert dict(zip(nodes.tolist(), roots.tolist())) == {1: 1, 2: 1, 5: 5, 6: 5, 9: 5}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_jaccard_at_the_threshold(spark):
    """Pairs of all sizes at, or one shingle under, a similarity of 0.8; the smaller one inside the larger or both with words of their own."""
    rows = []
    for seed, n in enumerate([1, 2, 4, 5, 6, 8, 9, 12, 20, 31, 36, 40, 64, 72, 99, 100, 128, 180, 320, 400] * 3):
        words = prose(9000 + seed, 2 * n + 60).split()
        base = words[: n + 4]
        if seed % 3 == 0:  # inside: n of n / 0.8 shingles
            other = words[: n + 4 + n // 4 + (seed // 3) % 2]
        else:  # the last k words differ: n - k of n + k shingles in common
            k = n // 9 + (seed // 3) % 2
            other = base[: len(base) - k] + [f"z{seed}x{i}" for i in range(k)]
        rows += [(len(rows) + i, " ".join(t), "en", "s", 1, "", "", "") for i, t in enumerate((base, other))]
    want = brute_groups(rows)
    assert 20 < len(rows) - len({c for _, c in want.values()}) < 60
    assert groups(documents(spark, rows)) == want
    assert groups(documents(spark, rows, 7), few=0) == want


def test_merge_skip():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lists = [sorted(set(rng.integers(0, 30, rng.integers(0, 20)).tolist())) for _ in range(rng.integers(1, 12))]
        least = int(rng.integers(1, 7))
        counts = collections.Counter(x for v in lists for x in v)
        assert jaccard_join.merge_skip(lists, least) == {k: n for k, n in counts.items() if n >= least}


@pytest.mark.parametrize("most", [0, 10**9])
def test_block_groups_by_heap_and_by_count(monkeypatch, most):
    """Both ways to merge the short lists give the groups of all pairs."""
    monkeypatch.setattr(jaccard_join, "MERGED", most)
    rng = np.random.default_rng(8)
    sets = []
    for family in range(4):
        base = rng.choice(10_000, 60, replace=False) + 10_000 * (family // 2)
        for _ in range(25):
            s = base.copy()
            k = int(rng.integers(0, 16))
            s[rng.choice(60, k, replace=False)] = rng.integers(50_000, 90_000, k)
            sets.append(np.unique(s[: int(rng.integers(48, 61))]).astype(np.uint64))
    got = jaccard_join.local_groups(sets)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    assert len(set(root)) > 4 and len({(a, b) for a, b in zip(root, got.tolist())}) == len(set(root)) == len(set(got.tolist()))
