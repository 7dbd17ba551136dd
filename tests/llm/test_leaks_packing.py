"""Decontamination and packing against brute force; the pipeline."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from convlake.llm import decontaminate, packing

from ..conftest import SF
from .helpers import corpus, documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_leaks(text, items):
    w, hit, found = words(text), set(), set()
    for key, t in items:
        b = words(t)
        n = min(10, len(b))
        for j in range(len(b) - n + 1) if b else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[j : j + n]:
                    hit.update(range(i, i + n))
                    found.add("" if key is None else str(key))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


ITEMS = [
    (1, prose(3, 60)), (2, prose(1, 30)), (3, "one two"), (4, None), (5, ""), (6, "é é é"), (7, prose(77, 40)), (10, "ONE two THREE four"),
    (11, "w w w w w w w w w w w w"), (12, prose(1, 14)), (None, "kappa kappa kappa"), (13, prose(3, 60)),
]


def test_leaks(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = corpus()
    found = decontaminate.digest(decontaminate.decontaminate(documents(spark), bench)).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found)
    assert got == collections.Counter((r[0], *brute_leaks(r[1], ITEMS)) for r in rows)
    assert sum(r.contaminated for r in found) > 5
    clean = decontaminate.drop_contaminated(documents(spark), bench)
    assert clean.columns == documents(spark).columns and clean.count() == sum(not r.contaminated for r in found)


def test_leaks_proximity(spark):
    """Items with edits in every window are near without a hit; the share is that of words within two places."""
    item = prose(501, 40).split()
    edited = [f"q{i}" if i % 8 == 3 else w for i, w in enumerate(item)]
    moved = edited[:20] + ["inserted"] + edited[20:]
    far = [w if i % 2 else f"q{i}" for i, w in enumerate(item)][:24]
    pad = prose(502, 30)
    rows = [(1, " ".join([pad, *edited, pad])), (2, " ".join([pad, *moved])), (3, " ".join(far)), (4, " ".join(item)), (5, pad)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _h string, _found_h string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}

    def share(text):
        w = text.split()
        return max(sum(item[p] in w[max(0, d + p - 2) : max(0, d + p + 3)] for p in range(len(item))) for d in range(-len(item), len(w))) / len(item)

    for k in (1, 2):
        assert got[k].hits is None and got[k].items is None and got[k].near_items == ["7"]
        assert abs(got[k].near - share(dict(rows)[k])) < 1e-9 or 0.5 <= got[k].near <= share(dict(rows)[k])
    assert got[1].near >= 35 / 40 and got[4].near == 1.0 and got[4].items == ["7"]
    assert got[3].near is None and got[5].near is None
    kept = decontaminate.drop_contaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5] and kept.columns == docs.columns


def test_leaks_in_a_long_text(spark, monkeypatch):
    """Windows around the ends of stretches, in a text of many of them."""
    monkeypatch.setattr(decontaminate, "STRETCH", 16)
    items = [(1, prose(3, 25)), (2, prose(1, 30)), (3, "one two"), (11, "w w w w w w w w w w w w")]
    text = " ".join([prose(1, 30), prose(600, 9), "w " * 45, prose(3, 25), prose(601, 13), prose(1, 12), "one two", prose(3, 25)])
    docs = [(1, text), (2, prose(1, 30)), (3, "x " + text), (4, "one two three"), (5, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.digest(decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench)).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found} == {(k, *brute_leaks(t, items)) for k, t in docs}


def test_leaks_empty(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.decontaminate(documents(spark, []), bench).count() == 0
    none = decontaminate.decontaminate(documents(spark), bench.limit(0))
    assert none.count() == len(corpus()) and none.where("hits IS NOT NULL").count() == 0


def check_packing(rows, pieces, window=2048):
    tokenizer = Tokenizer.from_file(PATH)
    ids = collections.Counter()
    for r in rows:
        ids[r[0], np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()] += 1
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length
    want = collections.defaultdict(list)
    for (k, b), n in ids.items():
        want[k] += [b] * n
    for k, parts in docs.items():
        copies = len(want[k])
        by_start = collections.defaultdict(list)
        for p in parts:
            by_start[p.start].append(p)
        if copies == 1:
            parts.sort(key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in parts) == want[k][0] and all(4 * p.doc_tokens == len(want[k][0]) for p in parts)
        else:
            assert sum(p.length for p in parts) == sum(len(b) // 4 for b in want[k])
    assert set(docs) == set(want)
    short = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)
        short += at < window
    assert short <= 11


def test_packing(spark):
    check_packing(corpus(), packing.pack(documents(spark), PATH).collect())
    check_packing(corpus(), packing.pack(documents(spark), PATH, grain=32, window=256, weights={"src1": 3.0, "src2": 1.0}).collect(), 256)
    assert packing.pack(documents(spark, []), PATH).count() == 0


def test_packing_mixture(spark):
    """Every full window holds the sources' shares to within two grains."""
    rows = [(k, prose(k, 200), "en", "ab"[k % 4 == 0], 1, "", "", "") for k in range(200)]
    pieces = packing.pack(documents(spark, rows), PATH, grain=128).collect()
    total = collections.Counter()
    windows = collections.defaultdict(collections.Counter)
    for p in pieces:
        total[p.queue] += p.length
        windows[p.sequence_id][p.queue] += p.length
    share = total["b"] / sum(total.values())
    full = [w for w in windows.values() if sum(w.values()) == 2048]
    assert len(full) > 10 and all(abs(w["b"] - 2048 * share) <= 2 * 128 for w in full)


def test_packing_weights_beyond_the_queues(spark):
    """A small source with a weight keeps its queue and share, and one named like a shared queue its own rows."""
    names = [*["big"] * 40, *["~5"] * 3, *["small"] * 2, *[f"s{k:02}" for k in range(80)]]
    rows = [(k, prose(k, 100), "en", q, 1, "", "", "") for k, q in enumerate(names)]
    pieces = packing.pack(documents(spark, rows), PATH, window=256, grain=32, weights={"small": 1.0, "big": 1.0}, max_queues=66).collect()
    assert {p.doc_id for p in pieces if p.queue == "small"} == {43, 44}
    assert {p.doc_id for p in pieces if p.queue == "~5"} <= {40, 41, 42}
    assert {p.queue for p in pieces if p.sequence_id == 0} == {"small", "big"}
    pieces = packing.pack(documents(spark, rows), PATH, max_queues=66).collect()
    assert {p.doc_id for p in pieces if p.queue == "~5"} == {40, 41, 42}


def test_schedule_many_queues():
    rng = np.random.default_rng(1)
    totals = rng.integers(1, 5000, 50)
    plan = packing.Schedule([str(i) for i in range(50)], totals, 512, 64)
    row, start, length, seq, off = plan.pieces(np.arange(50), np.zeros(50, dtype=np.int64), totals)
    place = np.sort(np.concatenate([np.arange(o, o + n) + s * 100_000 for s, o, n in zip(seq, off, length)]))
    assert len(place) == totals.sum() and len(np.unique(place)) == len(place)
    assert (np.bincount(row, weights=length) == totals).all() and (start >= 0).all()


def test_words_are_encoded_as_texts():
    e, t = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["It's Don't x's!!", "a,b ., c. ΑΣ Σ ΟΔΟΣ", "e\u0301 ﬁ İ", "<|endoftext|> a<|startoftext|>", "a\x1cb\x85c\u2028d", "#@! *** 12a3", "", "日本 語。", "ab\u0301, c\u0327."]
    for _ in range(2):
        got = [np.frombuffer(b, dtype=e.kind).tolist() for b in e.encode(texts)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_any_unicode_text_is_encoded_as_by_the_tokenizer():
    e, t = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    assert e.fast
    rng = np.random.default_rng(4)
    blocks = ["abcXYZ", " \t\n", ".,'-!#s", "0123", "\u0130\u03a3\u03c3\u03c2\u00df\u0149\u01c5", "\u0301\u0307\u0345\u00b7\u2019", "\x00\x1c\x1f\x85\u00a0\u2028\u3000\u200b\ufeff"]
    wide = [chr(c) for c in range(0x80, 0x3000) if chr(c).isprintable()] + list("\u65e5\u672c\uac00\u1100\u1161\U0001f600\U00010400\U0001d400\ufb01")
    texts = ["\u0130- \u03a3", "a\u0130. \u03a3", "\u0130,\n\u03a3", "don\u2019T 'S", "x\u0345 \u0391\u03a3\u0301."]
    for k in range(20_000):
        pool = list("".join(rng.choice(blocks, 3))) + [str(x) for x in rng.choice(wide, 4)]
        texts.append("".join(rng.choice(pool, int(rng.integers(1, 14)))))
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        got = [np.frombuffer(b, dtype=e.kind).tolist() for b in e.encode(part)]
        want = [x.ids for x in t.encode_batch(part, add_special_tokens=False)]
        assert got == want, [x for x, a, b in zip(part, got, want) if a != b][:5]
    other = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.fast
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [np.frombuffer(b, dtype=other.kind).tolist() for b in other.encode(texts[:200])] == [x.ids for x in plain.encode_batch(texts[:200], add_special_tokens=False)]


def test_pipeline(spark):
    """Each stage against what it says it keeps."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    at = docs
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in at.collect()}
        at = P.stash(stage(spark, at, SF), f"test-{name}")
        assert at.columns == columns
        after = {r.doc_id: r.text for r in at.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before)
        if name == "near_duplicates":
            from .test_dedup import brute_groups

            groups = brute_groups(list(before.items()))
            assert set(after) == {c for _, c in groups.values()}
        if name == "repeated_substrings":
            from .test_dedup import brute_substrings

            keys = list(before)
            want = dict(zip(keys, (k.decode("utf-8", "ignore") for _, _, k in brute_substrings([before[k] for k in keys], 200))))
            assert {k: v.encode("utf-8", "ignore") for k, v in after.items()} == {k: v.encode() for k, v in want.items()}
        if name == "benchmark_leaks":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            grams = {tuple(w[i : i + min(10, len(w))]) for _, t in items for w in [words(t)] if w for i in range(max(1, len(w) - 9))}
            dirty = {k for k, t in before.items() for w in [words(t)] if any(tuple(w[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1))}
            assert set(after) == set(before) - dirty
    pieces = P.STAGES[-1][1](spark, at, SF)
    tokens = pieces.agg(F.sum("length")).first()[0]
    assert tokens == pieces.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
    assert zlib.crc32(b"") == 0


@pytest.mark.parametrize("few", [500_000, 0])
def test_pipeline_repeated_and_null_ids(spark, few):
    """Every distinct text keeps exactly one row, and repeated_substrings leaves it whole."""
    import corpus_pipeline as P

    a, b, c, d, e, f = (prose(900 + k, 80) for k in range(6))
    near = " ".join([*d.split()[:-1], "changed"])
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (2, c), (2, d), (3, near), (None, e), (4, e), (5, f), (5, near), (None, None), (None, None), (6, ""), (6, "")]
    docs = documents(spark, [(k, t, "en", f"src{i % 2}", None if t is None else len(t), "", "", "") for i, (k, t) in enumerate(rows)])
    kept = P.stash(P.near_duplicates(spark, docs, SF, few=few), "test-repeated-ids")
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = [(1, a), (None, b), (2, c), (2, d), (4, e), (5, f), (None, None), (None, None), (6, ""), (6, "")]
    assert kept.columns == docs.columns and got == sorted(want, key=repr)
    cut = sorted(((r.doc_id, r.text) for r in P.repeated_substrings(spark, kept, SF).collect()), key=repr)
    assert cut == sorted(((k, t or "") for k, t in got), key=repr)  # a null text is an empty one from here on
