"""Phrase mining against brute force, with small limits that force every split."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convlake.llm import phrases

KIND = "doc_id long, text string, lang string, h string, f long, phrase string"


def brute(rows, least, longest, top, covered):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang, text = "und" if lang is None else lang, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, ".")
        for piece in text.split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), b in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if (lang, p[i : i + m]) in found and 100 * b >= covered * found[lang, p[i : i + m]]:
                    gone.add((lang, p[i : i + m]))
    out = []
    for lang in n:
        best = []
        for (x, p), a in found.items():
            if x == lang and (x, p) not in gone:
                cuts = [(2_000_000 * a // (f[x, p[:k]] + f[x, p[k:]]), k, f[x, p[:k]], f[x, p[k:]]) for k in range(1, len(p))]
                s, _, left, right = min(cuts)
                best.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, b.decode(), -a, left, right, n[lang], -s) for i, (s, a, b, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def corpus():
    r = random.Random(5)
    words = ["Red", "tea", "CUP", "of", "the", "É", "é", "a", "x" * 40, "n o"]
    rows = []
    for k in range(90):
        w = [r.choice(words[: 3 + k % 8]) + r.choice(["", "", "", ".", ",", "\n", "!\t", "\r"]) for _ in range(r.randint(0, 80))]
        rows.append((" ".join(w), [None, "en", "fr", "und", "en", ""][k % 6]))
    rows += [(None, "en"), ("", None), (" \t ", "en"), ("...", "fr"), ("a a a a a a", "en"), ("lone", "de"), ("the " * 4000, "en"), ("one. two " * 3000, "fr")]
    return rows + rows[:5]


@pytest.mark.parametrize("options", [{}, {"held": 40, "share": 10**6, "buckets": 5}, {"bits": 1 << 10, "top": 7}, {"covered": 50, "longest": 3}])
def test_against_brute_force(spark, monkeypatch, options):
    rows = corpus()
    df = spark.createDataFrame([(i, t, x, "h", i, "p") for i, (t, x) in enumerate(rows)], KIND).repartition(5)
    if "held" in options:
        monkeypatch.setattr(phrases, "ROW", 3)
    want = brute(rows, 6, options.get("longest", 4), options.get("top", 2000), options.get("covered", 80))
    got = sorted(tuple(r) for r in phrases.mine(df, least=6, **options).collect())
    assert len(want) > 20 and got == want


def test_stretches_cut_long_texts_between_pieces():
    text = b"one two, three. " * 50_000 + b"x" * 2_000_000 + b" end"
    held = [x for part in phrases.stretches([None, text, b"", b"short"], 1000) for x in part]
    assert b"".join(t for r, t in held if r == 1) == text and [t for r, t in held if r == 3] == [b"short"]
    assert all(t[-1] in phrases.STOPS for r, t in held[:-2])


def test_score_is_exact_beyond_64_bits(spark):
    a = 9_000_000_000_000_000_000
    df = spark.createDataFrame([(a, a, a - 7), (5, 7, 2**62), (30, 31, 30)], "a long, l long, r long")
    got = [r[0] for r in df.select(phrases.cut_score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [2_000_000 * a // (2 * a - 7), 10_000_000 // (2**62 + 7), 60_000_000 // 61]


def test_no_phrases(spark):
    df = spark.createDataFrame([], KIND)
    assert phrases.mine(df).collect() == []
    out = phrases.mine(spark.createDataFrame([(1, "a b", "en", "h", 1, "p")], KIND))
    assert out.collect() == [] and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
