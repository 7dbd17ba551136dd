"""Phrases by a tree of words, embeddings by a model."""

import random
import re

import numpy as np
import pandas as pd
import xxhash

from convlake.operators import lexicon as X
from convlake.operators import memory as M


def brute(texts, phrases):
    words = lambda x: re.findall(r"\w+", (x or "").lower())
    out = []
    for k, text in texts:
        t = words(text)
        for i, p in phrases:
            w = words(p)
            out += [(k, place, i) for place in range(len(t)) if w and t[place : place + len(w)] == w]
    return sorted(out)


def test_phrases_equal_brute_force(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("ab AB c d e.".split(" ")) for _ in range(n))
    texts = [(i, say(rng.randrange(0, 40))) for i in range(60)] + [(90, None), (91, ""), (92, "..."), (93, "a " * 5000), (94, "zz"), (95, "a b")]
    phrases = [(i, say(rng.randrange(1, 6))) for i in range(40)] + [(50, None), (51, "?!"), (52, "A, b"), (53, "a b"), (54, "ab ab"), (55, "d")]
    df, lex = spark.createDataFrame(texts, "place_of long, text string"), spark.createDataFrame(phrases, "i int, phrase string")
    want = brute(texts, phrases)
    for few in (200_000, 0):
        got = X.phrase_hits(df, ["place_of"], "text", lex, few=few)
        assert got.columns == ["place_of", "place", "i", "phrase"]
        assert sorted((r.place_of, r.place, r.i) for r in got.collect()) == want and len(want) > 3000
    assert X.phrase_hits(df, ["place_of"], "text", lex.where("i in (50, 51)")).count() == 0
    assert X.phrase_hits(df.where("false"), ["place_of"], "text", lex).count() == 0


def test_joins_do_not_grow_with_the_lexicon(spark):
    df = spark.createDataFrame([(1, "w1 w2 w3")], "k long, text string")
    plans = []
    for n in (3, 1000):
        lex = spark.createDataFrame([(f"w{i} w{i + 1}",) for i in range(n)], "phrase string")
        hits = X.phrase_hits(df, ["k"], "text", lex)
        plans.append(hits._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        assert sorted((r.place, r.phrase) for r in hits.collect()) == [(0, "w1 w2"), (1, "w2 w3")]
    assert plans[0] == plans[1]


def test_topics_by_phrases(spark):
    lex = spark.createDataFrame([(1, "x", "red tea", 1.0), (2, "y", "tea", 1.0), (2, "y", "green tea cup", 0.5), (1, "x", "pot", 0.5)], "rank int, topic string, phrase string, weight double")
    df = spark.createDataFrame([(1, "red tea, tea"), (2, "Green TEA cup"), (3, "red pot"), (4, "none"), (5, None)], "k long, text string")
    assert {r.k: (r.topic, r.score) for r in X.phrase_topics(df, "k", "text", lex).collect()} == {1: ("x", 1.0), 2: ("y", 1.5), 3: ("x", 0.5)}


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "Red tea tea"), (2, ""), (3, None), (4, "a b c d e")], "k long, text string")
    got = {r.k: np.array(r.embedding) for r in M.embeddings(df, "k", "text").collect()}
    for k, text in ((1, "red tea tea"), (4, "a b c d e"), (2, ""), (3, "")):
        v = np.zeros(64)
        for w in text.split():
            h = xxhash.xxh64(w.encode(), seed=42).intdigest() % 2**31
            v[h % 64] += h % 97 / 100 + 0.1
        assert np.allclose(got[k], v / (np.linalg.norm(v) or 1), atol=1e-6)

    def model(batches):
        for s in batches:
            yield pd.Series([[float(len(x)), 1.0] for x in s])

    assert {r.k: list(r.embedding) for r in M.embeddings(df, "k", "text", model).collect()} == {1: [11.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0], 4: [9.0, 1.0]}
