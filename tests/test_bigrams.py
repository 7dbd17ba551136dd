"""The most frequent pairs of words against a plain count, and how many pairs are counted for it."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convlake.operators import profile as P

from .conftest import SF


def plain(texts, k):
    n = Counter()
    for x in texts:
        t = re.findall(r"\w+", (x or "").lower())
        n.update(map(" ".join, zip(t, t[1:])))
    return sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[:k]


def counted(monkeypatch):
    """Rows that each count of pairs takes in."""
    rows, made = [], P.bigrams

    def bigrams(*a):
        df = made(*a)
        rows.append(df.count())
        return df

    monkeypatch.setattr(P, "bigrams", bigrams)
    return rows


def rare(n=2000):
    r = random.Random(5)
    return ["to be or not to be " + " ".join(f"w{r.randrange(10**9)}" for _ in range(30)) for _ in range(n)]


def apart(n=40):
    """Frequent words that never meet, and rarer ones that do."""
    return [" ".join(x for i in range(5) for x in (w, f"u{k}_{i}{w}")) for k in range(n) for w in "abcd"] + ["x y z"] * 3 + ["y z"] * 2


@pytest.mark.parametrize("texts", [rare(200), apart(), [None, "", "one", "!?"], ["a b", "B A", "a  B"], ["Ça va, Ça ne va_1 pas"] * 3, ["a"] * 9 + ["p q r s t u v w x y z"]])
@pytest.mark.parametrize("k, places", [(3, 1 << 16), (10, 7), (1, 1)])
def test_against_a_plain_count(spark, texts, k, places):
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(3)
    assert [tuple(r) for r in P.top_bigrams(df, "text", k, places).collect()] == plain(texts, k)
    assert sorted((r.term, r.n) for r in P.top_k(P.bigrams(df, "text"), "term", 10**6).collect()) == sorted(plain(texts, None))


def test_pairs_with_rare_words_are_not_counted(spark, monkeypatch):
    texts, rows = rare(), counted(monkeypatch)
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(3)
    assert [tuple(r) for r in P.top_bigrams(df, "text", 4).collect()] == plain(texts, 4)
    assert len(rows) == 1 and rows[0] < 6 * len(texts)


def test_words_that_never_meet_are_counted_again(spark, monkeypatch):
    texts, rows = apart(), counted(monkeypatch)
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(3)
    assert [tuple(r) for r in P.top_bigrams(df, "text", 2).collect()] == plain(texts, 2) == [("y z", 5), ("x y", 3)]
    assert len(rows) == 2


def test_documents(spark, monkeypatch):
    rows = counted(monkeypatch)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in P.top_bigrams(df, "text", 10).collect()]
    every = df.select(F.explode(F.split(F.col("text"), r"[^\p{L}\p{N}_]+"))).count()
    assert len(got) == 10 and sum(rows) < every / 2
