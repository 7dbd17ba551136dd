"""Families of the Jaccard join and the near-duplicate stage at size: what ties, what a block holds, what is moved and what stays on disk."""

import os

import numpy as np
import pytest

import corpus_pipeline
from convlake.llm import common, jaccard_join

from .helpers import prose

R = np.random.default_rng(11)


def some(n):
    return np.unique(R.integers(0, 1 << 63, n, dtype=np.uint64))


def test_linked_sets_share_a_mark():
    """Pairs at the threshold, whatever their sizes and whatever counts as common."""
    for _ in range(1500):
        n = int(R.integers(1, 30)) if R.random() < 0.6 else int(R.integers(30, 900))
        a = some(n)
        gone = int(R.integers(0, len(a) // 5 + 1))
        both = R.permutation(a)[gone:]
        m = 0
        while 9 * len(both) >= 4 * (len(a) + len(both) + m + 1):
            m += 1
        b = np.sort(np.concatenate((both, some(int(R.integers(m // 2, m + 1))))))
        assert 100 * len(both) >= 80 * (len(a) + len(b) - len(both))
        late = np.sort(R.permutation(a)[: int(R.integers(0, len(a) + 1))])
        assert set(jaccard_join.marks(a, late).tolist()) & set(jaccard_join.marks(b, late).tolist())


def chance_texts():
    """300 long texts, each of which has a few passages of seven words with others, and five with a near copy."""
    passages = [prose(9000 + k, 7) for k in range(40)]
    texts = {}
    for k in range(300):
        words = [prose(2000 + 20 * k + i, 30) for i in range(20)]
        for at in range(0, 20, 4):
            words.insert(at, passages[int(R.integers(0, 40))])
        texts[k] = " ".join(words)
    for k in range(5):
        texts[1000 + k] = texts[k] + " and a word more"
    return texts


def test_chance_ties_nothing(spark):
    texts = chance_texts()
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    links = jaccard_join.family_links(df, 5, np.zeros(0, dtype=np.uint64)).distinct().count()
    assert 5 <= links < 30, "the copies, and hardly another text"


@pytest.mark.parametrize("options", [{"heavy": 1500}, {"heavy": 5000, "block": 4, "pivots": 1, "few": 2}, {"few": 0}])
def test_blocks_by_shingles(spark, options):
    texts = {k: prose(50, 200) + " " + prose(300 + k, 4 + 9 * (k % 5)) for k in range(40)} | {100 + k: prose(80 + k // 3, 150) + f" end {k}" for k in range(15)}
    texts |= {200: None, 201: "", 202: texts[0]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    shingles = lambda t: set(zip(*((t or "").lower().split()[i:] for i in range(5))))
    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = {r.doc_id: r.component for r in jaccard_join.group_documents(df, **options).collect()}
    assert got == root and len(set(root.values())) < 20


def test_rows_stay_where_they_are_and_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = {k: prose(700 + k % 60, 60) + " " * (k // 60) for k in range(150)}
        df = spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id long, text string, lang string").repartition(3)
        for few in (500_000, 20):
            kept = corpus_pipeline.near_duplicates(spark, df, "", few=few)
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
        assert sorted(p.split("-")[2] for p in os.listdir(tmp_path)) == ["spare", "spare"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
