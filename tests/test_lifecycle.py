"""Memories by the batch and the streaming form against the rules said row by row."""

import random

import pytest
from pyspark.sql import functions as F

from convlake.operators import lifecycle as L
from convlake.streaming import streams as X

CASES = [
    (1, "p", "I prefer tea", "low"), (2, "p", "I prefer coffee", "medium"), (3, "p", "I prefer tea!", "high"),  # A, B, A
    (4, "p", "Likes cats", "low"), (5, "p", "My name is Ada", None), (6, "p", "likes the cats.", "high"), (7, "p", "liked cats", "odd"),  # not adjacent, verb forms
    (8, "q", "I prefer tea", "low"), (9, "q", "Likes cats", "low"), (10, "p", "I preferred tea", "low"), (11, "q", "I prefer tea", "high"),  # two personas
    (12, None, "I live in Rome", "low"), (13, None, "vivo en Rome", "low"), (14, None, "I live in Oslo", "low"), (15, None, "I live in Rome", "low"),  # one value, two wordings
    (16, "p", None, "low"), (17, "p", "the of", "low"), (18, "p", "", "high"), (19, "p", "my name Ada", "high"), (20, "p", "Je m'appelle Ada", "low"),
]


def norm(content):
    import re

    words = [L.VERBS.get(w, w) for w in re.findall(r"\w+", (content or "").lower()) if w not in L.FILLERS]
    return " ".join(words)


def brute(rows):
    """As the rules say it: one after the other, over all active memories of the persona."""
    import re

    store, did = [], []
    for at, persona, content, importance in rows:
        n = norm(content)
        slot = next(((s, m[1]) for s, p in L.SLOTS if (m := re.match(p, n))), None)
        rank = L.RANKS.index(importance) if importance in L.RANKS else 1
        mine = [m for m in store if m["persona"] == persona and m["status"] == "active"]
        if same := [m for m in mine if m["norm"] == n]:
            m = same[0]
            m |= {"rank": max(m["rank"], rank), "updated": at, "merged": m["merged"] + 1}
            did.append((persona, at, "merged", m["m_id"]))
            continue
        against = [m for m in mine if slot and m["slot"] and m["slot"][0] == slot[0] and m["slot"][1] != slot[1]]
        for m in against:
            m |= {"status": "superseded", "superseded_by": at, "updated": at}
        store.append({"persona": persona, "m_id": at, "content": content, "norm": n, "slot": slot, "rank": rank, "updated": at, "merged": 1, "status": "active", "superseded_by": None})
        did.append((persona, at, "superseded" if against else "created", at))
    flat = [(m["persona"], m["m_id"], m["content"], *(m["slot"] or (None, None)), L.RANKS[m["rank"]], m["m_id"], m["updated"], m["merged"], m["status"], m["superseded_by"]) for m in store]
    return sorted(flat, key=str), sorted(did, key=str)


def random_rows(n=300):
    r = random.Random(8)
    says = ["I prefer {}", "prefiero {}", "I live in {}", "likes {}", "My name is {}", "{}"]
    return [(i, r.choice(["hot", "hot", "p", "q", None]), r.choice(says).format(r.choice(["a1", "b2", "c3"])), r.choice(L.RANKS)) for i in range(1, n)]


@pytest.mark.parametrize("rows, at", [(CASES, None), (CASES, [3.0, 13.0]), (random_rows(), None), (random_rows(), list(map(float, range(0, 300, 11))))])
def test_batch(spark, rows, at):
    found = L.candidates(spark.createDataFrame(rows, "id long, who string, content string, importance string").repartition(3), "who", "id", "content", "importance")
    memories, did = brute(rows)
    assert sorted((tuple(r) for r in L.memories(found, at).collect()), key=str) == memories
    assert sorted((tuple(r) for r in L.actions(found, at).collect()), key=str) == did


def test_cases_by_hand():
    memories, did = brute(CASES)
    by = {m[1]: m for m in memories}
    assert [by[k][9] for k in (1, 2, 3)] == ["superseded", "superseded", "active"] and (by[1][10], by[2][10]) == (2, 3)
    assert by[4][5] == "high" and by[4][8] == 3 and by[8][8] == 2 and by[3][8] == 2
    assert [by[k][10] for k in (12, 13)] == [14, 14] and by[14][10] == 15 and by[15][9] == "active"


@pytest.mark.parametrize("rows, files", [(CASES, 6), (random_rows(), 4)])
def test_stream_equals_batch(spark, tmp_path, rows, files):
    df = spark.createDataFrame(rows, "id long, who string, content string, importance string")
    for k in range(files):
        size = -(-len(rows) // files)
        df.where((F.col("id") > k * size) & (F.col("id") <= (k + 1) * size)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = X.json_stream(spark, str(tmp_path / "in"), df.schema, files=1)
    with X.rocksdb(spark):
        got = X.drain(L.stream_actions(L.candidates(stream, "who", "id", "content", "importance")), "memories")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)[1]


def test_empty(spark):
    found = L.candidates(spark.createDataFrame([], "id long, who string, content string"), "who", "id", "content")
    assert L.memories(found).collect() == [] and L.actions(found).collect() == []
