"""Ordered rules of intent, state, strategy, tone, confidence and instruction, branch by branch; splits without a global order."""

import pytest
from pyspark.sql import functions as F

from convlake import params
from convlake.operators import decide, memory, splits

INTENTS = [
    ("", "", "unknown"), (None, None, "unknown"), ("Why?", "", "unknown"), ("qui", "", "unknown"), ("yes!", "Come along, will you", "invitation"), ("no thanks", "let us go", "invitation"),
    ("yes I would like that a lot", "let us go", "agreement"), ("ok", "Tomorrow at nine", "agreement"), ("no", "Tomorrow at nine", "disagreement"), ("Could you explain that", "", "answer_request"),
    ("explique por favor", "", "answer_request"), ("I am free tomorrow", "", "planning"), ("on part demain", "", "planning"), ("join me", "", "invitation"), ("I will never join", "", "unknown"),
    ("Fine. Who will join", "", "question"), ("It rains. where", "", "question"), ("where it rains. Fine", "", "unknown"), ("you there?", "", "question"), ("oui", "", "agreement"), ("nein", "", "disagreement"),
    ("the sky over us is blue", "", "information"), ("sky is blue", "", "unknown"), ("great!", "", "reaction"), ("haha good one", "", "reaction"), ("hello you", "", "casual_chat"), ("many thanks", "", "casual_chat"),
    ("goodbye then", "", "casual_chat"), ("one two three four five six seven eight", "", "information"), ("one two three", "", "unknown"),
]


def test_intent(spark):
    df = spark.createDataFrame([(i, t, b) for i, (t, b, _) in enumerate(INTENTS)], "i int, t string, b string")
    assert spark.range(1).select(decide.first_of([], "none")).first()[0] == "none"
    got = {r.i: r.intent for r in decide.intent(df, F.col("t"), F.col("b")).collect()}
    assert [(INTENTS[i], got[i]) for i in sorted(got) if got[i] != INTENTS[i][2]] == []


PLANS = [  # low, intent, state, ambiguity, topic -> strategy, tone
    (("x", "question", "closing", "high", "people"), "close_conversation", "casual"), (("no, not me", "invitation", "ongoing", "low", "people"), "decline", "casual"),
    (("x", "invitation", "banter", "high", "people"), "accept", "humorous"), (("x", "unknown", "ongoing", "high", "time"), "ask_clarification", "casual"),
    (("x", "question", "ongoing", "high", "time"), "ask_clarification", "neutral"), (("x", "answer_request", "ongoing", "low", "things"), "provide_information", "neutral"),
    (("x", "answer_request", "ongoing", "low", "other"), "answer", "casual"), (("x", "question", "ongoing", "low", "people"), "answer", "casual"),
    (("x", "unknown", "inquiry", "low", "time"), "answer", "casual"), (("x", "planning", "ongoing", "low", "time"), "suggest", "casual"),
    (("it is broken", "information", "ongoing", "low", "things"), "suggest", "supportive"), (("x", "reaction", "banter", "low", "time"), "continue_banter", "humorous"),
    (("x", "disagreement", "banter", "low", "time"), "continue_banter", "teasing"), (("x", "agreement", "ongoing", "low", "time"), "acknowledge", "casual"),
    (("x", "information", "ongoing", "low", "time"), "acknowledge", "casual"), (("x", "unknown", "agreement", "low", "time"), "acknowledge", "casual"),
    (("x", "disagreement", "ongoing", "low", "time"), "react", "serious"), (("x", "casual_chat", "opening", "low", "casual_chat"), "react", "casual"),
]


def test_plan(spark):
    rows = [(i, *p, i % 4, i % 2 == 0) for i, (p, _, _) in enumerate(PLANS)]
    df = spark.createDataFrame(rows, "i int, low string, intent string, state string, ambiguity string, topic string, depth int, use_memory boolean")
    got = {r.i: r for r in decide.plan(df).collect()}
    for i, (p, strategy, tone) in enumerate(PLANS):
        assert (got[i].strategy, got[i].tone) == (strategy, tone), p
        sure = {"question": 25, "invitation": 25, "agreement": 25, "planning": 25, "disagreement": 25, "information": 20, "reaction": 20}.get(p[1], 15)
        sure += {"low": 35, "medium": 20, "high": 5}[p[3]] + (15 if i % 4 >= 3 else 10 if i % 4 == 2 else 5)
        sure += (15 if strategy in ("accept", "decline", "close_conversation", "answer", "provide_information") else 10) + (5 if i % 2 else 10)
        assert got[i].confidence == sure / 100
        memories = "off" if strategy in ("ask_clarification", "close_conversation") else "none" if i % 2 else "given"
        assert got[i].instruction == f"aim: {params.AIMS[strategy][0]}; tone: {tone}; topic: {p[4]}; memories: {memories}"


def test_example_state(spark):
    rows = [("x", "ok bye", 3, "closing"), ("haha you", "fine", 3, "banter"), ("do it", "ok done", 3, "agreement"), ("do it", "ok it will be done by nine", 3, "ongoing"),
            ("where is it", "there", 3, "inquiry"), ("is it?", "there", 3, "inquiry"), ("hello my old friend", "there", 1, "opening"), ("two words", "there", 1, "opening"),
            ("more than two words", "there", 1, "ongoing"), ("two words", "there", 2, "ongoing"), (None, None, 1, "opening")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u string, t string, d int, want string")
    out = df.withColumn("got", decide.example_state(F.col("u"), F.col("t"), F.col("d"))).collect()
    assert [r for r in out if r.got != r.want] == []


def test_selection_policy(spark):
    rows = [(1, 1, "people", "people", "ongoing", 0.9), (1, 2, "time", "people", "ongoing", 0.8), (1, 3, None, "people", "ongoing", 0.7), (1, 4, "people", "people", "ongoing", 0.6),
            (2, 5, "general", "casual_chat", "ongoing", 0.5), (2, 6, "time", "other", "ongoing", 0.9), (2, 7, "", "other", "ongoing", 0.44), (3, 8, "time", "time", "closing", 0.9)]
    df = spark.createDataFrame(rows, "q int, m_id int, m_topic string, q_topic string, state string, score double")
    got = {r.q: r.memory_ids for r in memory.select_policy(df, "q", by="score", topic="q_topic", state="state").collect()}
    assert got == {1: [1, 3], 2: [5]}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 333])
def test_splits_without_a_global_order(spark, n):
    import hashlib

    df = spark.range(n).withColumn("v", F.col("id") * 2).repartition(3)
    order = sorted(range(n), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    a, b = max(1, int(n * 0.8)), max(1, int(n * 0.8)) + int(n * 0.1)
    want = {k: "train" if i < a else "val" if i < b else "test" for i, k in enumerate(order)}
    out = splits.row_split(df, "id", (0.8, 0.1, 0.1))
    assert {r.id: r.split for r in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().toString()
    v, t = round(n * 0.1), round(n * 0.2)
    v, t = (max(1, v), max(1, t)) if n >= 3 else (v, t)
    want = {k: "train" if i < n - v - t else "val" if i < n - t else "test" for i, k in enumerate(order)}
    assert {r.id: r.split for r in splits.group_split(df, "id", (0.7, 0.1, 0.2)).collect()} == want


def test_stratified(spark):
    import hashlib

    df = spark.range(300).withColumn("s", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    got = {r.id for r in splits.stratified(df, "s", "id", {"a": 0.5, "b": 0.5}, 81).collect()}
    by = lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k)
    a, b = (sorted((k for k in range(300) if (k % 3 == 0) == first), key=by) for first in (True, False))
    assert got == set(a[:41]) | set(b[:40]) and splits.row_split(df.limit(0), "id", (0.8, 0.1, 0.1)).count() == 0
