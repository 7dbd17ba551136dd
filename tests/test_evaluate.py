"""Evaluation of plans, modes, sets of responses."""

from pyspark.sql import functions as F

from convlake.operators import evaluate as E
from convlake.operators import memory as M
from convlake.plans import score as S

RESULT = (
    "id int, category string, topic string, intent string, strategy string, ambiguity string, use_memory boolean, memory_topics array<string>, "
    "expected_topic string, expected_intent string, expected_strategy string, expected_memory boolean"
)
CASES = [
    (1, "dialogue", "food", "question", "answer", "low", True, ["food"], "food", "question", "answer", True),
    (2, "dialogue", "food", "question", "answer", "low", True, ["Food", "music"], "food", "question", "react", True),
    (3, "dialogue", "casual_chat", "question", "answer", "low", True, ["music"], "food", "question", "answer", False),
    (4, "dialogue", "food", "unknown", "react", "High", False, None, None, None, "answer", True),
    (5, "ambiguous", None, None, None, None, None, [None], "food", None, "react", None),
    (6, "ambiguous", "food", "question", "answer", "low", False, ["music"], "food", "question", "answer", False),
    (7, "dialogue", "food", "question", "answer", "low", True, [None, ""], "food", "question", "answer", None),
]


def test_judge(spark):
    got = {r.id: r for r in E.judge(spark.createDataFrame(CASES, RESULT), "ambiguous").collect()}
    assert {k: r.explanation for k, r in got.items()} == {1: "", 2: "strategy | contamination", 3: "context", 4: "strategy | memory", 5: "context | strategy", 6: "", 7: ""}
    assert {k for k, r in got.items() if r.contaminated} == {2}, "small talk, unused memories and memories without a topic do not count"
    assert {k for k, r in got.items() if r.unclear} == {4, 5, 6}
    assert {k for k, r in got.items() if not r.ambiguity_ok} == {4, 5}
    assert {k for k, r in got.items() if not r.memory_ok} == {3, 4}, "a null expectation is met"
    assert [r.category for r in E.judge(spark.createDataFrame(CASES, RESULT)).where("unclear").collect()] == ["dialogue"]


def test_benchmark(spark):
    judged = E.judge(spark.createDataFrame(CASES, RESULT), "ambiguous")
    got = {r.category: r.asDict() for r in E.benchmark(judged, ["category"]).collect()}
    assert got["dialogue"] == {
        "category": "dialogue", "cases": 5, "topic_accuracy": 0.8, "intent_accuracy": 1.0, "strategy_accuracy": 0.6, "memory_accuracy": 0.6, "ambiguity_accuracy": 0.0,
        "memory_precision": 0.5, "memory_recall": 0.6667, "contamination_rate": 0.2, "utilization_rate": 0.8,
    }
    assert (got["ambiguous"]["memory_precision"], got["ambiguous"]["memory_recall"], got["ambiguous"]["ambiguity_accuracy"]) == (1.0, 1.0, 0.5)
    assert E.benchmark(judged.where("false"), ["category"]).count() == 0
    whole = {(r.category, r.error): r.n for r in E.error_histogram(judged, ["category"]).collect()}
    assert len(whole) == 10 and whole["ambiguous", "intent"] == 0 and whole["dialogue", "strategy"] == 2 and whole["dialogue", "contamination"] == 1


def test_sweep_repeats_rows_once(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, None, 3)], "k int, x string, y int")
    out = E.sweep(df, {"full": {}, "no_x": {"x": "?"}, "none": {"x": "!", "y": None}})
    assert sorted(tuple(r) for r in out.select("k", "mode", F.coalesce("x", F.lit("-")), F.coalesce("y", F.lit(-1))).collect()) == [
        (1, "full", "a", 2), (1, "no_x", "?", 2), (1, "none", "!", -1), (2, "full", "-", 3), (2, "no_x", "?", 3), (2, "none", "!", -1),
    ]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_modes(spark):
    """What a mode leaves out is gone, and the context is analysed once for all."""
    turns = [(1, 0, "user", "hello you"), (1, 1, "assistant", "hi"), (1, 2, "user", "where was i when you said this in that place?"), (2, 0, "user", "bye")]
    turns = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    context = S.context_analysis(turns)
    topic = {r.conv_id: r.topic for r in context.collect()}
    memories = spark.createDataFrame([(1, "m1", "that place", topic[1], "high"), (1, "m2", "where was that place when you said this", "elsewhere", "high"), (2, "m3", "bye", topic[2], "high")], "conv_id long, m_id string, m_text string, m_topic string, m_importance string")
    got = {(r.conv_id, r.mode): r for r in S.ablation(context, memories, least=0.2).collect()}
    assert len(got) == 2 * len(S.MODES)
    assert got[1, "full"].memory_ids == ["m1"] and got[1, "full"].memory_topics == [topic[1]] and got[1, "full"].topic == topic[1]
    assert got[1, "no_memory"].memory_ids is None and not got[1, "no_memory"].use_memory and got[1, "no_memory"].intent == got[1, "full"].intent
    assert (got[1, "no_context"].topic, got[1, "no_context"].intent, got[1, "no_context"].memory_ids) == ("casual_chat", "unknown", None)
    assert (got[1, "no_planning"].strategy, got[1, "no_planning"].tone, got[1, "no_planning"].memory_ids) == ("react", "casual", ["m1"])
    assert got[1, "persona_only"].strategy == "react" and not got[1, "persona_only"].use_memory
    open_ = {(r.conv_id, r.mode): r for r in S.ablation(context, memories, least=0.2, gate=False).collect()}
    assert sorted(open_[1, "full"].memory_ids) == ["m1", "m2"]


def test_responses(spark):
    rows = [("a", 1, "Yes", "yes "), ("a", 2, "I am, as an AI, glad", "x"), ("a", 3, None, ""), ("a", 4, "le chat and the dog", None), ("b", 1, "no", "yes"), ("b", 2, "I am, as an AI, glad", "x")]
    df = spark.createDataFrame(rows, "model string, k int, response string, expected string")
    seen = spark.createDataFrame([("YES",), ("yes",), ("",), (None,)], "target string")
    got = {r.model: r.asDict() for r in E.response_metrics(df, ["model"], seen, ["le"], ["the"], "as an ai").collect()}
    assert got["a"] == {"model": "a", "cases": 4, "exact": 25.0, "chars": 10.5, "words": 3.0, "mixed": 25.0, "emoji": 0.0, "casual": 75.0, "unrelated": 50.0, "memorised": 25.0}
    assert got["b"]["exact"] == 0.0 and got["b"]["memorised"] == 0.0
    assert [tuple(r) for r in E.sensitivity(df, [], ["k"], "model", "a", "b").collect()] == [(2, 50.0)]


def test_fact_rules_find_their_facts(spark):
    said = {
        "likes": "I really like tea", "dislikes": "Je déteste le bruit", "prefers": "I'd rather walk", "collects": "Ich sammle Briefmarken", "owns": "I bought a bike", "lives": "Vivo en Madrid", "comes from": "I'm from Oslo",
        "works": "Trabajo en casa", "studies": "I study law", "travels": "Je voyage demain", "moves": "I'm moving soon", "name": "Ich heiße Ada", "has family": "My sister called", "has a partner": "Ma femme dort",
        "has a friend": "Mi amiga vino", "has a pet": "mein Hund bellt", "speaks": "I speak Dutch", "age": "J'ai 30 ans", "birthday": "My birthday is near", "has a date": "I have an exam", "has a habit": "I usually run",
    }
    assert sorted(said) == sorted(r[0] for r in M.RULES) and len(M.RULES) == 21
    turns = [(i, 1, "user", text) for i, text in enumerate(said.values())] + [(90, 1, "assistant", "I like tea"), (91, 1, "user", "like tea"), (92, 1, "user", None), (93, 1, "user", "thanks!"), (94, 1, "user", "I like tea, my name is Bo"), (94, 2, "user", "I love jam")]
    out = M.extract_facts(spark.createDataFrame(turns, "k int, turn int, role string, text string"), "k", "turn").collect()
    got = {}
    for r in out:
        got.setdefault(r.k, set()).add((r.content, r.turn))
    assert got == {i: {(name, 1)} for i, name in enumerate(said)} | {94: {("likes", 1), ("name", 1)}}


def test_an_unknown_age_is_half_recent(spark):
    ages = spark.createDataFrame([(1, None), (2, 0.0), (3, -4.0), (4, 30.0)], "k int, age double")
    one = F.lit(0.0)
    got = {r.k: r.s for r in ages.select("k", F.round(M.score(one, one, one, F.col("age")), 6).alias("s")).collect()}
    assert got == {1: 0.05, 2: 0.1, 3: 0.1, 4: 0.036788}
