"""Schema rules, rows compared by place, repeated runs."""

import json

from pyspark.sql import functions as F

from convlake.operators import annotate as A
from convlake.operators import profile as P
from convlake.operators import quality as Q
from convlake.operators import relational as R

GOOD = {"conversation_id": "a", "persona_id": "p", "metadata": {}, "messages": [{"speaker": "x", "text": "t"}, {"speaker": "y", "text": ""}]}
CASES = [
    (GOOD, []), ({}, ["missing conversation_id", "missing messages"]), ([1], ["document is not of kind object", "missing conversation_id", "missing messages"]),
    (GOOD | {"conversation_id": ""}, ["conversation_id under 1"]), (GOOD | {"conversation_id": 5}, ["conversation_id is not of kind string"]), (GOOD | {"more": 1}, ["document has unknown keys"]),
    (GOOD | {"metadata": [1]}, ["metadata is not of kind object"]), (GOOD | {"messages": "x"}, ["messages is not of kind array"]), (GOOD | {"messages": []}, ["messages under 2"]),
    (GOOD | {"messages": [{"speaker": "", "text": "t"}, {"speaker": "x", "text": 4, "z": 1}, "no"]},
     ["messages: document has unknown keys 1", "messages: document is not of kind object 2", "messages: missing speaker 2", "messages: missing text 2", "messages: speaker under 1 0", "messages: text is not of kind string 1"]),
    (GOOD | {"persona_id": None}, ["persona_id is not of kind string"]),
]


def test_conversation_rules(spark):
    rows = [(i, json.dumps(d)) for i, (d, _) in enumerate(CASES)] + [(90, "{broken"), (91, None)]
    found = Q.schema_issues(spark.createDataFrame(rows, "k long, doc string"), "k", "doc", Q.CONVERSATION_RULES).collect()
    got = {}
    for r in found:
        got.setdefault(int(r.key), []).append(r.rule if r.place is None else f"{r.rule} {r.place}")
    for i, (d, want) in enumerate(CASES):
        assert sorted(got.get(i, [])) == want, d
    assert got[90] == got[91] == ["no JSON"]
    assert {r.message for r in found if r.key == "3"} == {"conversation_id under 1 at 3"}


def test_training_rules(spark):
    ok = {"conversation_id": "a", "text": "t", "split": "val", "metadata": {"num_turns": 2}}
    cases = [(ok, []), (ok | {"split": "dev"}, ["split outside its values"]), (ok | {"metadata": {"num_turns": 0}}, ["metadata.num_turns under 1"]), (ok | {"metadata": {"num_turns": 1.5}}, ["metadata.num_turns is not of kind integer"])]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(cases)], "k long, doc string")
    got = {i: [] for i in range(len(cases))}
    for r in Q.schema_issues(df, "k", "doc", Q.TRAINING_RULES).collect():
        got[int(r.key)].append(r.rule)
    assert got == {i: w for i, (_, w) in enumerate(cases)}
    number = Q.schema_issues(spark.createDataFrame([("a", '{"x": 2.5, "y": 3}'), ("b", '{"x": true, "y": 9}')], "k string, doc string"), "k", "doc", [Q.Field("x", "number", most=2), Q.Field("y", "integer", most=5)])
    assert sorted((r.key, r.rule) for r in number.collect()) == [("a", "x over 2"), ("b", "x is not of kind number"), ("b", "y over 5")]


def test_by_place(spark):
    a = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 3, None), (None, 1, "z"), ("only", 9, "q")], "k string, o long, t string")
    b = spark.createDataFrame([("k", 1, "a"), ("k", 3, None), ("k", 4, None), ("k", 5, "e"), (None, 1, "y")], "k string, o long, t string")
    for at in (None, [2.0, 4.0]):
        got = sorted((r.k, r.place, r.kind) for r in R.by_place(a, b, ["k"], "o", ["t", "o"], at).where("k IS NOT NULL").collect())
        assert got == [("k", 1, "changed_o"), ("k", 1, "changed_t"), ("k", 2, "changed_o"), ("k", 3, "extra"), ("only", 0, "missing")]
        assert [r.kind for r in R.by_place(a, b, ["k"], "o", ["t"], at).where("k IS NULL").collect()] == ["changed_t"]


def test_runs_and_dominance(spark):
    df = spark.range(50).withColumn("s", F.floor(F.sqrt("id")))
    assert tuple(R.same_runs([df, df.repartition(7), df.orderBy(F.desc("id"))]).first()) == (50, 3, True)
    assert not R.same_runs([df, df.where("id < 49")]).first().same
    got = {r.k: (r["rows"], r.percent) for r in P.dominance(df, "s", [1, 3, 50]).collect()}
    assert got == {1: (13, 26.0), 3: (13 + 11 + 9, 66.0), 50: (50, 100.0)}


def test_audit_and_release(spark):
    rows = [(1, "the cat of", "en"), (2, "le chat des", "fr"), (3, "der Hund the", "fr"), (4, "zzz", None), (5, "zzz", "en"), (6, None, "en"), (7, "la la la les de", "es")]
    df = spark.createDataFrame(rows, "id long, text string, lang string").withColumn("likely", A.likely_language(F.col("text"), {"en": ["the", "of"], "fr": ["le", "des", "la", "les"], "es": ["la", "de", "los"], "de": ["der"]}))
    assert {r.id: r.likely for r in df.collect()} == {1: "en", 2: "fr", 3: "en", 4: "unknown", 5: "unknown", 6: "unknown", 7: "fr"}
    found = Q.label_audit(df, {"language": F.col("lang") == F.col("likely"), "text": F.col("text").isNotNull()})
    assert {r.check: (r.n, r.wrong, r.share) for r in found.collect()} == {"language": (6, 4, 0.6667), "text": (7, 1, 0.1429)}
    assert tuple(Q.release(found, {"language": 0.7, "text": 0.2}).first()) == (True, "")
    assert tuple(Q.release(found, {"text": 0.1}).first()) == (False, "language,text")
    assert [tuple(r)[1:] for r in Q.label_audit(df.limit(0), {"x": F.lit(True)}).collect()] == [(0, 0, 0.0)]
