"""Runs along an order give the same rows wherever a key is cut, and a hot key is spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from convlake.operators import ordered, sessions


def rows():
    r = random.Random(4)
    out = []
    for user in ["hot"] * 400 + [None] * 20 + [f"u{i % 9}" for i in range(180)]:
        out.append((user, r.choice(["a", "b", "a", None]), r.choice([None, *range(12)])))
    r.shuffle(out)
    clock, made = {}, []
    for i, (user, who, step) in enumerate(out):
        clock[user] = clock.get(user, 0) + 20 * (step or 0) - (30 if i % 17 == 0 else 0)
        made.append((i, user, who, None if step is None else clock[user], f"t{i}"))
    return made


@pytest.fixture(scope="module")
def events(spark):
    df = spark.createDataFrame(rows(), "id long, user string, who string, minute long, text string")
    return df.withColumn("ts", F.timestamp_seconds(F.col("minute") * 60)).repartition(5)


def brute():
    """session and turn of each id."""
    last, out = {}, {}
    for i, user, who, minute, _ in rows():
        if user not in last:
            s, t = 0, 0
        else:
            before, s, t, said = last[user]
            gap = minute is not None and before is not None and minute - before > 120
            s, t = s + gap, 0 if gap else t + (said != who)
        last[user] = (minute, s, t, who)
        out[i] = (s, t)
    return out


@pytest.mark.parametrize("at", [None, [300.0], [10.0, 11.0, 12.0, 250.5, 599.0, 1e9], list(map(float, range(0, 600, 7)))])
def test_cuts_change_nothing(events, at):
    want = brute()
    s = sessions.sessionize(events, "user", "id", "ts", 120, at)
    assert {r.id: r.session for r in s.collect()} == {i: x for i, (x, _) in want.items()}
    turns = sessions.bursts(s, ["user", "session"], "id", "who", "text", "ts", at).collect()
    got = {i: (r.session, r.turn) for r in turns for i in r.message_ids}
    assert got == want and sum(len(r.message_ids) for r in turns) == len(want)
    assert all(r.text == "\n".join(f"t{i}" for i in r.message_ids) for r in turns)


def test_a_hot_key_is_spread(events):
    at = ordered.cuts(events, "id", rows=60)
    assert 5 <= len(at) <= 10 and ordered.cuts(events, "id") == []
    s = sessions.sessionize(events, "user", "id", "ts", 120, at)
    assert {r.id: r.session for r in s.collect()} == {i: x for i, (x, _) in brute().items()}
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user" in plan and "_range" in plan.split("hashpartitioning(user", 1)[1].split(")")[0]
    assert events.where("user = 'hot'").select(ordered._range("id", at).alias("r")).distinct().count() == len(at) + 1


def test_empty(spark, events):
    assert sessions.sessionize(events.limit(0), "user", "id", "ts", 120, [5.0]).count() == 0 and ordered.cuts(events.limit(0), "id") == []
