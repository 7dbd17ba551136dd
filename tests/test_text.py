"""Patterns mean the same to both engines."""

import duckdb

from convlake.functions import text as T
from convlake.operators import memory as M
from convlake.operators import profile as P
from convlake.queries_evaluate import FACTS

SAID = [
    "il est dans leséau", "dans les eaux", "in théa", "in the", "éi live", "i liveé", "J'ÉTUDIE", "j'étudie", "ICH HEIẞE Ada", "ich heiße", "ı live", "I LIVE", "İ live", "iKollect",
    "Kok", "oK", "ok ", "ok\x0b", "ok \n", "ok ", "hello!", "ich bin es immer", "ich bin\res immer", "ich bin\nes immer", "that iſ", "that isé", "mein hund", "la sœur", "ma SŒUR", "",
]


def test_patterns_agree_with_sql(spark):
    patterns = [*(r[1] for r in FACTS), M.EPHEMERAL, r"as an ai|\bthat is\b", r"[\s.]x", r"a[]\s]b", "(?i)x[^]i]y"]
    said = [*SAID, "\x0bx", "\tx", "a]b", "a b", "xay", "XIY", "x]y"]
    duck = duckdb.connect()
    want = {(t, p) for p in patterns for t in said if duck.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0]}
    df = spark.createDataFrame([(t,) for t in said], "t string")
    rows = df.select("t", *[df["t"].rlike(T.portable(p)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    got = {(r[0], p) for r in rows for i, p in enumerate(patterns) if r[i + 1]}
    assert got == want


def test_prompts_are_capitalised_letter_by_letter(spark):
    said = ["ßen HAUS", "der ßand", "İstanbul şehir", "ΟΔΟΣ ΣΑΣ", "ǆep ŉab", "ﬁn ᾳb", "élan Émile", "a"]
    df = spark.createDataFrame([(p, r) for p in said for r in "xy"], "p string, r string")
    got = {r.prompt for r in P.ambiguous_prompts(df, "p", "r", ["der"]).collect()}
    sql = "SELECT array_to_string(list_transform(string_split(lower(?), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    assert got == {duckdb.execute(sql, [p]).fetchone()[0] for p in said}
    assert "\u1e9een Haus" in got
