"""Readers and the chat-export parser on small fixture files."""

import json

import pytest
from pyspark.sql import functions as F

from convlake.schemas import CONVERSATION_INPUT, TRAINING_EXAMPLE
from convlake.sources import chat_export, files

CHAT = (
    "stray line\n"
    "12/31/24, 9:05 PM - Ana: hello\nsecond line\n\n"
    "31/12/2024, 21:10 - Bo: https://x.example/a\n"
    "[01/02/2025, 10:00:05] Ana: <Media omitted>\r\n"
    "2/3/75, 9:00 AM - Messages are end-to-end encrypted.\n"
    "14.02.2025, 10:00 – Bo: odd date\n"
)


@pytest.fixture()
def chat(spark, tmp_path):
    (tmp_path / "a.txt").write_text(CHAT, encoding="utf-8")
    m, o = chat_export.parse(chat_export.lines(spark, str(tmp_path)), "Ana")
    return {r.line_number: r for r in m.collect()}, o.collect()


def test_messages(chat):
    m, orphans = chat
    assert [o.content for o in orphans] == ["stray line"]
    assert m[2].text == "hello\nsecond line\n" and m[2].speaker == "Ana" and m[2].is_persona
    assert str(m[2].timestamp) == "2024-12-31 21:05:00"
    assert m[5].message_type == "url" and str(m[5].timestamp) == "2024-12-31 21:10:00"
    assert m[6].message_type == "media" and str(m[6].timestamp) == "2025-02-01 10:00:05"
    assert m[7].speaker == "SYSTEM" and m[7].message_type == "system" and m[7].timestamp.year == 1975
    assert m[8].timestamp is None and m[8].raw_timestamp.startswith("14.02.2025")


def test_message_types(spark, tmp_path):
    bodies = [
        ("Bo: image omitted", "media"), ("Bo: I saw image omitted", "text"), ("Bo: Location: https://maps.google.com/?q=1", "media"), ("Bo: THIS message was deleted", "deleted"),
        ("Bo: he said This message was deleted", "text"), ("Bo: your security code changed today", "system"), ("Bo: Waiting for this message", "system"),
        ("Bo: I am Waiting for this message", "text"), ("Bo: www.x.example", "text"), ("Bo: http://x.example/a b", "text"), ("Bo:  ", "empty"),
    ]
    lines = [f"01/02/2025, 10:{i:02d} - {b}" for i, (b, _) in enumerate(bodies)]
    lines += ["01/02/2025, 11:00 - Ana created group", "more: of the notice"]
    (tmp_path / "b.txt").write_text("\n".join(lines), encoding="utf-8")
    m, _ = chat_export.parse(chat_export.lines(spark, str(tmp_path)))
    got = {r.line_number: r for r in m.collect()}
    assert [(b, got[i + 1].message_type) for i, (b, want) in enumerate(bodies) if got[i + 1].message_type != want] == []
    last = got[len(bodies) + 1]
    assert last.speaker == "SYSTEM" and last.message_type == "system" and last.text == "Ana created group\nmore: of the notice"


def test_turns_of_exports(spark, tmp_path):
    from convlake.plans.build_corpus import build, from_exports

    text = "".join(f"01/02/2025, 10:{i:02d} - {'Ana' if i % 2 else 'Bo'}: text {i}\n" for i in range(12))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(text)
    turns = from_exports(spark, str(tmp_path / "in"), "Ana")
    assert [r.role for r in turns.orderBy("turn").collect()] == ["user", "assistant"] * 6
    build(turns, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("depth").count().count() == 4


def test_jsonl(spark, tmp_path):
    rows = [{"conversation_id": "a", "text": "é"}, {"conversation_id": "b", "text": None}]
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    df = files.read_jsonl(spark, str(p), TRAINING_EXAMPLE)
    assert df.count() == 2
    files.write_jsonl(df, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), TRAINING_EXAMPLE).count() == 2
    p.write_text('{"conversation_id": "a"}\nnot json\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), TRAINING_EXAMPLE).collect()
    good, bad = files.line_errors(spark, str(p), TRAINING_EXAMPLE)
    assert good.count() == 1 and [(r.line_no, r.line) for r in bad.collect()] == [(2, "not json")]
    good, bad = files.read_any(spark, str(p), TRAINING_EXAMPLE)
    assert good.count() == 1 and bad.count() == 1
    assert files.file_hashes(spark, str(p)).first().bytes == p.stat().st_size


def test_three_input_forms(spark, tmp_path):
    docs = [
        {"conversation_id": "a", "context": [{"speaker": "x", "text": "q"}], "response": "r", "persona_speaker": "p"},
        {"example_id": "b", "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "v"}], "target": "t"},
        {"messages": [{"speaker": "s", "text": "w"}]},
    ]
    p = tmp_path / "d.json"
    p.write_text(json.dumps(docs))
    out = {r.conversation_id: [tuple(m) for m in r.messages] for r in files.standard(files.read_json(spark, str(p), CONVERSATION_INPUT)).collect()}
    assert out == {"a": [("x", "q"), ("p", "r")], "b": [("user", "u"), ("persona", "v"), ("persona", "t")], "conv-unknown": [("s", "w")]}


def test_text_functions(spark):
    from convlake.functions import text as T

    df = spark.createDataFrame([("  Ａb \n",), ("👍🏽 ok 👨‍👩‍👧",), (None,)], "t string")
    got = df.select(T.clean(F.col("t")).alias("c"), T.emoji_count(F.col("t")).alias("e")).collect()
    assert got[0].c == "Ab" and got[1].e == 2 and got[2].c == ""
