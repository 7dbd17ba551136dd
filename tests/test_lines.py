"""Line numbers of files that are read in many splits."""

import pytest

from convlake.operators import ordered
from convlake.sources import chat_export, files
from convlake.sources.lines import numbered_lines


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_numbers_are_exact(spark, tmp_path, small_splits):
    one = "".join(f"line {i} {'x' * (i % 90)}\r\n" if i % 5 else "\n" for i in range(1, 1500))
    (tmp_path / "a.txt").write_text(one + "the end")
    (tmp_path / "b.txt").write_bytes(b"only \xff bad\n")
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.txt").write_text("y" * 9000 + "\nz\n\n")
    df = numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
    got = {}
    for r in df.collect():
        got.setdefault(r.path[-5:], {})[r.line_no] = r.line
    want = [x.removesuffix("\r") for x in (one + "the end").split("\n")]
    assert [got["a.txt"][i + 1] for i in range(len(want))] == want and len(got["a.txt"]) == len(want)
    assert got["b.txt"] == {1: "only � bad"} and got["d.txt"] == {1: "y" * 9000, 2: "z", 3: ""} and "c.txt" not in got


def test_a_large_export(spark, tmp_path, small_splits):
    head = "before one\n\nbefore two\n"
    text = head + "".join(f"{'[' * (i % 2)}0{1 + i % 9}/02/2025, 10:{i % 60:02d}{'] ' if i % 2 else ' - '}P{i % 3}: text {i}\n" + "more\n\nlast\n" * (i % 4) for i in range(700))
    (tmp_path / "a.txt").write_text(text)
    lines = chat_export.lines(spark, str(tmp_path))
    for at in (None, ordered.cuts(lines, "line_no", rows=1200)):
        messages, orphans = chat_export.parse(lines, "P1", at)
        got = sorted((r.line_number, r.speaker, r.text) for r in messages.collect())
        assert [(s, t) for _, s, t in got] == [(f"P{i % 3}", f"text {i}" + "\nmore\n\nlast" * (i % 4)) for i in range(700)]
        assert sorted((o.line_no, o.content) for o in orphans.collect()) == [(1, "before one"), (3, "before two")]
    assert len(at) >= 1


def test_bad_lines_and_documents(spark, tmp_path, small_splits):
    (tmp_path / "x.jsonl").write_text("".join('{"text": "%d"}\n' % i if i % 7 else "{bad %d\n" % i for i in range(1, 900)))
    good, bad = files.line_errors(spark, str(tmp_path / "x.jsonl"), "text string")
    assert good.count() == 899 - 128 and sorted(r.line_no for r in bad.collect()) == list(range(7, 900, 7))
    df = spark.createDataFrame([(1, "é\n"), (2, None)], "a int, b string")
    files.write_json(df, str(tmp_path / "doc"))
    assert sorted(tuple(r) for r in files.read_json(spark, str(tmp_path / "doc"), df.schema).collect()) == [(1, "é\n"), (2, None)]
