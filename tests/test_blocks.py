"""Comparisons in blocks: the results of the plain forms, no row for each pair before the end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import convlake.catalog  # noqa: F401
from convlake.operators import memory as M
from convlake.operators import neighbours as N
from convlake.registry import QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", ["m11_search_topk", "m12_rank", "m14_retrieval_job", "m16_selection", "e09_contamination"])
def test_pairs_meet_in_blocks(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "zip_with" not in plan


def test_retrieval_in_blocks_is_the_same(spark, monkeypatch):
    vec = lambda i: None if i % 5 == 0 else [] if i % 7 == 0 else [float(i % 3), 1.0, float(i % 4)]
    words = ["red tea", "red tea cup", "green", "", None, "blue sky over a red cup"]
    q = spark.createDataFrame([(i, i % 2 if i else None, vec(i), words[i % 6], ["Food", None, "sky", ""][i % 4]) for i in range(12)], "q_id long, p long, q_embedding array<float>, q_text string, q_topic string")
    rows = [(i, i % 2 if i else None, vec(i + 2), words[(i * 5) % 6], ["food", None, "sky", ""][i % 4], ["high", "low", None][i % 3], [None, 3.0, 900.0, -1.0][i % 4], "old" if i == 9 else "active") for i in range(40)]
    m = spark.createDataFrame(rows, "m_id long, p long, m_embedding array<float>, m_text string, m_topic string, m_importance string, m_age_days double, status string")
    whole = N.blocked
    monkeypatch.setattr(N, "blocked", lambda q, m, key, work, kind, *_: whole(q, m, key, work, kind, 2, 3))
    cols = ["q_id", "m_id", "rank", "score", "m_topic", "q_text", F.round("semantic", 9)]
    for own in (False, True):
        a, b = (sorted(map(str, M.retrieve(q, m, "p", 4, own, {"food": ["tea"]}, blocks=x).select(*cols).collect())) for x in (False, True))
        assert a == b and len(a) == 44


def test_half_up_is_sql_round(spark):
    xs = [0.00625, 0.45005, 0.39995, 0.12344999, 0.5, 0.00005, 0.1 + 0.2, 0.99995, 1 / 3]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(F.round("x", 4)).collect()]
    assert N.half_up(np.array([xs]), 4)[0].tolist() == got


def test_all_near_pairs_are_found_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6))
    v[40:] = v[:20] + rng.normal(size=(20, 6)) * 0.2
    rows = [(i, [None, 1, 2][i % 3] if i < 40 else [None, 1, 2][(i - 40) % 3], x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, g int, vec array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if rows[i][1] == rows[j][1] and unit[i] @ unit[j] >= 0.8}
    for size in (4096, 4):
        assert [tuple(r) for r in N._all_pairs(df, ["g"], 0.8, size).select("a", "b").orderBy("a", "b").collect()] == sorted(want)
    plan = N.near_pairs(df, ["g"], "id", "vec", 0.8, miss=1e-6)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(want) > 15 and "bucket" not in plan, "no candidates travel where all pairs cost less"


def test_a_split_is_hashed_by_many_tasks(spark, monkeypatch, tmp_path):
    from convlake import queries_sources as Q
    from convlake.streaming import streams as X

    seen, hashes = [], Q.files.file_hashes
    monkeypatch.setattr(X, "shared_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(Q, "_examples", lambda spark, d: spark.range(90).selectExpr("id AS conversation_id", "'x' AS text", "'en' AS split").repartition(3))
    monkeypatch.setattr(Q.files, "file_hashes", lambda spark, path: seen.append(hashes(spark, path).count()) or hashes(spark, path))
    assert QUERIES["s10_file_hashes"](spark, SF).first().n == 1 and seen == [3]
