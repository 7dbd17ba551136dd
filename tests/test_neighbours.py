"""Near pairs and searches against all pairs."""

import random

import duckdb
import numpy as np
import pytest

import convlake.catalog  # noqa: F401
from convlake.operators import neighbours as N
from convlake.registry import QUERIES, SQL

R = np.random.default_rng(2)


def vectors(n=300, dim=16):
    rows = [(i, ["p", "q", None][i % 3], R.normal(size=dim).tolist()) for i in range(n)]
    for i in range(0, n, 3):  # near copies, closer and farther
        v = np.array(rows[i][2])
        for c, far in enumerate((0.02, 0.08, 0.2)):
            rows.append((1000 + 10 * i + c, rows[i][1], (v + far * R.normal(size=dim)).tolist()))
    rows += [(9000 + i, "p", rows[0][2]) for i in range(40)]  # exact copies
    return rows + [(9900, "p", None), (9901, "p", []), (9902, "p", [0.0] * dim), (9903, "p", [None] * dim), (9904, "p", [1.0, 2.0])]


def all_pairs(rows, threshold):
    reps = {}
    for i, k, v in rows:
        if v and None not in v and any(v):
            reps[k, tuple(v)] = min(i, reps.get((k, tuple(v)), i))
    flat = [(i, k, np.array(v) / np.linalg.norm(v)) for (k, v), i in reps.items()]
    return {(min(a, b), max(a, b)) for a, k, v in flat for b, o, w in flat if a < b and k == o and len(v) == len(w) and v @ w >= threshold}


@pytest.mark.parametrize("threshold, options", [(0.98, {}), (0.9, {"bits": 10, "probes": 3}), (0.98, {"crowd": 5, "bits": 8})])
def test_near_pairs(spark, threshold, options):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, persona string, v array<double>").repartition(4)
    pairs, classes = N.near_pairs(df, ["persona"], "vec_id", "v", threshold, **options)
    got, want = {(r.a, r.b) for r in pairs.collect()}, all_pairs(rows, threshold)
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 50
    assert {r.id for r in classes.where("rep = 0").collect()} == {0, *range(9000, 9040)}


def test_no_join_of_all_of_a_key(spark):
    df = spark.createDataFrame(vectors(60), "vec_id long, persona string, v array<double>")
    plan = N.near_pairs(df, ["persona"], "vec_id", "v")[0]._jdf.queryExecution().optimizedPlan().toString()
    assert all("bucket" in line for line in plan.splitlines() if "Join Inner" in line and "l_persona" in line) and "Cartesian" not in plan


def test_tables():
    assert N.tables_for(0.98, 8, 1e-3) < N.tables_for(0.9, 8, 1e-3) < N.tables_for(0.9, 12, 1e-3) and N.tables_for(1.0, 8, 1e-3) == 1


@pytest.mark.parametrize("own, blocks", [(True, (1024, 8192)), (True, (3, 7)), (False, (2, 5))])
def test_search(spark, own, blocks):
    r = random.Random(6)
    rows = []
    for i in range(200):
        v = [None, [], [0.0] * 4, [1.0, 2.0]][i % 40 // 10] if i % 10 == 0 else [r.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(4)]
        words = None if i % 11 == 0 else [r.choice("abcdefgh") for _ in range(r.randint(0, 6))]
        rows.append((i, "hot" if i % 3 else f"k{i % 4}", v, words))
    rows += [(500, None, [1.0] * 4, ["a"])]
    m = spark.createDataFrame(rows, "m_id long, key string, m_embedding array<double>, m_words array<string>").repartition(3)
    asked = [x for x in rows if x[0] % 5 == 0] + [(-1, "nobody", [1.0] * 4, ["a"])]
    q = spark.createDataFrame(asked, "q_id long, key string, q_embedding array<double>, q_words array<string>")
    want = []
    for a, k, v, s in asked:
        found = []
        for b, o, w, t in rows:
            if k == o and k is not None and not (own and a == b):
                x, y = np.array(v or [0.0]), np.array(w or [0.0])
                c = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) if len(x) == len(y) and x.any() and y.any() else 0.0
                both, any_of = set(s or ()) & set(t or ()), set(s or ()) | set(t or ())
                found.append((-round(0.7 * min(1, max(0, c)) + (0.3 * len(both) / max(1, len(any_of)) if s and t else 0), 9), b))
        want += [(a, b, -x, i + 1) for i, (x, b) in enumerate(sorted(found)[:4])]
    got = N.search(q, m, "key", 4, own, query_block=blocks[0], memory_block=blocks[1]).collect()
    assert sorted((g.q_id, g.m_id, g["rank"]) for g in got) == sorted((a, b, i) for a, b, _, i in want)
    assert all(abs(x - y) < 1e-8 for (*_, x, _), (*_, y, _) in zip(sorted((g.q_id, g["rank"], g.score, 0) for g in got), sorted((a, i, x, 0) for a, b, x, i in want)))


def test_empty(spark):
    pairs, classes = N.near_pairs(spark.createDataFrame([], "vec_id long, persona string, v array<double>"), ["persona"], "vec_id", "v")
    assert pairs.count() == 0 and classes.count() == 0


@pytest.mark.parametrize("name", ["j06_near_duplicates", "j06_near_copies"])
def test_queries_give_every_pair(spark, tmp_path, name):
    """Exact copies are pairs in SQL, as are those without a cosine (NaN is over 0.9); null labels and ids are in none."""
    rows = [(i, R.normal(size=8).tolist(), i % 2) for i in range(40)]
    rows += [(100 + i, rows[i % 3][1], i % 3 % 2) for i in range(9)] + [(200 + i, (np.array(rows[i][1]) + 0.05).tolist(), i % 2) for i in range(20)]
    rows += [(300, rows[0][1], None), (301, rows[0][1], None), (None, rows[0][1], 0), (302, None, 0), (303, [0.0] * 8, 0), (304, [0.0] * 8, 1), (305, [float("nan")] * 8, 1)]
    rows += [(101, rows[4][1], 0), (101, rows[1][1], 1), (306, [-0.0, *rows[1][1][1:]], 1), (307, [0.0, *rows[1][1][1:]], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(map(str, duck.execute(SQL[name]).fetchall()))
    got = sorted(str(tuple(r)) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert got == want and len(want) > 150


def test_no_pair_is_left_to_chance(spark):
    """However many vectors a group has, all pairs are compared where no buckets are asked for."""
    df = spark.range(13_000).selectExpr("id", "1 AS g", "array(rand(1), rand(2)) AS vec").localCheckpoint()
    assert "bucket" not in N.near_pairs(df, ["g"], "id", "vec", 0.98, miss=0.9)[0]._jdf.queryExecution().optimizedPlan().toString()
