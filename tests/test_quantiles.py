"""Order statistics by binning against sorted values, and plans without a sort of a group."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlake.operators import profile, quantiles


def rows():
    r = random.Random(9)
    out = [("hot", float(r.choice([1, 2, 2, 3, 1000, -5]))) for _ in range(400)] + [("wide", r.gauss(0, 1) * 10 ** r.randint(-9, 12)) for _ in range(200)]
    out += [(None, float(i)) for i in range(37)] + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("flat", 3.0), ("flat", 3.0), ("gone", None), ("hot", None)]
    return out + [("huge", 1.5e308), ("huge", -1.5e308), ("huge", 0.0), ("one", float("nan")), ("one", float("inf"))]


def groups():
    out = {}
    for k, v in rows():
        if v is not None and math.isfinite(v):
            out.setdefault(k, []).append(v)
    return out


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_percentiles(spark, bins):
    df = spark.createDataFrame(rows(), "k string, v double").repartition(3)
    shares = {"p0": 0.0, "p25": 0.25, "median": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: [r[c] for c in shares] for r in quantiles.percentiles(df, ["k"], "v", shares, bins).collect()}
    want = groups()
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(got[k], np.quantile(np.array(v, dtype=np.longdouble), list(shares.values())).astype(float), rtol=1e-9, atol=0), k


def test_lower_median_and_no_group_sort(spark):
    df = spark.createDataFrame(rows(), "k string, v double")
    got = {r.k: r.lower_median for r in profile.lower_median(df, "v", ["k"]).collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in groups().items()}
    out = profile.percentiles(df.where("k IS NULL OR k <> 'one'"), "v", ["k"])
    row = {r.k: r for r in out.collect()}
    assert (row["gone"].median, row["gone"].max, row["two"].median, row["two"].p90) == (0.0, 0.0, 1.5, 1.9)
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_no_keys_and_no_rows(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert [tuple(r) for r in quantiles.percentiles(df, [], "v", {"m": 0.5, "q": 0.075}).collect()] == [(50.0, 7.5)]
    assert quantiles.percentiles(df.limit(0), [], "v", {"m": 0.5}).collect() == []
