"""Percentiles by refined histograms against sorted values."""

from __future__ import annotations

import math
import random

import pytest

from tidemark.operators import profile as P

SHARES = {"p0": 0.0, "p1": 0.01, "p33": 1 / 3, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def plain(values, share):
    known = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0))
    t = share * (len(known) - 1)
    low, high = known[math.floor(t)], known[math.ceil(t)]
    return low if low == high else low + (high - low) * (t - math.floor(t))


def columns(rng, n):
    pick = rng.random
    return {
        "even": [pick() for _ in range(n)],
        "steep": [math.exp(rng.gauss(0, 8)) * rng.choice([-1, 1]) for _ in range(n)],
        "few": [float(rng.randrange(4)) for _ in range(n)],
        "mass": [5.0 if pick() < 0.9 else 5.0 + pick() * 1e-9 for _ in range(n)],
        "gaps": [None if pick() < 0.3 else pick() for _ in range(n)],
        "odd": [rng.choice([math.inf, -math.inf, math.nan, 1.5, -2.0, 1e308, -1e308, None]) for _ in range(n)],
        "none": [None] * n,
        "one": [3.25] + [None] * (n - 1),
    }


@pytest.mark.parametrize("buckets, few", [(1024, 2000), (4, 3), (2, 1)])
def test_percentiles(spark, monkeypatch, buckets, few):
    monkeypatch.setattr(P, "BUCKETS", buckets)
    monkeypatch.setattr(P, "FEW", few)
    data = columns(random.Random(9), 300)
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in data)).repartition(3)
    got = {r["column"]: r for r in P.percentiles(df, list(data), SHARES).collect()}
    assert set(got) == set(data) - {"none"}
    for c, r in got.items():
        for n, s in SHARES.items():
            want = plain(data[c], s)
            assert r[n] == want or math.isnan(r[n]) and math.isnan(want), (c, n, r[n], want)


def test_three_passes_do(spark, monkeypatch):
    """Ends, one histogram, and the values of the buckets that hold a rank."""
    passes, real = [], P._in_ranges
    monkeypatch.setattr(P, "_in_ranges", lambda *a: passes.append(1) or real(*a))
    df = spark.range(200_000).selectExpr("cast(pmod(xxhash64(id), 1000003) as double) as v", "cast(id % 50 as double) as w")
    got = {r["column"]: r["p50"] for r in P.percentiles(df, ["v", "w"], {"p50": 0.5}).collect()}
    assert len(passes) == 2 and got["w"] == 24.5
    assert got["v"] == df.selectExpr("percentile(v, 0.5) as p").head().p


def test_other_types_and_no_rows(spark):
    df = spark.sql("select * from values (1, cast(2.5 as decimal(5,1))), (3, null), (null, cast(0.5 as decimal(5,1))) as t(a, b)")
    assert sorted(map(tuple, P.percentiles(df, ["a", "b"], {"h": 0.5}).collect())) == [("a", 2.0), ("b", 1.5)]
    assert P.percentiles(df.where("false"), ["a", "b"], {"h": 0.5}).collect() == []
    assert P.percentiles(df, [], {"h": 0.5}).collect() == []
