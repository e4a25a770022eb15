"""Exact quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators.ranking import quantiles, rank_within, value_ranks, with_quantiles

rng = np.random.default_rng(6)


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_quantiles(spark, accuracy):
    groups = {0: rng.normal(0, 1, 20_000), 1: rng.integers(0, 3, 5000).astype(float), 2: np.array([7.0]), 3: np.array([1.0, 2.0]), 4: np.full(3000, 4.0),
              5: np.exp(rng.normal(0, 40, 3000)), 6: np.append(rng.random(50), 1e300), None: rng.random(37), 8: np.arange(11.0)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [(0, None), (9, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    shares = [0.0, 0.001, 0.25, 0.3, 0.5, 0.9, 0.999, 1.0]
    wanted = {f"q{i}": ("v", p) for i, p in enumerate(shares)}
    got = {r["k"]: r for r in with_quantiles(df, ["k"], wanted, F.count("*").alias("n")).collect()}
    for k, x in groups.items():
        assert np.allclose([got[k][f"q{i}"] for i in range(len(shares))], np.quantile(x, shares), rtol=1e-12), k
    assert got[9]["n"] == 1 and got[9]["q0"] is None and got[0]["n"] == 20_001
    every = np.concatenate(list(groups.values()))
    one = quantiles(df, [], wanted | {"less": (-F.col("v"), 0.1)}, accuracy).first()
    assert np.allclose([one[f"q{i}"] for i in range(len(shares))], np.quantile(every, shares), rtol=1e-12)
    assert np.isclose(one["less"], np.quantile(-every, 0.1), rtol=1e-12)
    assert quantiles(df.limit(0), ["k"], wanted).collect() == []


@pytest.mark.parametrize("bucket,sample", [(64, 1), (50, 4), (1 << 16, 64)])
def test_ranks_over_buckets(spark, bucket, sample):
    vals = [("hot", i, float(x)) for i, x in enumerate(np.round(rng.gamma(1, 5, 3000), 1))] + [("small", i, float(i % 7)) for i in range(40)] + [("one", 0, 1.0)]
    df = spark.createDataFrame(vals, "g string, i int, s double").repartition(5)
    got = {(r.g, r.i): r["rank"] for r in rank_within(df, ["g"], "s", ["i"], bucket=bucket, sample=sample).collect()}
    want = {}
    for g in ("hot", "small", "one"):
        want |= {(g, i): k + 1 for k, (_, i) in enumerate(sorted((-s, i) for h, i, s in vals if h == g))}
    assert got == want
    for r in value_ranks(df, ["g"], "s", bucket, sample).collect():
        mine = [s for g, _, s in vals if g == r.g]
        assert (r.below, r.same, r.total) == (sum(s < r.s for s in mine), mine.count(r.s), len(mine))
