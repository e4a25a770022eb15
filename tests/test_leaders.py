"""Greedy leaders against the row-by-row rule."""

import math

import numpy as np
import pandas as pd
import pytest

from helixframe.operators import msa as M
from helixframe.operators import structures as ST

rng = np.random.default_rng(9)


def greedy(mats):
    out = set()
    for family, rows in mats.items():
        leaders = []
        for i, row in sorted(rows):
            near = False
            for other in leaders:
                seen = [(a, b) for a, b in zip(row, other) if a != M.GAP and b != M.GAP]
                near |= len(seen) >= 10 and sum(a == b for a, b in seen) / len(seen) >= 1 / math.e
            if not near:
                leaders.append(row)
                out.add((family, i))
    return out


@pytest.fixture(scope="module")
def mats():
    out = {}
    for family, n in (("hot", 160), ("b", 30), ("one", 1), ("gaps", 20)):
        seeds = rng.integers(0, 20, (12, 30))
        rows = []
        for i in range(n):
            row = seeds[rng.integers(0, 12)].copy()
            row[rng.random(30) < rng.choice([.2, .6])] = rng.integers(0, 20)
            row[rng.random(30) < (.75 if family == "gaps" else .1)] = M.GAP
            rows.append((int(i * 7 % n), row.tolist()))
        out[family] = rows
    return out


@pytest.mark.parametrize("block", [1, 7, 64, 2048])
def test_identity_leaders(spark, mats, block):
    few = mats if block > 1 else {k: v[:12] for k, v in mats.items()}
    df = spark.createDataFrame([(f, i, c) for f, rows in few.items() for i, c in rows], "family string, row_id bigint, codes array<int>").repartition(3)
    assert {tuple(r) for r in M.identity_leaders(df, block).collect()} == greedy(few)


def test_neff_clusters_counts_leaders(spark, mats):
    df = spark.createDataFrame([(f, i, c) for f, rows in mats.items() for i, c in rows], "family string, row_id bigint, codes array<int>")
    want = greedy(mats)
    for r in M.neff_clusters(df).collect():
        assert r.n_clusters == sum(f == r.family for f, _ in want) == r.neff_clusters and r.n_seqs == len(mats[r.family])
    for r in M.neff_clusters(df, 10).collect():
        assert r.n_sampled == min(10, len(mats[r.family])) and r.neff_clusters == r.n_clusters * r.n_seqs / r.n_sampled
    assert M.neff_clusters(df.limit(0)).collect() == []


def near_rows(m, row):
    both = (m != M.GAP) & (row != M.GAP)
    return (both.sum(1) >= 10) & (((m == row) & both).sum(1) >= both.sum(1) / math.e)


@pytest.mark.parametrize("width", [5, 30, 64, 65, 130])
def test_packed_rows_are_near_as_codes_are(width):
    own = np.random.default_rng(width)
    m = own.integers(0, 20, (8, width))[own.integers(0, 8, 600)]
    m = np.where(own.random(m.shape) < own.choice([.2, .6, .7], (600, 1)), own.integers(0, 20, m.shape), m)
    m = np.where(own.random(m.shape) < own.choice([0, .1, .75], (600, 1)), M.GAP, m)
    packed = M.packed_codes.func(pd.Series(list(m)))
    assert {len(b) for b in packed} == {40 * -(-width // 64)}
    rows = M.Packed.of(packed)
    near = M.nearness(rows, rows)
    for k in range(600):
        assert near(k).tolist() == np.flatnonzero(near_rows(m, m[k])).tolist()


def test_missing_codes_are_gaps():
    whole = list(range(12))
    rows = M.Packed.of(M.packed_codes.func(pd.Series([np.array(x, float) if x is not None else None for x in (
        whole, [*whole, *[M.GAP] * 60], [*whole[:9], None, None, None], None, [])])))
    near = M.nearness(rows, rows)
    assert [near(k).tolist() for k in range(5)] == [[0, 1], [0, 1], [], [], []]
    with pytest.raises(ValueError):
        M.packed_codes.func(pd.Series([np.array([21])]))


def test_large_families_take_few_rounds(spark, monkeypatch):
    """Rounds and stored tables follow the block, and a family of some thousand distinct rows is one block."""
    own = np.random.default_rng(4)
    m = own.integers(0, 20, (5000, 64))
    m[own.integers(0, 5000, 300)] = m[own.integers(0, 5000, 300)]
    free, want = np.ones(5000, bool), set()
    for i in range(5000):
        if free[i]:
            want.add(i)
            free[i:] &= ~near_rows(m[i:], m[i])
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate(m.tolist())], "family string, row_id bigint, codes array<int>").repartition(4)
    stored = []
    monkeypatch.setattr(M, "cut_lineage", lambda d, keep=M.cut_lineage: stored.append(1) or keep(d))
    assert {r.row_id for r in M.identity_leaders(df).collect()} == want
    assert len(stored) <= 5
    assert {r.row_id for r in M.identity_leaders(df, 2000).collect()} == want


def test_leader_clusters_follow_the_score_order(spark):
    scored, pairs, want = [], [], {}
    for target in range(6):
        n = 25
        at = rng.uniform(0, 12, n)
        score = [float(x) for x in rng.integers(0, 8, n)]
        scored += [(target, i, score[i]) for i in range(n)]
        pairs += [(target, i, j, float(abs(at[i] - at[j]))) for i in range(n) for j in range(i + 1, n)]
        leaders = []
        for i in sorted(range(n), key=lambda k: (-score[k], k)):
            own = next((m for m in leaders if abs(at[i] - at[m]) <= 1.5), None)
            if own is None:
                leaders.append(i)
            want[target, i] = i if own is None else own
    s = spark.createDataFrame([*scored, (99, 0, 1.0)], "target int, model bigint, score double")
    p = spark.createDataFrame(pairs, "target int, m1 bigint, m2 bigint, rmsd double")
    got = {(r.target, r.model): r.leader for r in ST.leader_cluster(s, p, 1.5).collect()}
    assert got == want | {(99, 0): 0}
    assert ST.leader_cluster(s.limit(0), p).collect() == []
