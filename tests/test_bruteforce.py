"""Operators without SQL against brute force on small fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe import constants as C
from helixframe.operators import evaluate as EV
from helixframe.operators import ranking as RK
from helixframe.operators import spatial as SP
from helixframe.operators import structures as ST
from helixframe.operators import templates as TP
from helixframe.operators import tracks as T

rng = np.random.default_rng(3)


def test_assign_is_optimal():
    for n, m in [(1, 1), (3, 3), (2, 4), (5, 3), (4, 4)]:
        cost = rng.random((n, m))
        best = min(sum(cost[i, j] for i, j in (zip(range(n), p) if n <= m else zip(p, range(m))))
                   for p in itertools.permutations(range(max(n, m)), min(n, m)))
        row, col = np.indices((n, m)).reshape(2, -1)
        pairs = [(row[k], col[k]) for k in T.assign(row, col, cost.ravel(), 10.0)]
        assert len(pairs) == min(n, m) and abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-12


def slow_align(a, b):
    n, m = len(a), len(b)
    d = [[-(i + j) if i == 0 or j == 0 else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = max(d[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), d[i - 1][j] - 1, d[i][j - 1] - 1)
    return d[n][m]


def test_alignment_score_is_optimal():
    for _ in range(30):
        a = "".join(rng.choice(list("ACDE"), rng.integers(1, 15)))
        b = "".join(rng.choice(list("ACDE"), rng.integers(1, 15)))
        p = TP._align(a, b)
        score = sum(1 if a[i] == b[j] else -1 for i, j in p) - (len(a) - len(p)) - (len(b) - len(p))
        assert score == slow_align(a, b)
        assert p == sorted(set(p))


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(0, 9)] + [(20, 25), (25, 30)], "u bigint, v bigint")
    got = {r.node: r.comp for r in T.components(e).collect()}
    assert got == {**{k: 0 for k in range(10)}, 20: 20, 25: 20, 30: 20}


def cells(n, frames=1):
    return [(0, k, k % frames, float(z), float(y), float(x), 1, float(rng.random() + 1)) for k, (z, y, x) in enumerate(
        zip(rng.integers(0, 6, n), rng.integers(0, 60, n), rng.integers(0, 60, n)))]


def test_greedy_match_in_order(spark):
    g, d = cells(25), cells(25)
    scale = np.array(C.SCALE_ZYX)
    gt = spark.createDataFrame([(r[0], r[1], r[2], *r[3:6]) for r in g], "dataset bigint, id bigint, t bigint, z double, y double, x double")
    det = spark.createDataFrame(d, "dataset bigint, det_id bigint, t bigint, z double, y double, x double, tier int, intensity double")
    used, want = set(), {}
    for r in g:
        dist = sorted((float(np.linalg.norm((np.array(r[3:6]) - np.array(q[3:6])) * scale)), q[1]) for q in d)
        free = [(x, k) for x, k in dist if k not in used and x <= C.MATCH_UM]
        if free:
            used.add(free[0][1])
            want[r[1]] = free[0][1]
    assert {r.gt: r.det_id for r in T.greedy_match(gt, det).collect()} == want


def test_links_are_one_to_one_and_gated(spark):
    det = spark.createDataFrame(cells(60, 3), "dataset bigint, det_id bigint, t bigint, z double, y double, x double, tier int, intensity double")
    links = T.link_frames(det).collect()
    assert links and len({r.src for r in links}) == len(links) == len({r.dst for r in links})
    assert all(r.d <= C.STEP_UM for r in links)


def test_contact_join_equals_all_pairs(spark):
    a, b = rng.random((40, 3)) * 20, rng.random((50, 3)) * 20
    left = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(a)], "s int, i int, lx double, ly double, lz double")
    right = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(b)], "s int, j int, rx double, ry double, rz double")
    got = {(r.i, r.j) for r in SP.contact_join(left, right, 4.0, ["s"]).collect()}
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    assert got == {(int(i), int(j)) for i, j in np.argwhere(d <= 4.0)}


def test_contact_join_copies_few_and_broadcasts_none(spark):
    """The side copied to its cells is larger than it is estimated, so it must not go through the driver."""
    a, b = (rng.integers(-60, 60, (200, 3)) * 0.5 for _ in range(2))
    left = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(a)], "s int, i int, lx double, ly double, lz double")
    right = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(b)], "s int, j int, rx double, ry double, rz double")
    for strict in (False, True):
        j = SP.contact_join(left, right, 5.0, ["s"], strict)
        got = sorted((r.i, r.j) for r in j.collect())
        d = np.linalg.norm(a[:, None] - b[None], axis=2)
        assert got == [(int(x), int(y)) for x, y in np.argwhere(d < 5.0 if strict else d <= 5.0)]
        assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()
    assert SP.with_cell(right, "r", 5.0, spread=True).count() < 200 * 27 / 3


def test_springs_shuffle_pairs_once(spark):
    """Places come along with the contacts, so nothing is joined to the pairs."""
    touch = {(str(k), int(p), int(i)) for k, p, i in zip(rng.choice(["a", "b"], 300), rng.integers(0, 20, 300), rng.integers(0, 40, 300))}
    at = rng.random((38, 3)) * 30
    c = spark.createDataFrame([(k, 0, p, i) for k, p, i in touch] * 2, "source string, s int, partner int, i int")
    ca = spark.createDataFrame([(0, k, *map(float, v)) for k, v in enumerate(at)], "s int, idx int, x double, y double, z double")
    sep = {"a": 1, "b": 4}
    got = SP.shared_contact_springs(c, ca, ["s"], F.when(F.col("source") == "a", 1).otherwise(4), ["source"])
    want = {}
    for k, p, i in touch:
        for l, q, j in touch:
            if k == l and p == q and j - i >= sep[k] and j < 38:
                want[k, i, j] = min(p, want.get((k, i, j), p))
    rows = got.collect()
    assert {(r.source, r.i, r.j): r.partner for r in rows} == want and len(rows) == len(want)
    assert all(abs(r.d0 - np.linalg.norm(at[r.i] - at[r.j])) < 1e-9 for r in rows)
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1


def test_superpose_recovers_a_rotation(spark):
    p = rng.random((12, 3)) * 10
    th = 0.7
    r = np.array([[np.cos(th), -np.sin(th), 0], [np.sin(th), np.cos(th), 0], [0, 0, 1]])
    q = p @ r.T + np.array([3.0, -2, 5])
    frame = lambda m, x: [(1, m, k, *map(float, v)) for k, v in enumerate(x)]
    pts = spark.createDataFrame(frame(1, p), "target int, model int, idx int, x double, y double, z double")
    ref = spark.createDataFrame(frame(0, q), "target int, model int, idx int, x double, y double, z double").drop("model")
    dev = ST.per_residue_deviation(pts, ref, ["target"], ["model"]).agg(F.max("deviation")).first()[0]
    assert dev < 1e-9


@pytest.fixture
def scores(spark):
    vals = [(k % 2, k, float(v)) for k, v in enumerate(rng.integers(0, 40, 500))]
    return vals, spark.createDataFrame(vals, "g int, id int, s double")


def test_rank_within_and_top_n(scores):
    vals, df = scores
    want = {}
    for g in (0, 1):
        for k, r in enumerate(sorted((r for r in vals if r[0] == g), key=lambda r: (-r[2], r[1]))):
            want[r[1]] = k + 1
    assert {r.id: r["rank"] for r in RK.rank_within(df, ["g"], "s", ["id"]).collect()} == want
    top = RK.top_n(df, ["g"], "s", 17, ["id"], step=3.0).collect()
    assert {r.id: r["rank"] for r in top} == {k: v for k, v in want.items() if v <= 17}


def test_value_ranks(scores):
    vals, df = scores
    for r in RK.value_ranks(df, ["g"], "s").collect():
        mine = [v for g, _, v in vals if g == r.g]
        assert (r.below, r.same, r.total) == (sum(v < r.s for v in mine), sum(v == r.s for v in mine), len(mine))


def test_leader_clusters(spark):
    scored = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (1, 4, 0.6)], "target int, model bigint, score double")
    near = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 4, 1.0), (1, 1, 3, 9.0), (1, 1, 4, 9.0), (1, 2, 4, 9.0)],
                                 "target int, m1 bigint, m2 bigint, rmsd double")
    got = {r.model: r.leader for r in ST.leader_cluster(scored, near).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_peak_detect_finds_blobs(spark):
    vol = np.zeros((8, 40, 40))
    for z, y, x in [(4, 10, 10), (3, 30, 28)]:
        g = np.indices(vol.shape).astype(float)
        vol += 100 * np.exp(-(((g[0] - z) / 1) ** 2 + ((g[1] - y) / 3) ** 2 + ((g[2] - x) / 3) ** 2) / 2)
    rows = [(0, 0, int(z), int(y), int(x), float(vol[z, y, x])) for z, y, x in np.ndindex(vol.shape)]
    v = spark.createDataFrame(rows, "dataset bigint, t bigint, z bigint, y bigint, x bigint, v double")
    first = sorted((round(r.z), round(r.y), round(r.x)) for r in T.peak_detect(v).filter("tier = 1").collect())
    assert first == [(3, 30, 28), (4, 10, 10)]


def test_first_models_do_not_make_lines_travel(spark):
    """Where few files hold several models, their ends are sent to the lines."""
    from helixframe.sources import pdb as PDB

    atom = "ATOM  %5d CA   ALA A%4d    %8.3f%8.3f%8.3f"
    rows = [(f"p{f}", k, "ENDMDL" if f == 3 and k in (4, 8) else atom % (k, k, k, k, f)) for f in range(6) for k in range(12)]
    lines = spark.createDataFrame(rows, "pdb_id string, line_no int, value string")
    got = PDB.atoms(lines)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.pdb_id, r.line_no) for r in got.collect()) == sorted((p, k) for p, k, _ in rows if p != "p3" or k < 4)


def test_permutation_trials_are_counted_in_estimates(spark):
    """Rows times trials must look as large as they are, or they are broadcast through the driver."""
    from helixframe.operators import evaluate as EV

    v = spark.createDataFrame([(k, float(k * 37 % 101), k % 3, k % 2 == 0) for k in range(40)], "id bigint, value double, kind int, picked boolean")
    got = EV.permutation_enrichment(v, 50)
    assert "explode(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()
    r = got.first()
    pct = {k: sum(j * 37 % 101 < k * 37 % 101 for j in range(40)) / 40 for k in range(40)}
    obs = np.mean([pct[k] for k in range(0, 40, 2)])
    score = lambda k, t: ((k * 7919 + t * 104729 + k * t % 6007) % 100003, k)
    free = [np.mean([pct[k] for k in sorted(range(40), key=lambda k: score(k, t))[:20]]) for t in range(50)]
    assert r.n_set == 20 and abs(r.observed - obs) < 1e-9
    assert abs(r.p_value - np.mean([round(m, 12) >= round(obs, 12) for m in free])) < 1e-9


def test_membership_stays_in_the_row(spark):
    from helixframe.functions.bases import letters_of
    from helixframe.operators import regions as RG

    seqs = spark.createDataFrame([(k, "".join(rng.choice(list(C.AA20), n))) for k, n in enumerate([0, 1, 3, 4, 70, 400])] + [(9, "A" * 6), (10, None)], "seq_id int, seq string")
    got = RG.sequence_membership(seqs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    res = seqs.select("seq_id", F.posexplode(letters_of("seq")).alias("pos", "aa")).filter("aa <> ''")
    want = RG.region_membership(res, RG.detect_regions(seqs))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_domains_of_the_same_ends_meet_positions_once(spark):
    from helixframe.operators import variants as V

    doms = spark.createDataFrame([(0, 3, 9, k, f"d{k}") for k in range(7, 60)] + [(0, 5, 6, 2, "first")], "gene int, start int, end int, ord int, pfam string")
    pos = spark.createDataFrame([(0, p) for p in (2, 3, 5, 9, 10)], "gene int, pos int")
    got = V.position_domain(pos, doms)
    below = got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "Aggregate" in below
    assert [r.pfam for r in got.orderBy("pos").collect()] == ["default_0", "d7", "first", "d7", "default_0"]


def test_bootstrap_rows_draw_in_many_tasks(spark):
    v = spark.range(400).coalesce(1).select("id", (F.col("id") % 37 / 37).alias("value"))
    for stat in ("mean", "median"):
        out = EV.bootstrap_ci(v, 50, stat=stat)
        assert out.first()["draws"] == 50
        # one file of few rows used to draw all its weights in one task: no exchange lay below the generator
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan[plan.index("Generate"):]


def test_pdb_lines_travel_before_they_are_grouped(spark):
    """No read task holds its lines in a map: the grouping follows the only shuffle."""
    from helixframe.plans import files

    plan = files.lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan.split("Exchange")[1]


def test_base_pairs_are_counted_without_a_row_per_position(spark):
    from helixframe.operators import sequences as S

    rows = [(0, "AAAAC"), (1, "gaucUXn"), (2, ""), (3, None), (4, "A"), (5, "AC\nGT"), (6, "Aé\U0001f600Aé"), (0, "CA"), (7, "ACGTN" * 50)]
    want = {}
    for k, s in rows:
        s = (s or "").upper().replace("U", "T").replace("\n", "")
        for a, b in zip(s, s[1:]):
            want[k, a, b] = want.get((k, a, b), 0) + 1
    got = S.base_pairs(spark.createDataFrame(rows, "seq_id long, seq string"))
    assert {(r.seq_id, r.b1, r.b2): r.n for r in got.collect()} == want and dict(got.dtypes)["n"] == "bigint"
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_regions_are_found_without_arrays_of_positions(spark):
    from helixframe.operators import regions as RG

    letters = "".join(C.AA20)
    rows = [(0, ""), (1, None), (2, "A"), (3, "AAAA"), (4, "VVV"), (5, "AAA"), *[(6 + k, "".join(rng.choice(list(letters), 300, p=None))) for k in range(20)]]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    got = RG.detect_regions(df)
    want = df.select("seq_id", F.explode(RG.region_array(RG.tunnel_labels("seq"))).alias("r")).select("seq_id", "r.*")
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect()) and got.count() > 20
    assert "transform" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "segment": 5, "chunk": 16, "left": 1}])
def test_permutation_in_blocks(spark, sizes, monkeypatch):
    """Both nulls row by row, whatever the blocks of rows, segments of kinds and chunks of trials are; no row per row and trial."""
    from helixframe.operators import evaluate as EV

    n, trials = 60, 50
    v = spark.createDataFrame([(k * 31 - 40, float(k * 37 % 23), k % 3, k % 4 == 0) for k in range(n)], "id bigint, value double, kind int, picked boolean")
    r = EV.permutation_enrichment(v, trials, **sizes).first()
    rows = [(k * 31 - 40, sum(j * 37 % 23 < k * 37 % 23 for j in range(n)) / n, k % 3, k % 4 == 0) for k in range(n)]
    picked = [x for x in rows if x[3]]
    obs = np.mean([x[1] for x in picked])
    rem = lambda a, b: int(np.fmod(a, b))
    order = lambda x, t: (rem(x[0] * 7919 + t * 104729 + rem(x[0] * t, 6007), 100003), x[0])
    free = [np.mean([x[1] for x in sorted(rows, key=lambda x: order(x, t))[:len(picked)]]) for t in range(trials)]
    same = []
    for t in range(trials):
        drawn = []
        for x in picked:
            kind = sorted(y[:2] for y in rows if y[2] == x[2])
            o = rem(rem(rem(x[0] * 48271 + t * 104729 + 7, 2147483647) * 69621, 2147483647), len(kind))
            drawn += [kind[o][1]] if o >= 0 else []
        same.append(np.mean(drawn))
    share = lambda means: np.mean([round(m, 12) >= round(obs, 12) for m in means])
    assert r.n_set == len(picked) and abs(r.observed - obs) < 1e-9
    assert abs(r.p_value - share(free)) < 1e-9 and abs(r.p_same_kind - share(same)) < 1e-9
    none = EV.permutation_enrichment(v.withColumn("picked", v.picked & False), trials).first()
    assert tuple(none) == (None,) * 4


def test_spring_pairs_stay_with_their_structure(spark):
    """Contacts and pairs of points that are dealt out by structure are made without a further shuffle."""
    rows = [(s, k, "protein" if k % 3 else "metal", int(rng.integers(0, 12)), *map(float, rng.random(3) * 25)) for s in range(3) for k in range(60)]
    points = spark.createDataFrame(rows, "s int, serial int, kind string, i int, x double, y double, z double").repartition(4, "s")
    p = F.col("kind") == "protein"
    residue = F.when(p, F.struct("i", *[F.col("i").cast("double").alias(f"i_{k}") for k in "xyz"], *"xyz"))
    partner = F.when(~p, F.struct(F.col("serial").alias("partner"), F.lit(6.0).alias("own"), *"xyz"))
    found = SP.gathered_contacts(points, ["s"], 18.0, residue, partner)
    got = SP.shared_contact_springs(found.select("s", "partner.partner", "residue.i", *[f"residue.i_{k}" for k in "xyz"]), None, ["s"], 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    touch = {(a[0], b[1], a[3]) for a in rows for b in rows if a[0] == b[0] and a[2] == "protein" and b[2] == "metal" and np.linalg.norm(np.subtract(a[4:], b[4:])) <= 6}
    want = {}
    for s, m, i in touch:
        for t, n, j in touch:
            if s == t and m == n and j - i >= 2:
                want[s, i, j] = min(m, want.get((s, i, j), m))
    rows_ = got.collect()
    assert {(r.s, r.i, r.j): r.partner for r in rows_} == want and len(rows_) == len(want) > 20
    assert all(abs(r.d0 - (r.j - r.i) * 3 ** .5) < 1e-9 for r in rows_)
