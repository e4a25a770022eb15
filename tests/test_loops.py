"""Loop rebuilding, consensus and gap filling against residue loops."""

import numpy as np

from helixframe import constants as C
from helixframe.operators import structures as ST

rng = np.random.default_rng(12)


def fill(x, masked):
    """Islands one by one: chord between the ends, straight walks off the chain's ends."""
    y, n = x.copy(), len(x)
    free = np.flatnonzero(~masked)
    if len(free) < 2:
        return y
    for i in np.flatnonzero(masked):
        left, right = free[free < i], free[free > i]
        if len(left) and len(right):
            a, b = left[-1], right[0]
            step = (x[b] - x[a]) / (b - a) if np.linalg.norm(x[b] - x[a]) >= 1e-6 else np.array([C.CA_CA, 0, 0])
            y[i] = x[a] + step * (i - a)
        else:
            a, b = (right[0], right[1]) if len(right) else (left[-1], left[-2])
            d = x[a] - x[b]
            y[i] = x[a] + abs(i - a) * C.CA_CA * d / (np.linalg.norm(d) + 1e-9)
    return y


def rebuilt(x, masked, models):
    whole = [m for m in models if len(m) == len(x) and np.isfinite(m).all()]
    if len(whole) >= 2 and masked.any() and (~masked).sum() >= 4:
        acc = np.zeros_like(x)
        for m in whole:
            a, b = m[~masked], x[~masked]
            u, _, vt = np.linalg.svd((a - a.mean(0)).T @ (b - b.mean(0)))
            r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
            acc += (m - a.mean(0)) @ r.T + b.mean(0)
        y = x.copy()
        y[masked] = (acc / len(whole))[masked]
    else:
        y = fill(x, masked)
    return y - y.mean(0)


def test_loop_rebuild(spark):
    points, refs, masks, want = [], [], [], {}
    for target in range(10):
        n = int(rng.integers(8, 20))
        x = np.cumsum(rng.normal(0, 2, (n, 3)), 0)
        masked = rng.random(n) < .4
        models = []
        for m in range(int(rng.integers(0, 5)) if target else 4):
            q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
            q *= np.sign(np.linalg.det(q))
            y = (x + rng.normal(0, .4, x.shape)) @ q + rng.normal(0, 9, 3)
            models.append(y[:-1] if rng.random() < .2 else y)
        if target == 8:
            masked[:] = True
            masked[3] = False
        if target == 9:
            models, masked = [], np.zeros(n, bool)
            masked[:2], masked[4:6], masked[-2:] = True, True, True
            x[6] = x[3]
        refs += [(target, i, *map(float, p)) for i, p in enumerate(x)]
        masks += [(target, i, bool(b)) for i, b in enumerate(masked)]
        points += [(target, m, i, *map(float, p)) for m, y in enumerate(models) for i, p in enumerate(y)]
        want[target] = rebuilt(x, masked, models)
    xyz = "x double, y double, z double"
    got = ST.loop_rebuild(spark.createDataFrame(points, f"target int, model int, idx int, {xyz}"), spark.createDataFrame(refs, f"target int, idx int, {xyz}"),
                          spark.createDataFrame(masks, "target int, idx int, masked boolean"), ["target"], ["model"]).collect()
    for target, w in want.items():
        mine = np.array([(r.x, r.y, r.z) for r in sorted((r for r in got if r.target == target), key=lambda r: r.idx)])
        assert mine.shape == w.shape and np.allclose(mine, w, atol=1e-6), target


def test_template_consensus(spark):
    points, models, want = [], [], {}
    weights = {"score_power": lambda m: m[0] ** C.PHI**6, "residual": lambda m: 1 / max(m[3], 1e-12), "agreement": lambda m: (m[1] * m[2]) ** 8}
    orders = {"score_power": lambda m: -m[0], "residual": lambda m: m[3], "agreement": lambda m: -m[1] * m[2]}
    for target in range(4):
        n = 22
        x = np.cumsum(rng.normal(0, 2, (n, 3)), 0)
        pool = []
        for m in range(7):
            q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
            q *= np.sign(np.linalg.det(q))
            seen = (rng.random(n) < .8) & (np.arange(n) > 1) & (np.arange(n) < 20)
            if m == 3:
                seen[8:] = False
            y = (x + rng.normal(0, .3, x.shape)) @ q + rng.normal(0, 5, 3)
            facts = tuple(float(v) for v in rng.uniform(.3, 1, 3)) + (float(rng.uniform(0, 3)),)
            pool.append((facts, y, seen))
            models.append((target, m, *facts))
            points += [(target, m, int(i), *map(float, y[i])) for i in np.flatnonzero(seen)]
        for rule in weights:
            top = sorted(pool, key=lambda c: orders[rule](c[0]))[:4]
            acc, total, ref = np.zeros((n, 3)), np.zeros(n), top[0]
            for facts, y, seen in top:
                common = np.flatnonzero(seen & ref[2])
                if len(common) < 8:
                    continue
                a, b = y[common], ref[1][common]
                u, _, vt = np.linalg.svd((a - a.mean(0)).T @ (b - b.mean(0)))
                r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
                moved = (y - a.mean(0)) @ r.T + b.mean(0)
                acc[seen] += weights[rule](facts) * moved[seen]
                total[seen] += weights[rule](facts)
            covered = total > 0
            mean = np.zeros((n, 3))
            mean[covered] = acc[covered] / total[covered, None]
            if covered.sum() > 1:
                want[rule, target] = fill(mean, ~covered)
    p = spark.createDataFrame(points, "target int, model int, idx int, x double, y double, z double")
    m = spark.createDataFrame(models, "target int, model int, score double, identity double, coverage double, energy double")
    n = m.select("target").distinct().selectExpr("target", "22 n")
    for rule in weights:
        got = ST.template_consensus(p, m, n, rule, ["target"], ["model"]).collect()
        assert {r.target for r in got} == {t for k, t in want if k == rule}
        for target in {r.target for r in got}:
            mine = np.array([(r.x, r.y, r.z) for r in sorted((r for r in got if r.target == target), key=lambda r: r.idx)])
            assert np.allclose(mine, want[rule, target], atol=1e-6), (rule, target)
