"""Structure comparison over long point tables (keys..., idx, x, y, z)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from .. import constants as C
from ..functions import residues as RF
from ..functions.common import dist, freeze
from ..session import cut_lineage

XYZ = "xyz"


def matched_sums(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Covariance sums of matched points (px..qz) per key, in one aggregate."""
    return centred_sums(matched.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in moments().items()]), keys)


def moments() -> dict[str, F.Column]:
    """What a set of matched points is summed up by: count, first moments, products and squares."""
    p = {k: F.col(f"p{k}") for k in XYZ}
    q = {k: F.col(f"q{k}") for k in XYZ}
    return {"n": F.lit(1), **{f"sp{k}": p[k] for k in XYZ}, **{f"sq{k}": q[k] for k in XYZ}, **{f"s{a}{b}": p[a] * q[b] for a in XYZ for b in XYZ},
            "ss": sum((p[k] * p[k] + q[k] * q[k] for k in XYZ), F.lit(0.0))}


def centred_sums(g: DataFrame, keys: list[str]) -> DataFrame:
    """Centred covariances, spread and centroids of summed moments."""
    n = F.col("n")
    h = [(F.col(f"s{a}{b}") - F.col(f"sp{a}") * F.col(f"sq{b}") / n).alias(f"h{a}{b}") for a in XYZ for b in XYZ]
    e0 = F.col("ss") - sum((F.pow(F.col(f"s{s}{k}"), 2) for s in "pq" for k in XYZ), F.lit(0.0)) / n
    cen = [(F.col(f"s{s}{k}") / n).alias(f"c{s}{k}") for s in "pq" for k in XYZ]
    return g.select(*keys, "n", *h, e0.alias("e0"), *cen)


def kabsch_rmsd(matched: DataFrame, keys: list[str]) -> DataFrame:
    """RMSD after the best proper rotation, from closed-form 3x3 singular values."""
    return freeze(rmsd_of(matched_sums(matched, keys)).select(*keys, "n", "rmsd"))


def rmsd_of(s: DataFrame) -> DataFrame:
    h = lambda a, b: F.col(f"h{a}{b}")
    g = s.withColumns({f"g{a}{b}": sum((h(k, a) * h(k, b) for k in XYZ), F.lit(0.0))
                       for a in XYZ for b in XYZ if a <= b})
    gg = lambda a, b: F.col(f"g{min(a, b)}{max(a, b)}")
    det = (h("x", "x") * (h("y", "y") * h("z", "z") - h("y", "z") * h("z", "y"))
           - h("x", "y") * (h("y", "x") * h("z", "z") - h("y", "z") * h("z", "x"))
           + h("x", "z") * (h("y", "x") * h("z", "y") - h("y", "y") * h("z", "x")))
    g = g.withColumns({"det": det, "q0": (gg("x", "x") + gg("y", "y") + gg("z", "z")) / 3})
    off = 2 * (F.pow(gg("x", "y"), 2) + F.pow(gg("x", "z"), 2) + F.pow(gg("y", "z"), 2))
    diag = sum((F.pow(gg(k, k) - F.col("q0"), 2) for k in XYZ), F.lit(0.0))
    g = g.withColumn("p0", F.sqrt((diag + off) / 6))
    b = lambda a, c: (gg(a, c) - (F.col("q0") if a == c else F.lit(0.0))) / F.col("p0")
    r = (b("x", "x") * (b("y", "y") * b("z", "z") - b("y", "z") * b("y", "z"))
         - b("x", "y") * (b("x", "y") * b("z", "z") - b("y", "z") * b("x", "z"))
         + b("x", "z") * (b("x", "y") * b("y", "z") - b("y", "y") * b("x", "z"))) / 2
    r = F.when(F.col("p0") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).otherwise(1.0)
    g = g.withColumn("phi", F.acos(r) / 3)
    g = g.withColumns({
        "l1": F.greatest(F.col("q0") + 2 * F.col("p0") * F.cos("phi"), F.lit(0.0)),
        "l3": F.greatest(F.col("q0") + 2 * F.col("p0") * F.cos(F.col("phi") + 2 * math.pi / 3), F.lit(0.0)),
    })
    l2 = F.greatest(3 * F.col("q0") - F.col("l1") - F.col("l3"), F.lit(0.0))
    trace = F.sqrt("l1") + F.sqrt(l2) + F.signum("det") * F.sqrt("l3")
    return g.withColumn("rmsd", F.sqrt(F.greatest(F.lit(0.0), F.col("e0") - 2 * trace) / F.col("n")))


@pandas_udf(T.ArrayType(T.DoubleType()))
def _rotation(h: pd.Series) -> pd.Series:
    """Batched proper rotations from flattened 3x3 covariances."""
    if not len(h):
        return pd.Series([], dtype=object)
    m = np.stack(h.to_numpy()).reshape(-1, 3, 3)
    u, _, vt = np.linalg.svd(m)
    d = np.sign(np.linalg.det(np.transpose(vt, (0, 2, 1)) @ np.transpose(u, (0, 2, 1))))
    fix = np.zeros_like(m)
    fix[:, 0, 0] = fix[:, 1, 1] = 1.0
    fix[:, 2, 2] = d
    r = np.transpose(vt, (0, 2, 1)) @ fix @ np.transpose(u, (0, 2, 1))
    return pd.Series(list(r.reshape(-1, 9)))


def rotations(matched: DataFrame, keys: list[str], min_points: int = 4) -> DataFrame:
    """Rotation and both centroids per key; one small row per pair of point sets."""
    s = matched_sums(matched, keys).filter(F.col("n") >= min_points)
    h = F.array(*[F.col(f"h{a}{b}") for a in XYZ for b in XYZ])
    return s.select(*keys, "n", _rotation(h).alias("rot"), *[f"c{s_}{k}" for s_ in "pq" for k in XYZ])


def apply_rotation(points: DataFrame, rot: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """Move points of the p side onto the q side's frame."""
    j = points.join(rot, keys)
    d = {k: F.col(f"{prefix}{k}") - F.col(f"cp{k}") for k in XYZ}
    moved = {f"{prefix}{k}": sum((F.col("rot")[3 * r + c] * d[a] for c, a in enumerate(XYZ)), F.lit(0.0)) + F.col(f"cq{k}")
             for r, k in enumerate(XYZ)}
    return j.withColumns(moved).select(*points.columns)


def match_points(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of two point tables with p and q coordinates."""
    q = b.select(*on, *[F.col(k).alias(f"q{k}") for k in XYZ])
    return a.withColumnsRenamed({k: f"p{k}" for k in XYZ}).join(q, on)


def superpose(points: DataFrame, reference: DataFrame, group: list[str], each: list[str]) -> DataFrame:
    """Superpose every (group, each) point set on the group's reference by idx."""
    m = match_points(points, reference, [*group, "idx"])
    return apply_rotation(points, rotations(m, [*group, *each]), [*group, *each])


def per_residue_deviation(points: DataFrame, reference: DataFrame, group: list[str], each: list[str]) -> DataFrame:
    moved = superpose(points, reference, group, each)
    return match_points(moved, reference, [*group, "idx"]).withColumn("deviation", dist("p", "q"))


def chain_steps(points: DataFrame, keys: list[str]) -> DataFrame:
    """Bond length to the next residue; keys name one chain."""
    w = W.partitionBy(*keys).orderBy("idx")
    nxt = [F.lead(k).over(w).alias(f"n{k}") for k in XYZ]
    j = points.select("*", *nxt, F.lead("idx").over(w).alias("nidx")).filter("nidx is not null")
    return j.withColumn("bond", F.sqrt(sum((F.pow(F.col(f"n{k}") - F.col(k), 2) for k in XYZ), F.lit(0.0))))


def radius_of_gyration() -> F.Column:
    return F.sqrt(sum((F.var_pop(k) for k in XYZ), F.lit(0.0)))


def bond_integrity(points: DataFrame, keys: list[str]) -> DataFrame:
    return chain_steps(points, keys).groupBy(*keys).agg(
        F.avg(F.pow(F.col("bond") - C.CA_CA, 2)).alias("bond_mse"),
        F.avg((F.col("bond") > 5).cast("double")).alias("frac_broken"))


CLASH = C.E + C.PHI


def idx_pairs(points: DataFrame, keys: list[str], gate: int = 1) -> DataFrame:
    """Residue pairs of one chain; the chain length bounds the expansion."""
    g = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", *XYZ))).alias("a"))
    i = g.select(*keys, F.size("a").alias("n"), "a", F.explode("a").alias("p"))
    p = i.select(*keys, "n", "p", F.explode("a").alias("q")).filter(F.col("q.idx") - F.col("p.idx") >= gate)
    d = F.sqrt(sum((F.pow(F.col(f"p.{k}") - F.col(f"q.{k}"), 2) for k in XYZ), F.lit(0.0)))
    return p.select(*keys, "n", F.col("p.idx").alias("i"), F.col("q.idx").alias("j"), d.alias("distance"))


def interface_energy(points: DataFrame, keys: list[str]) -> DataFrame:
    """Residual-weighted bond, clash and compactness terms of each model."""
    bonds = chain_steps(points, keys).groupBy(*keys).agg(F.sum(F.pow(F.col("bond") - C.CA_CA, 2)).alias("b"))
    shape = points.groupBy(*keys).agg(F.count("*").alias("n"), radius_of_gyration().alias("rg"))
    clash = idx_pairs(points, keys, 2).groupBy(*keys).agg(F.sum(
        F.when(F.col("distance") < CLASH, F.pow(CLASH - F.col("distance"), 2)).otherwise(0.0)).alias("c"))
    j = shape.join(bonds, keys, "left").join(clash, keys, "left")
    return j.select(
        *keys, "n", "rg",
        (C.RESIDUAL["Physical_Chemistry"] * F.coalesce("b", F.lit(0.0))).alias("e_bond"),
        (C.RESIDUAL["Chemistry"] * F.coalesce("c", F.lit(0.0))).alias("e_clash"),
        (C.RESIDUAL["Biochemistry"] * F.pow(F.col("rg") - RF.target_rg("n"), 2)).alias("e_fold"),
    ).withColumn("energy", F.col("e_bond") + F.col("e_clash") + F.col("e_fold"))


def model_sanity(points: DataFrame, keys: list[str]) -> DataFrame:
    shape = points.groupBy(*keys).agg(F.count("*").alias("n"), radius_of_gyration().alias("rg"))
    j = shape.join(bond_integrity(points, keys), keys)
    t = RF.target_rg("n")
    return j.withColumn("is_sane", (F.col("rg") > 0.5 * t) & (F.col("rg") < 2 * t) & (F.col("frac_broken") < 0.1))


def termini_stress(points: DataFrame, keys: list[str]) -> DataFrame:
    s = chain_steps(points, keys)
    n = points.groupBy(*keys).agg(F.count("*").alias("n"))
    j = s.join(n, keys)
    band, last = F.greatest(F.lit(3), F.floor(F.col("n") / 10)), F.col("n") - 1
    err = F.abs(F.col("bond") - C.CA_CA)
    head = (F.col("idx") < band).cast("int")
    tail = (F.col("idx") >= F.greatest(F.lit(0), last - band)).cast("int")
    core = (F.col("idx") >= band) & (F.col("idx") < F.greatest(band + 1, last - band))
    return j.groupBy(*keys).agg(
        (F.sum(err * (head + tail)) / F.sum(head + tail)).alias("termini"),
        F.coalesce(F.avg(F.when(core, err)), F.avg(err)).alias("core"))


def tertiary_contacts(points: DataFrame, group: list[str], each: list[str], gate: int = C.GATE) -> DataFrame:
    """Pairs whose distance is short and agrees over a target's models."""
    p = idx_pairs(points, [*group, *each], gate)
    g = p.groupBy(*group, "i", "j").agg(F.percentile("distance", 0.5).alias("median"), F.stddev_pop("distance").alias("sd"))
    return g.filter((F.col("median") < C.PHI * C.CONTACT) & (F.col("sd") <= C.PHI))


def superposed_mask(points: DataFrame, reference: DataFrame, group: list[str], each: list[str]) -> DataFrame:
    """Residues whose spread over superposed models exceeds phi."""
    al = superpose(points, reference, group, each)
    sd = sum((F.stddev_pop(k) for k in XYZ), F.lit(0.0)) / 3
    return al.groupBy(*group, "idx").agg(sd.alias("spread")).withColumn("masked", F.col("spread") > C.PHI)


def consensus(points: DataFrame, reference: DataFrame, weights: DataFrame, group: list[str], each: list[str]) -> DataFrame:
    """Weighted mean of superposed models per residue."""
    al = superpose(points, reference, group, each).join(weights, [*group, *each])
    return al.groupBy(*group, "idx").agg(
        *[(F.sum(F.col("w") * F.col(k)) / F.sum("w")).alias(k) for k in XYZ], F.count("*").alias("n_models"))


#: How the models of a target are ordered, best first, and weighted.
RULES = {
    "score_power": (lambda: -F.col("score"), lambda: F.pow("score", F.lit(C.PHI**6))),
    "residual": (lambda: F.round("energy", 9), lambda: 1.0 / F.greatest("energy", F.lit(1e-12))),
    "agreement": (lambda: -(F.col("identity") * F.col("coverage")), lambda: F.pow(F.col("identity") * F.col("coverage"), F.lit(8.0))),
}


def template_consensus(points: DataFrame, models: DataFrame, lengths: DataFrame, rule: str, group: list[str], each: list[str], top_k: int = 4,
                       min_common: int = 8) -> DataFrame:
    """Weighted mean of a target's best models, fitted to the best one, with gaps filled.

    ``models`` is (group, each, score, identity, coverage, energy). By ``rule`` the ``top_k`` best are taken; a model that shares ``min_common`` residues
    with the best is fitted on them. Residues that no fitted model covers are filled along the chain of ``lengths``. Ties go by score, then model.
    """
    order, weight = RULES[rule]
    rank = F.row_number().over(W.partitionBy(*group).orderBy(order(), F.desc("score"), *each))
    top = models.withColumn("rank", rank).filter(F.col("rank") <= top_k).select(*group, *each, "rank", weight().alias("w"))
    own = points.select(*group, *each, "idx", *XYZ).join(top, [*group, *each])
    best = own.filter("rank = 1").select(*group, "idx", *XYZ)
    fit = rotations(match_points(own, best, [*group, "idx"]), [*group, *each], min_common)
    moved = apply_rotation(own, fit, [*group, *each])
    mean = moved.groupBy(*group, "idx").agg(*[(F.sum(F.col("w") * F.col(k)) / F.sum("w")).alias(k) for k in XYZ])
    return gap_fill(mean, group, lengths)


def consensus_atoms(atoms: DataFrame, reference: DataFrame, group: list[str], each: list[str], primary) -> DataFrame:
    """Mean of an agreeing named atom, else the primary model's atom."""
    al = superpose(atoms, reference, group, each)
    g = al.groupBy(*group, "idx", "name").agg(
        F.count("*").alias("n_models"), (sum((F.stddev_pop(k) for k in XYZ), F.lit(0.0)) / 3).alias("spread"),
        *[F.avg(k).alias(f"m{k}") for k in XYZ],
        *[F.max(F.when(primary, F.col(k))).alias(f"f{k}") for k in XYZ])
    agree = (F.col("n_models") >= 2) & (F.col("spread") < C.PHI)
    return g.select(*group, "idx", "name", "n_models", agree.alias("agree"),
                    *[F.when(agree, F.col(f"m{k}")).otherwise(F.col(f"f{k}")).alias(k) for k in XYZ]).filter("x is not null")


def model_pairs(points: DataFrame, group: list[str], each: str) -> DataFrame:
    """RMSD of every two models of one target; a target holds a bounded model pool."""
    a = points.select(*group, F.col(each).alias("m1"), "idx", *[F.col(k).alias(f"p{k}") for k in XYZ])
    b = points.select(*group, F.col(each).alias("m2"), "idx", *[F.col(k).alias(f"q{k}") for k in XYZ])
    return kabsch_rmsd(a.join(b, [*group, "idx"]).filter("m1 < m2"), [*group, "m1", "m2"])


def medoid(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Model with the least total RMSD to the others of its target."""
    ends = pairs.select(*group, F.explode(F.array("m1", "m2")).alias("model"), "rmsd")
    tot = ends.groupBy(*group, "model").agg(F.sum("rmsd").alias("total"))
    return tot.groupBy(*group).agg(F.min_by("model", F.struct(F.round("total", 9), F.col("model"))).alias("medoid"),
                                   F.min("total").alias("total"))


def leader_cluster(scored: DataFrame, pairs: DataFrame, radius: float = C.PHI**2) -> DataFrame:
    """Score-ordered leader clusters: a model that is near no better leader leads, the others follow the best leader near them.

    Decided in rounds over the whole table: a model with no better undecided model nearby leads, and what is near it is no
    leader. So each round settles the best of every neighbourhood at once and no target is held in one row. Equal scores go by model.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("model").alias("m"))
    nodes = scored.select("target", "model", order.alias("o"))
    side = lambda c, k: nodes.select("target", F.col("model").alias(c), F.col("o").alias(k))
    e = (pairs.filter(F.col("rmsd") <= radius).select("target", "m1", "m2").join(side("m1", "o1"), ["target", "m1"]).join(side("m2", "o2"), ["target", "m2"]))
    swap = F.col("o2") < F.col("o1")
    pick = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    e = cut_lineage(e.select("target", pick("m2", "m1").alias("first"), pick("o2", "o1").alias("o"), pick("m1", "m2").alias("second")).distinct())
    open_ = cut_lineage(nodes.select("target", "model"))
    leaders = None
    while not open_.isEmpty():
        undecided = e.join(open_.withColumnRenamed("model", "first"), ["target", "first"]).select("target", F.col("second").alias("model"))
        new = cut_lineage(open_.join(undecided, ["target", "model"], "left_anti"))
        leaders = new if leaders is None else leaders.unionByName(new)
        near = e.join(new.withColumnRenamed("model", "first"), ["target", "first"]).select("target", F.col("second").alias("model"))
        open_ = cut_lineage(open_.join(new.unionByName(near).distinct(), ["target", "model"], "left_anti"))
    if leaders is None:
        return open_.withColumn("leader", F.col("model"))
    follow = e.join(leaders.withColumnRenamed("model", "first"), ["target", "first"]).groupBy("target", F.col("second").alias("model")).agg(
        F.min_by("first", "o").alias("leader"))
    follow = follow.join(leaders, ["target", "model"], "left_anti")
    return leaders.withColumn("leader", F.col("model")).unionByName(follow)


def gap_fill(points: DataFrame, keys: list[str], lengths: DataFrame, apart: bool = False) -> DataFrame:
    """Linear fill between measured residues and straight walks off both ends.

    A measured residue carries its measured neighbours, so a gap sees the two points on either side and no row holds a chain. Chains with fewer
    than two measured residues are left out. With ``apart``, a gap between two points at one place goes in steps of a bond along x.
    """
    order = W.partitionBy(*keys).orderBy("idx")
    point = F.struct(F.col("idx").alias("i"), *XYZ)
    known = points.select(*keys, "idx", *XYZ, F.lag(point).over(order).alias("before"), F.lead(point).over(order).alias("after"))
    known = known.select(*keys, "idx", F.struct(F.col("idx").alias("i"), *XYZ, "before", "after").alias("p"))
    grid = lengths.select(*keys, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    g = grid.join(known, [*keys, "idx"], "left")
    back, ahead = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    g = g.select(*keys, "idx", F.last("p", True).over(back).alias("l"), F.first("p", True).over(ahead).alias("r"), F.count("p").over(W.partitionBy(*keys)).alias("c"))
    g = g.filter("c > 1")

    def walk(anchor: str, other: str, k: str):
        step = [F.col(f"{anchor}.{c}") - F.col(f"{anchor}.{other}.{c}") for c in XYZ]
        length = F.sqrt(sum((s * s for s in step), F.lit(0.0))) + 1e-9
        away = F.abs(F.col("idx") - F.col(f"{anchor}.i"))
        return F.col(f"{anchor}.{k}") + away * C.CA_CA * (F.col(f"{anchor}.{k}") - F.col(f"{anchor}.{other}.{k}")) / length

    into = (F.col("idx") - F.col("l.i")).cast("double")
    t = F.try_divide(into, (F.col("r.i") - F.col("l.i")).cast("double"))
    chord = F.sqrt(sum((F.pow(F.col(f"r.{k}") - F.col(f"l.{k}"), 2) for k in XYZ), F.lit(0.0)))
    line = {k: F.col(f"l.{k}") + (F.col(f"r.{k}") - F.col(f"l.{k}")) * t for k in XYZ}
    if apart:
        line = {k: F.when(chord < 1e-6, F.col(f"l.{k}") + (into * C.CA_CA if k == "x" else 0.0)).otherwise(v) for k, v in line.items()}
    out = {k: F.when(F.col("l").isNull(), walk("r", "after", k)).when(F.col("r").isNull(), walk("l", "before", k))
           .when(F.col("l.i") == F.col("r.i"), F.col(f"l.{k}")).otherwise(line[k]) for k in XYZ}
    return g.select(*keys, "idx", *[v.alias(k) for k, v in out.items()])


def loop_rebuild(points: DataFrame, reference: DataFrame, mask: DataFrame, group: list[str], each: list[str]) -> DataFrame:
    """The reference with its masked residues rebuilt, centred.

    ``mask`` is (group, idx, masked). Models as long as the reference are fitted to it on the residues that are not masked, four or more; with
    two fitted models a masked residue takes their mean. Otherwise the islands of the mask are filled: along the chord between their ends,
    or by a straight walk at the chain's ends. Where fewer than two residues are free nothing changes.
    """
    free = mask.filter(~F.col("masked")).select(*group, "idx")
    size = reference.groupBy(*group).agg(F.count("*").cast("int").alias("n"))
    finite = F.bool_and(~sum((F.isnan(k).cast("int") + F.col(k).isNull().cast("int") for k in XYZ), F.lit(0)).cast("boolean"))
    whole = points.groupBy(*group, *each).agg(F.count("*").cast("int").alias("n"), finite.alias("ok")).filter("ok").join(size, [*group, "n"]).select(*group, *each)
    models = points.select(*group, *each, "idx", *XYZ).join(whole, [*group, *each], "left_semi")
    fit = match_points(models, reference, [*group, "idx"]).join(free, [*group, "idx"], "left_semi")
    moved = apply_rotation(models, rotations(fit, [*group, *each]), [*group, *each])
    mean = moved.groupBy(*group, "idx").agg(F.count("*").alias("w"), *[F.avg(k).alias(f"m{k}") for k in XYZ]).filter("w > 1").drop("w")
    chord = gap_fill(reference.join(free, [*group, "idx"], "left_semi"), group, size, apart=True).withColumnsRenamed({k: f"g{k}" for k in XYZ})
    j = reference.join(mask.select(*group, "idx", "masked"), [*group, "idx"]).join(mean, [*group, "idx"], "left").join(chord, [*group, "idx"], "left")
    built = j.select(*group, "idx", *[F.when(F.col("masked"), F.coalesce(f"m{k}", f"g{k}", k)).otherwise(F.col(k)).alias(k) for k in XYZ])
    return centred(built, group)


def soft_termini(points: DataFrame, keys: list[str], lengths: DataFrame, n_term: int = 1, c_term: int = 3) -> DataFrame:
    """Drop the ends and rebuild them as straight walks, then centre."""
    core = points.join(lengths, keys).filter(
        (F.col("idx") >= n_term) & (F.col("idx") < F.col("n") - c_term)).drop("n")
    return centred(gap_fill(core, keys, lengths), keys)


def centred(points: DataFrame, keys: list[str]) -> DataFrame:
    mid = points.groupBy(*keys).agg(*[F.avg(k).alias(f"c{k}") for k in XYZ])
    return points.join(mid, keys).select(*keys, "idx", *[(F.col(k) - F.col(f"c{k}")).alias(k) for k in XYZ])


def hinge_split(matched: DataFrame, keys: list[str], min_seg: int = 6) -> DataFrame:
    """Split index whose worse segment RMSD is smallest.

    The moments run along the chain, so the segments of every split are a running sum and its difference from the chain's; no point is copied per split.
    Points are centred on their chain first, which keeps the differences exact enough.
    """
    chain, so_far = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    own = matched.withColumns({f"{s}{k}": F.col(f"{s}{k}") - F.avg(f"{s}{k}").over(chain) for s in "pq" for k in XYZ})
    own = own.withColumns({f"_{k}": v for k, v in moments().items()})
    runs = own.select(*keys, F.col("idx").alias("k"), F.sum("_n").over(chain).alias("len"),
                      F.struct(*[F.coalesce(F.sum(f"_{k}").over(so_far), F.lit(0)).alias(k) for k in moments()]).alias("head"),
                      F.struct(*[F.sum(f"_{k}").over(chain).alias(k) for k in moments()]).alias("all"))
    ok = (F.col("len") >= 2 * min_seg) & F.col("k").between(F.lit(min_seg), F.col("len") - min_seg - 1)
    tail = F.struct(*[(F.col(f"all.{k}") - F.col(f"head.{k}")).alias(k) for k in moments()])
    side = F.posexplode(F.array("head", tail)).alias("side", "m")
    segs = runs.filter(ok).select(*keys, "k", side).select(*keys, "k", "side", "m.*").filter("n > 0")
    r = freeze(rmsd_of(centred_sums(segs, [*keys, "k", "side"])).select(*keys, "k", "rmsd")).groupBy(*keys, "k").agg(F.max("rmsd").alias("worst"))
    return r.groupBy(*keys).agg(F.min_by("k", F.struct(F.round("worst", 9), F.col("k"))).alias("split"), F.min("worst").alias("worst"))


def sharpest_turn(points: DataFrame, keys: list[str], w: int = 4) -> DataFrame:
    """The residue where the directions from ``w`` residues before and to ``w`` after agree least; the chain's middle if it is too short for any."""
    order = W.partitionBy(*keys).orderBy("idx")
    p = points.select(*keys, "idx", *[(F.col(k) - F.lag(k, w).over(order)).alias(f"a{k}") for k in XYZ], *[(F.lead(k, w).over(order) - F.col(k)).alias(f"b{k}") for k in XYZ])
    dot = lambda s, t: sum((F.col(f"{s}{k}") * F.col(f"{t}{k}") for k in XYZ), F.lit(0.0))
    p = p.withColumn("cos", dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")) + 1e-12))
    middle = F.floor(F.count("*") / 2).cast("int")
    return p.groupBy(*keys).agg(
        F.coalesce(F.min_by("idx", F.when(F.col("cos").isNotNull(), F.struct(F.round("cos", 9), F.col("idx")))), middle).alias("turn"), F.min("cos").alias("turn_cos"))


def helix_handedness(points: DataFrame, helices: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of normalised triple products over helix quadruplets."""
    w = W.partitionBy(*keys).orderBy("idx")
    p = points.select(*keys, "idx", *[F.lead(k, d).over(w).alias(f"{k}{d}") for d in range(4) for k in XYZ])
    j = p.join(helices, keys).filter((F.col("idx") >= F.col("start")) & (F.col("idx") <= F.col("end") - 3) & F.col("x3").isNotNull())
    v = [[F.col(f"{k}{d + 1}") - F.col(f"{k}{d}") for k in XYZ] for d in range(3)]
    cross = [v[0][1] * v[1][2] - v[0][2] * v[1][1], v[0][2] * v[1][0] - v[0][0] * v[1][2], v[0][0] * v[1][1] - v[0][1] * v[1][0]]
    triple = sum((c * d for c, d in zip(cross, v[2])), F.lit(0.0))
    norm = F.lit(1.0)
    for vec in v:
        norm = norm * F.sqrt(sum((x * x for x in vec), F.lit(0.0)))
    return j.groupBy(*keys).agg(F.sum(F.when(norm > 0, triple / norm).otherwise(0.0)).alias("signed_volume"))


def residue_frames(points: DataFrame, keys: list[str]) -> DataFrame:
    """Orthonormal frame from the previous, own and next point; NULL at ends or when degenerate."""
    w = W.partitionBy(*keys).orderBy("idx")
    p = points.select(*keys, "idx", *XYZ, *[F.lag(k).over(w).alias(f"b{k}") for k in XYZ], *[F.lead(k).over(w).alias(f"n{k}") for k in XYZ])
    x = {k: F.col(f"n{k}") - F.col(f"b{k}") for k in XYZ}
    u = {k: F.col(k) - F.col(f"b{k}") for k in XYZ}
    v = {k: F.col(f"n{k}") - F.col(k) for k in XYZ}
    p = p.withColumns({**{f"a{k}": x[k] for k in XYZ},
                       "mx": u["y"] * v["z"] - u["z"] * v["y"], "my": u["z"] * v["x"] - u["x"] * v["z"],
                       "mz": u["x"] * v["y"] - u["y"] * v["x"]})
    length = lambda c: F.sqrt(sum((F.pow(F.col(f"{c}{k}"), 2) for k in XYZ), F.lit(0.0)))
    ok = (length("a") >= 1e-6) & (length("m") >= 1e-6)
    p = p.withColumns({f"{o}{k}": F.when(ok, F.col(f"{c}{k}") / length(c)) for o, c in (("ex_", "a"), ("ez_", "m")) for k in XYZ})
    z, e = (lambda k: F.col(f"ez_{k}")), (lambda k: F.col(f"ex_{k}"))
    return p.withColumns({"ey_x": z("y") * e("z") - z("z") * e("y"), "ey_y": z("z") * e("x") - z("x") * e("z"),
                          "ey_z": z("x") * e("y") - z("y") * e("x")}).select(
        *keys, "idx", *[f"e{a}_{k}" for a in XYZ for k in XYZ])


def ss_geometry(points: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement of helix i,i+4 and strand i,i+1 distances with the ideal, times compactness.

    ``regions`` is (keys, kind, start, end).
    """
    ideal = math.sqrt(36 + (4.6 * math.sin(math.radians(200))) ** 2)
    n = points.groupBy(*keys).agg(F.count("*").alias("n"), radius_of_gyration().alias("rg"))
    w = W.partitionBy(*keys).orderBy("idx")
    far = lambda k: F.sqrt(sum((F.pow(F.lead(c, k).over(w) - F.col(c), 2) for c in XYZ), F.lit(0.0)))
    p = points.select(*keys, "idx", far(1).alias("d1"), far(4).alias("d4"))
    size = F.col("end") - F.col("start") + 1
    span = regions.filter(((F.col("kind") == "H") & (size >= 5)) | ((F.col("kind") == "E") & (size >= 3))).withColumn(
        "idx", F.explode(F.sequence("start", "end")))
    j = span.join(p, [*keys, "idx"]).join(n, keys)
    helix = (F.col("kind") == "H") & (F.col("idx") < F.least(F.col("end") - 3, F.col("n") - 4))
    strand = (F.col("kind") == "E") & (F.col("idx") < F.least(F.col("end"), F.col("n") - 1))
    score = F.when(helix, F.exp(-F.abs(F.col("d4") - ideal) / C.PHI)).when(strand, F.exp(-F.abs(F.col("d1") - C.CA_CA)))
    g = j.withColumn("s", score).groupBy(*keys).agg(F.avg("s").alias("mean"))
    out = n.join(g, keys, "left")
    compact = F.exp(-F.abs(F.col("rg") - RF.target_rg("n")) / (C.PHI * C.E))
    return out.select(*keys, F.coalesce(F.col("mean") * compact, F.lit(0.0)).alias("ss_geometry"))
