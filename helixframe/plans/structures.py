"""Structure queries: every embedding vector is one 21-point model, eight models per target."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import structures as ST
from ..session import stored
from .base import P, PI_, R, num, query, r6, spread, table, with_

PTS = """raw AS (SELECT vec_id//8 AS target, vec_id%8 AS model, label, k AS idx, embedding[3*k+1]::DOUBLE AS ex, embedding[3*k+2]::DOUBLE AS ey, embedding[3*k+3]::DOUBLE AS ez
 FROM embeddings, (SELECT unnest(range(21)) AS k)),
walk AS (SELECT target, idx, sum(ex) OVER w AS bx, sum(ey) OVER w AS by_, sum(ez) OVER w AS bz FROM raw WHERE model=0 WINDOW w AS (PARTITION BY target ORDER BY idx)),
pts AS (SELECT r.target, model, label, r.idx, round(17.5::DOUBLE*bx+4*ex,3) AS x, round(17.5::DOUBLE*by_+4*ey,3) AS y, round(17.5::DOUBLE*bz+4*ez,3) AS z
 FROM raw r JOIN walk USING (target,idx))"""
KEYS = ["target", "model"]


def points(spark, sf):
    """Long points of all models; a target's models share a backbone walk."""
    e = table(spark, sf, "embeddings")
    d = spread(e.select(F.floor(F.col("vec_id") / 8).alias("target"), (F.col("vec_id") % 8).alias("model"), "label",
                        F.transform("embedding", lambda x: x.cast("double")).alias("e")), "target")
    step = lambda a, off: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.get(a, 3 * k + off))

    def running(a):
        return F.aggregate(a, F.array().cast("array<double>"), lambda acc, v: F.concat(
            acc, F.array(v + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))

    walk = d.filter("model = 0").select("target", *[running(step(F.col("e"), o)).alias(f"b{k}") for o, k in enumerate("xyz")])
    z = F.arrays_zip(*[F.zip_with(f"b{k}", step(F.col("e"), o), lambda b, v: F.round(17.5 * b + 4 * v, 3)).alias(k)
                       for o, k in enumerate("xyz")])
    return (d.join(walk, "target").select("target", "model", "label", F.posexplode(z).alias("idx", "p"))
            .select("target", "model", "label", "idx", "p.x", "p.y", "p.z"))


def reference(p):
    return p.filter("model = 0").select("target", "idx", "x", "y", "z")


def others(p):
    return p.filter("model > 0").select("target", "model", "idx", "x", "y", "z")


def matched(spark, sf):
    p = points(spark, sf)
    return ST.match_points(others(p), reference(p), ["target", "idx"])


MATCHED = """mt AS (SELECT p.target, p.model, p.idx, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM pts p JOIN pts q
 ON q.target=p.target AND q.idx=p.idx AND q.model=0 WHERE p.model>0)"""


def kabsch_sql(src: str, keys: str, name: str = "kb") -> str:
    """Closed-form RMSD per key over centred points."""
    on = "(" + keys + ")"
    h = ",".join(f"sum((m.p{a}-c.p{a})*(m.q{b}-c.q{b})) AS h{a}{b}" for a in "xyz" for b in "xyz")
    g = ",".join(f"hx{a}*hx{b}+hy{a}*hy{b}+hz{a}*hz{b} AS g{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    bb = {a + b: f"((g{a}{b}{'-q0' if a == b else ''})/p0)" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    det = (f"{bb['xx']}*({bb['yy']}*{bb['zz']}-{bb['yz']}*{bb['yz']})-{bb['xy']}*({bb['xy']}*{bb['zz']}-{bb['yz']}*{bb['xz']})"
           f"+{bb['xz']}*({bb['xy']}*{bb['yz']}-{bb['yy']}*{bb['xz']})")
    return f"""{name}c AS (SELECT {keys}, {",".join(f"avg({s}{k}) AS {s}{k}" for s in "pq" for k in "xyz")} FROM {src} GROUP BY ALL),
{name}h AS (SELECT {keys}, count(*) AS n, {h}, sum(pow(m.px-c.px,2)+pow(m.py-c.py,2)+pow(m.pz-c.pz,2)+pow(m.qx-c.qx,2)+pow(m.qy-c.qy,2)+pow(m.qz-c.qz,2)) AS e0
 FROM {src} m JOIN {name}c c USING {on} GROUP BY ALL),
{name}g AS (SELECT {keys}, n, e0, {g}, hxx*(hyy*hzz-hyz*hzy)-hxy*(hyx*hzz-hyz*hzx)+hxz*(hyx*hzy-hyy*hzx) AS det FROM {name}h),
{name}q AS (SELECT *, (gxx+gyy+gzz)/3 AS q0 FROM {name}g),
{name}p AS (SELECT *, sqrt((pow(gxx-q0,2)+pow(gyy-q0,2)+pow(gzz-q0,2)+2*(gxy*gxy+gxz*gxz+gyz*gyz))/6) AS p0 FROM {name}q),
{name}r AS (SELECT *, acos(greatest(-1,least(1,({det})/2)))/3 AS phi FROM {name}p),
{name}l AS (SELECT *, greatest(0,q0+2*p0*cos(phi)) AS l1, greatest(0,q0+2*p0*cos(phi+2*pi()/3)) AS l3 FROM {name}r),
{name} AS (SELECT {keys}, n, sqrt(greatest(0,e0-2*(sqrt(l1)+sqrt(greatest(0,3*q0-l1-l3))+sign(det)*sqrt(l3)))/n) AS rmsd FROM {name}l)"""


KB = with_(PTS, MATCHED, kabsch_sql("mt", "target,model"))


@query("kabsch_rmsd", KB + f"SELECT target, model, n, {R('rmsd', 'rmsd')} FROM kb")
def kabsch_rmsd(spark, sf):
    return ST.kabsch_rmsd(matched(spark, sf), KEYS).select(*KEYS, "n", r6("rmsd"))


@query("per_residue_deviation", KB + f"SELECT target, model, n, {R('rmsd', 'rmsd')} FROM kb")
def per_residue_deviation(spark, sf):
    p = points(spark, sf)
    d = ST.per_residue_deviation(others(p), reference(p), ["target"], ["model"])
    return d.groupBy(*KEYS).agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(F.pow("deviation", F.lit(2)))), "rmsd"))


@query("superpose_points", KB + f""", c AS (SELECT target, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts WHERE model=0 GROUP BY target)
SELECT kb.target, model, {R('rmsd', 'plain_rmsd')}, {R('cx', 'cx')}, {R('cy', 'cy')}, {R('cz', 'cz')} FROM kb JOIN c USING (target)""")
def superpose_points(spark, sf):
    p = points(spark, sf)
    moved = ST.superpose(others(p), reference(p), ["target"], ["model"])
    from ..functions.common import dist

    m = ST.match_points(moved, reference(p), ["target", "idx"])
    return m.groupBy(*KEYS).agg(r6(F.sqrt(F.avg(F.pow(dist("p", "q"), 2))), "plain_rmsd"), *[r6(F.avg(f"p{k}"), f"c{k}") for k in "xyz"])


STEPS = """stp AS (SELECT *, sqrt(pow(nx-x,2)+pow(ny-y,2)+pow(nz-z,2)) AS bond FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM pts
 WINDOW w AS (PARTITION BY target,model ORDER BY idx)) WHERE nx IS NOT NULL)"""
BOND = "bnd AS (SELECT target, model, avg(pow(bond-3.8,2)) AS bond_mse, avg(CASE WHEN bond>5 THEN 1.0 ELSE 0 END) AS fb, sum(pow(bond-3.8,2)) AS sb FROM stp GROUP BY ALL)"
SHAPE = f"""shp AS (SELECT target, model, count(*) AS n, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) AS rg, {PI_}*pow(count(*),1/{PI_}) AS tg FROM pts GROUP BY ALL)"""
IJ = """ij AS (SELECT a.target, a.model, a.idx AS i, b.idx AS j, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)) AS d FROM pts a JOIN pts b
 ON a.target=b.target AND a.model=b.model AND a.idx<b.idx)"""


@query("distance_stats", with_(PTS, SHAPE, IJ) + f"""SELECT s.target, s.model, {R('max(rg)', 'rg')}, {R('avg(d)', 'mean_distance')}, {R('max(d)', 'max_distance')},
 {R('max(d) FILTER (i=0 AND j=20)', 'end_to_end')} FROM shp s JOIN ij ON ij.target=s.target AND ij.model=s.model GROUP BY s.target, s.model""")
def distance_stats(spark, sf):
    p = points(spark, sf)
    d = ST.idx_pairs(p, KEYS).groupBy(*KEYS).agg(
        r6(F.avg("distance"), "mean_distance"), r6(F.max("distance"), "max_distance"),
        r6(F.max(F.when((F.col("i") == 0) & (F.col("j") == 20), F.col("distance"))), "end_to_end"))
    return p.groupBy(*KEYS).agg(r6(ST.radius_of_gyration(), "rg")).join(d, KEYS)


@query("bond_integrity", with_(PTS, STEPS, BOND) + f"SELECT target, model, {R('bond_mse', 'bond_mse')}, {R('fb', 'frac_broken')} FROM bnd")
def bond_integrity(spark, sf):
    return ST.bond_integrity(points(spark, sf), KEYS).select(*KEYS, r6("bond_mse"), r6("frac_broken"))


RB, RC, RFO = (num(C.RESIDUAL[k]) for k in ("Physical_Chemistry", "Chemistry", "Biochemistry"))
ENERGY = f"""en AS (SELECT s.target, s.model, {RB}*sb AS eb, {RC}*coalesce(c,0) AS ec, {RFO}*pow(rg-tg,2) AS ef, {RB}*sb+{RC}*coalesce(c,0)+{RFO}*pow(rg-tg,2) AS energy, bond_mse FROM shp s
 JOIN bnd USING (target,model) LEFT JOIN (SELECT target, model, sum(pow({num(ST.CLASH)}-d,2)) AS c FROM ij WHERE j-i>=2 AND d<{num(ST.CLASH)} GROUP BY ALL) USING (target,model))"""
EN = with_(PTS, STEPS, BOND, SHAPE, IJ, ENERGY)


@query("interface_energy", EN + f"SELECT target, model, {R('eb', 'e_bond')}, {R('ec', 'e_clash')}, {R('ef', 'e_fold')}, {R('energy', 'energy')} FROM en")
def interface_energy(spark, sf):
    return ST.interface_energy(points(spark, sf), KEYS).select(*KEYS, *[r6(k) for k in ("e_bond", "e_clash", "e_fold", "energy")])


@query("model_sanity", with_(PTS, STEPS, BOND, SHAPE) + f"""SELECT target, model, {R('rg', 'rg')}, {R('fb', 'frac_broken')}, rg>0.5*tg AND rg<2*tg AND fb<0.1 AS is_sane
 FROM shp JOIN bnd USING (target,model)""")
def model_sanity(spark, sf):
    return ST.model_sanity(points(spark, sf), KEYS).select(*KEYS, r6("rg"), r6("frac_broken"), "is_sane")


@query("termini_stress", with_(PTS, STEPS) + f"""SELECT target, model, {R('avg(abs(bond-3.8)) FILTER (idx<3 OR idx>=17)', 'termini')}, {R('avg(abs(bond-3.8)) FILTER (idx>=3 AND idx<17)', 'core')}
 FROM stp GROUP BY ALL""")
def termini_stress(spark, sf):
    return ST.termini_stress(points(spark, sf), KEYS).select(*KEYS, r6("termini"), r6("core"))


@query("tertiary_contacts", with_(PTS, IJ) + f"""SELECT target, i, j, {R('median(d)', 'median')} FROM ij WHERE j-i>=7 GROUP BY target, i, j
 HAVING median(d)<{num(C.PHI * C.CONTACT)} AND stddev_pop(d)<={P}""")
def tertiary_contacts(spark, sf):
    return ST.tertiary_contacts(points(spark, sf), ["target"], ["model"]).select("target", "i", "j", r6("median"))


MP = """mp AS (SELECT a.target, a.model AS m1, b.model AS m2, a.x AS px, a.y AS py, a.z AS pz, b.x AS qx, b.y AS qy, b.z AS qz FROM pts a JOIN pts b
 ON a.target=b.target AND a.idx=b.idx AND a.model<b.model)"""
MR = [PTS, MP, kabsch_sql("mp", "target,m1,m2", "mr")]


def pair_rmsd(spark, sf):
    return ST.model_pairs(points(spark, sf).select("target", "model", "idx", "x", "y", "z"), ["target"], "model")


@query("medoid", with_(*MR) + f""", tt AS (SELECT target, model, sum(rmsd) AS total FROM (SELECT target, m1 AS model, rmsd FROM mr UNION ALL SELECT target, m2, rmsd FROM mr) GROUP BY ALL)
SELECT target, model AS medoid, {R('total', 'total', 5)} FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(total,9), model) AS k FROM tt) WHERE k=1""")
def medoid(spark, sf):
    return ST.medoid(pair_rmsd(spark, sf), ["target"]).select("target", "medoid", r6("total", digits=5))


def scores(p):
    """Alignment scores of the models: deterministic, distinct per model."""
    return p.select("target", "model").distinct().withColumn("score", 1.0 / (1.0 + (F.col("model") * 5 + F.col("target")) % 8))


SCORE = "sco AS (SELECT DISTINCT target, model, 1.0::DOUBLE/(1+(model*5+target)%8) AS score FROM pts)"


LEADERS = f"""nr AS (SELECT target, a, list(b) AS near FROM (SELECT target, m1 AS a, m2 AS b FROM mr WHERE rmsd<={num(C.PHI**2)} UNION ALL SELECT target, m2, m1 FROM mr WHERE rmsd<={num(C.PHI**2)}) GROUP BY ALL),
od AS (SELECT sco.target, model, coalesce(near,[]) AS near, row_number() OVER (PARTITION BY sco.target ORDER BY score DESC, model) AS k FROM sco LEFT JOIN nr ON nr.target=sco.target AND a=model),
lr AS (SELECT DISTINCT target, 0 AS k, []::BIGINT[] AS leaders FROM od UNION ALL SELECT lr.target, lr.k+1, CASE WHEN len(list_intersect(leaders,near))>0 THEN leaders ELSE list_append(leaders,model) END
 FROM lr JOIN od ON od.target=lr.target AND od.k=lr.k+1)"""


@query("leader_cluster", with_(*MR, SCORE, LEADERS).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT od.target, model, list_filter(leaders, lambda x: x=model OR list_contains(near,x))[1] AS leader
 FROM od JOIN (SELECT target, max_by(leaders,k) AS leaders FROM lr GROUP BY target) USING (target)""")
def leader_cluster(spark, sf):
    p = points(spark, sf)
    return ST.leader_cluster(scores(p), pair_rmsd(spark, sf))


@query("state_representatives")
def state_representatives(spark, sf):
    """Per leader cluster: best score, lowest energy, and the largest cluster's intact members."""
    from ..operators.templates import state_representatives as op

    p = points(spark, sf)
    pairs = pair_rmsd(spark, sf)
    cl = ST.leader_cluster(scores(p), pairs)
    en = ST.interface_energy(p, KEYS).select(*KEYS, "energy").join(ST.bond_integrity(p, KEYS), KEYS)
    return op(cl, scores(p).join(en, KEYS), pairs)


@query("superposed_mask")
def superposed_mask(spark, sf):
    p = points(spark, sf)
    return ST.superposed_mask(p.select("target", "model", "idx", "x", "y", "z"), reference(p), ["target"], ["model"]).select(
        "target", "idx", r6("spread"), "masked")


@query("consensus_coords")
def consensus_coords(spark, sf):
    """The consensus of each target's models by every rule; the chain is two residues longer than the models."""
    p = points(spark, sf)
    high = p.groupBy(*KEYS).agg(F.max("z").alias("top"))
    measured = p.join(high, KEYS).filter("z < top").select(*KEYS, "idx", "x", "y", "z")
    s = F.col("score")
    models = scores(p).join(ST.interface_energy(p, KEYS).select(*KEYS, "energy"), KEYS).select(
        *KEYS, "score", (0.4 + 0.6 * s).alias("identity"), (1.0 / (1.0 + F.col("model") / 8)).alias("coverage"), "energy")
    measured, models = stored(measured), stored(models)
    n = models.select("target").distinct().withColumn("n", F.lit(23))
    out = None
    for rule in ST.RULES:
        c = ST.template_consensus(measured, models, n, rule, ["target"], ["model"]).select(F.lit(rule).alias("rule"), "target", "idx", r6("x"), r6("y"), r6("z"))
        out = c if out is None else out.unionByName(c)
    return out


@query("consensus_atoms")
def consensus_atoms(spark, sf):
    p = points(spark, sf)
    a = p.select("target", "model", "idx", F.concat(F.lit("C"), (F.col("idx") % 4).cast("string")).alias("name"), "x", "y", "z")
    c = ST.consensus_atoms(a, reference(p), ["target"], ["model"], F.col("model") == 0)
    return c.select("target", "idx", "name", "n_models", "agree", r6("x"), r6("y"), r6("z"))


@query("loop_rebuild")
def loop_rebuild(spark, sf):
    """Residues on which the superposed models disagree, rebuilt from the models fitted on the others."""
    p = points(spark, sf)
    all_ = p.select("target", "model", "idx", "x", "y", "z")
    mask = ST.superposed_mask(all_, reference(p), ["target"], ["model"]).select("target", "idx", "masked")
    return ST.loop_rebuild(all_, reference(p), mask, ["target"], ["model"]).select("target", "idx", r6("x"), r6("y"), r6("z"))


KEEP = "(idx*7+model*3+target)%5<>0 AND idx BETWEEN 2 AND 17"
LEN = "SELECT unnest(range(21)) AS idx"
FILL = f"""ms AS (SELECT * FROM pts WHERE {KEEP}), gr AS (SELECT DISTINCT target, model FROM ms),
an AS (SELECT gr.target, gr.model, g.idx, (SELECT max(idx) FROM ms WHERE ms.target=gr.target AND ms.model=gr.model AND ms.idx<=g.idx) AS li,
 (SELECT min(idx) FROM ms WHERE ms.target=gr.target AND ms.model=gr.model AND ms.idx>=g.idx) AS ri FROM gr, ({LEN}) g),
rkk AS (SELECT *, row_number() OVER (PARTITION BY target,model ORDER BY idx) AS f, row_number() OVER (PARTITION BY target,model ORDER BY idx DESC) AS b FROM ms)"""


def fill_axis(k):
    def walk(anchor, a, b):
        return (f"{anchor}.{k}+(an.idx-{anchor}.idx)*3.8*({b}.{k}-{a}.{k})/(sqrt(pow({b}.x-{a}.x,2)+pow({b}.y-{a}.y,2)+pow({b}.z-{a}.z,2))+1e-9)")
    return (f"CASE WHEN li IS NULL THEN {walk('f1', 'f1', 'f2')} WHEN ri IS NULL THEN {walk('b1', 'b2', 'b1')} WHEN li=ri THEN l.{k} "
            f"ELSE l.{k}+(r.{k}-l.{k})*(an.idx-li)/(ri-li)::DOUBLE END AS {k}")


FILLED = f"""fl AS (SELECT an.target, an.model, an.idx, {",".join(fill_axis(k) for k in "xyz")} FROM an
 LEFT JOIN ms l ON l.target=an.target AND l.model=an.model AND l.idx=li LEFT JOIN ms r ON r.target=an.target AND r.model=an.model AND r.idx=ri
 JOIN rkk f1 ON f1.target=an.target AND f1.model=an.model AND f1.f=1 JOIN rkk f2 ON f2.target=an.target AND f2.model=an.model AND f2.f=2
 JOIN rkk b1 ON b1.target=an.target AND b1.model=an.model AND b1.b=1 JOIN rkk b2 ON b2.target=an.target AND b2.model=an.model AND b2.b=2)"""


def lengths(p):
    return p.select(*KEYS).distinct().withColumn("n", F.lit(21))


@query("gap_interpolate", with_(PTS, FILL, FILLED) + f"SELECT target, model, idx, {R('x', 'x')}, {R('y', 'y')}, {R('z', 'z')} FROM fl")
def gap_interpolate(spark, sf):
    p = points(spark, sf)
    return ST.gap_fill(p.filter(KEEP), KEYS, lengths(p)).select(*KEYS, "idx", r6("x"), r6("y"), r6("z"))


@query("transfer_by_alignment", with_(PTS, FILL, FILLED) + f"""SELECT f.target, f.model, f.idx, {",".join(R(f"CASE WHEN n>=12 THEN {k} END", k) for k in "xyz")} FROM fl f
 JOIN (SELECT target, model, count(*) AS n FROM ms GROUP BY ALL) USING (target,model)""")
def transfer_by_alignment(spark, sf):
    """Aligned points carried to the query index; NULL coordinates when too few pairs."""
    p = points(spark, sf)
    kept = p.filter(KEEP)
    n = kept.groupBy(*KEYS).agg(F.count("*").alias("np"))
    filled = ST.gap_fill(kept, KEYS, lengths(p)).join(n, KEYS)
    return filled.select(*KEYS, "idx", *[r6(F.when(F.col("np") >= 12, F.col(k)), k) for k in "xyz"])


@query("soft_termini", with_(PTS, FILL.replace(KEEP, "idx BETWEEN 1 AND 17"), FILLED) + f""", c AS (SELECT target, model, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM fl GROUP BY ALL)
SELECT target, model, idx, {R('x-cx', 'x')}, {R('y-cy', 'y')}, {R('z-cz', 'z')} FROM fl JOIN c USING (target,model)""")
def soft_termini(spark, sf):
    p = points(spark, sf)
    return ST.soft_termini(p.select(*KEYS, "idx", "x", "y", "z"), KEYS, lengths(p)).select(*KEYS, "idx", r6("x"), r6("y"), r6("z"))


SPLITS = """sg AS (SELECT mt.*, k, (idx>=k)::INT AS side FROM mt, (SELECT unnest(range(6,15)) AS k))"""


TURN = """tn AS (SELECT target, model, idx, (ax*bx+ay*by_+az*bz)/(sqrt(ax*ax+ay*ay+az*az)*sqrt(bx*bx+by_*by_+bz*bz)+1e-12) AS cs FROM (SELECT target, model, idx,
 px-lag(px,4) OVER w AS ax, py-lag(py,4) OVER w AS ay, pz-lag(pz,4) OVER w AS az, lead(px,4) OVER w-px AS bx, lead(py,4) OVER w-py AS by_, lead(pz,4) OVER w-pz AS bz FROM mt WINDOW w AS (PARTITION BY target,model ORDER BY idx))),
tb AS (SELECT target, model, idx AS turn, cs FROM (SELECT *, row_number() OVER (PARTITION BY target,model ORDER BY round(cs,9), idx) AS r FROM tn WHERE cs IS NOT NULL) WHERE r=1)"""


@query("hinge_split", with_(PTS, MATCHED, SPLITS, kabsch_sql("sg", "target,model,k,side", "hs"), TURN) + f""", w AS (SELECT target, model, k, max(rmsd) AS worst FROM hs GROUP BY ALL)
SELECT target, model, k AS split, {R('worst', 'worst')}, turn, {R('cs', 'turn_cos')} FROM (SELECT *, row_number() OVER (PARTITION BY target,model ORDER BY round(worst,9), k) AS r FROM w) JOIN tb USING (target,model) WHERE r=1""")
def hinge_split(spark, sf):
    m = matched(spark, sf)
    turn = ST.sharpest_turn(m.select(*KEYS, "idx", *[F.col(f"p{k}").alias(k) for k in "xyz"]), KEYS)
    return ST.hinge_split(m, KEYS).join(turn, KEYS).select(*KEYS, F.col("split").cast("bigint").alias("split"), r6("worst"),
                                                           F.col("turn").cast("bigint").alias("turn"), r6("turn_cos"))


QUAD = """qd AS (SELECT target, model, idx, """ + ",".join(
    f"lead({k},{d + 1}) OVER w-{'lead(' + k + ',' + str(d) + ') OVER w' if d else k} AS {k}{d}" for d in range(3) for k in "xyz"
) + " FROM pts WINDOW w AS (PARTITION BY target,model ORDER BY idx))"


@query("helix_handedness", with_(PTS, QUAD) + f"""SELECT target, model, {R('''sum(((y0*z1-z0*y1)*x2+(z0*x1-x0*z1)*y2+(x0*y1-y0*x1)*z2)/(sqrt(x0*x0+y0*y0+z0*z0)*sqrt(x1*x1+y1*y1+z1*z1)*sqrt(x2*x2+y2*y2+z2*z2)))''', 'signed_volume')}
 FROM qd WHERE x2 IS NOT NULL AND idx>=model AND idx<=model+9 GROUP BY ALL""")
def helix_handedness(spark, sf):
    p = points(spark, sf)
    hel = p.select(*KEYS).distinct().select(*KEYS, F.col("model").alias("start"), (F.col("model") + 12).alias("end"))
    return ST.helix_handedness(p.select(*KEYS, "idx", "x", "y", "z"), hel, KEYS).select(*KEYS, r6("signed_volume"))


FR = """fr0 AS (SELECT target, model, idx, nx-bx AS ax, ny-by_ AS ay, nz-bz AS az, (y-by_)*(nz-z)-(z-bz)*(ny-y) AS mx, (z-bz)*(nx-x)-(x-bx)*(nz-z) AS my, (x-bx)*(ny-y)-(y-by_)*(nx-x) AS mz FROM
 (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS by_, lag(z) OVER w AS bz, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM pts WINDOW w AS (PARTITION BY target,model ORDER BY idx))),
fr1 AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS la, sqrt(mx*mx+my*my+mz*mz) AS lm FROM fr0),
fr AS (SELECT target, model, idx, ax/la AS ex_x, ay/la AS ex_y, az/la AS ex_z, mx/lm AS ez_x, my/lm AS ez_y, mz/lm AS ez_z FROM fr1)"""


@query("residue_frames", with_(PTS, FR) + "SELECT target, model, idx, " + ",".join(
    [R(f"e{a}_{k}", f"e{a}_{k}") for a in "xz" for k in "xyz"] + [
        R("ez_y*ex_z-ez_z*ex_y", "ey_x"), R("ez_z*ex_x-ez_x*ex_z", "ey_y"), R("ez_x*ex_y-ez_y*ex_x", "ey_z")]) + " FROM fr")
def residue_frames(spark, sf):
    f = ST.residue_frames(points(spark, sf), KEYS)
    return f.select(*KEYS, "idx", *[r6(f"e{a}_{k}") for a in "xyz" for k in "xyz"])




SSG = """rg(kind,s,e) AS (VALUES ('H',0,7),('E',9,13),('H',14,20)), dd AS (SELECT target, model, idx, sqrt(pow(lead(x) OVER w-x,2)+pow(lead(y) OVER w-y,2)+pow(lead(z) OVER w-z,2)) AS d1,
 sqrt(pow(lead(x,4) OVER w-x,2)+pow(lead(y,4) OVER w-y,2)+pow(lead(z,4) OVER w-z,2)) AS d4 FROM pts WINDOW w AS (PARTITION BY target,model ORDER BY idx)),
sg AS (SELECT target, model, avg(CASE WHEN kind='H' AND idx<least(e-3,17) THEN exp(-abs(d4-sqrt(36+pow(4.6*sin(200*pi()/180),2)))/""" + P + """) WHEN kind='E' AND idx<least(e,20) THEN exp(-abs(d1-3.8)) END) AS m
 FROM dd JOIN rg ON idx BETWEEN s AND e GROUP BY ALL)"""


@query("ss_geometry", with_(PTS, SHAPE, SSG) + f"SELECT target, model, {R(f'm*exp(-abs(rg-tg)/({P}*{num(C.E)}))', 'ss_geometry')} FROM sg JOIN shp USING (target, model)")
def ss_geometry(spark, sf):
    p = points(spark, sf)
    spans = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end")) for k, a, b in (("H", 0, 7), ("E", 9, 13), ("H", 14, 20))])
    rg = p.select(*KEYS).distinct().select(*KEYS, F.explode(spans).alias("r")).select(*KEYS, "r.*")
    return ST.ss_geometry(p.select(*KEYS, "idx", "x", "y", "z"), rg, KEYS).select(*KEYS, r6("ss_geometry"))
