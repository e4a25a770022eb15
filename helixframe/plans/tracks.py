"""Track queries: events are detections of cells, one cell per user, six-hour frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import tracks as T
from ..operators.ranking import with_quantiles
from ..session import stored
from .base import P, R, num, query, r6, table, with_

SZ, SY, SX = (num(s) for s in C.SCALE_ZYX)
DET = """det AS (SELECT event_id AS det_id, user_id, user_id%4 AS dataset, date_diff('day', DATE '2024-01-01', ts::DATE)*4+hour(ts)//6 AS t, (value*100)::BIGINT%7 AS z,
 (user_id%13)*40+event_id%9 AS y, (user_id//13)*40+floor(value*10)::BIGINT%9 AS x, CASE WHEN event_type='error' THEN 2 ELSE 1 END AS tier, value AS intensity FROM events),
um AS (SELECT *, z*""" + SZ + " AS uz, y*" + SY + " AS uy, x*" + SX + """ AS ux FROM det),
node AS (SELECT dataset, det_id AS id, user_id, t, z, y+3 AS y, x+1 AS x FROM det WHERE tier=1),
fst AS (SELECT dataset, user_id, t, min(id) AS lo, max(id) AS hi FROM node GROUP BY ALL),
edge AS (SELECT a.dataset, a.lo AS parent, b.lo AS child FROM fst a JOIN fst b ON a.dataset=b.dataset AND a.user_id=b.user_id AND b.t=a.t+1
 UNION SELECT a.dataset, a.lo, b.hi FROM fst a JOIN fst b ON a.dataset=b.dataset AND a.user_id=b.user_id AND b.t=a.t+1)"""
UD = "sqrt(pow(a.uz-b.uz,2)+pow(a.uy-b.uy,2)+pow(a.ux-b.ux,2))"


def dets(spark, sf):
    e = table(spark, sf, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    tenths = F.floor(F.col("value") * 10)
    return e.select(
        F.col("event_id").alias("det_id"), "user_id", (F.col("user_id") % 4).alias("dataset"),
        (F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 4 + F.floor(F.hour("ts") / 6)).alias("t"),
        (cents % 7).alias("z"), ((F.col("user_id") % 13) * 40 + F.col("event_id") % 9).alias("y"),
        (F.floor(F.col("user_id") / 13) * 40 + tenths % 9).alias("x"),
        F.when(F.col("event_type") == "error", 2).otherwise(1).alias("tier"), F.col("value").alias("intensity"))


def nodes(d):
    return d.filter("tier = 1").select("dataset", F.col("det_id").alias("id"), "user_id", "t", "z", (F.col("y") + 3).alias("y"), (F.col("x") + 1).alias("x"))


def edges(n):
    """Parent to child one frame later; a second event of the child frame is a daughter."""
    f = n.groupBy("dataset", "user_id", "t").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    nxt = f.select("dataset", "user_id", (F.col("t") - 1).alias("t"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("child"))
    return f.join(nxt, ["dataset", "user_id", "t"]).select("dataset", F.col("lo").alias("parent"), "child")


STP = f"""stp AS (SELECT e.dataset, sqrt(pow((a.z-b.z)*{SZ},2)+pow((a.y-b.y)*{SY},2)+pow((a.x-b.x)*{SX},2)) AS step FROM edge e JOIN node a ON a.dataset=e.dataset AND a.id=parent JOIN node b ON b.dataset=e.dataset AND b.id=child)"""


@query("track_stats", with_(DET, STP) + f""", od AS (SELECT dataset, parent, count(*) AS k FROM edge GROUP BY ALL), ed AS (SELECT dataset, sum(k)::BIGINT AS n_edges, count(*) FILTER (k>=2) AS n_divisions FROM od GROUP BY dataset),
 sd AS (SELECT dataset, median(step) AS md, avg(step) AS mn FROM stp GROUP BY dataset)
SELECT n.dataset, count(*) AS n_nodes, min(t) AS t_min, max(t) AS t_max, {R(f'(max(z)-min(z))*{SZ}', 'span_z')}, {R(f'(max(y)-min(y))*{SY}', 'span_y')}, {R(f'(max(x)-min(x))*{SX}', 'span_x')},
 n_edges, n_divisions, {R('md', 'step_median')}, {R('mn', 'step_mean')} FROM node n JOIN ed USING (dataset) JOIN sd USING (dataset) GROUP BY n.dataset, n_edges, n_divisions, md, mn""")
def track_stats(spark, sf):
    n = nodes(dets(spark, sf))
    return T.track_stats(n, edges(n)).select("dataset", "n_nodes", "t_min", "t_max", "n_edges", "n_divisions", *[
        r6(k) for k in ("span_z", "span_y", "span_x", "step_median", "step_mean")])


LISTED = [0, 1, 2, 3, 99]


@query("track_inventory", with_(DET) + """SELECT d.dataset, count(*) AS n_nodes, (SELECT count(*) FROM edge e WHERE e.dataset=d.dataset) AS n_edges,
 CASE WHEN (SELECT count(*) FROM edge e WHERE e.dataset=d.dataset)=0 THEN 'no_edges' END AS error FROM node d GROUP BY d.dataset
 UNION ALL SELECT 99, 0, 0, 'no_nodes'""")
def track_inventory(spark, sf):
    """Counts per listed dataset; a dataset without nodes keeps an error row."""
    n = nodes(dets(spark, sf))
    listed = spark.createDataFrame([(k,) for k in LISTED], "dataset long")
    a = n.groupBy("dataset").agg(F.count("*").alias("n_nodes"))
    b = edges(n).groupBy("dataset").agg(F.count("*").alias("n_edges"))
    j = listed.join(a, "dataset", "left").join(b, "dataset", "left")
    return j.select("dataset", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
                    F.when(F.col("n_nodes").isNull(), "no_nodes").when(F.col("n_edges").isNull(), "no_edges").alias("error"))


@query("track_energy", with_(DET, STP) + f""", m AS (SELECT dataset, median(step) AS med FROM stp GROUP BY dataset)
SELECT dataset, count(*) AS n_steps, {R('max(med)', 'median')}, {R(f"{num(C.RESIDUAL['Biochemistry'])}*avg(pow(step-med,2))", 'energy')}, {R('avg(abs(step-med))', 'mae')} FROM stp JOIN m USING (dataset) GROUP BY dataset""")
def track_energy(spark, sf):
    n = nodes(dets(spark, sf))
    return T.track_energy(n, edges(n)).select("dataset", "n_steps", r6("median"), r6("energy"), r6("mae"))


CAND = f"""cand AS (SELECT a.dataset, a.t, a.det_id AS src, b.det_id AS dst, {UD} AS d, {UD}*(1+abs(a.intensity-b.intensity)/(greatest(a.intensity,b.intensity)+1e-6)) AS cost FROM um a JOIN um b
 ON a.dataset=b.dataset AND b.t=a.t+1 AND {UD}<={num(C.STEP_UM)})"""


@query("frame_step_join", with_(DET, CAND) + f"SELECT dataset, t, src, dst, {R('d', 'd')}, {R('cost', 'cost')} FROM cand")
def frame_step_join(spark, sf):
    d = dets(spark, sf)
    return T.frame_step_join(d, d, C.STEP_UM).select("dataset", "t", "src", "dst", r6("d"), r6("cost"))


GT = f"""gu AS (SELECT dataset, id, t, z*{SZ} AS uz, y*{SY} AS uy, x*{SX} AS ux FROM node), gm AS (SELECT a.dataset, a.t, a.id AS gt, b.det_id, b.tier, {UD} AS d FROM gu a JOIN um b
 ON a.dataset=b.dataset AND a.t=b.t AND {UD}<=7)"""


@query("frame_match_join", with_(DET, GT) + f"SELECT dataset, t, gt, det_id, {R('d', 'd')} FROM gm")
def frame_match_join(spark, sf):
    d = dets(spark, sf)
    return T.frame_match_join(nodes(d), d).select("dataset", "t", "gt", "det_id", r6("d"))


@query("isolated_anti_join", with_(DET) + f"""SELECT dataset, det_id FROM um a WHERE tier=2 AND NOT EXISTS (SELECT 1 FROM um b WHERE b.dataset=a.dataset AND b.t=a.t AND b.tier=1 AND {UD}<={num(C.NMS_UM)})""")
def isolated_anti_join(spark, sf):
    return T.isolated(dets(spark, sf)).select("dataset", "det_id")


@query("unmatched_anti_join", with_(DET, CAND) + """SELECT det_id, 'no_next' AS side FROM det WHERE det_id NOT IN (SELECT src FROM cand)
 UNION ALL SELECT det_id, 'no_previous' FROM det WHERE det_id NOT IN (SELECT dst FROM cand)""")
def unmatched_anti_join(spark, sf):
    d = dets(spark, sf)
    c = T.frame_step_join(d, d, C.STEP_UM)
    out = d.join(c.select(F.col("src").alias("det_id")), "det_id", "left_anti").select("det_id", F.lit("no_next").alias("side"))
    return out.unionByName(d.join(c.select(F.col("dst").alias("det_id")), "det_id", "left_anti").select("det_id", F.lit("no_previous").alias("side")))


@query("lineage_edge_join", with_(DET, CAND, GT) + """, g2p AS (SELECT dataset, gt, det_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset, gt ORDER BY round(d,9), det_id) AS k FROM gm) WHERE k=1),
 pe AS (SELECT DISTINCT dataset, least(src,dst) AS lo, greatest(src,dst) AS hi FROM cand)
SELECT e.dataset, count(*) AS n_gt_edges, count(pe.lo) AS n_matched FROM edge e LEFT JOIN g2p a ON a.dataset=e.dataset AND a.gt=parent LEFT JOIN g2p b ON b.dataset=e.dataset AND b.gt=child
 LEFT JOIN pe ON pe.dataset=e.dataset AND lo=least(a.det_id,b.det_id) AND hi=greatest(a.det_id,b.det_id) AND a.det_id IS NOT NULL AND b.det_id IS NOT NULL GROUP BY e.dataset""")
def lineage_edge_join(spark, sf):
    from ..operators.spatial import nearest

    d = dets(spark, sf)
    n = nodes(d)
    m = nearest(T.frame_match_join(n, d), ["dataset", "gt"], "det_id")
    return T.lineage_edges(edges(n), m, T.frame_step_join(d, d, C.STEP_UM))


@query("link_frames")
def link_frames(spark, sf):
    return T.link_frames(dets(spark, sf))


@query("link_residual_gate")
def link_residual_gate(spark, sf):
    return T.link_residual_gate(dets(spark, sf))


@query("link_staged")
def link_staged(spark, sf):
    return T.link_staged(dets(spark, sf))


def greedy_sql(passes: list[tuple[float, int]]) -> str:
    """Passes of (radius, tier): in id order the truth rows left take their nearest detection left, frame by frame."""
    out, done = [], "SELECT NULL::BIGINT AS dataset, NULL::BIGINT AS gt, NULL::BIGINT AS det_id, NULL::DOUBLE AS d WHERE false"
    for i, (r, tier) in enumerate(passes):
        out.append(f"""k{i} AS MATERIALIZED ({done}),
o{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY dataset, t ORDER BY gt) AS k FROM (SELECT dataset, t, gt, list({{'det_id': det_id, 'd': d}} ORDER BY d, det_id) AS c FROM gm
 WHERE d<={num(r)} AND tier={tier} AND NOT EXISTS (SELECT 1 FROM k{i} x WHERE x.dataset=gm.dataset AND x.gt=gm.gt) AND NOT EXISTS (SELECT 1 FROM k{i} x WHERE x.dataset=gm.dataset AND x.det_id=gm.det_id) GROUP BY dataset, t, gt)),
r{i} AS (SELECT DISTINCT dataset, t, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS gt, NULL::STRUCT(det_id BIGINT, d DOUBLE) AS got FROM o{i}
 UNION ALL SELECT dataset, t, k, CASE WHEN got IS NULL THEN used ELSE list_append(used, got.det_id) END, gt, got FROM (SELECT o.dataset, o.t, o.k, used, o.gt, list_filter(c, lambda x: NOT list_contains(used, x.det_id))[1] AS got
  FROM r{i} r JOIN o{i} o ON o.dataset=r.dataset AND o.t=r.t AND o.k=r.k+1))""")
        done = f"SELECT * FROM k{i} UNION ALL SELECT dataset, gt, got.det_id, got.d FROM r{i} WHERE got IS NOT NULL"
    return ",\n".join(out) + ",\nfound AS (" + done + ")"


GREEDY = greedy_sql([(r, tier) for r in (C.NMS_UM, C.MATCH_UM) for tier in (1, 2)])


@query("greedy_match", with_(DET, GT, GREEDY).replace("WITH ", "WITH RECURSIVE ", 1) + f"SELECT dataset, gt, det_id, {R('d', 'd')} FROM found")
def greedy_match(spark, sf):
    d = dets(spark, sf)
    return T.greedy_match(nodes(d), d, seed=C.NMS_UM, primary=True, fill=True).select("dataset", "gt", "det_id", r6("d"))


@query("centroid_recall")
def centroid_recall(spark, sf):
    d = dets(spark, sf)
    m = with_quantiles(stored(T.optimal_match(nodes(d), d)), ["dataset"], {"median_um": ("d", 0.5)}, F.count("*").alias("n_matched"), F.avg("d").alias("mean_um"))
    n = nodes(d).groupBy("dataset").agg(F.count("*").alias("n_gt"))
    return n.join(m, "dataset", "left").select("dataset", "n_gt", "n_matched", r6(F.col("n_matched") / F.col("n_gt"), "recall"), r6("median_um"), r6("mean_um"))


VOX = """vox AS (SELECT l_suppkey%4 AS dataset, l_linenumber AS t, l_partkey%4 AS z, l_quantity::BIGINT%20 AS y, l_orderkey%20 AS x, (sum(l_quantity)*10)::BIGINT AS v FROM lineitem GROUP BY ALL)"""


def voxels(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 4).alias("dataset"), F.col("l_linenumber").alias("t"), (F.col("l_partkey") % 4).alias("z"),
                      (F.col("l_quantity").cast("bigint") % 20).alias("y"), (F.col("l_orderkey") % 20).alias("x")).agg(
        (F.sum("l_quantity") * 10).cast("bigint").alias("v"))


@query("frame_stats", with_(VOX) + f"""SELECT dataset, t, min(v) AS v_min, max(v) AS v_max, {R('avg(v)', 'v_mean', 4)}, {R('quantile_cont(v,0.5)', 'v_median')}, {R('quantile_cont(v,0.99)', 'p99')},
 {R('quantile_cont(v,0.999)', 'p999')} FROM vox GROUP BY dataset, t""")
def frame_stats(spark, sf):
    return T.frame_stats(voxels(spark, sf)).select("dataset", "t", "v_min", "v_max", r6("v_mean", digits=4), r6(F.col("q")[0], "v_median"),
                                                   r6(F.col("q")[1], "p99"), r6(F.col("q")[2], "p999"))


@query("mad_threshold", with_(VOX) + f""", m AS (SELECT dataset, t, median(v) AS med FROM vox GROUP BY ALL), md AS (SELECT dataset, t, med, median(abs(v-med))+1e-6 AS mad FROM vox JOIN m USING (dataset,t) GROUP BY ALL),
 o AS (SELECT dataset, t, med, mad, avg(CASE WHEN v>=med+{P}*mad THEN 1.0 ELSE 0 END) AS ov FROM vox JOIN md USING (dataset,t) GROUP BY ALL)
SELECT dataset, t, {R('med', 'med')}, {R('mad', 'mad')}, {R(f'med+mad*(CASE WHEN ov>1/{P} THEN {P}*{P} ELSE {P} END)', 'threshold')} FROM o""")
def mad_threshold(spark, sf):
    return T.mad_threshold(voxels(spark, sf)).select("dataset", "t", r6("med"), r6("mad"), r6("threshold"))


@query("sample_intensity", with_(VOX) + """, p AS (SELECT event_id, user_id%4 AS dataset, user_id%7+1 AS t, value/100 AS z, value/10 AS y, event_id%23*0.9 AS x FROM events),
 s AS (SELECT dataset, max(z) AS mz, max(y) AS my, max(x) AS mx FROM vox GROUP BY dataset)
SELECT event_id, v FROM (SELECT event_id, dataset, t, greatest(0,least(round_even(p.z,0)::BIGINT,mz)) AS z, greatest(0,least(round_even(p.y,0)::BIGINT,my)) AS y, greatest(0,least(round_even(p.x,0)::BIGINT,mx)) AS x FROM p JOIN s USING (dataset)) q
 LEFT JOIN vox USING (dataset,t,z,y,x)""")
def sample_intensity(spark, sf):
    p = table(spark, sf, "events").select("event_id", (F.col("user_id") % 4).alias("dataset"), (F.col("user_id") % 7 + 1).alias("t"),
                                          (F.col("value") / 100).alias("z"), (F.col("value") / 10).alias("y"), (F.col("event_id") % 23 * 0.9).alias("x"))
    return T.sample_intensity(p, voxels(spark, sf)).select("event_id", "v")


def _pass_sql(axis: str, source: str, name: str) -> str:
    """One smoothing pass: every cell gathers its mirrored neighbours."""
    w = T._kernel(T.SMOOTH[axis])
    rest = [k for k in "zyx" if k != axis]
    values = ",".join(f"({o - len(w) // 2},{num(x)})" for o, x in enumerate(w))
    return f"""{name} AS (SELECT g.dataset, g.t, g.z, g.y, g.x, g.nz, g.ny, g.nx, sum(k.w*s.v) AS v FROM {source} g, (VALUES {values}) k(o,w), {source} s
 WHERE s.dataset=g.dataset AND s.t=g.t AND {" AND ".join(f"s.{r}=g.{r}" for r in rest)} AND s.{axis}=(CASE WHEN g.{axis}+o<0 THEN -g.{axis}-o-1
 WHEN g.{axis}+o>=g.n{axis} THEN 2*g.n{axis}-1-g.{axis}-o ELSE g.{axis}+o END) GROUP BY ALL)"""


def _maxima_sql(source: str, name: str) -> str:
    """Cells that are the largest of their box and reach the threshold; the grid is dense, so rows are steps."""
    parts, value = [], "v"
    for axis, h in T._half_box(2, 0).items():
        rest = ",".join(k for k in "zyx" if k != axis)
        top = f"{name}_{axis}"
        parts.append(f"{top} AS (SELECT *, max({value}) OVER (PARTITION BY dataset, t, {rest} ORDER BY {axis} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS m{axis} FROM {source})")
        source, value = top, f"m{axis}"
    return ",\n".join([*parts, f"{name} AS (SELECT dataset, t, z, y, x FROM {source} WHERE v={value} AND v>=threshold)"])


def _in_box(a: str, b: str, half: dict, scale: int = 1) -> str:
    return " AND ".join([f"{a}.dataset={b}.dataset AND {a}.t={b}.t", *[f"abs({a}.{k}-{b}.{k}{'' if k == 'z' else f'*{scale}'})<={h}" for k, h in half.items()]])


PEAKS = f"""shp AS (SELECT dataset, t, max(z)+1 AS fz, max(y)+1 AS fy, max(x)+1 AS fx FROM vox GROUP BY ALL),
g0 AS (SELECT dataset, t, z, y, x, fz AS nz, (fy+1)//2 AS ny, (fx+1)//2 AS nx FROM shp, LATERAL (SELECT unnest(range(fz)) AS z), LATERAL (SELECT unnest(range((fy+1)//2)) AS y), LATERAL (SELECT unnest(range((fx+1)//2)) AS x)),
g AS (SELECT g0.*, coalesce(vox.v,0)::DOUBLE AS v FROM g0 LEFT JOIN vox ON vox.dataset=g0.dataset AND vox.t=g0.t AND vox.z=g0.z AND vox.y=2*g0.y AND vox.x=2*g0.x),
{_pass_sql("z", "g", "s1")},
{_pass_sql("y", "s1", "s2")},
{_pass_sql("x", "s2", "s3")},
sm AS (SELECT dataset, t, z, y, x, round(v,6) AS v FROM s3),
pm AS (SELECT dataset, t, median(v) AS med FROM sm GROUP BY ALL), pd AS (SELECT dataset, t, med, median(abs(v-med))+1e-6 AS mad FROM sm JOIN pm USING (dataset,t) GROUP BY ALL),
po AS (SELECT dataset, t, med, mad, avg(CASE WHEN v>=med+{P}*mad THEN 1.0 ELSE 0 END) AS ov FROM sm JOIN pd USING (dataset,t) GROUP BY ALL),
pt AS (SELECT dataset, t, round(med+mad*(CASE WHEN ov>1/{P} THEN {P}*{P} ELSE {P} END),6) AS threshold FROM po),
one AS (SELECT sm.*, threshold FROM sm JOIN pt USING (dataset,t)),
{_maxima_sql("one", "first")},
two AS (SELECT one.dataset, one.t, one.z, one.y, one.x, CASE WHEN EXISTS (SELECT 1 FROM first WHERE {_in_box("first", "one", T._half_box(2, 1))}) THEN 0 ELSE one.v END AS v, threshold FROM one),
{_maxima_sql("two", "second")},
pk AS (SELECT *, 1 AS tier FROM first UNION ALL SELECT *, 2 FROM second),
nb AS (SELECT pk.dataset, pk.t, pk.tier, pk.z AS pz, pk.y*2 AS py, pk.x*2 AS px, vox.z, vox.y, vox.x, vox.v FROM pk JOIN vox ON {_in_box("vox", "pk", T._half_box(1, 1), 2)}),
tp AS (SELECT *, greatest(v-0.5*max(v) OVER (PARTITION BY dataset, t, tier, pz, py, px),0)::DOUBLE AS w FROM nb),
ct AS (SELECT dataset, t, tier, pz, py, px, sum(w) AS w, sum(w*z) AS sz, sum(w*y) AS sy, sum(w*x) AS sx FROM tp GROUP BY ALL),
"at" AS (SELECT pk.dataset, pk.t, pk.tier, CASE WHEN w>=1e-6 THEN sz/w ELSE pk.z END AS z, CASE WHEN w>=1e-6 THEN sy/w ELSE pk.y*2 END AS y, CASE WHEN w>=1e-6 THEN sx/w ELSE pk.x*2 END AS x
 FROM pk LEFT JOIN ct ON ct.dataset=pk.dataset AND ct.t=pk.t AND ct.tier=pk.tier AND pz=pk.z AND py=pk.y*2 AND px=pk.x*2)
SELECT a.dataset, a.t, {R('a.z', 'z')}, {R('a.y', 'y')}, {R('a.x', 'x')}, tier::BIGINT AS tier, coalesce(vox.v,0)::DOUBLE AS intensity FROM "at" a JOIN shp USING (dataset,t)
 LEFT JOIN vox ON vox.dataset=a.dataset AND vox.t=a.t AND vox.z=least(greatest(round_even(a.z,0),0),fz-1) AND vox.y=least(greatest(round_even(a.y,0),0),fy-1) AND vox.x=least(greatest(round_even(a.x,0),0),fx-1)"""


@query("peak_detect", with_(VOX, PEAKS.rpartition("\nSELECT a.dataset")[0]) + "SELECT a.dataset" + PEAKS.rpartition("\nSELECT a.dataset")[2])
def peak_detect(spark, sf):
    return T.peak_detect(voxels(spark, sf)).select("dataset", "t", r6("z"), r6("y"), r6("x"), "tier", "intensity")
