"""Residue-pair queries over whole benchmark passages and conversation turns."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import constants as C
from ..functions import pairs as PF
from ..functions import residues as RF
from ..functions.common import freeze
from ..operators import pairs as PR
from ..operators import regions as RG
from .base import AA, CHAINS, E_, P, PI_, R, TURNS, chains, cl, num, query, r6, residues_sql, turns, with_
from .chem import s_sql
from .residues import labelled_sql, regions_sql

FE = PR.FEATURES
CONTACT = num(C.CONTACT)


def coords(k):
    """Deterministic fold of a chain: a point per residue, PDB precision."""
    s = F.col("seq_id").cast("double")
    return (F.round(8 * F.sin(0.37 * k + s), 3), F.round(8 * F.cos(0.23 * k), 3),
            F.round(6 * F.sin(0.11 * k + 0.5 * s) + 0.05 * k, 3))


COORDS = """round(8*sin(0.37::DOUBLE*pos+seq_id),3) AS x, round(8*cos(0.23::DOUBLE*pos),3) AS y,
 round(6*sin(0.11::DOUBLE*pos+0.5::DOUBLE*seq_id)+0.05::DOUBLE*pos,3) AS z"""
LABELS = with_(CHAINS, AA, labelled_sql("chains"), regions_sql())
RX = f"""rx AS (SELECT l.seq_id, l.n, l.pos, l.aa, r.region, r.kind, r."start" AS st, r."end" AS en, {COORDS.replace('seq_id', 'l.seq_id').replace('pos', 'l.pos')},
 {",".join("f." + k for k in FE)} FROM lab l JOIN aa f USING (aa) LEFT JOIN regions r ON r.seq_id=l.seq_id AND l.pos BETWEEN r."start" AND r."end")"""
CARRY = ["aa", "kind", "st", "en", "x", "y", "z", *FE]
PRS = f"""pr AS (SELECT a.seq_id, a.n, a.pos AS i, b.pos AS j, b.pos-a.pos AS sep, (b.pos-a.pos)::DOUBLE AS sd,
 {",".join(f"a.{k} AS i_{k}, b.{k} AS j_{k}" for k in CARRY)} FROM rx a JOIN rx b ON a.seq_id=b.seq_id AND a.pos<b.pos)"""
GATE = C.GATE
LINK_SQL = f"""CASE WHEN sep<=2 THEN 'backbone_covalent_geometry' WHEN i_aa='C' AND j_aa='C' THEN 'disulfide_covalent'
 WHEN i_q*j_q<-1e-9 THEN 'salt_bridge_electrostatic' WHEN i_kd>0 AND j_kd>0 AND sep>={GATE} THEN 'hydrophobic_packing'
 WHEN (sep IN (3,4,7) AND i_p_alpha@>1/{E_} AND j_p_alpha@>1/{E_}) OR (i_p_beta@>1/{E_} AND j_p_beta@>1/{E_}) THEN 'hbond_secondary'
 WHEN sep<{GATE} THEN 'molecular_sidechain' ELSE 'tertiary_biochem' END"""


def by_link(values) -> str:
    return "(CASE link " + " ".join(f"WHEN '{k}' THEN {num(v)}" for k, v in values.items()) + " END)"


DOMS = {k: C.DOMAINS[d] for k, d in PF.LINK_DOMAIN.items()}
HELIX_D = "sqrt(pow(sd*1.5,2)+pow(4.6*sin(sd*100*pi()/180/2),2))"
P1 = f"""p0 AS (SELECT *, pow(sd,-1/{PI_}) AS loc, sd/(sd+{CONTACT}) AS env, greatest(-1,least(1,i_spin))*greatest(-1,least(1,j_spin)) AS tau,
 exp(-pow(sd-{CONTACT},2)/({CONTACT}*{P})) AS ssg, {LINK_SQL.replace('@', '')} AS link, sqrt(pow(i_x-j_x,2)+pow(i_y-j_y,2)+pow(i_z-j_z,2)) AS distance FROM pr),
p1 AS (SELECT *, {P}*loc*((tau*{E_}+(1-abs(tau))*{PI_})+0.15::DOUBLE*(-i_charge*j_charge*{E_}))*(0.35::DOUBLE+0.65::DOUBLE*env) AS pw FROM p0),
p2 AS (SELECT *, CASE WHEN i_aa='C' AND j_aa='C' THEN pow({P},6)*ssg ELSE greatest(i_kd,0)*greatest(j_kd,0)/({P}*{E_})-i_q*j_q*{E_}
  +sqrt(i_mu*j_mu)/({cl('GAMMA')}*{PI_}*{E_}*{E_})+pw/{CONTACT}+(CASE WHEN i_aromatic<>0 AND j_aromatic<>0 THEN env/{P} ELSE 0 END) END AS chem,
 {by_link({k: float(v[0]) for k, v in DOMS.items()})}::DOUBLE AS link_d,
 {by_link({k: v[2] for k, v in DOMS.items()})}::DOUBLE*(1+0.5::DOUBLE*(i_spin+j_spin)/{P})+{cl('B_IN')}*(0.5::DOUBLE*(i_charge+j_charge))/{P} AS dpsi,
 1+0.25::DOUBLE*(i_branch+j_branch+i_aromatic+j_aromatic)/({P}*{P}) AS dtheta FROM p1)"""
P3 = f"""p3 AS (SELECT *, {s_sql('link_d', '0.0::DOUBLE', '(round_even(dpsi*1000,0)/1000)', "link<>'backbone_covalent_geometry'",
                                  'least(n,400)::DOUBLE', '(round_even(dtheta*1000,0)/1000)')} AS s FROM p2),
p4 AS (SELECT *, 1+abs(s)*{cl('P_NEW')} AS residual, 1+{cl('CHAOS')}*(link_d-25)/25 AS chaos,
 coalesce(i_kind=j_kind AND i_st<>j_st, false) AS region_same FROM p3),
p5 AS (SELECT *, CASE WHEN sep<=2 THEN 1 ELSE residual END AS ru, CASE WHEN sep<=2 THEN 1 ELSE chaos END AS cu,
 CASE WHEN NOT region_same THEN 1 WHEN i_kind='H' THEN (CASE WHEN (i-i_st)%7 IN (0,3) AND (j-j_st)%7 IN (0,3) THEN {P} ELSE 1/{P} END)
  ELSE pow({P},-least(abs(j-(j_en-(i-i_st))),abs(j-(j_st+(i-i_st))))/{PI_}) END AS mult FROM p4),
p6 AS (SELECT *, chem*env*{cl('CHEM_AMP')}*ru*cu AS chemistry,
 CASE WHEN sep IN (3,4,7) THEN pow(sqrt(i_p_alpha*j_p_alpha),3)/{E_} ELSE 0 END AS hb,
 CASE WHEN sep>=3 THEN i_p_beta*j_p_beta/(1+greatest(ln(sd/{PI_}),0))/{P} ELSE 0 END AS sb,
 CASE WHEN region_same AND sep>={GATE} THEN sqrt(CASE WHEN i_kind='H' THEN i_p_alpha*j_p_alpha ELSE i_p_beta*j_p_beta END)
  *greatest(0,ln(sqrt((i_en-i_st+1)*(j_en-j_st+1))))*{cl('REGION_AMP')}*mult*ru*cu ELSE 0 END AS region FROM p5),
p7 AS (SELECT *, hb*ru AS helix, sb*ru AS sheet FROM p6),
pm AS (SELECT *, loc+chemistry+helix+sheet+region AS m FROM p7)"""
EV = f"""ev0 AS (SELECT *, CASE WHEN i_kd>0 AND j_kd>0 THEN {P}*sqrt(i_kd*j_kd) ELSE 0 END AS hydrophobic,
 CASE WHEN i_q*j_q<0 THEN {E_}*abs(i_q*j_q)*{P} ELSE 0 END AS salt, CASE WHEN i_aa='C' AND j_aa='C' THEN pow({P},3)*ssg ELSE 0 END AS disulfide,
 CASE WHEN region_same THEN mult*{P} ELSE 0 END AS register_term, sqrt(i_polar*j_polar)/({P}*{E_}) AS polarizability FROM pm WHERE sep>={GATE}),
ev AS (SELECT *, m+hydrophobic+salt+disulfide+register_term+polarizability AS evidence FROM ev0),
rk AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY round(evidence,9) DESC, i, j) AS rank FROM ev)"""


def chain_sql(*extra: str) -> str:
    return LABELS + ",\n" + ",\n".join([RX, PRS, *extra]) + "\n"


def chain_pairs(spark, sf, gate=1, max_sep=None):
    return PR.residue_pairs(PR.with_residues(chains(spark, sf), coords), gate=gate, max_sep=max_sep)


def scored(spark, sf):
    return PR.native_distance(PR.proximity_channels(chain_pairs(spark, sf)))


@query("residue_pairs", with_(TURNS, residues_sql("turns")) + """SELECT b.pos-a.pos AS sep, count(*) AS n_pairs,
 count(*) FILTER (a.aa=b.aa) AS n_same FROM res a JOIN res b ON a.seq_id=b.seq_id AND a.pos<b.pos GROUP BY 1""")
def residue_pairs(spark, sf):
    p = PR.residue_pairs(PR.with_residues(turns(spark, sf)), features=False)
    return p.groupBy("sep").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("i_aa") == F.col("j_aa")).alias("n_same"))


def sums(df, keys, digits=4, **cols):
    """Count, sum and maximum of score columns per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_pairs"), *[
        r6(fn(c), f"{n}_{tag}", digits) for n, c in cols.items() for tag, fn in (("sum", F.sum), ("max", F.max))])


def sums_sql(src, keys, digits=4, **cols):
    return f"SELECT {keys}, count(*) AS n_pairs, " + ", ".join(
        R(f"{fn}({c})", f"{n}_{fn}", digits) for n, c in cols.items() for fn in ("sum", "max")) + f" FROM {src} GROUP BY {keys}"


@query("pair_weight", chain_sql(P1) + sums_sql("p2", "seq_id, i", w="pw"))
def pair_weight(spark, sf):
    return sums(chain_pairs(spark, sf), ["seq_id", "i"], w=PF.pair_weight())


OPCODE_SQL = f"""CASE WHEN i_aa='C' AND j_aa='C' THEN pow({P},6) ELSE (i_hydro-1)/{P}*(j_hydro-1)/{P}-i_charge*j_charge*{E_}
 +sqrt(i_mu*j_mu)/({cl('GAMMA')}*{PI_}*{E_}*{E_})+pw/{CONTACT}+(CASE WHEN i_aromatic<>0 AND j_aromatic<>0 THEN env/{P} ELSE 0 END) END"""


@query("pair_chemistry", chain_sql(P1) + sums_sql("p2", "seq_id, i", chem="chem", opcode=OPCODE_SQL))
def pair_chemistry(spark, sf):
    return sums(chain_pairs(spark, sf), ["seq_id", "i"], chem=PF.pair_chemistry(), opcode=PF.pair_chemistry_opcode())


@query("chem_link_route", chain_sql(P1) + "SELECT seq_id, sep, link, count(*) AS n_pairs FROM p2 GROUP BY ALL")
def chem_link_route(spark, sf):
    return chain_pairs(spark, sf).groupBy("seq_id", "sep", PF.chem_link().alias("link")).agg(F.count("*").alias("n_pairs"))


@query("pair_scalar", chain_sql(P1, P3) + sums_sql("p4", "seq_id, i", s="abs(s)", residual="residual", dpsi="dpsi", dtheta="dtheta"))
def pair_scalar(spark, sf):
    p = PR.pair_scalars(chain_pairs(spark, sf))
    return sums(p, ["seq_id", "i"], s=F.abs("s"), residual=F.col("residual"), dpsi=F.col("dpsi"), dtheta=F.col("dtheta"))


TARGET_SQL = f"""(CASE link WHEN 'backbone_covalent_geometry' THEN (CASE sep WHEN 1 THEN 3.8 WHEN 2 THEN 3.8*sqrt({E_}/{P}) END)
 WHEN 'disulfide_covalent' THEN ({PI_}+{E_}/{P})*{P}/{E_}/residual WHEN 'salt_bridge_electrostatic' THEN {CONTACT}/{P}/sqrt(residual)
 WHEN 'hydrophobic_packing' THEN {CONTACT}/sqrt(residual) WHEN 'hbond_secondary' THEN (CASE WHEN sep IN (3,4,7) AND i_p_alpha>1/{E_}
  AND j_p_alpha>1/{E_} THEN {HELIX_D} ELSE {PI_}+{E_}/{P} END) WHEN 'tertiary_biochem' THEN {CONTACT}*{P}/residual END)"""


@query("link_target_distance", chain_sql(P1, P3) + f"""SELECT seq_id, link, count(*) AS n_pairs, count(t) AS n_target, {R('avg(t)', 'mean_t')},
 {R('min(t)', 'min_t')}, {R('max(t)', 'max_t')} FROM (SELECT seq_id, link, {TARGET_SQL} AS t FROM p4) GROUP BY seq_id, link""")
def link_target_distance(spark, sf):
    p = PR.pair_scalars(chain_pairs(spark, sf)).withColumn("t", PF.link_target("link", "residual"))
    return p.groupBy("seq_id", "link").agg(F.count("*").alias("n_pairs"), F.count("t").alias("n_target"),
                                           r6(F.avg("t"), "mean_t"), r6(F.min("t"), "min_t"), r6(F.max("t"), "max_t"))


@query("helix_bonus", chain_sql(P1, P3) + sums_sql("p6 WHERE sep<=7", "seq_id, sep", bonus="hb"))
def helix_bonus(spark, sf):
    return sums(chain_pairs(spark, sf, max_sep=7), ["seq_id", "sep"], bonus=PF.helix_bonus())


@query("sheet_bonus", chain_sql(P1, P3) + sums_sql("p6", "seq_id, sep", bonus="sb"))
def sheet_bonus(spark, sf):
    return sums(chain_pairs(spark, sf), ["seq_id", "sep"], bonus=PF.sheet_bonus())


FACE = "(CASE WHEN {0}%7 IN (0,3) THEN 1 WHEN {0}%7 IN (4,6) THEN 0 ELSE -1 END)"
SHIFT = "(CASE WHEN abs((i-i_st)+(j-j_st)-(j_en-j_st))<=abs((j-j_st)-(i-i_st)) THEN abs((i-i_st)+(j-j_st)-(j_en-j_st)) ELSE abs((j-j_st)-(i-i_st)) END)"


@query("register_mult", chain_sql(P1, P3) + f"""SELECT seq_id, i_kind AS kind, count(*) AS n_pairs, {R('sum(mult)', 'mult', 4)},
 {R(f"sum(CASE WHEN i_kind='H' THEN pow({P},{FACE.format('(i-i_st)')}+{FACE.format('(j-j_st)')}) WHEN {SHIFT}>greatest(2.0,(j_en-j_st)*0.5) THEN 1/({P}*{P}) "
    f"WHEN {SHIFT}=0 THEN {P} ELSE pow({P},-1.0-greatest({SHIFT}-1,0)/{PI_}) END)", 'cells', 4)} FROM p5 WHERE region_same GROUP BY seq_id, i_kind""")
def register_mult(spark, sf):
    p = PR.with_regions(chain_pairs(spark, sf)).filter("region_same")
    cells = F.when(F.col("i_kind") == "H", PF.heptad_faces("i", "j", "i_start", "j_start")).otherwise(
        PF.strand_cells("i", "j", "i_start", "j_start", "j_end"))
    return p.groupBy("seq_id", F.col("i_kind").alias("kind")).agg(
        F.count("*").alias("n_pairs"), r6(F.sum("register_mult"), "mult", 4), r6(F.sum(cells), "cells", 4))


CH = {"locality": "loc", "chemistry": "chemistry", "helix": "helix", "sheet": "sheet", "region": "region", "m": "m"}


@query("proximity_channels", chain_sql(P1, P3) + sums_sql("pm", "seq_id, i", **CH))
def proximity_channels(spark, sf):
    return sums(scored(spark, sf), ["seq_id", "i"], **{k: F.col(k) for k in CH})


@query("contact_evidence", chain_sql(P1, P3, EV) + sums_sql("ev", "seq_id, i", **{
    k: k for k in ("hydrophobic", "salt", "disulfide", "register_term", "polarizability", "evidence")}))
def contact_evidence(spark, sf):
    ev = PR.contact_evidence(scored(spark, sf).filter(F.col("sep") >= GATE))
    return sums(ev, ["seq_id", "i"], **{k: F.col(k) for k in (
        "hydrophobic", "salt", "disulfide", "register_term", "polarizability", "evidence")})


@query("rank_contacts", chain_sql(P1, P3, EV) + f"SELECT seq_id, i, j, i_aa||j_aa AS aa, rank, {R('evidence', 'evidence')} FROM rk")
def rank_contacts(spark, sf):
    return PR.rank_contacts(scored(spark, sf)).select("seq_id", "i", "j", F.concat("i_aa", "j_aa").alias("aa"), "rank", r6("evidence"))


EVK = ["hydrophobic", "salt", "disulfide", "register_term", "polarizability", "m"]


@query("top_l_precision", chain_sql(P1, P3, EV) + f"""SELECT seq_id, n AS top_l, count(*) FILTER (hit) AS n_native,
 count(*) FILTER (hit AND rank<=n) AS n_hits, {R('count(*) FILTER (hit AND rank<=n)/n::DOUBLE', 'precision_l')},
 {R('count(*) FILTER (hit AND rank<=n)/greatest(count(*) FILTER (hit),1)::DOUBLE', 'recall_l')},
 {",".join(R(f"coalesce(avg({k}) FILTER (hit AND rank<=n),0)", 'hit_' + k) for k in EVK)},
 min(rank) FILTER (hit AND rank>n) AS first_miss FROM (SELECT *, distance<8 AS hit FROM rk) GROUP BY seq_id, n""")
def top_l_precision(spark, sf):
    r = PR.rank_contacts(scored(spark, sf)).withColumn("hit", F.col("distance") < 8)
    won = F.col("hit") & (F.col("rank") <= F.col("n"))
    hits, native = F.count_if(won), F.count_if("hit")
    return r.groupBy("seq_id", F.col("n").cast("bigint").alias("top_l")).agg(
        native.alias("n_native"), hits.alias("n_hits"), r6(hits / F.max("n"), "precision_l"),
        r6(hits / F.greatest(native, F.lit(1)), "recall_l"),
        *[r6(F.coalesce(F.avg(F.when(won, F.col(k))), F.lit(0.0)), "hit_" + k) for k in EVK],
        F.min(F.when(F.col("hit") & (F.col("rank") > F.col("n")), F.col("rank"))).alias("first_miss"))


TOPK = ",".join(f"""t{t} AS (SELECT seq_id, {t} AS min_sep, avg(CASE WHEN distance<8 THEN 1.0 ELSE 0 END) AS p FROM (SELECT *, row_number() OVER (PARTITION BY seq_id
 ORDER BY round(m,9) DESC, i, j) AS k FROM pm WHERE sep>={t}) WHERE k<=greatest(n//2,1) GROUP BY seq_id)""" for t in (6, 12, 24))


@query("topk_precision", chain_sql(P1, P3, TOPK) + "SELECT seq_id, min_sep, " + R("p", "precision_half_l")
       + " FROM (SELECT * FROM t6 UNION ALL SELECT * FROM t12 UNION ALL SELECT * FROM t24)")
def topk_precision(spark, sf):
    from ..operators.evaluate import topk_precision as op

    p = freeze(scored(spark, sf).select("seq_id", "n", "i", "j", "sep", F.round("m", 9).alias("score"), "distance"))
    return op(p, (6, 12, 24)).select("seq_id", "min_sep", r6("precision_half_l"))


@query("sparse_pairs", chain_sql(P1, P3) + f"""SELECT seq_id, i, j FROM pm WHERE sep<=12 UNION SELECT seq_id, i, j FROM (SELECT *, row_number() OVER
 (PARTITION BY seq_id ORDER BY round(m,9) DESC, i, j) AS k FROM pm WHERE sep>={GATE}) WHERE k<=2*n""")
def sparse_pairs(spark, sf):
    return PR.sparse_pairs(scored(spark, sf))


@query("link_histogram", chain_sql(P1, P3) + f"""SELECT link, link_d::INT AS d_eff, count(*) AS n_pairs, {R('avg(abs(s))', 'mean_abs_s')},
 {R("avg(CASE WHEN link<>'backbone_covalent_geometry' THEN 1.0 ELSE 0 END)", 'observed_frac')} FROM p3 GROUP BY link, link_d""")
def link_histogram(spark, sf):
    p = PR.pair_scalars(chain_pairs(spark, sf))
    return p.groupBy("link", F.col("link_d").cast("int").alias("d_eff")).agg(
        F.count("*").alias("n_pairs"), r6(F.avg(F.abs("s")), "mean_abs_s"), r6(F.avg(F.col("observed").cast("double")), "observed_frac"))


IMP = f"""im AS (SELECT seq_id, n, pos, avg(a) AS importance FROM (SELECT seq_id, n, i AS pos, abs(s) AS a FROM p3 WHERE sep>={GATE}
 UNION ALL SELECT seq_id, n, j, abs(s) FROM p3 WHERE sep>={GATE}) GROUP BY ALL)"""


@query("residue_importance", chain_sql(P1, P3, IMP) + f"SELECT seq_id, pos, {R('importance', 'importance')} FROM im")
def residue_importance(spark, sf):
    return PR.residue_importance(PR.pair_scalars(chain_pairs(spark, sf))).select("seq_id", "pos", r6("importance"))


REGP = f"""rp AS (SELECT a.seq_id, a.kind, a.region AS r1, b.region AS r2, (a."start"+a."end")//2 AS mi, (b."start"+b."end")//2 AS mj,
 a."start" AS s1, a."end" AS e1, b."start" AS s2, b."end" AS e2 FROM regions a JOIN regions b ON a.seq_id=b.seq_id AND a.kind=b.kind AND a.region<b.region
 WHERE (b."start"+b."end")//2-(a."start"+a."end")//2>={GATE})"""


@query("same_kind_region_pairs", chain_sql(P1, REGP) + f"""SELECT rp.seq_id, kind, r1, r2, mi, mj, {R('min(distance)', 'min_distance')} FROM rp
 JOIN p0 ON p0.seq_id=rp.seq_id AND p0.i BETWEEN s1 AND e1 AND p0.j BETWEEN s2 AND e2 GROUP BY ALL""")
def same_kind_region_pairs(spark, sf):
    # a pair already knows the start of the region each end lies in, so this is an equi-join
    rp = PR.region_pairs(RG.detect_regions(chains(spark, sf)))
    p = PR.native_distance(chain_pairs(spark, sf))
    near = (p.filter("i_start is not null and j_start is not null").groupBy("seq_id", F.col("i_start").alias("s1"), F.col("j_start").alias("s2"))
            .agg(F.min("distance").alias("min_distance")))
    return rp.join(near, ["seq_id", "s1", "s2"]).select("seq_id", "kind", "r1", "r2", "mi", "mj", r6("min_distance"))


HARD = "link IN ('disulfide_covalent','salt_bridge_electrostatic','hydrophobic_packing','hbond_secondary')"
BOOST = num(1 + (C.PACKING_AMP / C.REGION_AMP) / C.PHI)
PTD = f"""d0 AS (SELECT *, {TARGET_SQL} AS t, greatest(m,1e-9) AS mm, 3.8*pow(sd,1/{PI_}) AS poly FROM pm),
d1 AS (SELECT *, CASE sep WHEN 1 THEN 3.8 WHEN 2 THEN 3.8*sqrt({E_}/{P}) ELSE
 (CASE WHEN mm>loc*{P} THEN least((1-env)*poly+env*least(3.8/mm,{CONTACT}*{P}),{CONTACT}/(1+(mm-loc)*{P})) ELSE (1-env)*poly+env*least(3.8/mm,{CONTACT}*{P}) END) END AS d FROM d0),
d2 AS (SELECT * REPLACE (CASE WHEN t IS NULL THEN d WHEN link IN ('disulfide_covalent','salt_bridge_electrostatic') THEN least(d,t)
 WHEN link='hbond_secondary' THEN (d+{P}*t)/(1+{P}) WHEN link='hydrophobic_packing' THEN (CASE WHEN mm>loc*{P} THEN least(d,t*{P}) ELSE d END)
 WHEN link='tertiary_biochem' THEN (CASE WHEN mm>loc*{P}*{P} THEN least(d,greatest(t,{CONTACT}/{P}),{CONTACT}/residual) ELSE least(d,greatest(t,{CONTACT}/{P})) END)
 ELSE d END AS d) FROM d1),
d3 AS (SELECT * REPLACE (CASE WHEN sep IN (3,4,7) AND coalesce(i_kind='H' AND j_kind='H',false) THEN (d+{P}*{HELIX_D})/(1+{P})
 WHEN sep IN (3,4,7) AND i_p_alpha>1/{E_} AND j_p_alpha>1/{E_} THEN least(d,{HELIX_D}) ELSE d END AS d) FROM d2),
d4 AS (SELECT * REPLACE (CASE WHEN region_same AND i_kind='E' AND sep>={GATE} AND mult>=1 THEN least(d,{PI_}+{E_}/{P}) ELSE d END AS d) FROM d3),
d5 AS (SELECT * REPLACE (CASE WHEN sep BETWEEN 3 AND {GATE - 1} THEN least(d,greatest((i_vdw+j_vdw)*{E_},3.8*{P})) ELSE d END AS d) FROM d4),
d6 AS (SELECT * REPLACE (least(greatest(d,3.8*0.95),{CONTACT}*{P}*{P}) AS d) FROM d5),
anc AS (SELECT DISTINCT seq_id, mi, mj FROM rp),
d7 AS (SELECT d6.*, rk.rank-1 AS rk, anc.mi IS NOT NULL AS anchor FROM d6 LEFT JOIN rk ON rk.seq_id=d6.seq_id AND rk.i=d6.i AND rk.j=d6.j AND rk.rank<=d6.n
 LEFT JOIN anc ON anc.seq_id=d6.seq_id AND anc.mi=d6.i AND anc.mj=d6.j),
d8 AS (SELECT *, CASE WHEN rk IS NULL THEN NULL WHEN {HARD} OR rk<greatest(n//5,1) THEN (CASE WHEN rk<greatest(n//2,1) AND {HARD} THEN {CONTACT}/{P}/{BOOST}
 WHEN rk<greatest(n//2,1) THEN {CONTACT}/sqrt({BOOST}) ELSE {CONTACT} END) WHEN rk<greatest(n//2,1) THEN {CONTACT} END AS cap0 FROM d7),
d9 AS (SELECT *, CASE WHEN anchor THEN least(coalesce(cap0,{CONTACT}),{CONTACT}) ELSE cap0 END AS cap, {PI_}*pow(n,1/{PI_}) AS rg FROM d8),
ptd AS (SELECT * REPLACE (CASE WHEN cap IS NOT NULL THEN least(d,cap) WHEN sep>={GATE} THEN greatest(d,least(greatest(poly,rg/{P}),rg*sqrt(2)*{P})) ELSE d END AS d) FROM d9)"""


@query("proximity_to_distance", chain_sql(P1, P3, EV, REGP, PTD) + f"""SELECT seq_id, sep, count(*) AS n_pairs, {R('sum(d)', 'd_sum', 4)},
 {R('min(d)', 'd_min')}, {R('max(d)', 'd_max')}, count(cap) AS n_capped FROM ptd GROUP BY seq_id, sep""")
def proximity_to_distance(spark, sf):
    d = PR.proximity_to_distance(scored(spark, sf), RG.detect_regions(chains(spark, sf)))
    return d.groupBy("seq_id", "sep").agg(F.count("*").alias("n_pairs"), r6(F.sum("d"), "d_sum", 4), r6(F.min("d"), "d_min"),
                                          r6(F.max("d"), "d_max"), F.count("cap").alias("n_capped"))


@query("sequence_summary", chain_sql(P1, P3) + f""", dom AS (SELECT seq_id, string_agg(CASE WHEN p_alpha>=p_beta AND p_alpha>=p_coil THEN 'H' WHEN p_beta>=p_coil
 THEN 'E' ELSE 'C' END,'' ORDER BY pos) AS secondary, max(n) AS length FROM res JOIN aa USING (aa) GROUP BY seq_id),
 rg AS (SELECT seq_id, count(*) AS n_regions, string_agg(kind||':'||"start"||'-'||"end",',' ORDER BY region) AS regions FROM regions GROUP BY seq_id),
 ps AS (SELECT seq_id, avg(abs(s)) AS ms, avg(CASE WHEN sep>2 THEN 1.0 ELSE 0 END) AS ob FROM p3 GROUP BY seq_id)
SELECT dom.seq_id, length, secondary, coalesce(n_regions,0) AS n_regions, coalesce(regions,'') AS regions, {R(f'{PI_}*pow(length,1/{PI_})', 'rg_target')},
 {R('ms', 'mean_abs_s')}, {R('ob', 'observed_frac')} FROM dom LEFT JOIN rg USING (seq_id) LEFT JOIN ps USING (seq_id)""")
def sequence_summary(spark, sf):
    c = chains(spark, sf)
    dominant = {}
    for a in C.AA20:
        pa, pb, pc = RG.propensity(a)
        dominant[a] = "H" if pa >= pb and pa >= pc else ("E" if pb >= pc else "C")
    labels = RG.region_array(RG.tunnel_labels("seq"))
    text = F.transform(labels, lambda r: F.concat(r["kind"], F.lit(":"), r["start"].cast("string"), F.lit("-"), r["end"].cast("string")))
    rows = c.select("seq_id", F.length("seq").cast("bigint").alias("length"),
                    F.translate("seq", C.AA20, "".join(dominant[a] for a in C.AA20)).alias("secondary"),
                    F.size(labels).cast("bigint").alias("n_regions"), F.array_join(text, ",").alias("regions"),
                    r6(RF.target_rg(F.length("seq")), "rg_target"))
    s = PR.pair_scalars(chain_pairs(spark, sf)).groupBy("seq_id").agg(
        r6(F.avg(F.abs("s")), "mean_abs_s"), r6(F.avg(F.col("observed").cast("double")), "observed_frac"))
    return rows.join(s, "seq_id", "left")


def link_x_sql():
    return LINK_SQL.replace("@", "_x")


RBY = by_link(PR.RESIDUAL_BY_LINK)
SPR = f"""sx AS (SELECT seq_id, n, i, j, sep, sd, distance, link0 AS link, i_p_alpha_x>=i_p_beta_x AND j_p_alpha_x>=j_p_beta_x AS hel FROM (SELECT *, {link_x_sql()} AS link0 FROM p0)),
sy AS (SELECT *, CASE WHEN link='hbond_secondary' AND sep IN (3,4,7) AND hel AND abs(distance-{HELIX_D})<{P} THEN {HELIX_D} ELSE distance END AS d0 FROM sx WHERE sep>=3),
sn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY round(distance,9), i, j) AS k FROM sy WHERE sep>={GATE} AND distance<{CONTACT}) WHERE k<=n),
se AS (SELECT * FROM sy WHERE ((link='disulfide_covalent' AND distance<{CONTACT}) OR (link='salt_bridge_electrostatic' AND distance<{CONTACT}*{P})
 OR (link='hbond_secondary' AND sep IN (3,4,7) AND distance<{CONTACT})) AND NOT EXISTS (SELECT 1 FROM sn WHERE sn.seq_id=sy.seq_id AND sn.i=sy.i AND sn.j=sy.j))"""


@query("measured_springs", chain_sql(P1, SPR) + f"""SELECT seq_id, i, j, {R('d0', 'd0')}, {R(RBY, 'r')}, link, 'contact' AS source FROM sn
 UNION ALL SELECT seq_id, i, j, {R('d0', 'd0')}, {R(RBY, 'r')}, link, 'precision' FROM se""")
def measured_springs(spark, sf):
    return PR.measured_springs(chain_pairs(spark, sf)).select("seq_id", "i", "j", r6("d0"), r6("r"), "link", "source")


@query("sep2_springs", chain_sql(P1) + f"""SELECT seq_id, i, j, {R('d0', 'd0')} FROM (SELECT seq_id, i, j, CASE
 WHEN i_p_alpha_x>1/{E_} AND j_p_alpha_x>1/{E_} AND i_p_alpha_x>=i_p_beta_x AND j_p_alpha_x>=j_p_beta_x AND abs(distance-{HELIX_D})<{P} THEN {HELIX_D}
 WHEN i_p_beta_x>1/{E_} AND j_p_beta_x>1/{E_} AND i_p_beta_x>=i_p_alpha_x AND j_p_beta_x>=j_p_alpha_x AND abs(distance-3.8*{E_}/{P})<{P} THEN 3.8*{E_}/{P} END AS d0
 FROM p0 WHERE sep=2) WHERE d0 IS NOT NULL""")
def sep2_springs(spark, sf):
    return PR.sep2_springs(chain_pairs(spark, sf, max_sep=2)).select("seq_id", "i", "j", r6("d0"))


