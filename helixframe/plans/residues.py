"""Residue features and secondary-structure queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import constants as C
from .. import dims
from ..functions import residues as RF
from ..functions.bases import letters_of
from ..operators import regions as RG
from ..operators import sequences as S
from .base import (AA, PROTEIN, TURNS, E_, P, PI_, R, protein, query, r6, residues_sql, spread_if_few, turns, with_)

AC = with_(PROTEIN, AA, "ac AS (SELECT aa, count(*) AS n FROM (SELECT unnest(regexp_extract_all(seq,'.')) AS aa FROM protein) GROUP BY aa)")


def residue_counts(spark, sf):
    counts = (protein(spark, sf).select(F.explode(letters_of("seq")).alias("aa"))
              .groupBy("aa").agg(F.count("*").alias("n")))
    return counts.join(F.broadcast(dims.aa_dim(spark)), "aa")


def feature_query(key: str, **columns: tuple[str, object, int]):
    """Register a per-residue feature query: alias -> (SQL, Column, digits or None)."""
    sql = AC + "SELECT aa, n, " + ", ".join(
        f"{e} AS {a}" if d is None else R(e, a, d) for a, (e, _, d) in columns.items()
    ) + " FROM ac JOIN aa USING (aa)"

    def run(spark, sf):
        return residue_counts(spark, sf).select("aa", "n", *[
            column(c).alias(a) if d is None else r6(column(c), a, d) for a, (_, c, d) in columns.items()])

    run.__name__ = key
    return query(key, sql)(run)


def column(c):
    """Columns are built late: queries are registered before a session exists."""
    return F.col(c) if isinstance(c, str) else c()


def same(*names, digits=6):
    return {n: (n, n, digits) for n in names}


feature_query("aa_opcode", **same("c", "p", "v", "aromatic", "branch", "hetero", "detail", digits=None))
feature_query("aa_spin_charge", **same("spin", "charge"))
feature_query("aa_volume_hydro", **same("volume", "hydro"))
feature_query(
    "aa_chem_base",
    h0=(f"pow({P},-p)*exp(v/{PI_})", lambda: RF.chem_base()[0], 6), v0=(f"{PI_}*{E_}*pow({P},v)", lambda: RF.chem_base()[1], 6),
    q0=("c", lambda: RF.chem_base()[2], 6), mu0=(f"{C.GAMMA!r}*exp(abs(c)+p+1)", lambda: RF.chem_base()[3], 6), mu=("mu", "mu", 6))
feature_query("hydrophobicity_kd", **same("kd"))
feature_query("formal_charge", q=("q", "q", 6),
              q_acid=("CASE WHEN aa IN ('D','E','C','Y') THEN (CASE WHEN 3.0>pkr THEN -1 ELSE 0 END) WHEN aa IN ('K','R') "
                      "THEN (CASE WHEN 3.0<pkr THEN 1 ELSE 0 END) WHEN aa='H' THEN 1/(1+pow(10.0,3.0-pkr)) ELSE 0 END",
                      lambda: RF.formal_charge(3.0), 6))
feature_query("vdw_polarizability", element=("element", "element", None), vdw=("vdw", "vdw", 6), polar=("polar", "polar", 6))
feature_query("ss_propensity", **same("p_alpha", "p_beta", "p_coil"))
feature_query("ss_propensity_expanded", **same("p_alpha_x", "p_beta_x", "p_coil_x"))
feature_query("ss_dominant", label=(
    "CASE WHEN p_alpha>=p_beta AND p_alpha>=p_coil THEN 'H' WHEN p_beta>=p_coil THEN 'E' ELSE 'C' END", RF.ss_dominant, None))
INIT_SQL = f"CASE WHEN p_alpha>1/{E_} AND p_alpha>p_beta THEN 'H' WHEN p_beta>1/{E_} AND p_beta>p_alpha THEN 'E' ELSE 'C' END"
feature_query("region_collapse", label=(INIT_SQL, RF.region_collapse, None))


@query("aa_phase_alt", AC + "SELECT aa, n, c, p, v FROM ac JOIN (VALUES " + ",".join(
    f"('{a}',{c},{p},{v})" for a, (c, p, v) in C.AA_PHASE_ALT.items()) + ") t(aa,c,p,v) USING (aa)")
def aa_phase_alt(spark, sf):
    counts = residue_counts(spark, sf).select("aa", "n")
    return counts.join(F.broadcast(dims.aa_alt_dim(spark)), "aa").select(
        "aa", "n", F.col("alt_c").alias("c"), F.col("alt_p").alias("p"), F.col("alt_v").alias("v"))


@query("clean_sequence", with_(PROTEIN) + "SELECT seq_id, length(seq) AS n, md5(seq) AS digest FROM protein")
def clean_sequence(spark, sf):
    return protein(spark, sf).select("seq_id", F.length("seq").cast("bigint").alias("n"), F.md5("seq").alias("digest"))


@query("target_rg", with_(PROTEIN) + f"SELECT seq_id, {R(f'{PI_}*pow(greatest(length(seq),1),1/{PI_})', 'rg')} FROM protein")
def target_rg(spark, sf):
    return protein(spark, sf).select("seq_id", r6(RF.target_rg(F.length("seq")), "rg"))


@query("word_collisions", AC + """, w AS (SELECT aa, 'base' AS kind, c||','||p||','||v AS word FROM ac JOIN aa USING (aa)
 UNION ALL SELECT aa, 'opcode', c||','||p||','||v||','||aromatic||','||branch||','||hetero||','||detail FROM ac JOIN aa USING (aa))
SELECT kind, word, string_agg(aa,'' ORDER BY aa) AS residues, count(*) AS n_residues FROM w GROUP BY kind, word HAVING count(*)>1""")
def word_collisions(spark, sf):
    d = residue_counts(spark, sf)
    base = S.word_collisions(d, ["c", "p", "v"]).withColumn("kind", F.lit("base"))
    full = S.word_collisions(d, ["c", "p", "v", "aromatic", "branch", "hetero", "detail"]).withColumn("kind", F.lit("opcode"))
    return base.unionByName(full)


@query("aa_dim_join", with_(PROTEIN, AA) + f""", r AS (SELECT seq_id, unnest(regexp_extract_all(seq,'.')) AS aa FROM protein)
SELECT seq_id, count(*) AS n, {R('sum(spin)', 'spin', 4)}, {R('sum(charge)', 'charge', 4)}, {R('avg(hydro)', 'hydro')},
 {R('avg(p_alpha)', 'p_alpha')}, {R('sum(q)', 'net_q', 4)} FROM r JOIN aa USING (aa) GROUP BY seq_id""")
def aa_dim_join(spark, sf):
    # a residue's features depend on its letter, so letters are counted before the join
    counts = (protein(spark, sf).select("seq_id", F.explode(letters_of("seq")).alias("aa"))
              .groupBy("seq_id", "aa").agg(F.count("*").alias("k")))
    j = counts.join(F.broadcast(dims.aa_dim(spark)), "aa")
    k, n = F.col("k"), F.sum("k")
    return j.groupBy("seq_id").agg(
        n.alias("n"), r6(F.sum(F.col("spin") * k), "spin", 4), r6(F.sum(F.col("charge") * k), "charge", 4),
        r6(F.sum(F.col("hydro") * k) / n, "hydro"), r6(F.sum(F.col("p_alpha") * k) / n, "p_alpha"),
        r6(F.sum(F.col("q") * k), "net_q", 4))


def labelled_sql(source: str) -> str:
    """Initial and tunnelled labels per residue, with windows."""
    return f"""{residues_sql(source)},
l0 AS (SELECT seq_id, n, pos, aa, {INIT_SQL} AS l, (greatest(p_alpha,p_beta)-least(p_alpha,p_beta))/greatest(p_alpha,p_beta)
  < 1/({P}*{P}) AS tie FROM res JOIN aa USING (aa)),
l1 AS (SELECT *, lag(l) OVER w AS lf, lead(l) OVER w AS rt, lag(l,2) OVER w AS l2, lag(l,3) OVER w AS l3,
  lead(l,2) OVER w AS r2, lead(l,3) OVER w AS r3 FROM l0 WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
lab AS (SELECT seq_id, n, pos, aa, CASE WHEN NOT tie OR lf IS NULL OR rt IS NULL THEN l WHEN lf=rt AND lf<>'C' THEN lf
  WHEN lf<>'C' AND rt<>'C' AND lf<>rt THEN 'C' ELSE l END AS label,
  CASE WHEN tie AND lf=rt AND lf<>'C' THEN lf ELSE l END AS bridge,
  CASE WHEN tie AND lf=rt AND lf<>'C' AND l2=lf AND l3=lf AND r2=rt AND r3=rt THEN lf ELSE l END AS coherence FROM l1)"""


def regions_sql(label: str = "label", src: str = "lab", name: str = "regions") -> str:
    return f"""{name}_g AS (SELECT seq_id, pos, {label} AS kind, pos-row_number() OVER (PARTITION BY seq_id, {label} ORDER BY pos) AS grp FROM {src}),
{name}_r AS (SELECT seq_id, kind, min(pos) AS "start", max(pos) AS "end" FROM {name}_g GROUP BY seq_id, kind, grp),
{name} AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY "start")-1 AS region, kind, "start", "end" FROM {name}_r
  WHERE (kind='H' AND "end"-"start">=3) OR (kind='E' AND "end"-"start">=2))"""


@query("region_tunnel", with_(PROTEIN, AA, labelled_sql("protein")) + """SELECT seq_id, md5(string_agg(label,'' ORDER BY pos)) AS frustrated,
 md5(string_agg(bridge,'' ORDER BY pos)) AS bridge, md5(string_agg(coherence,'' ORDER BY pos)) AS coherence FROM lab GROUP BY seq_id""")
def region_tunnel(spark, sf):
    return protein(spark, sf).filter(F.length("seq") > 0).select(
        "seq_id", *[F.md5(RG.tunnel_labels("seq", m)).alias(m) for m in ("frustrated", "bridge", "coherence")])


@query("region_runs", with_(PROTEIN, AA, labelled_sql("protein"), regions_sql()) + """
SELECT seq_id, region, kind, "start", "end" FROM regions""")
def region_runs(spark, sf):
    return RG.detect_regions(protein(spark, sf))


@query("label_sequence", with_(PROTEIN, AA, labelled_sql("protein"), regions_sql()) + """
SELECT l.seq_id, md5(string_agg(CASE WHEN r.kind IS NULL THEN 'C' ELSE l.label END,'' ORDER BY pos)) AS digest,
 count(*) FILTER (r.kind='H') AS n_h, count(*) FILTER (r.kind='E') AS n_e FROM lab l
 LEFT JOIN regions r ON r.seq_id=l.seq_id AND l.pos BETWEEN r."start" AND r."end" GROUP BY l.seq_id""")
def label_sequence(spark, sf):
    from ..functions.bases import count_of

    d = RG.label_sequence(protein(spark, sf).filter(F.length("seq") > 0))
    return d.select("seq_id", F.md5("labels").alias("digest"),
                    count_of("labels", "H").cast("bigint").alias("n_h"), count_of("labels", "E").cast("bigint").alias("n_e"))


@query("region_membership", with_(TURNS, AA, labelled_sql("turns"), regions_sql()) + """
SELECT l.seq_id, l.pos, l.aa, r.region, r.kind FROM lab l LEFT JOIN (SELECT seq_id, region, kind, unnest(range("start","end"+1)) AS pos FROM regions) r
 ON r.seq_id=l.seq_id AND r.pos=l.pos""")
def region_membership(spark, sf):
    t = spread_if_few(turns(spark, sf), "seq_id")
    return RG.sequence_membership(t).select("seq_id", "pos", "aa", "region", "kind")


LOGS = ",".join("('{}',{!r}::DOUBLE,{!r}::DOUBLE,{!r}::DOUBLE)".format(a, *(math.log(x) for x in RG.propensity(a, True))) for a in C.AA20)
VITERBI = f"""logs(aa,eh,ee,ec) AS (VALUES {LOGS}),
vres AS (SELECT seq_id, n, pos, eh, ee, ec FROM res JOIN logs USING (aa)),
vf AS (SELECT seq_id, pos, n, eh AS h, ee AS e, ec AS c, '' AS bh, '' AS be, '' AS bc FROM vres WHERE pos=0
 UNION ALL SELECT r.seq_id, r.pos, r.n, greatest(f.h+b,f.e,f.c)+r.eh, greatest(f.h,f.e+b,f.c)+r.ee, greatest(f.h,f.e,f.c+b)+r.ec,
 CASE WHEN f.h+b>=f.e AND f.h+b>=f.c THEN 'H' WHEN f.e>=f.c THEN 'E' ELSE 'C' END,
 CASE WHEN f.h>=f.e+b AND f.h>=f.c THEN 'H' WHEN f.e+b>=f.c THEN 'E' ELSE 'C' END,
 CASE WHEN f.h>=f.e AND f.h>=f.c+b THEN 'H' WHEN f.e>=f.c+b THEN 'E' ELSE 'C' END
 FROM vf f JOIN vres r ON r.seq_id=f.seq_id AND r.pos=f.pos+1, (SELECT {math.log(C.PHI) / C.PHI!r}::DOUBLE AS b)),
vb AS (SELECT seq_id, pos, CASE WHEN h>=e AND h>=c THEN 'H' WHEN e>=c THEN 'E' ELSE 'C' END AS s FROM vf WHERE pos=n-1
 UNION ALL SELECT f.seq_id, f.pos-1, CASE vb.s WHEN 'H' THEN bh WHEN 'E' THEN be ELSE bc END FROM vb JOIN vf f
 ON f.seq_id=vb.seq_id AND f.pos=vb.pos WHERE f.pos>0),
vlab AS (SELECT seq_id, pos, s AS label FROM vb)"""


@query("region_viterbi", with_(TURNS, AA, residues_sql("turns"), VITERBI).replace("WITH ", "WITH RECURSIVE ", 1)
       + "SELECT seq_id, string_agg(label,'' ORDER BY pos) AS labels FROM vlab GROUP BY seq_id")
def region_viterbi(spark, sf):
    t = spread_if_few(turns(spark, sf), "seq_id").filter(F.length("seq") > 0)
    return t.select("seq_id", RG.viterbi_labels("seq").alias("labels"))
