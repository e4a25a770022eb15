"""Alignment queries: every embedding vector is one aligned row of 64 columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import msa as M
from .base import P, R, num, query, r6, spread_if_few, table, with_

WIDTH = 64
PER_ROW = 8  # partners that every row draws; the SQL below says the same
CELLS = """emb AS (SELECT label AS family, vec_id AS row_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
cells AS (SELECT family, row_id, pos, ((floor(x*20)::BIGINT+pos)%21+21)%21 AS aa FROM emb)"""
LN20 = num(M.LN20)
STATS = f"""cnt AS (SELECT family, pos, aa, count(*) AS n FROM cells GROUP BY ALL),
st0 AS (SELECT family, pos, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (aa<20),0)::BIGINT AS covered FROM cnt GROUP BY ALL),
st1 AS (SELECT family, pos, -sum(n/covered::DOUBLE*ln(n/covered::DOUBLE)) AS h FROM cnt JOIN st0 USING (family,pos) WHERE aa<20 GROUP BY ALL),
stats AS (SELECT family, pos, n_rows, covered, coalesce(greatest(h,0),{LN20}) AS entropy, 1-covered/n_rows::DOUBLE AS gap_frac,
 CASE WHEN covered>0 THEN greatest(0,1-greatest(h,0)/{LN20}) ELSE 0 END AS conservation FROM st0 LEFT JOIN st1 USING (family,pos))"""
MI = f"""jt AS (SELECT a.family, a.pos AS i, b.pos AS j, a.aa AS a, b.aa AS b, count(*) AS n FROM cells a JOIN cells b
 ON a.family=b.family AND a.row_id=b.row_id AND a.pos<b.pos WHERE a.aa<20 AND b.aa<20 GROUP BY ALL),
jp AS (SELECT family,i,j,n, sum(n) OVER (PARTITION BY family,i,j) AS t, sum(n) OVER (PARTITION BY family,i,j,a) AS na,
 sum(n) OVER (PARTITION BY family,i,j,b) AS nb FROM jt),
mi AS (SELECT family,i,j,max(t)::BIGINT AS n_rows, CASE WHEN max(t)>=20 THEN sum(n/t::DOUBLE*ln((n/t::DOUBLE)/(na/t::DOUBLE*nb/t::DOUBLE))) ELSE 0 END AS mi FROM jp GROUP BY ALL)"""
APC = """rm AS (SELECT family, pos, sum(mi)/64 AS mean FROM (SELECT family, i AS pos, mi FROM mi UNION ALL SELECT family, j, mi FROM mi) GROUP BY ALL),
al AS (SELECT family, 2*sum(mi)/4096 AS a FROM mi GROUP BY family),
coev AS (SELECT mi.family, mi.i, mi.j, mi, greatest(0, CASE WHEN a<=0 THEN mi ELSE mi-p.mean*q.mean/(a+1e-12) END) AS coev FROM mi JOIN rm p ON p.family=mi.family AND p.pos=i
 JOIN rm q ON q.family=mi.family AND q.pos=j JOIN al ON al.family=mi.family)"""
QROW = """qr AS (SELECT family, min(row_id) AS query_row FROM cells GROUP BY family),
q AS (SELECT c.family, c.pos, c.aa AS query_aa FROM cells c JOIN qr ON qr.family=c.family AND qr.query_row=c.row_id)"""
NEFF = """ord AS (SELECT family, row_id, row_number() OVER (PARTITION BY family ORDER BY row_id)-1 AS o FROM (SELECT DISTINCT family, row_id FROM cells)),
sz AS (SELECT family, count(*) AS n_seqs FROM ord GROUP BY family),
dr AS (SELECT family, n_seqs, k, o AS a, (o*48271+k*104729+12345)%2147483647*69621%2147483647%n_seqs AS b FROM sz JOIN ord USING (family), range(8) t(k)),
ii AS (SELECT dr.family, k, a, avg(CASE WHEN x.aa=y.aa THEN 1.0 ELSE 0 END) AS idn, count(*) AS c FROM dr JOIN ord p ON p.family=dr.family AND p.o=a JOIN ord q ON q.family=dr.family AND q.o=b
 JOIN cells x ON x.family=dr.family AND x.row_id=p.row_id AND x.aa<20 JOIN cells y ON y.family=dr.family AND y.row_id=q.row_id AND y.pos=x.pos AND y.aa<20 WHERE a<>b GROUP BY ALL),
nf AS (SELECT sz.family, n_seqs, avg(idn) FILTER (c>=10) AS mean_id FROM sz LEFT JOIN ii USING (family) GROUP BY ALL),
neff AS (SELECT family, n_seqs, mean_id, CASE WHEN mean_id IS NULL THEN n_seqs ELSE n_seqs/(1+(n_seqs-1)*least(greatest(mean_id,0),1-1e-9)) END AS neff FROM nf)"""


def rows(spark, sf):
    codes = F.transform("embedding", lambda x, k: F.pmod(F.floor(x.cast("double") * 20).cast("int") + k, 21))
    e = spread_if_few(table(spark, sf, "embeddings").select("label", "vec_id", "embedding"), "vec_id")
    return e.select(F.col("label").alias("family"), F.col("vec_id").alias("row_id"), codes.alias("codes"))


def stats(spark, sf):
    return M.column_stats(M.column_counts(rows(spark, sf)))


def coev(spark, sf):
    return M.apc_correction(M.mutual_information(rows(spark, sf)), WIDTH)


def neff(spark, sf):
    return M.neff_analytic(rows(spark, sf), PER_ROW).withColumnRenamed("neff_analytic", "neff")


@query("msa_column_stats", with_(CELLS, STATS) + f"""SELECT family, pos, n_rows, covered, {R('entropy', 'entropy')}, {R('gap_frac', 'gap_frac')},
 {R('conservation', 'conservation')}, (SELECT string_agg(substring('{C.AA20}',aa::INT+1,1)||':'||n,',' ORDER BY substring('{C.AA20}',aa::INT+1,1)) FROM cnt
 WHERE cnt.family=stats.family AND cnt.pos=stats.pos AND aa<20) AS letters FROM stats""")
def msa_column_stats(spark, sf):
    s = stats(spark, sf)
    text = F.transform(F.array_sort(F.map_entries("freq")), lambda e: F.concat(
        e["key"], F.lit(":"), F.round(e["value"] * F.col("covered")).cast("bigint").cast("string")))
    return s.select("family", "pos", "n_rows", "covered", r6("entropy"), r6("gap_frac"), r6("conservation"),
                    F.array_join(text, ",").alias("letters"))


IDC = """idc AS (SELECT q.family, q.pos, query_aa, coalesce(covered,0) AS covered, CASE WHEN covered>0 THEN coalesce(n,0)/covered::DOUBLE ELSE 0 END AS ic FROM q
 LEFT JOIN st0 USING (family,pos) LEFT JOIN cnt ON cnt.family=q.family AND cnt.pos=q.pos AND cnt.aa=q.query_aa WHERE query_aa<20)"""


@query("identity_conservation", with_(CELLS, STATS, QROW, IDC) + f"SELECT family, pos, query_aa::INT AS query_aa, covered, {R('ic', 'identity_cons')} FROM idc")
def identity_conservation(spark, sf):
    r = rows(spark, sf)
    return M.identity_conservation(M.column_counts(r), M.query_rows(r)).select("family", "pos", "query_aa", "covered", r6("identity_cons"))


@query("shannon_conservation", with_(CELLS, STATS, QROW, IDC) + f"""SELECT family, pos, {R('conservation', 'shannon')}, {R('greatest(conservation,ic)', 'blend')}
 FROM idc JOIN stats USING (family,pos)""")
def shannon_conservation(spark, sf):
    r = rows(spark, sf)
    counts = M.column_counts(r)
    j = M.identity_conservation(counts, M.query_rows(r)).join(M.column_stats(counts).select("family", "pos", "conservation"), ["family", "pos"])
    return j.select("family", "pos", r6("conservation", "shannon"), r6(F.greatest("conservation", "identity_cons"), "blend"))


@query("map_msa_to_query", with_(CELLS, QROW) + """, sc AS (SELECT c.family, c.row_id, count(*) FILTER (c.aa=query_aa AND c.aa<20) AS matches FROM cells c JOIN q USING (family,pos)
 JOIN qr ON qr.family=c.family WHERE c.row_id<>query_row GROUP BY ALL),
 rf AS (SELECT family, row_id AS ref_row, matches FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY matches DESC, row_id) AS k FROM sc) WHERE k=1)
SELECT q.family, ref_row, matches, q.pos AS col, CASE WHEN query_aa<20 THEN sum((query_aa<20)::INT) OVER w-1 END::BIGINT AS query_index,
 CASE WHEN c.aa<20 THEN sum((c.aa<20)::INT) OVER w-1 END::BIGINT AS ref_index FROM q JOIN rf USING (family) JOIN cells c ON c.family=q.family AND c.row_id=ref_row AND c.pos=q.pos
 WINDOW w AS (PARTITION BY q.family ORDER BY q.pos)""")
def map_msa_to_query(spark, sf):
    return M.map_to_query(rows(spark, sf))


@query("column_to_residue", with_(CELLS) + """SELECT family, row_id, count(*) FILTER (aa<20) AS n_residues,
 md5(string_agg(CASE WHEN aa<20 THEN idx::BIGINT::VARCHAR ELSE '-' END, ',' ORDER BY pos)) AS index_map FROM
 (SELECT *, sum((aa<20)::INT) OVER (PARTITION BY row_id ORDER BY pos)-1 AS idx FROM cells) GROUP BY family, row_id""")
def column_to_residue(spark, sf):
    idx = F.transform("codes", lambda x, k: F.when(
        x != M.GAP, (F.size(F.filter(F.slice("codes", 1, k + 1), lambda y: y != M.GAP)) - 1).cast("string")).otherwise("-"))
    return rows(spark, sf).select("family", "row_id", F.size(F.filter("codes", lambda x: x != M.GAP)).cast("bigint").alias("n_residues"),
                                  F.md5(F.array_join(idx, ",")).alias("index_map"))


@query("mutual_information", with_(CELLS, MI) + f"SELECT family, i, j, n_rows, {R('mi', 'mi')} FROM mi")
def mutual_information(spark, sf):
    return M.mutual_information(rows(spark, sf)).select("family", "i", "j", F.col("rows").alias("n_rows"), r6("mi"))


@query("apc_correction", with_(CELLS, MI, APC) + f"SELECT family, i, j, {R('coev', 'coev')} FROM coev")
def apc_correction(spark, sf):
    return coev(spark, sf).select("family", "i", "j", r6("coev"))


@query("neff_analytic", with_(CELLS, NEFF) + f"SELECT family, n_seqs, {R('mean_id', 'mean_id')}, {R('neff', 'neff')} FROM neff")
def neff_analytic(spark, sf):
    return neff(spark, sf).select("family", "n_seqs", r6("mean_id"), r6("neff"))


GREEDY = f"""np AS (SELECT x.family, x.row_id AS a, y.row_id AS b FROM cells x JOIN cells y ON x.family=y.family AND x.pos=y.pos AND x.row_id<y.row_id AND x.aa<20 AND y.aa<20
 GROUP BY ALL HAVING count(*)>=10 AND count(*) FILTER (x.aa=y.aa)>=count(*)/{num(C.E)}),
nl AS (SELECT family, b AS row_id, list(a) AS near FROM np GROUP BY ALL),
nd AS (SELECT ord.family, ord.row_id, o, coalesce(near,[]) AS near FROM ord LEFT JOIN nl USING (family,row_id)),
gr AS (SELECT DISTINCT family, -1::BIGINT AS o, []::BIGINT[] AS leaders FROM nd UNION ALL SELECT gr.family, gr.o+1, CASE WHEN len(list_intersect(leaders,near))>0 THEN leaders ELSE list_append(leaders,row_id) END
 FROM gr JOIN nd ON nd.family=gr.family AND nd.o=gr.o+1)"""


@query("neff_clusters", with_(CELLS, NEFF, GREEDY).replace("WITH ", "WITH RECURSIVE ", 1) + f"""SELECT family, n_seqs, n_clusters, {R('greatest(n_clusters,neff,1)', 'neff')} FROM neff
 JOIN (SELECT family, max(len(leaders))::BIGINT AS n_clusters FROM gr GROUP BY family) USING (family)""")
def neff_clusters(spark, sf):
    c = M.neff_clusters(rows(spark, sf)).join(neff(spark, sf).select("family", "neff"), "family")
    return c.select("family", "n_seqs", "n_clusters", r6(F.greatest("neff_clusters", "neff", F.lit(1.0)), "neff"))


DEPTH = f"n_seqs>=9 AND neff>={P}"


@query("depth_gate", with_(CELLS, NEFF) + f"SELECT family, n_seqs, {DEPTH} AS depth_ok FROM neff")
def depth_gate(spark, sf):
    return neff(spark, sf).select("family", "n_seqs", M.depth_ok().alias("depth_ok"))


@query("msa_summary", with_(CELLS, STATS, NEFF) + f"""SELECT family, n_seqs, {R('neff', 'neff')}, count(*) AS length, {R('avg(conservation)', 'mean_conservation')},
 {R('avg(gap_frac)', 'mean_gap_frac')}, count(*) FILTER (covered>0) AS n_covered, {DEPTH} AS depth_ok FROM stats JOIN neff USING (family) GROUP BY family, n_seqs, neff""")
def msa_summary(spark, sf):
    return stats(spark, sf).join(neff(spark, sf), "family").groupBy("family", "n_seqs", "neff").agg(
        F.count("*").alias("length"), r6(F.avg("conservation"), "mean_conservation"), r6(F.avg("gap_frac"), "mean_gap_frac"),
        F.count_if(F.col("covered") > 0).alias("n_covered")).select(
        "family", "n_seqs", r6("neff"), "length", "mean_conservation", "mean_gap_frac", "n_covered", M.depth_ok().alias("depth_ok"))




@query("evo_confidence", with_(CELLS, STATS, NEFF) + f""", ec AS (SELECT family, pos, greatest(0,least(1,conservation*(1-gap_frac)*(1-exp(-neff/{P})))) AS c FROM stats JOIN neff USING (family))
SELECT family, pos, {R('c', 'confidence')}, {R(f"1-(1-c)*(1-CASE pos%3 WHEN 0 THEN 1 WHEN 1 THEN 1/{P} ELSE 1/({P}*{P}) END)", 'fused')} FROM ec""")
def evo_confidence(spark, sf):
    e = M.evo_confidence(stats(spark, sf), neff(spark, sf).select("family", "neff"))
    prov = F.when(F.col("pos") % 3 == 0, "identical").when(F.col("pos") % 3 == 1, "mutated").otherwise("gap")
    return e.select("family", "pos", r6("confidence"), r6(M.fused_confidence(F.col("confidence"), prov), "fused"))


SCALE = """scl AS (SELECT family, avg(coev)+1e-12 AS scale FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(coev,9) DESC, i, j) AS k FROM coev WHERE j-i>=7)
 WHERE k<=64 GROUP BY family)"""


@query("top_l_normalise", with_(CELLS, MI, APC, SCALE) + f"SELECT family, i, j, {R('coev/scale', 'coev_norm')} FROM coev JOIN scl USING (family)")
def top_l_normalise(spark, sf):
    return M.top_l_normalise(coev(spark, sf), WIDTH).select("family", "i", "j", r6("coev_norm"))


BOOST = f"""bst AS (SELECT c.family, i, j, {num(M.EVO_AMP)}*coev/scale*sqrt(p.conservation*q.conservation)*(1-0.5::DOUBLE*(p.gap_frac+q.gap_frac)) AS boost,
 coev*sqrt(p.conservation*q.conservation) AS sc, coev FROM coev c JOIN scl USING (family) JOIN stats p ON p.family=c.family AND p.pos=i JOIN stats q ON q.family=c.family AND q.pos=j WHERE j-i>=7)"""


@query("evo_boost", with_(CELLS, STATS, MI, APC, SCALE, BOOST) + f"SELECT family, i, j, {R('boost', 'boost', 8)} FROM bst WHERE boost>0")
def evo_boost(spark, sf):
    return M.evo_boost(coev(spark, sf), stats(spark, sf), WIDTH).select("family", "i", "j", r6("boost", digits=8))


TOPC = """tcp AS (SELECT * FROM (SELECT *, round(sc,9) AS score, row_number() OVER (PARTITION BY family ORDER BY round(sc,9) DESC, i, j) AS rank FROM bst
 WHERE coev>0 AND round(sc,9)>0) WHERE rank<=64)"""


@query("top_coev_pairs", with_(CELLS, STATS, MI, APC, SCALE, BOOST, TOPC) + f"SELECT family, i, j, rank, {R('score', 'score')} FROM tcp")
def top_coev_pairs(spark, sf):
    return M.top_coev_pairs(coev(spark, sf), stats(spark, sf), WIDTH).select("family", "i", "j", "rank", r6("score"))


MODEL = """pt AS (SELECT family, c.pos, 8*sin(0.37::DOUBLE*c.pos+family) AS x, 8*cos(0.23::DOUBLE*c.pos) AS y, 6*sin(0.11::DOUBLE*c.pos+0.5::DOUBLE*family) AS z
 FROM (SELECT DISTINCT family, pos FROM cells) c)"""


@query("coev_agreement", with_(CELLS, STATS, MI, APC, SCALE, BOOST, TOPC, MODEL) + f"""SELECT t.family, count(*) AS n_pairs,
 {R(f"avg(CASE WHEN sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2))<{num(C.CONTACT * C.PHI)} THEN 1.0 ELSE 0 END)", 'agreement')} FROM tcp t
 JOIN pt a ON a.family=t.family AND a.pos=t.i JOIN pt b ON b.family=t.family AND b.pos=t.j GROUP BY t.family""")
def coev_agreement(spark, sf):
    from ..functions.common import dist

    def at(k):
        p, f = F.col(k), F.col("family")
        return {f"{k}_x": 8 * F.sin(0.37 * p + f), f"{k}_y": 8 * F.cos(0.23 * p), f"{k}_z": 6 * F.sin(0.11 * p + 0.5 * f)}

    t = M.top_coev_pairs(coev(spark, sf), stats(spark, sf), WIDTH).withColumns({**at("i"), **at("j")})
    hit = dist("i_", "j_") < C.CONTACT * C.PHI
    return t.groupBy("family").agg(F.count("*").alias("n_pairs"), r6(F.avg(hit.cast("double")), "agreement"))


@query("empty_profile", with_(CELLS, STATS) + f"""SELECT d.lang, p.pos, {R('coalesce(conservation,0)', 'conservation')}, {R('coalesce(gap_frac,1)', 'gap_frac')},
 {R(f'coalesce(entropy,{LN20})', 'entropy')} FROM (SELECT lang, row_number() OVER (ORDER BY lang)*4-4 AS family FROM (SELECT DISTINCT lang FROM documents)) d, (SELECT unnest(range(64)) AS pos) p
 LEFT JOIN stats ON stats.family=d.family AND stats.pos=p.pos""")
def empty_profile(spark, sf):
    """Targets without an alignment keep default columns."""
    from pyspark.sql import Window as W

    langs = table(spark, sf, "documents").select("lang").distinct()
    targets = langs.withColumn("family", F.row_number().over(W.orderBy("lang")) * 4 - 4)  # one row per language
    grid = targets.select("lang", "family", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("pos"))
    j = grid.join(stats(spark, sf), ["family", "pos"], "left")
    return j.select("lang", "pos", r6(F.coalesce("conservation", F.lit(0.0)), "conservation"),
                    r6(F.coalesce("gap_frac", F.lit(1.0)), "gap_frac"), r6(F.coalesce("entropy", F.lit(M.LN20)), "entropy"))


@query("msa_features", with_(CELLS, STATS, NEFF, MI, APC) + f"""SELECT s.family, {R('max(neff)', 'neff')}, {R('avg(conservation)', 'mean_conservation')},
 count(*) FILTER (covered>0) AS n_covered, {R('max(c.ms)', 'sum_coev', 4)}, {R('max(c.mx)', 'max_coev')} FROM stats s JOIN neff USING (family)
 JOIN (SELECT family, sum(coev) AS ms, max(coev) AS mx FROM coev GROUP BY family) c USING (family) GROUP BY s.family""")
def msa_features(spark, sf):
    c = coev(spark, sf).groupBy("family").agg(r6(F.sum("coev"), "sum_coev", 4), r6(F.max("coev"), "max_coev"))
    s = stats(spark, sf).groupBy("family").agg(r6(F.avg("conservation"), "mean_conservation"), F.count_if(F.col("covered") > 0).alias("n_covered"))
    return s.join(neff(spark, sf).select("family", r6("neff")), "family").join(c, "family")


