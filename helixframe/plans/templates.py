"""Template search and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structures as ST
from ..operators import templates as TP
from ..session import stored
from .base import CHAINS, P, R, chains, num, query, r6, spread, table, with_
from .structures import EN, KEYS, PTS, SCORE, kabsch_sql, others, pair_rmsd, points, reference, scores

MERS = """km AS (SELECT DISTINCT seq_id, substring(seq,(i+1)::INT,4) AS kmer FROM (SELECT seq_id, seq, unnest(range(greatest(length(seq)-3,0))) AS i FROM chains)),
seeds AS (SELECT a.seq_id AS query, b.seq_id AS homolog, count(*) AS shared FROM km a JOIN km b USING (kmer) WHERE a.seq_id<>b.seq_id GROUP BY ALL HAVING count(*)>=6),
cand AS (SELECT query, homolog, shared, q.seq AS qseq, h.seq AS hseq FROM seeds JOIN chains q ON q.seq_id=query JOIN chains h ON h.seq_id=homolog WHERE length(h.seq) BETWEEN 0.5*length(q.seq) AND 1.8*length(q.seq))"""


@query("kmer_seed_join", with_(CHAINS, MERS) + "SELECT query, homolog, shared FROM seeds")
def kmer_seed_join(spark, sf):
    c = spread(chains(spark, sf), "seq_id")
    return TP.kmer_seeds(c, c)


def candidates(spark, sf):
    c = spread(chains(spark, sf), "seq_id")
    q = c.select(F.col("seq_id").alias("query"), F.col("seq").alias("qseq"))
    h = c.select(F.col("seq_id").alias("homolog"), F.col("seq").alias("hseq"))
    return stored(spread(TP.length_prefilter(TP.kmer_seeds(c, c).join(q, "query").join(h, "homolog")), "query", "homolog"))


@query("length_prefilter", with_(CHAINS, MERS) + "SELECT query, homolog, shared FROM cand")
def length_prefilter(spark, sf):
    return candidates(spark, sf).select("query", "homolog", "shared")


@query("pairwise_align")
def pairwise_align(spark, sf):
    return TP.pairwise_align(spread(candidates(spark, sf), "query", "homolog")).select("query", "homolog", F.size("qi").alias("n_pairs"), F.md5(
        F.concat_ws(",", F.transform("qi", lambda x: x.cast("string")), F.transform("ti", lambda x: x.cast("string")))).alias("path"))


@query("alignment_identity")
def alignment_identity(spark, sf):
    c = candidates(spark, sf)
    a = TP.alignment_identity(stored(TP.pairwise_align(spread(c, "query", "homolog"))), c)
    return a.select("query", "homolog", "n_pairs", "n_same", r6("identity"), r6("coverage"), r6("score"))


@query("diagonal_seed_align", with_(CHAINS, MERS) + """, ql AS (SELECT query, homolog, unnest(range(length(qseq))) AS i, unnest(regexp_extract_all(qseq,'.')) AS aa FROM cand),
 hl AS (SELECT query, homolog, unnest(range(length(hseq))) AS j, unnest(regexp_extract_all(hseq,'.')) AS aa FROM cand),
 hit AS (SELECT query, homolog, i, j, i-row_number() OVER (PARTITION BY query, homolog, i-j ORDER BY i) AS g FROM ql JOIN hl USING (query, homolog, aa)),
 rn AS (SELECT query, homolog, count(*) AS length, min(i) AS qi, min(j) AS ti FROM hit GROUP BY query, homolog, i-j, g)
SELECT query, homolog, length, qi, ti FROM (SELECT *, row_number() OVER (PARTITION BY query, homolog ORDER BY length DESC, qi, ti) AS k FROM rn) WHERE k=1 AND length>=4""")
def diagonal_seed_align(spark, sf):
    return TP.diagonal_seed(spread(candidates(spark, sf), "query", "homolog")).select("query", "homolog", "length", "qi", "ti")


@query("provenance_class")
def provenance_class(spark, sf):
    """Residues of each query by what its best homolog says of them."""
    c = candidates(spark, sf)
    al = stored(TP.pairwise_align(spread(c, "query", "homolog")))
    best = TP.alignment_identity(al, c).groupBy("query").agg(F.max_by("homolog", F.struct(F.round("score", 9), -F.col("homolog"))).alias("homolog"))
    z = al.join(best, ["query", "homolog"]).join(c, ["query", "homolog"]).select("query", "qseq", "hseq", F.explode(F.arrays_zip("qi", "ti")).alias("z"))
    same = F.substr("qseq", F.col("z.qi") + 1, F.lit(1)) == F.substr("hseq", F.col("z.ti") + 1, F.lit(1))
    k = z.groupBy("query").agg(F.count_if(same).alias("identical"), F.count_if(~same).alias("mutated"), F.max(F.length("qseq")).alias("n"))
    return k.select("query", "identical", "mutated", (F.col("n") - F.col("identical") - F.col("mutated")).alias("gap"))


HITS = """hits AS (SELECT l_suppkey%50 AS target, l_partkey%400 AS pdb_id, l_linenumber%6 AS priority, l_orderkey AS ord, 0.4+l_quantity*0.012 AS identity, 0.6+l_discount*4 AS coverage, l_tax<0.08 AS sane FROM lineitem),
h1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, pdb_id ORDER BY priority, ord, identity, coverage) AS k FROM hits WHERE pdb_id<>target) WHERE k=1),
h2 AS (SELECT *, CASE WHEN priority>0 THEN row_number() OVER (PARTITION BY target, priority>0 ORDER BY priority, ord, pdb_id) ELSE 0 END AS rk FROM h1),
pool AS (SELECT target, pdb_id, priority, identity::DOUBLE AS identity, coverage::DOUBLE AS coverage, (identity*coverage)::DOUBLE AS score FROM h2 WHERE identity<=0.95 AND identity>=0.45 AND coverage>=0.65 AND sane)"""


def hits(spark, sf):
    h = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("target"), (F.col("l_partkey") % 400).alias("pdb_id"), (F.col("l_linenumber") % 6).alias("priority"),
        F.col("l_orderkey").alias("ord"), F.round(0.4 + F.col("l_quantity") * 0.012, 6).alias("identity"),
        F.round(0.6 + F.col("l_discount") * 4, 6).alias("coverage"), (F.col("l_tax") < 0.08).alias("sane"))
    return h


HITS = HITS.replace("0.4+l_quantity*0.012 AS identity", "round(0.4+l_quantity*0.012,6) AS identity").replace("0.6+l_discount*4 AS coverage", "round(0.6+l_discount*4,6) AS coverage")


@query("candidate_pool", with_(HITS) + f"SELECT target, count(*) AS n_pool, {R('max(score)', 'best')}, count(*) FILTER (priority=0) AS n_priority FROM pool GROUP BY target")
def candidate_pool(spark, sf):
    p = TP.candidate_pool(hits(spark, sf))
    return p.groupBy("target").agg(F.count("*").alias("n_pool"), r6(F.max("score"), "best"), F.count_if(F.col("priority") == 0).alias("n_priority"))


@query("exclude_self", with_(HITS) + "SELECT target, count(DISTINCT pdb_id) AS n FROM hits WHERE pdb_id<>target GROUP BY target")
def exclude_self(spark, sf):
    return hits(spark, sf).filter("pdb_id <> target").groupBy("target").agg(F.count_distinct("pdb_id").alias("n"))


SCO = EN + ", " + SCORE + f""", idn AS (SELECT target, model, score, 0.9::DOUBLE*score+CASE WHEN target%4=0 THEN 0.1::DOUBLE ELSE 0 END AS identity, energy, bond_mse FROM sco JOIN en USING (target, model)),
bs AS (SELECT target, max(score) AS best, arg_max(model, score) AS top, max((identity>=0.95)::INT) AS same FROM idn GROUP BY target),
bd AS (SELECT i.*, best, top, same, score>=best/{P} AS band FROM idn i JOIN bs USING (target)),
ag AS (SELECT target, best, top, same, count(*) FILTER (band) AS n_band, min(energy) FILTER (band) AS e_min, arg_min(model, energy) FILTER (band) AS band_low,
 min(energy) FILTER (identity>=0.95) AS same_min, arg_min(model, energy) FILTER (identity>=0.95) AS same_low, arg_max(model, score) FILTER (identity>=0.95) AS same_top,
 max(energy) FILTER (model=top) AS top_e, max(bond_mse) FILTER (model=top) AS top_b FROM bd GROUP BY ALL),
ft AS (SELECT bd.target, arg_max(bd.model, bd.score) AS fit_top FROM bd JOIN ag USING (target) WHERE bd.band AND bd.energy<={P}*e_min GROUP BY bd.target),
ab AS (SELECT ag.*, fit_top, top_e>{P}*e_min AND top_b>{num(TP.BROKEN)} AS unfit, (SELECT energy FROM idn WHERE idn.target=ag.target AND idn.model=same_top) AS same_e FROM ag LEFT JOIN ft USING (target))
"""


def scored(spark, sf):
    p = points(spark, sf)
    en = ST.interface_energy(p, KEYS).select(*KEYS, "energy").join(ST.bond_integrity(p, KEYS).select(*KEYS, "bond_mse"), KEYS)
    ident = 0.9 * F.col("score") + F.when(F.col("target") % 4 == 0, 0.1).otherwise(0.0)
    return scores(p).withColumn("identity", ident).join(en, KEYS)


@query("authority_band", SCO + f"""SELECT target, n_band, CASE WHEN same=1 THEN 'same_protein_consensus' WHEN best>=1/{P} AND unfit THEN 'residual_fit_data_authority' WHEN best>=1/{P} THEN 'data_authority_measured'
 ELSE 'residual_at_remote_interface' END AS mode, CASE WHEN same=1 THEN (CASE WHEN same_e>{P}*same_min THEN same_low ELSE same_top END) WHEN best>=1/{P} AND unfit THEN coalesce(fit_top, top)
 WHEN best>=1/{P} THEN top ELSE band_low END AS "primary" FROM ab""")
def authority_band(spark, sf):
    return TP.authority_band(scored(spark, sf))


@query("top5_by", SCO.split(",\nbs AS")[0] + """, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, model) AS rs, row_number() OVER (PARTITION BY target ORDER BY round(energy,9), model) AS re FROM idn)
SELECT target, model, 'score' AS list, rs AS rank FROM r WHERE rs<=5 UNION ALL SELECT target, model, 'energy', re FROM r WHERE re<=5""")
def top5_by(spark, sf):
    from ..operators.ranking import top_n

    s = scored(spark, sf)
    a = top_n(s, ["target"], "score", 5, ["model"], step=0.05).select("target", "model", F.lit("score").alias("list"), "rank")
    e = s.withColumn("neg", -F.round("energy", 9))
    return a.unionByName(top_n(e, ["target"], "neg", 5, ["model"], step=5.0).select("target", "model", F.lit("energy").alias("list"), "rank"))


@query("flip_partner")
def flip_partner(spark, sf):
    p = points(spark, sf)
    dev = ST.per_residue_deviation(others(p), reference(p), ["target"], ["model"]).select("target", "model", "deviation")
    pairs = pair_rmsd(spark, sf).filter("m1 = 0").select("target", F.col("m2").alias("model"), "rmsd")
    s = scored(spark, sf)
    primary = s.filter("model = 0").select("target", "model")
    return TP.flip_partner(dev, pairs, s, primary).select("target", "partner", r6("rmsd"))


@query("apparatus_min", with_(PTS) + ", " + """mp AS (SELECT a.target, b.model AS m2, b.x AS px, b.y AS py, b.z AS pz, a.x AS qx, a.y AS qy, a.z AS qz FROM pts a JOIN pts b ON a.target=b.target AND a.idx=b.idx AND a.model=0 AND b.model>0), """
       + kabsch_sql("mp", "target,m2") + f" SELECT target, arg_min(m2, round(rmsd,9)) AS winner, {R('min(rmsd)', 'rmsd')} FROM kb GROUP BY target")
def apparatus_min(spark, sf):
    pairs = pair_rmsd(spark, sf).filter("m1 = 0")
    return pairs.groupBy("target").agg(F.min_by("m2", F.round("rmsd", 9)).alias("winner"), r6(F.min("rmsd"), "rmsd"))


@query("partner_chain_pick", with_(HITS) + f"""SELECT target, pdb_id, chain, {R('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY target, pdb_id ORDER BY score DESC, chain) AS k FROM
 (SELECT target, pdb_id//8 AS pdb_id, pdb_id%8 AS chain, max(round(identity*coverage,9))::DOUBLE AS score FROM hits WHERE identity>=0.7 AND coverage>=0.7 GROUP BY ALL)) WHERE k=1""")
def partner_chain_pick(spark, sf):
    """Best chain per (target, structure) by identity times coverage."""
    h = hits(spark, sf).filter("identity >= 0.7 and coverage >= 0.7").groupBy("target", F.floor(F.col("pdb_id") / 8).alias("structure"), (F.col("pdb_id") % 8).alias("chain")).agg(
        F.max(F.round(F.col("identity") * F.col("coverage"), 9)).alias("score"))
    return h.groupBy("target", "structure").agg(F.max_by("chain", F.struct("score", -F.col("chain"))).alias("chain"), F.max("score").alias("s")).select(
        "target", F.col("structure").alias("pdb_id"), "chain", r6("s", "score"))


@query("collapse_candidates", with_(HITS) + """, d AS (SELECT target, pdb_id, bool_or(priority=1) AS nucleic FROM hits GROUP BY ALL)
SELECT target, pdb_id, nucleic FROM (SELECT *, bool_or(nucleic) OVER (PARTITION BY target) AS a FROM d) WHERE nucleic OR NOT a""")
def collapse_candidates(spark, sf):
    """Distinct structures; only nucleic-bound ones where the target has any."""
    d = hits(spark, sf).groupBy("target", "pdb_id").agg(F.bool_or(F.col("priority") == 1).alias("nucleic"))
    any_ = d.groupBy("target").agg(F.bool_or("nucleic").alias("a"))
    return d.join(any_, "target").filter(F.col("nucleic") | ~F.col("a")).select("target", "pdb_id", "nucleic")


@query("regime_select", """SELECT CASE WHEN l_returnflag='A' AND l_quantity>20 THEN 'template_msa_fuse' WHEN l_returnflag='A' THEN 'template_physics' WHEN l_linestatus='O' AND l_quantity>20 THEN 'bulk_msa'
 WHEN l_linestatus='O' THEN 'bulk_single' ELSE 'no_measured_map' END AS regime, count(*) AS n FROM lineitem GROUP BY 1""")
def regime_select(spark, sf):
    template, depth, force = F.col("l_returnflag") == "A", F.col("l_quantity") > 20, F.col("l_linestatus") == "O"
    regime = (F.when(template & depth, "template_msa_fuse").when(template, "template_physics").when(force & depth, "bulk_msa")
              .when(force, "bulk_single").otherwise("no_measured_map"))
    return table(spark, sf, "lineitem").groupBy(regime.alias("regime")).agg(F.count("*").alias("n"))


@query("window_align", with_(CHAINS, MERS) + """, ofs AS (SELECT query, homolog, i, j, (SELECT count(*) FROM range(least(length(qseq)-i,length(hseq)-j)) t(k) WHERE substring(qseq,(i+k+1)::INT,1)=substring(hseq,(j+k+1)::INT,1)) AS same,
 least(length(qseq)-i,length(hseq)-j) AS len FROM cand, (SELECT unnest(range(31)) AS i) a, (SELECT unnest(range(31)) AS j) b WHERE (i=0 OR j=0) AND i<length(qseq) AND j<length(hseq))
SELECT query, homolog, i, j, """ + R("same/len::DOUBLE", "identity") + """ FROM (SELECT *, row_number() OVER (PARTITION BY query, homolog ORDER BY round(same/len::DOUBLE,9) DESC, i, j) AS r FROM ofs) WHERE r=1""")
def window_align(spark, sf):
    """Best start offsets up to 30 by identity of the overlap."""
    i = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.struct(k.alias("i"), F.lit(0).alias("j")))
    j = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.struct(F.lit(0).alias("i"), k.alias("j")))
    o = candidates(spark, sf).select("query", "homolog", "qseq", "hseq", F.explode(F.concat(i, j)).alias("o")).select("query", "homolog", "qseq", "hseq", "o.i", "o.j")
    n = F.least(F.length("qseq") - F.col("i"), F.length("hseq") - F.col("j"))
    o = o.withColumn("len", n).filter("len > 0").withColumns({
        "a": F.split(F.substr("qseq", F.col("i") + 1, F.col("len")), ""), "b": F.split(F.substr("hseq", F.col("j") + 1, F.col("len")), "")})
    same = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda v: v))
    s = o.select("query", "homolog", "i", "j", (same / F.col("len")).alias("identity"))
    best = s.groupBy("query", "homolog").agg(F.max_by(F.struct("i", "j", "identity"), F.struct(F.round("identity", 9), -F.col("i"), -F.col("j"))).alias("b"))
    return best.select("query", "homolog", F.col("b.i").cast("bigint").alias("i"), F.col("b.j").cast("bigint").alias("j"), r6("b.identity", "identity"))


