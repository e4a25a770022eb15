"""Variant queries: genes are benchmark passages, observations and variants are order lines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import constants as C
from .. import dims
from ..operators import variants as V
from .base import AA, CHAINS, CODON_DIM, R, chains, num, query, r6, table, with_

N_GENES = "(SELECT count(*) FROM benchmark)"
AA21 = C.AA20 + "*"
GENES = CHAINS + ",\ngenes AS (SELECT seq_id AS gene, seq, length(seq) AS len FROM chains)"
OBS = f"""obs AS (SELECT gene, pos, CASE WHEN l_quantity<=35+gene%10 THEN substring(seq,pos::INT,1) ELSE substring('{C.AA20}',(l_orderkey%20+1)::INT,1) END AS aa
 FROM (SELECT l.*, gene, seq, len, l_partkey%len+1 AS pos FROM lineitem l JOIN genes ON gene=l_suppkey%{N_GENES} WHERE len>0))"""
LN20 = num(math.log(20.0))
PROFILE = f"""oc AS (SELECT gene, pos, aa, count(*) AS n FROM obs GROUP BY ALL),
ot AS (SELECT gene, pos, sum(n) AS t FROM oc GROUP BY ALL),
oh AS (SELECT gene, pos, t, -sum(n/t::DOUBLE*ln(n/t::DOUBLE)) AS h FROM oc JOIN ot USING (gene,pos) GROUP BY ALL),
gp AS (SELECT gene, unnest(range(1,len+1)) AS pos, unnest(regexp_extract_all(seq,'.')) AS wt FROM genes),
prof AS (SELECT gp.gene, gp.pos, wt, coalesce(t,0)::BIGINT AS cover, CASE WHEN t>0 THEN coalesce(oc.n,0)/t::DOUBLE ELSE 0 END AS ic,
 CASE WHEN t>0 THEN greatest(0,1-greatest(h,0)/{LN20}) ELSE 0 END AS sh FROM gp LEFT JOIN oh USING (gene,pos)
 LEFT JOIN oc ON oc.gene=gp.gene AND oc.pos=gp.pos AND oc.aa=gp.wt),
profile AS (SELECT *, greatest(ic,sh) AS cons FROM prof)"""
BG = f"""bg AS (SELECT p.gene, p.pos, wt, m.mut, round(cons*(1-coalesce(n/t::DOUBLE,0)),12) AS impact FROM profile p,
 (SELECT unnest(regexp_extract_all('{C.AA20}','.')) AS mut) m LEFT JOIN oc ON oc.gene=p.gene AND oc.pos=p.pos AND oc.aa=m.mut
 LEFT JOIN ot ON ot.gene=p.gene AND ot.pos=p.pos WHERE mut<>wt)"""
VARS = f"""vars AS (SELECT gene, pos, CASE WHEN l_tax=0.08 THEN substring('{C.AA20}',l_linenumber,1) ELSE coalesce(nullif(substring(seq,pos::INT,1),''),'A') END AS wt,
 substring('{AA21}',(l_quantity::BIGINT%21+1)::INT,1) AS mut, max(l_discount*5) AS pop_af, count(*) AS n_obs FROM
 (SELECT l.*, gene, seq, l_partkey%(len+20)+1 AS pos FROM lineitem l JOIN genes ON gene=l_suppkey%{N_GENES}) GROUP BY ALL)"""
SCORED = f"""v0 AS (SELECT v.*, p.wt AS seq_wt, cons, cover, ic, sh, CASE WHEN p.wt IS NULL THEN 'position_out_of_range' WHEN p.wt<>v.wt THEN
  'sequence_mismatch_expected_'||v.wt||'_found_'||p.wt END AS error FROM vars v LEFT JOIN profile p USING (gene,pos)),
v1 AS (SELECT v0.*, CASE WHEN error IS NULL THEN (CASE WHEN mut='*' THEN 'nonsense' ELSE 'missense' END) END AS kind, coalesce(cover>0 AND cons>0,false) AS cov,
 CASE WHEN error IS NULL AND mut<>'*' THEN coalesce(n/t::DOUBLE,0) END AS f_mut,
 CASE WHEN error IS NULL THEN (CASE WHEN mut='*' THEN 1.0 ELSE round(cons*(1-coalesce(n/t::DOUBLE,0)),12) END) END AS impact
 FROM v0 LEFT JOIN oc ON oc.gene=v0.gene AND oc.pos=v0.pos AND oc.aa=v0.mut LEFT JOIN ot ON ot.gene=v0.gene AND ot.pos=v0.pos),
bgc AS (SELECT gene, impact, count(*) AS c FROM bg GROUP BY ALL),
bgt AS (SELECT gene, count(*) AS tot FROM bg GROUP BY gene),
vi AS (SELECT DISTINCT gene, impact FROM v1 WHERE impact IS NOT NULL),
vb AS (SELECT vi.gene, vi.impact, coalesce(sum(c) FILTER (bgc.impact<vi.impact),0) AS below FROM vi JOIN bgc ON bgc.gene=vi.gene GROUP BY ALL),
v2 AS (SELECT v1.*, CASE WHEN kind='nonsense' THEN 100 WHEN kind IS NOT NULL AND cov THEN 100.0::DOUBLE*below/tot END AS pct FROM v1 LEFT JOIN vb ON vb.gene=v1.gene AND vb.impact=v1.impact
 LEFT JOIN bgt ON bgt.gene=v1.gene),
v3 AS (SELECT *, CASE WHEN cons>={num(C.CONS_HIGH)} AND f_mut<={num(C.FMUT_RARE)} THEN 'LIKELY DAMAGING' WHEN cons>={num(C.CONS_MID)} AND f_mut<={num(C.FMUT_ABSENT)} THEN 'uncertain'
 WHEN pct>=75 THEN 'LIKELY DAMAGING' WHEN pct>=40 THEN 'uncertain' WHEN cons>={num(C.CONS_MID)} AND f_mut<={num(C.FMUT_RARE)} THEN 'uncertain' ELSE 'likely tolerated' END AS base FROM v2),
scored AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN kind='nonsense' THEN 'LIKELY DAMAGING' WHEN NOT cov THEN 'insufficient_MSA_coverage'
 WHEN base='LIKELY DAMAGING' AND pop_af>={num(C.POP_AF_COMMON)} THEN 'common_polymorphism' ELSE base END AS call FROM v3)"""
ALL = with_(GENES, OBS, PROFILE, BG, VARS, SCORED)


def genes(spark, sf):
    return chains(spark, sf).select(F.col("seq_id").alias("gene"), "seq")


def n_genes(spark, sf):
    """Number of genes, as a scalar subquery."""
    return table(spark, sf, "benchmark").agg(F.count("*")).scalar()


def line_genes(spark, sf, beyond):
    """Lines dealt over all genes, at positions up to ``beyond`` letters past a gene's end."""
    li = table(spark, sf, "lineitem").withColumn("gene", F.col("l_suppkey") % n_genes(spark, sf))
    li = li.join(genes(spark, sf), "gene").filter(F.length("seq") + beyond > 0)
    return li.withColumn("pos", F.col("l_partkey") % (F.length("seq") + beyond) + 1)


def letter(text, k):
    return F.substring(F.lit(text), (k + 1).cast("int"), F.lit(1))


def observations(spark, sf):
    li = line_genes(spark, sf, 0)
    own = F.substring("seq", F.col("pos").cast("int"), F.lit(1))
    return li.select("gene", "pos", F.when(F.col("l_quantity") <= 35 + F.col("gene") % 10, own)
                     .otherwise(letter(C.AA20, F.col("l_orderkey") % 20)).alias("aa"))


def profile(spark, sf):
    return V.position_profile(genes(spark, sf), observations(spark, sf))


def variants(spark, sf):
    li = line_genes(spark, sf, 20)
    own = F.coalesce(F.nullif(F.substring("seq", F.col("pos").cast("int"), F.lit(1)), F.lit("")), F.lit("A"))
    wt = F.when(F.col("l_tax") == 0.08, letter(C.AA20, F.col("l_linenumber") - 1)).otherwise(own)
    mut = letter(AA21, F.col("l_quantity").cast("bigint") % 21)
    return (li.select("gene", "pos", wt.alias("wt"), mut.alias("mut"), (F.col("l_discount") * 5).alias("pop_af"))
            .groupBy("gene", "pos", "wt", "mut").agg(F.max("pop_af").alias("pop_af"), F.count("*").alias("n_obs")))


def scored(spark, sf):
    p = profile(spark, sf)
    return V.score_variants(variants(spark, sf), p, V.missense_background(p))


@query("missense_background", with_(GENES, OBS, PROFILE, BG) + f"""SELECT gene, pos, count(*) AS n, {R('sum(impact)', 'impact_sum')}, {R('max(impact)', 'impact_max')}
 FROM bg GROUP BY gene, pos""")
def missense_background(spark, sf):
    return V.missense_background(profile(spark, sf)).groupBy("gene", "pos").agg(
        F.count("*").alias("n"), r6(F.sum("impact"), "impact_sum"), r6(F.max("impact"), "impact_max"))


@query("variant_validate", with_(GENES, VARS) + """, gp AS (SELECT gene, unnest(range(1,len+1)) AS pos, unnest(regexp_extract_all(seq,'.')) AS w FROM genes)
SELECT v.gene, v.pos, v.wt, v.mut, CASE WHEN w IS NULL THEN 'position_out_of_range' WHEN w<>wt THEN 'sequence_mismatch_expected_'||wt||'_found_'||w END AS error
FROM vars v LEFT JOIN gp USING (gene,pos)""")
def variant_validate(spark, sf):
    return V.validate(variants(spark, sf), genes(spark, sf)).select("gene", "pos", "wt", "mut", "error")


@query("variant_score", ALL + f"""SELECT gene, pos, wt, mut, error, kind, {R('cons', 'cons')}, {R('ic', 'identity_cons')}, {R('sh', 'shannon')}, {R('f_mut', 'f_mut')},
 {R('impact', 'impact')}, {R('pct', 'percentile')}, call FROM scored""")
def variant_score(spark, sf):
    return scored(spark, sf).select("gene", "pos", "wt", "mut", "error", "kind", "call", *[
        r6(k) for k in ("cons", "identity_cons", "shannon", "f_mut", "impact", "percentile")])


@query("variant_percentile", ALL + f"SELECT gene, pos, mut, {R('max(pct)', 'percentile')} FROM scored WHERE error IS NULL GROUP BY ALL")
def variant_percentile(spark, sf):
    return (scored(spark, sf).filter(F.col("error").isNull()).groupBy("gene", "pos", "mut")
            .agg(r6(F.max("percentile"), "percentile")))


@query("variant_call", ALL + "SELECT gene, call, count(*) AS n FROM scored WHERE error IS NULL GROUP BY ALL")
def variant_call(spark, sf):
    return scored(spark, sf).filter(F.col("error").isNull()).groupBy("gene", "call").agg(F.count("*").alias("n"))


@query("variant_call_pct", ALL + """SELECT gene, CASE WHEN pct>=75 THEN 'LIKELY DAMAGING' WHEN pct>=40 THEN 'uncertain' ELSE 'likely tolerated' END AS call, count(*) AS n
 FROM scored WHERE pct IS NOT NULL GROUP BY ALL""")
def variant_call_pct(spark, sf):
    s = scored(spark, sf).filter(F.col("percentile").isNotNull())
    return s.groupBy("gene", V.call_by_percentile(F.col("percentile")).alias("call")).agg(F.count("*").alias("n"))


@query("panel_summary", ALL + f"""SELECT gene, count(*) AS n_variants, count(*) FILTER (error IS NULL) AS n_scored, count(*) FILTER (call='LIKELY DAMAGING') AS n_damaging,
 {R('avg(pct)', 'mean_percentile', 5)}, {R("count(*) FILTER (call='LIKELY DAMAGING')/count(*) FILTER (error IS NULL)::DOUBLE", 'recall')} FROM scored GROUP BY ROLLUP(gene)""")
def panel_summary(spark, sf):
    return V.panel_summary(scored(spark, sf)).select("gene", "n_variants", "n_scored", "n_damaging", r6("mean_percentile", digits=5), r6("recall"))


LABEL = "['pathogenic','drug_resistance','benign_like'][(pos%3+1)::INT]"


@query("label_agreement", ALL + f"""SELECT label, count(*) AS n, count(*) FILTER (CASE WHEN label='benign_like' THEN call<>'LIKELY DAMAGING' ELSE call='LIKELY DAMAGING' END) AS n_agree
 FROM (SELECT *, {LABEL} AS label FROM scored WHERE error IS NULL) GROUP BY label""")
def label_agreement(spark, sf):
    label = F.get(F.array(*[F.lit(x) for x in ("pathogenic", "drug_resistance", "benign_like")]), (F.col("pos") % 3).cast("int"))
    s = scored(spark, sf).filter(F.col("error").isNull()).withColumn("label", label)
    damaging = F.col("call") == "LIKELY DAMAGING"
    agree = F.when(F.col("label") == "benign_like", ~damaging).otherwise(damaging)
    return s.groupBy("label").agg(F.count("*").alias("n"), F.count_if(agree).alias("n_agree"))


@query("variant_class", with_(CODON_DIM) + """, cx AS (SELECT codon, aa, row_number() OVER (ORDER BY codon)-1 AS k FROM codon_dim),
 ch AS (SELECT codon AS wt_codon, l_linenumber%3 AS codon_pos, substring('ACGT',(l_suppkey%4+1)::INT,1) AS alt, aa AS aa_wt, count(*) AS n FROM lineitem JOIN cx ON k=l_partkey%64 GROUP BY ALL),
 mu AS (SELECT *, substring(wt_codon,1,codon_pos)||alt||substring(wt_codon,codon_pos+2) AS mut_codon FROM ch)
SELECT wt_codon, codon_pos, alt, n, aa_wt, d.aa AS aa_mut, CASE WHEN aa_wt=d.aa THEN 'synonymous' WHEN d.aa='*' THEN 'nonsense' ELSE 'missense' END AS kind
FROM mu JOIN codon_dim d ON d.codon=mut_codon""")
def variant_class(spark, sf):
    k = F.col("l_partkey") % 64
    digit = lambda p: F.substring(F.lit("ACGT"), (F.floor(k / p) % 4 + 1).cast("int"), F.lit(1))
    ch = table(spark, sf, "lineitem").select(
        F.concat(digit(16), digit(4), digit(1)).alias("wt_codon"), (F.col("l_linenumber") % 3).alias("codon_pos"),
        letter("ACGT", F.col("l_suppkey") % 4).alias("alt")).groupBy("wt_codon", "codon_pos", "alt").agg(F.count("*").alias("n"))
    return V.classify_codon_change(ch).select("wt_codon", "codon_pos", "alt", "n", "aa_wt", "aa_mut", "kind")


DOMS = f"doms AS (SELECT p_partkey%{N_GENES} AS gene, p_partkey AS ord, p_brand AS pfam, p_size AS \"start\", p_size+10 AS \"end\" FROM part)"


def domains(spark, sf):
    return table(spark, sf, "part").select(
        (F.col("p_partkey") % n_genes(spark, sf)).alias("gene"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("pfam"),
        F.col("p_size").alias("start"), (F.col("p_size") + 10).alias("end"))


@query("position_domain", with_(GENES, VARS, DOMS) + """, vp AS (SELECT DISTINCT gene, pos FROM vars),
 h AS (SELECT vp.gene, vp.pos, min(ord) AS ord FROM vp JOIN doms d ON d.gene=vp.gene AND vp.pos BETWEEN d."start" AND d."end" GROUP BY ALL)
SELECT vp.gene, vp.pos, coalesce(pfam,'default_'||vp.gene) AS pfam, "start", "end" FROM vp LEFT JOIN h USING (gene,pos) LEFT JOIN doms ON doms.gene=vp.gene AND doms.ord=h.ord""")
def position_domain(spark, sf):
    return V.position_domain(variants(spark, sf).select("gene", "pos").distinct(), domains(spark, sf))


SRC = f"""src AS (SELECT gene, l_partkey%len+1 AS pos, CASE WHEN l_returnflag='A' THEN 'cluster50' WHEN l_returnflag='N' THEN 'cluster90' ELSE 'family' END AS source,
 CASE WHEN l_returnflag='A' THEN 1 WHEN l_returnflag='N' THEN 2 ELSE 3 END AS priority FROM lineitem JOIN genes ON gene=l_suppkey%{N_GENES} WHERE len>0)"""


def source_rows(spark, sf):
    flag = F.col("l_returnflag")
    return line_genes(spark, sf, 0).select(
        "gene", "pos",
        F.when(flag == "A", "cluster50").when(flag == "N", "cluster90").otherwise("family").alias("source"),
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("priority"))


@query("profile_fallback", with_(GENES, SRC) + f""", g AS (SELECT gene, source, priority, count(*) AS n_rows, count(DISTINCT pos) AS n_pos FROM src GROUP BY ALL),
 o AS (SELECT genes.gene, source, n_rows, n_pos/len::DOUBLE AS coverage, row_number() OVER (PARTITION BY genes.gene ORDER BY priority) AS k FROM genes JOIN g USING (gene)
  WHERE source='family' OR (n_rows>=20 AND n_pos/len::DOUBLE>=0.5))
SELECT genes.gene, coalesce(source,'empty') AS chosen, coalesce(n_rows,0) AS n_rows, {R('coalesce(coverage,0)', 'coverage')} FROM genes LEFT JOIN o ON o.gene=genes.gene AND k=1""")
def profile_fallback(spark, sf):
    lengths = genes(spark, sf).select("gene", F.length("seq").alias("length"))
    return V.profile_fallback(source_rows(spark, sf), lengths).select("gene", "chosen", "n_rows", r6("coverage"))


@query("msa_source_fallback", with_(GENES, SRC) + """, g AS (SELECT gene AS target, source, priority, count(*) AS n_rows FROM src GROUP BY ALL)
SELECT target, source, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY priority) AS k FROM g WHERE n_rows>0) WHERE k=1""")
def msa_source_fallback(spark, sf):
    s = source_rows(spark, sf).groupBy(F.col("gene").alias("target"), "source", "priority").agg(F.count("*").alias("n_rows"))
    return V.source_fallback(s)


@query("cluster_lookup", """WITH m AS (SELECT 'A'||c_custkey||'.' AS accession, 'CL_A'||(c_custkey//7*7)||'.' AS cluster, 1 AS ord FROM customer
 UNION ALL SELECT 'A'||c_custkey||'.', 'CL_A'||(c_custkey%97)||'.', 0 FROM customer),
 p AS (SELECT accession, cluster FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY NOT contains(cluster,accession), ord) AS k FROM m) WHERE k=1),
 s AS (SELECT cluster, count(DISTINCT accession) AS n FROM m GROUP BY cluster)
SELECT accession, cluster, n-1 AS other_members FROM p JOIN s USING (cluster)""")
def cluster_lookup(spark, sf):
    c = table(spark, sf, "customer")
    name = lambda k: F.concat(F.lit("A"), k.cast("string"), F.lit("."))
    k = F.col("c_custkey")
    one = c.select(name(k).alias("accession"), F.concat(F.lit("CL_"), name((F.floor(k / 7) * 7).cast("bigint"))).alias("cluster"), F.lit(1).alias("ord"))
    two = c.select(name(k).alias("accession"), F.concat(F.lit("CL_"), name(k % 97)).alias("cluster"), F.lit(0).alias("ord"))
    return V.cluster_lookup(one.unionByName(two))


@query("cluster_profile", with_(GENES, OBS, PROFILE) + f"SELECT gene, pos, wt, cover AS n_members, {R('ic', 'identity_cons')}, {R('sh', 'shannon')} FROM profile")
def cluster_profile(spark, sf):
    return profile(spark, sf).select("gene", "pos", "wt", F.col("cover").alias("n_members"), r6("identity_cons"), r6("shannon"))


WORD = ["c", "p", "v", "aromatic", "branch", "hetero", "detail"]


@query("opcode_delta", with_(GENES, VARS, AA) + f""", s AS (SELECT wt, mut, count(*) AS n FROM vars WHERE mut<>'*' GROUP BY ALL)
SELECT wt, mut, n, {R('sqrt(' + '+'.join(f'pow(a.{k}-b.{k},2)' for k in WORD) + ')', 'opcode')},
 {R('abs(a.charge-b.charge)+abs(a.hydro-b.hydro)/4.5+abs(a.volume-b.volume)', 'chemistry')} FROM s JOIN aa a ON a.aa=wt JOIN aa b ON b.aa=mut""")
def opcode_delta(spark, sf):
    s = variants(spark, sf).filter(F.col("mut") != "*").groupBy("wt", "mut").agg(F.count("*").alias("n"))
    cols = [*WORD, "charge", "hydro", "volume"]
    d = dims.aa_dim(spark)
    a = d.select(F.col("aa").alias("wt"), *[F.col(k).alias("a_" + k) for k in cols])
    b = d.select(F.col("aa").alias("mut"), *[F.col(k).alias("b_" + k) for k in cols])
    diff = lambda k: F.col("a_" + k) - F.col("b_" + k)
    j = s.join(F.broadcast(a), "wt").join(F.broadcast(b), "mut")
    return j.select("wt", "mut", "n", r6(F.sqrt(sum((diff(k) * diff(k) for k in WORD), F.lit(0)).cast("double")), "opcode"),
                    r6(F.abs(diff("charge")) + F.abs(diff("hydro")) / 4.5 + F.abs(diff("volume")), "chemistry"))


