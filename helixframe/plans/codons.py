"""Nucleotide and codon queries over DNA spelled by the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import bases as B
from ..operators import sequences as S
from .base import (CODON_DIM, CODONS, DNA, UP, E_, G, P, PI_, R, cl, dna, query, r6, with_)

COUNT_SQL = """oc AS (SELECT seq_id, count(*) FILTER (b='A') AS a, count(*) FILTER (b='C') AS c,
 count(*) FILTER (b='G') AS g, count(*) FILTER (b='T') AS t, count(*) FILTER (b NOT IN ('A','C','G','T')) AS n
 FROM (SELECT seq_id, unnest(regexp_extract_all(seq,'.')) AS b FROM dnau) GROUP BY seq_id),
cc AS (SELECT seq_id, count(*) AS codons_total, count(*) FILTER (codon='ATG') AS codons_start,
 count(*) FILTER (codon IN ('TAA','TAG','TGA')) AS codons_stop FROM codons GROUP BY seq_id)"""

OBS_SQL = with_(DNA, UP, CODONS, COUNT_SQL) + f"""
SELECT oc.seq_id, a, c, g, t, n, coalesce(codons_total,0) AS codons_total, coalesce(codons_start,0) AS codons_start,
 coalesce(codons_stop,0) AS codons_stop, a+g-c-t AS primary_sum, a-t AS secondary_sum,
 {R("coalesce((g+c)/nullif(a+c+g+t,0)::DOUBLE,0)", "gc_frac")},
 {R("coalesce(a/nullif(t,0)::DOUBLE,0)", "at_ratio")}, {R("coalesce(g/nullif(c,0)::DOUBLE,0)", "gc_ratio")},
 {R("coalesce((a-t)/nullif(a+c+g+t,0)::DOUBLE,0)", "super_density")},
 {R("coalesce((a+g-c-t)/nullif(a+c+g+t,0)::DOUBLE,0)", "spin_density")}
FROM oc LEFT JOIN cc USING (seq_id)"""

RATIOS = ["gc_frac", "at_ratio", "gc_ratio", "super_density", "spin_density"]


def rounded_observables(df):
    return df.select(*[c for c in df.columns if c not in RATIOS], *[r6(k) for k in RATIOS])


@query("genome_observables", OBS_SQL)
def genome_observables(spark, sf):
    return rounded_observables(S.genome_observables(dna(spark, sf).filter(F.length("seq") > 0)))


@query("codon_usage", with_(DNA, UP, CODONS, CODON_DIM) + """
SELECT codon, coalesce(d.aa,'X') AS aa, count(*) AS n FROM codons LEFT JOIN codon_dim d USING (codon) GROUP BY ALL""")
def codon_usage(spark, sf):
    return S.codon_usage(dna(spark, sf))


USED = with_(DNA, UP, CODONS, CODON_DIM, """used AS (SELECT codon, count(*) AS n FROM codons GROUP BY codon),
pos AS (SELECT codon, n, substring(codon,1,1) AS b1, substring(codon,2,1) AS b2, substring(codon,3,1) AS b3 FROM used)""")


def used(spark, sf):
    return S.explode_codons(dna(spark, sf)).groupBy("codon").agg(F.count("*").alias("n"))


def prim(b):
    return f"(CASE WHEN {b} IN ('A','G') THEN 1 WHEN {b} IN ('C','T') THEN -1 ELSE 0 END)"


def seco(b):
    return f"(CASE {b} WHEN 'A' THEN 1 WHEN 'T' THEN -1 ELSE 0 END)"


BASES_SQL = with_(DNA, "bc AS (SELECT unnest(regexp_extract_all(seq,'.')) AS base FROM dna)")


def base_letters(spark, sf):
    return (dna(spark, sf).select(F.explode(B.letters_of("seq")).alias("base"))
            .groupBy("base").agg(F.count("*").alias("n")))


@query("base_primary", BASES_SQL + """SELECT base, count(*) AS n,
 CASE WHEN base IN ('A','G') THEN 1 WHEN base IN ('C','T','U') THEN -1 ELSE 0 END AS trit FROM bc GROUP BY ALL""")
def base_primary(spark, sf):
    return base_letters(spark, sf).withColumn("trit", B.base_primary("base"))


@query("base_secondary", BASES_SQL + """SELECT base, count(*) AS n,
 CASE WHEN base='A' THEN 1 WHEN base IN ('T','U') THEN -1 ELSE 0 END AS trit FROM bc GROUP BY ALL""")
def base_secondary(spark, sf):
    return base_letters(spark, sf).withColumn("trit", B.base_secondary("base"))


@query("codon_trits", USED + "SELECT codon, n, " + ", ".join(
    f"{prim(f'b{k}')} AS p{k}, {seco(f'b{k}')} AS s{k}" for k in (1, 2, 3)) + " FROM pos")
def codon_trits(spark, sf):
    t = used(spark, sf).withColumn("t", B.codon_trits("codon"))
    return t.select("codon", "n", *[F.col("t")["primary"][k].alias(f"p{k + 1}") for k in range(3)],
                    *[F.col("t")["secondary"][k].alias(f"s{k + 1}") for k in range(3)])


@query("codon_pack", USED + f"""SELECT codon, n, {prim('b1')}+1+3*({prim('b2')}+1)+9*({prim('b3')}+1)
 +27*({seco('b1')}+1+3*({seco('b2')}+1)+9*({seco('b3')}+1)) AS pack FROM pos""")
def codon_pack(spark, sf):
    return used(spark, sf).withColumn("pack", B.codon_pack("codon"))


def code(b):
    return f"(CASE {b} WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 3 WHEN 'T' THEN 4 ELSE 0 END)"


@query("codon_key", USED + f"SELECT codon, n, {code('b1')}*256+{code('b2')}*16+{code('b3')} AS key FROM pos")
def codon_key(spark, sf):
    return used(spark, sf).withColumn("key", B.codon_key("codon"))


@query("complement", with_(DNA) + """SELECT seq_id, length(seq) AS n,
 md5(reverse(translate(seq,'ACGTUN','TGCAAN'))) AS reverse_complement FROM dna""")
def complement(spark, sf):
    return dna(spark, sf).select("seq_id", F.length("seq").alias("n"),
                                 F.md5(B.reverse_complement("seq")).alias("reverse_complement"))


BIGRAMS = with_(DNA, UP, """bg AS (SELECT seq_id, b AS b1, lead(b) OVER (PARTITION BY seq_id ORDER BY k) AS b2 FROM
 (SELECT seq_id, unnest(regexp_extract_all(seq,'.')) AS b, unnest(range(length(seq))) AS k FROM dnau))""",
                """hb AS (SELECT *, CASE WHEN b1||b2 IN ('GC','CG') THEN 3 WHEN b1||b2 IN ('AT','TA') THEN 2 ELSE 0 END AS h,
 CASE WHEN b1 IN ('G','C') THEN 3 WHEN b1 IN ('A','T') THEN 2 ELSE 0 END AS h1,
 CASE WHEN b2 IN ('G','C') THEN 3 WHEN b2 IN ('A','T') THEN 2 ELSE 0 END AS h2 FROM bg WHERE b2 IS NOT NULL)""")


def bigrams(spark, sf):
    return S.neighbours(dna(spark, sf)).groupBy("b1", "b2").agg(F.sum("n").alias("n"))


@query("pair_hbonds", BIGRAMS + "SELECT b1, b2, count(*) AS n, h AS hbonds FROM hb GROUP BY ALL")
def pair_hbonds(spark, sf):
    return bigrams(spark, sf).withColumn("hbonds", B.pair_hbonds("b1", "b2"))


@query("pair_dg", BIGRAMS + f"""SELECT b1, b2, count(*) AS n,
 {R(f"CASE h WHEN 3 THEN {P}*({PI_}+{E_}) WHEN 2 THEN {P}*{PI_} ELSE 0 END", "dg")} FROM hb GROUP BY b1,b2,h""")
def pair_dg(spark, sf):
    return bigrams(spark, sf).select("b1", "b2", "n", r6(B.pair_dg("b1", "b2"), "dg"))


@query("stack_dg", BIGRAMS + f"""SELECT h1, h2, count(*) AS n, {R(f"{G}*(1+cos({PI_}*abs(h1-h2)/3))", "dg")}
 FROM hb GROUP BY h1,h2""")
def stack_dg(spark, sf):
    bond = lambda b: B.pair_hbonds(b, B.complement(b))
    return (bigrams(spark, sf).groupBy(bond(F.col("b1")).alias("h1"), bond(F.col("b2")).alias("h2"))
            .agg(F.sum("n").alias("n")).select("h1", "h2", "n", r6(B.stack_dg("h1", "h2"), "dg")))


@query("stack_energy_profile", BIGRAMS + f"""SELECT seq_id, count(*) AS n_stacks,
 {R(f"sum({G}*(1+cos({PI_}*abs(h1-h2)/3)))", "stack_dg", 4)},
 {R(f"avg({G}*(1+cos({PI_}*abs(h1-h2)/3)))", "mean_stack_dg")} FROM hb GROUP BY seq_id""")
def stack_energy_profile(spark, sf):
    return S.duplex_stack_energy(dna(spark, sf)).select(
        "seq_id", "n_stacks", r6("stack_dg", digits=4), r6("mean_stack_dg"))


@query("translate_codon", USED + """SELECT codon, n, coalesce(d.aa,'X') AS aa FROM used LEFT JOIN codon_dim d USING (codon)""")
def translate_codon(spark, sf):
    return S.codon_usage(dna(spark, sf)).select("codon", "n", "aa")


@query("is_start", USED + "SELECT codon='ATG' AS is_start, sum(n)::BIGINT AS n FROM used GROUP BY ALL")
def is_start(spark, sf):
    return used(spark, sf).groupBy((F.col("codon") == "ATG").alias("is_start")).agg(F.sum("n").alias("n"))


@query("is_stop", USED + """SELECT coalesce(aa,'X')='*' AS is_stop, sum(n)::BIGINT AS n FROM used
 LEFT JOIN codon_dim USING (codon) GROUP BY ALL""")
def is_stop(spark, sf):
    return (S.codon_usage(dna(spark, sf)).groupBy((F.col("aa") == "*").alias("is_stop"))
            .agg(F.sum("n").alias("n")))


@query("trit_ops", USED + f"""SELECT codon, n, -x AS neg, x*y AS pair, greatest(-1,least(1,x+y)) AS sum_sat,
 CASE WHEN x=y THEN x ELSE 0 END AS consensus, CASE WHEN m<-0.4 THEN -1 WHEN m>0.4 THEN 1 ELSE 0 END AS from_s
 FROM (SELECT codon, n, {prim('b1')} AS x, {prim('b3')} AS y, ({prim('b1')}+{prim('b2')}+{prim('b3')})/3.0 AS m FROM pos)""")
def trit_ops(spark, sf):
    t = used(spark, sf).withColumn("t", B.codon_trits("codon")["primary"])
    x, y = F.col("t")[0], F.col("t")[2]
    mean = (F.col("t")[0] + F.col("t")[1] + F.col("t")[2]) / 3.0
    return t.select("codon", "n", B.trit_neg(x).alias("neg"), B.trit_pair(x, y).alias("pair"),
                    B.trit_sum(x, y).alias("sum_sat"), B.trit_consensus(x, y).alias("consensus"),
                    B.trit_from(mean, -0.4, 0.4).alias("from_s"))


def bits(e, k):
    return f"((CASE WHEN {e}>0 THEN 1 WHEN {e}<0 THEN 3 ELSE 0 END)::BIGINT << {2 * k})"


@query("trit_pack_word", USED + "SELECT codon, n, " + "+".join(
    bits(prim(f"b{k + 1}"), k) for k in range(3)) + " + " + "+".join(
    bits(seco(f"b{k + 1}"), k + 3) for k in range(3)) + " AS word, " + "+".join(
    bits(f"({prim(f'b{k + 1}')}*{seco(f'b{k + 1}')})", k) for k in range(3)) + " AS product FROM pos")
def trit_pack_word(spark, sf):
    t = used(spark, sf).withColumn("t", B.codon_trits("codon"))
    both = F.concat(F.col("t")["primary"], F.col("t")["secondary"])
    return t.select("codon", "n", B.trit_pack(both).alias("word"),
                    B.trit_pack(B.trit_words_pair(F.col("t")["primary"], F.col("t")["secondary"])).alias("product"))


@query("translate_orf", with_(DNA, UP, CODONS, CODON_DIM) + """
, tr AS (SELECT seq_id, k, coalesce(d.aa,'X') AS aa FROM codons LEFT JOIN codon_dim d USING (codon)),
st AS (SELECT seq_id, min(k) FILTER (aa='*') AS s FROM tr GROUP BY seq_id)
SELECT dnau.seq_id, coalesce(string_agg(aa,'' ORDER BY k) FILTER (k < coalesce(s,1000000000)),'') AS protein
FROM dnau LEFT JOIN tr USING (seq_id) LEFT JOIN st ON st.seq_id=dnau.seq_id GROUP BY dnau.seq_id""")
def translate_orf(spark, sf):
    return S.translate_orf(dna(spark, sf))


ALT = "alt(aa,q) AS (VALUES " + ",".join(f"('{a}',{C.AA_PHASE_ALT[a][0]})" for a in C.AA20) + ")"


def program_ctes(source: str) -> str:
    return f"""pc AS (SELECT seq_id, unnest(regexp_extract_all(seq,'...')) AS codon FROM {source}),
pr AS (SELECT seq_id, {prim('substring(codon,1,1)')} AS x1, {prim('substring(codon,2,1)')} AS x2,
 {prim('substring(codon,3,1)')} AS x3, coalesce(alt.q,0) AS q, CASE WHEN d.aa IN ('F','Y','W') THEN 1 ELSE 0 END AS ar
 FROM pc JOIN codon_dim d USING (codon) LEFT JOIN alt ON alt.aa=d.aa),
pg AS (SELECT seq_id, count(*) AS n_codons, sum(x1+x2+x3)/(3.0*count(*)) AS spin, sum(q)::BIGINT AS charge_balance,
 sum(ar)/count(*)::DOUBLE AS aromatic_fraction, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM pr GROUP BY seq_id),
prog AS (SELECT *, least(3.0,greatest(0.05,pow({P},spin)*exp(abs(charge_balance)/({PI_}*n_codons))
 *(1+{G}*aromatic_fraction))) AS expression FROM pg)"""


@query("gene_program", with_(DNA, UP, CODON_DIM, ALT, program_ctes("dnau")) + f"""
SELECT seq_id, n_codons, {R('spin', 'spin')}, {R('expression', 'expression')}, charge_balance,
 {R('aromatic_fraction', 'aromatic_fraction')}, {R('m1', 'mean_trit_0')}, {R('m2', 'mean_trit_1')},
 {R('m3', 'mean_trit_2')} FROM prog""")
def gene_program(spark, sf):
    p = S.gene_programs(dna(spark, sf))
    return p.select("seq_id", "n_codons", "charge_balance", *[
        r6(k) for k in ("spin", "expression", "aromatic_fraction", "mean_trit_0", "mean_trit_1", "mean_trit_2")])


def flip_sql(s, m):
    site = f"((3*u+5*locus+7*{m})%n)+1"
    return f"""CASE WHEN {m} <= u%4 AND n>0 THEN substring({s},1,{site}-1) ||
 (CASE substring({s},{site},1) WHEN 'A' THEN 'G' WHEN 'G' THEN 'A' WHEN 'C' THEN 'T' WHEN 'T' THEN 'C'
  ELSE substring({s},{site},1) END) || substring({s},{site}+1) ELSE {s} END"""


MUTATED = f"""mu AS (SELECT seq_id, seq_id//4 AS u, seq_id%4 AS locus, length(seq) AS n, seq AS s0 FROM dnau),
m1 AS (SELECT *, {flip_sql('s0', 0)} AS s1 FROM mu), m2 AS (SELECT *, {flip_sql('s1', 1)} AS s2 FROM m1),
m3 AS (SELECT *, {flip_sql('s2', 2)} AS s3 FROM m2), mutated AS (SELECT seq_id, u, locus, n, {flip_sql('s3', 3)} AS seq FROM m3)"""


def mutated(spark, sf):
    d = dna(spark, sf).withColumn("seq", F.translate("seq", "U", "T"))
    unit, locus = F.floor(F.col("seq_id") / 4), F.col("seq_id") % 4
    return d.select("seq_id", unit.alias("unit"), locus.alias("locus"),
                    B.mutate_orf("seq", unit, locus).alias("seq"))


@query("mutate_orf", with_(DNA, UP, MUTATED) + "SELECT seq_id, u AS unit, locus, md5(seq) AS mutated FROM mutated")
def mutate_orf(spark, sf):
    return mutated(spark, sf).select("seq_id", "unit", "locus", F.md5("seq").alias("mutated"))


def lim(e, lo, hi):
    return f"least(greatest({e},{lo}),{hi})"


BIAS = "bias(cell_class,gene,bias) AS (VALUES " + ",".join(
    f"('{c}','{g}',{b})" for c, bs in C.CELL_BIAS.items() for g, b in zip(C.GENES, bs)) + ")"
PHENO_COLS = ["n_channels", "d_eff", "fire_threshold", "refractory_steps", "adapt_step", "adapt_gain", "adapt_decay",
              "resting_bias", "fi_stim", "vrest_mv", "composite_spin", "composite_charge",
              "p_props", "scn_expression", "kcn_expression", "cacna_expression", "leak_expression"]
PHENO_SQL = with_(DNA, UP, CODON_DIM, ALT, MUTATED, program_ctes("mutated"), BIAS) + f""",
gx AS (SELECT seq_id//4 AS unit, ['scn','kcn','cacna','leak'][seq_id%4+1] AS gene,
 ['pyr','pv','sst','vip'][(seq_id//4)%4+1] AS cell_class, expression, spin, charge_balance FROM prog),
gb AS (SELECT gx.*, {lim('expression*bias', 0.05, 3.5)} AS ex FROM gx JOIN bias USING (cell_class,gene)),
gp AS (SELECT unit, cell_class, max(ex) FILTER (gene='scn') AS scn, max(ex) FILTER (gene='kcn') AS kcn,
 max(ex) FILTER (gene='cacna') AS ca, max(ex) FILTER (gene='leak') AS leak, sum(spin*ex) AS sw, sum(ex) AS sx,
 sum(charge_balance*ex) AS sq FROM gb GROUP BY ALL),
ph AS (SELECT unit, cell_class, 4.0*(0.75+0.25*(scn+kcn+ca+leak)/4.0) AS n_channels,
 {lim(f'13.0+{P}*(ca-1)*0.35+{G}*(scn-kcn)*0.2', 8.0, 20.0)} AS d_eff,
 {lim('1.05-0.12*(scn-1)+0.06*(kcn-1)', 0.85, 1.25)} AS fire_threshold,
 {lim('12.0*(0.85+0.30*kcn)', 4.0, 40.0)} AS refractory_steps, {lim('0.7*(0.6+0.8*ca)', 0.0, 8.0)} AS adapt_step,
 0.02*(0.7+0.6*ca) AS adapt_gain, {lim('0.988-0.004*(ca-1)', 0.96, 0.995)} AS adapt_decay,
 {lim(f"0.46+0.02*(scn-leak)*{cl('ETA')}", 0.3, 0.65)} AS resting_bias,
 {lim('0.5*(0.85+0.25*scn-0.10*kcn)', 0.25, 0.95)} AS fi_stim,
 {lim('-70.0-3.0*(leak-1)+1.5*(scn-1)', -80.0, -55.0)} AS vrest_mv,
 CASE WHEN sx>1e-12 THEN sw/sx ELSE 0 END AS composite_spin, sq/4.0 AS composite_charge,
 {cl('NEURO_P')} AS p_props, scn AS scn_expression, kcn AS kcn_expression, ca AS cacna_expression, leak AS leak_expression FROM gp)
SELECT unit, cell_class, {R('n_channels', 'n_channels')},
 {R(f"CASE WHEN cell_class='vip' THEN least(20.0,d_eff+0.3*{P}) ELSE d_eff END", 'd_eff')},
 {R("CASE WHEN cell_class='pv' THEN greatest(0.85,fire_threshold-0.04) ELSE fire_threshold END", 'fire_threshold')},
 {R("CASE cell_class WHEN 'pv' THEN greatest(3.0,refractory_steps*0.45) WHEN 'sst' THEN refractory_steps*1.05 ELSE refractory_steps END", 'refractory_steps')},
 {R("CASE cell_class WHEN 'pv' THEN adapt_step*0.35 WHEN 'sst' THEN least(10.0,adapt_step*1.4) WHEN 'pyr' THEN adapt_step*1.05 ELSE adapt_step END", 'adapt_step')},
 {R('adapt_gain', 'adapt_gain')}, {R('adapt_decay', 'adapt_decay')}, {R('resting_bias', 'resting_bias')},
 {R("CASE cell_class WHEN 'pv' THEN least(0.95,fi_stim*1.15) WHEN 'vip' THEN fi_stim*0.9 ELSE fi_stim END", 'fi_stim')},
 {R('vrest_mv', 'vrest_mv')}, {R('composite_spin', 'composite_spin')}, {R('composite_charge', 'composite_charge', 4)},
 {",".join(R(k, k) for k in PHENO_COLS[12:])} FROM ph"""


@query("phenotype_table", PHENO_SQL)
def phenotype_table(spark, sf):
    programs = S.gene_programs(mutated(spark, sf).select("seq_id", "seq"))
    unit = F.floor(F.col("seq_id") / 4)
    pick = lambda names, k: F.get(F.array(*[F.lit(x) for x in names]), k.cast("int"))
    named = programs.select(
        unit.alias("unit"), pick(C.GENES, F.col("seq_id") % 4).alias("gene"),
        pick(["pyr", "pv", "sst", "vip"], unit % 4).alias("cell_class"),
        "expression", "spin", "charge_balance")
    out = S.phenotypes(named)
    return out.select("unit", "cell_class", *[r6(k, digits=4 if k == "composite_charge" else 6) for k in PHENO_COLS])


