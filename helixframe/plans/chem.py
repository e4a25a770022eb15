"""Parameter-table queries over the order lines and parts."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import constants as C
from .. import dims
from ..functions import residues as RF
from ..operators import chemistry as CH
from .base import P, R, cl, query, r6, table, with_

DOMAIN_NAMES = list(C.DOMAINS)
ROUTING_NAMES = list(C.ROUTINGS)
DOM = "dom(domain,d,hits,dpsi,observed) AS (VALUES " + ",".join(
    f"('{k}',{v[0]},{v[1]},{v[2]}::DOUBLE,{str(v[3]).lower()})" for k, v in C.DOMAINS.items()) + ")"


def s_sql(d, hits, dpsi, obs, n="1.0::DOUBLE", dth="1.0::DOUBLE") -> str:
    """S law as SQL text."""
    return f"""{cl('K')}*({n}/sqrt({d})*cos(({cl('PSI')}+{dpsi})/{cl('ETA')})*exp(-{cl('ALPHA')}*{hits}/{n}+1+{cl('B_IN')}*{dpsi})
 *(1+exp({cl('ALPHA')}*(1-{hits}/{n})*{cl('GAMMA')}/{P})*{cl('C_EFF')})*(1+{cl('P_NEW')}*ln({d}/25.0))
 *(CASE WHEN {obs} THEN exp({cl('C_FACTOR')}*{cl('P_VAR')})*cos({dpsi}+{cl('P_VAR')}) ELSE 1 END)+1
 +{cl('BETA')}*cos({dpsi})*{n}/sqrt({d})*(1+{cl('CHAOS')}*({d}-25.0)/25.0)
 *(1+{cl('POOF')}*cos({cl('THETA')}+pi())+{cl('SUCTION')}*sin({cl('THETA')}))
 *(1+{cl('A_BLEED')}*pow(sin({dth}),2)/{P}+{cl('A_IN')}*pow(cos({dth}),2)/{P})*(1+{cl('B_IN')}*{cl('P_VAR')}))"""


LINES = f"""li AS (SELECT *, {DOMAIN_NAMES!r}[l_suppkey%{len(DOMAIN_NAMES)}+1] AS domain FROM lineitem)"""


def lines(spark, sf):
    names = F.array(*[F.lit(x) for x in DOMAIN_NAMES])
    return table(spark, sf, "lineitem").withColumn(
        "domain", F.get(names, (F.col("l_suppkey") % len(DOMAIN_NAMES)).cast("int")))


@query("domain_scalar", with_(LINES, DOM) + f""", s AS (SELECT li.domain,
 {s_sql('d::DOUBLE', '(hits+floor(l_discount*100)%4)', '(dpsi+l_tax)', 'observed', 'l_quantity')} AS s FROM li JOIN dom USING (domain))
SELECT domain, count(*) AS n, {R('avg(s)', 'mean_s')}, {R('min(s)', 'min_s')}, {R('max(s)', 'max_s')},
 {R(f"avg(1+abs(s)*{cl('P_NEW')})", 'mean_residual')} FROM s GROUP BY domain""")
def domain_scalar(spark, sf):
    j = lines(spark, sf).join(F.broadcast(dims.domain_dim(spark)), "domain")
    s = RF.scalar_s("d_eff", F.col("hits") + F.floor(F.col("l_discount") * 100) % 4, F.col("dpsi") + F.col("l_tax"),
                    "observed", "l_quantity")
    return j.select("domain", s.alias("s")).groupBy("domain").agg(
        F.count("*").alias("n"), r6(F.avg("s"), "mean_s"), r6(F.min("s"), "min_s"), r6(F.max("s"), "max_s"),
        r6(F.avg(RF.residual_scale("s")), "mean_residual"))


ROUTED = "rt(routing,chem,ss,region,packing) AS (VALUES " + ",".join(
    "(" + ",".join(f"'{x}'" for x in (k, *v)) + ")" for k, v in C.ROUTINGS.items()) + ")"


@query("routing_params", with_(DOM, ROUTED) + f""", ds AS (SELECT domain, d, abs({s_sql('d::DOUBLE', 'hits', 'dpsi', 'observed')}) AS s FROM dom),
 cnt AS (SELECT {ROUTING_NAMES!r}[p_partkey%6+1] AS routing, count(*) AS n FROM part GROUP BY 1)
SELECT routing, n, {R(f"c.s*{cl('P_NEW')}", 'chem_amp')}, {R(f"q.s*{cl('P_NEW')}", 'ss_amp')},
 {R(f"g.s*{cl('P_NEW')}*{cl('C_EFF')}", 'region_amp')}, {R(f"k.s*{cl('P_NEW')}", 'packing_amp')},
 ceil({cl('ETA')}*g.d)::INT AS gate FROM cnt JOIN rt USING (routing) JOIN ds c ON c.domain=chem JOIN ds q ON q.domain=ss
 JOIN ds g ON g.domain=region JOIN ds k ON k.domain=packing""")
def routing_params(spark, sf):
    names = F.array(*[F.lit(x) for x in ROUTING_NAMES])
    cnt = (table(spark, sf, "part").groupBy(F.get(names, (F.col("p_partkey") % 6).cast("int")).alias("routing"))
           .agg(F.count("*").alias("n")))
    return cnt.join(F.broadcast(CH.routing_params(spark)), "routing").select(
        "routing", "n", "gate", *[r6(k) for k in ("chem_amp", "ss_amp", "region_amp", "packing_amp")])


ATOMS = ["H", "C", "O", "N", "F"]
BONDS_SQL = "bd(lo,hi,bond_order,length_a,energy_kj) AS (VALUES " + ",".join(
    f"('{min(a, b)}','{max(a, b)}',{o},{float(x)!r}::DOUBLE,{float(y)!r}::DOUBLE)" for a, b, o, x, y in C.BONDS) + ")"


@query("bond_lookup", with_(BONDS_SQL) + f""", pr AS (SELECT {ATOMS!r}[l_suppkey%5+1] AS a, {ATOMS!r}[l_partkey%5+1] AS b,
 l_linenumber%3+1 AS bond_order FROM lineitem)
SELECT a, b, pr.bond_order, count(*) AS n, {R('max(length_a)', 'length_a')}, {R('max(energy_kj)', 'energy_kj', 4)} FROM pr
 LEFT JOIN bd ON lo=least(a,b) AND hi=greatest(a,b) AND bd.bond_order=pr.bond_order GROUP BY a,b,pr.bond_order""")
def bond_lookup(spark, sf):
    names = F.array(*[F.lit(x) for x in ATOMS])
    pairs = table(spark, sf, "lineitem").select(
        F.get(names, (F.col("l_suppkey") % 5).cast("int")).alias("a"),
        F.get(names, (F.col("l_partkey") % 5).cast("int")).alias("b"), (F.col("l_linenumber") % 3 + 1).alias("bond_order"))
    counted = pairs.groupBy("a", "b", "bond_order").agg(F.count("*").alias("n"))
    return CH.bond_lookup(counted).select("a", "b", "bond_order", "n", r6("length_a"), r6("energy_kj", digits=4))


@query("observation_scalar", f"""WITH s AS (SELECT l_linenumber AS round_idx,
 {s_sql('13.0::DOUBLE', 'l_linenumber', f"(0.35+{cl('B_IN')}*tanh(l_discount*10/{P})/{P})", 'true', 'greatest(l_quantity,1.0)',
        f"(1+l_linenumber/(8+{P}))")} AS s FROM lineitem)
SELECT round_idx, count(*) AS n, {R('avg(s)', 'mean_s')}, {R('min(s)', 'min_s')}, {R('max(s)', 'max_s')} FROM s GROUP BY round_idx""")
def observation_scalar(spark, sf):
    s = CH.observation_scalar(F.col("l_linenumber"), F.lit(8), F.col("l_quantity"), F.col("l_discount") * 10)
    return (table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("round_idx"), s.alias("s"))
            .groupBy("round_idx").agg(F.count("*").alias("n"), r6(F.avg("s"), "mean_s"), r6(F.min("s"), "min_s"),
                                      r6(F.max("s"), "max_s")))


# Published S of the protein-scale domains, used as parity targets.
GOLDEN_S = {
    "Atomic_Physics": 0.7358238658627416, "Physical_Chemistry": 0.33401327040170914,
    "Chemistry": 0.4078840642307454, "Molecular_Chemistry": 0.3345733830778106,
    "Materials_Science": 0.33525988073638374, "Biology": 0.4447250077038459,
    "Biochemistry": 0.3062212293865662, "Condensed_Matter": 0.3384059955797751,
    "Neuroscience": 0.5143619629083619,
}
GOLD = "gold(domain,golden) AS (VALUES " + ",".join(f"('{k}',{v!r}::DOUBLE)" for k, v in GOLDEN_S.items()) + ")"


@query("domain_slices", with_(LINES, DOM, GOLD) + f""", cnt AS (SELECT domain, count(*) AS n FROM li GROUP BY domain),
 ds AS (SELECT *, {s_sql('d::DOUBLE', 'hits', 'dpsi', 'observed')} AS s FROM dom)
SELECT domain, n, d AS d_eff, hits, {R('dpsi', 'dpsi')}, observed, {R('s', 's', 9)}, {R('abs(s)', 'abs_s', 9)},
 abs(s-golden)<1e-9 AS ok FROM cnt JOIN ds USING (domain) JOIN gold USING (domain)""")
def domain_slices(spark, sf):
    cnt = lines(spark, sf).groupBy("domain").agg(F.count("*").alias("n"))
    gold = dims._values(spark, "domain, golden", list(GOLDEN_S.items()))
    return (cnt.join(F.broadcast(CH.domain_scalars(spark)), "domain").join(F.broadcast(gold), "domain").select(
        "domain", "n", "d_eff", "hits", r6("dpsi"), "observed", r6("s", digits=9), r6(F.abs("s"), "abs_s", 9),
        (F.abs(F.col("s") - F.col("golden")) < 1e-9).alias("ok")))


SECTIONS = ["§36 hydrophobicity", "§22 pKa", "§25 radii", "§26 polarizability", "§21 folding"]
NAMES = ["Gly", "ALA", "Val", "Leu", "Ile", "Met", "Phe", "Trp", "Pro", "Ser", "Thr", "Cys", "Tyr", "Asn", "Gln", "Asp", "Glu", "Lys", "Arg", "His",
         "Tryptophan", "Isoleucine", "Phenylalanine", "Histidine", "W", "x"]
SUFFIX = ["_pK1", "_pK2", "_pKR", "_side", "", "_pK₂", "_pK_1", " 2", "_nr"]
ELEMENTS = ["H", "c", "N", "O radius", "S"]
RES_SQL = "CASE WHEN length(u)=1 AND contains('" + C.AA20 + "',u) THEN u " + " ".join(f"WHEN starts_with(u,'{k}') OR contains(split_part(u,'_',1),'{k}') THEN '{v}'" for k, v in CH.AA_NAMES.items()) + " END"


@query("section_router", f"""WITH rec AS (SELECT p_partkey AS ord, {SECTIONS!r}[p_size%5+1] AS section, p_retailprice/100 AS value,
 CASE WHEN p_size%5 IN (2,3) THEN {ELEMENTS!r}[p_partkey%5+1] ELSE {NAMES!r}[p_partkey%26+1]||{SUFFIX!r}[p_partkey%11%9+1] END AS name FROM part),
 nm AS (SELECT *, upper(name) AS u, split_part(name,' ',1) AS el FROM rec),
 rt AS (SELECT ord, value, CASE WHEN section LIKE '%§36%' THEN 'hydro' WHEN section LIKE '%§22%' THEN 'pka' WHEN section LIKE '%§25%' THEN 'vdw' WHEN section LIKE '%§26%' THEN 'polar' WHEN section LIKE '%§21%' THEN 'fold' END AS kind,
 unnest(CASE WHEN section LIKE '%§36%' OR section LIKE '%§22%' THEN [{RES_SQL}] WHEN section LIKE '%§21%' THEN [name] ELSE list_distinct([el,upper(el)]) END) AS key,
 CASE WHEN section NOT LIKE '%§22%' THEN 'value' WHEN contains(u,'PKR') OR contains(u,'PK_R') OR contains(u,'SIDE') THEN 'pKR' WHEN contains(u,'PK2') OR contains(u,'PK₂') OR contains(u,'PK_2') THEN 'pK2'
  WHEN contains(u,'PK1') OR contains(u,'PK₁') OR contains(u,'PK_1') THEN 'pK1' WHEN contains(string_split(u,'_')[-1],'R') THEN 'pKR' WHEN contains(u,'2') OR contains(u,'₂') THEN 'pK2' ELSE 'pK1' END AS slot FROM nm)
SELECT kind, key, {",".join(R(f"arg_max(value,ord) FILTER (slot='{s}')", s) for s in ("value", "pK1", "pK2", "pKR"))}
FROM rt WHERE kind IS NOT NULL AND key IS NOT NULL GROUP BY kind, key""")
def section_router(spark, sf):
    pick = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), k.cast("int"))
    k = F.col("p_partkey")
    name = F.when((F.col("p_size") % 5).isin(2, 3), pick(ELEMENTS, k % 5)).otherwise(F.concat(pick(NAMES, k % 26), pick(SUFFIX, k % 11 % 9)))
    rec = table(spark, sf, "part").select(k.alias("ord"), pick(SECTIONS, F.col("p_size") % 5).alias("section"), name.alias("name"),
                                          (F.col("p_retailprice") / 100).alias("value"))
    return CH.section_router(rec).select("kind", "key", *[r6(c) for c in ("value", "pK1", "pK2", "pKR")])
