"""Contact queries: every order group is a structure, its lines are atoms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import constants as C
from ..functions.common import dist
from ..operators import spatial as SP
from ..session import stored
from ..operators import structures as ST
from .base import R, num, query, r6, table, with_
from .structures import PTS, kabsch_sql, points

# structure = 500 orders, chain by flag, residue by part, atom position from quantity, price and supplier
ATOMS = """atoms AS (SELECT DISTINCT l_orderkey//500 AS structure, CASE WHEN l_returnflag='R' AND l_linenumber<=2 THEN 'metal' WHEN l_returnflag='R' AND l_linenumber<=5 THEN 'ligand'
 WHEN l_returnflag='R' THEN 'dna' ELSE 'protein' END AS kind, CASE WHEN l_linestatus='O' THEN 'A' ELSE 'B' END AS chain, l_partkey%150 AS idx, l_suppkey AS serial,
 round(l_quantity*2.0,3)::DOUBLE AS x, l_extendedprice/1000 AS y, round((l_partkey%61)*1.5+l_discount*10,3)::DOUBLE AS z FROM lineitem)"""
PROT = "prot AS (SELECT * FROM atoms WHERE kind='protein')"
CA = "ca AS (SELECT structure, chain, idx, min(x) AS x, min(y) AS y, min(z) AS z FROM prot GROUP BY ALL)"
D = "sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2))"
RADII = {"metal": 3.0, "ligand": C.E + C.PHI, "dna": C.CONTACT * C.PHI}
HITS = ",".join(f"h_{k} AS (SELECT a.structure, a.chain, a.idx, b.serial AS partner, {D} AS d FROM prot a JOIN atoms b ON a.structure=b.structure AND b.kind='{k}' "
                f"WHERE {D}<={num(r)})" for k, r in RADII.items())
HITS += f""",h_ppi AS (SELECT a.structure, a.chain, a.idx, b.serial AS partner, {D} AS d FROM prot a JOIN prot b ON a.structure=b.structure AND a.chain<>b.chain
 WHERE {D}<={num(C.CONTACT)})"""
BASE = with_(ATOMS, PROT, CA, HITS)


def atoms(spark, sf, *by):
    """Distinct atoms; with ``by`` they are dealt out by these columns before they are compared."""
    li = table(spark, sf, "lineitem")
    flag, n = F.col("l_returnflag") == "R", F.col("l_linenumber")
    a = li.select(
        F.floor(F.col("l_orderkey") / 500).alias("structure"),
        F.when(flag & (n <= 2), "metal").when(flag & (n <= 5), "ligand").when(flag, "dna").otherwise("protein").alias("kind"),
        F.when(F.col("l_linestatus") == "O", "A").otherwise("B").alias("chain"), (F.col("l_partkey") % 150).alias("idx"),
        F.col("l_suppkey").alias("serial"), F.round(F.col("l_quantity") * 2.0, 3).alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        F.round((F.col("l_partkey") % 61) * 1.5 + F.col("l_discount") * 10, 3).alias("z"))
    return (a.repartition(*by) if by else a).distinct()


def side(df, p, *keep):
    return df.select("structure", *keep, *[F.col(k).alias(f"{p}{k}") for k in "xyz"])


def protein(a):
    return a.filter("kind = 'protein'")


def trace(a):
    return protein(a).groupBy("structure", "chain", "idx").agg(*[F.min(k).alias(k) for k in "xyz"])


RADIUS = {**RADII, "ppi": C.CONTACT}


def contacts(spark, sf, *kinds):
    """Contacts of protein atoms with partners of the given kinds (all without), from one pass: a partner row brings its own radius.

    Returned with the atoms, which are stored once. A protein atom is in one cell of a grid for all kinds, and a partner in
    those within its own radius; contacts themselves are not stored, queries aggregate them.
    """
    a = stored(atoms(spark, sf))
    left = SP.with_cell(side(protein(a), "l", "chain", "idx"), "l", C.CONTACT)
    right = side(a.withColumns({"other": F.when(F.col("kind") == "protein", F.col("chain")), "kind": F.when(F.col("kind") == "protein", "ppi").otherwise(F.col("kind"))}),
                 "r", "kind", "other", F.col("serial").alias("partner"))
    own = F.lit(None).cast("double")
    for k in kinds or RADIUS:
        own = F.when(F.col("kind") == k, float(RADIUS[k])).otherwise(own)
    right = SP.spread_cells(right.filter(F.col("kind").isin(*(kinds or RADIUS))), "r", own, C.CONTACT * SP.SIDE)
    j = left.join(right.hint("merge"), ["structure", *SP.CELL]).withColumn("d", dist("l", "r")).filter(F.col("d") <= own)
    j = j.filter(F.col("other").isNull() | (F.col("chain") != F.col("other")))
    return j.select("structure", "kind", "chain", "idx", "partner", "d"), a


@query("contact_join", BASE + " UNION ALL ".join(
    f"SELECT structure, '{k}' AS kind, count(*) AS n_contacts, count(DISTINCT chain||idx) AS n_residues, {R('min(d)', 'min_d')}, {R('avg(d)', 'mean_d')} FROM h_{k} GROUP BY structure"
    for k in (*RADII, "ppi")))
def contact_join(spark, sf):
    # a residue at a time first: what then travels grows with the residues and not with their contacts
    r = contacts(spark, sf)[0].groupBy("structure", "kind", "chain", "idx").agg(
        F.count("*").alias("n"), F.min("d").alias("least"), F.sum("d").alias("total"))
    return r.groupBy("structure", "kind").agg(
        F.sum("n").alias("n_contacts"), F.count_distinct(F.concat("chain", F.col("idx").cast("string"))).alias("n_residues"),
        r6(F.min("least"), "min_d"), r6(F.sum("total") / F.sum("n"), "mean_d"))


SPRINGS = " UNION ALL ".join(f"""SELECT '{k}' AS source, c.structure, c.chain, c.i, c.j, c.partner, sqrt(pow(p.x-q.x,2)+pow(p.y-q.y,2)+pow(p.z-q.z,2)) AS d0, {num(SP.RESIDUAL_OF[k])} AS r FROM
 (SELECT a.structure, a.chain, a.idx AS i, b.idx AS j, min(a.partner) AS partner FROM (SELECT DISTINCT structure, chain, idx, partner FROM h_{k}) a JOIN (SELECT DISTINCT structure, chain, idx, partner FROM h_{k}) b
  ON a.structure=b.structure AND a.chain=b.chain AND a.partner=b.partner AND b.idx-a.idx>={s} GROUP BY ALL) c
 JOIN ca p ON p.structure=c.structure AND p.chain=c.chain AND p.idx=c.i JOIN ca q ON q.structure=c.structure AND q.chain=c.chain AND q.idx=c.j"""
                             for k, s in (("metal", 1), ("ligand", 2), ("dna", 3)))
SEPS = {"metal": 1, "ligand": 2, "dna": 3}


def springs(spark, sf, *kinds):
    """Springs of the given kinds, with the atoms.

    Lines travel to their structure once; its atoms, contacts and pairs then stay in their task, group by group.
    """
    a = atoms(spark, sf, "structure")
    p = F.col("kind") == "protein"
    at = {f"i_{k}": F.min(F.when(p, F.col(k))).over(W.partitionBy("structure", "chain", "idx")) for k in "xyz"}
    pick = lambda of, key: F.element_at(F.create_map(*[F.lit(x) for k in kinds for x in (k, of[k])]), F.col(key))
    residue = F.when(p, F.struct("chain", F.col("idx").alias("i"), *at, *"xyz"))
    partner = F.when(F.col("kind").isin(*kinds), F.struct(F.col("kind").alias("source"), F.col("serial").alias("partner"), pick(RADIUS, "kind").alias("own"), *"xyz"))
    found = SP.gathered_contacts(a.withColumns(at).filter(F.col("kind").isin("protein", *kinds)), ["structure"], C.CONTACT * SP.SIDE, residue, partner)
    c = found.select("structure", "partner.source", "residue.chain", "partner.partner", "residue.i", *[f"residue.{k}" for k in at])
    out = SP.shared_contact_springs(c, None, ["structure", "chain"], pick(SEPS, "source"), ["source"])
    return out.withColumn("r", pick(SP.RESIDUAL_OF, "source")), a


@query("shared_contact_springs", BASE + f", spr AS ({SPRINGS}) SELECT source, structure, chain, i, j, partner, {R('d0', 'd0')}, {R('r', 'r')} FROM spr")
def shared_contact_springs(spark, sf):
    return springs(spark, sf, *SEPS)[0].select("source", "structure", "chain", "i", "j", "partner", r6("d0"), r6("r"))


def aligned(ca):
    """The query's index of every template residue."""
    return ca.select("structure", "chain", F.col("idx").alias("ti"), ((F.col("idx") * 7 + 3) % 149).alias("qi"))


AL = "(SELECT DISTINCT structure, chain, idx AS ti, (idx*7+3)%149 AS qi FROM ca)"


@query("remap_springs", BASE + f""", spr AS ({SPRINGS}), m AS (SELECT s.structure, s.chain, s.i, s.j, d0, least(a.qi,b.qi) AS a, greatest(a.qi,b.qi) AS b FROM spr s JOIN {AL} a ON a.structure=s.structure AND a.chain=s.chain AND a.ti=s.i
 JOIN {AL} b ON b.structure=s.structure AND b.chain=s.chain AND b.ti=s.j WHERE source='ligand' AND a.qi<>b.qi)
SELECT structure, chain, a, b, {R('d0', 'd0')} FROM (SELECT *, row_number() OVER (PARTITION BY structure, chain, a, b ORDER BY i, j) AS k FROM m) WHERE k=1""")
def remap_springs(spark, sf):
    s, a = springs(spark, sf, "ligand")
    return SP.remap_springs(s, aligned(trace(a)), ["structure", "chain"]).select("structure", "chain", "a", "b", r6("d0"))


@query("observer_springs", BASE + f""", spr AS ({SPRINGS}), m AS (SELECT s.structure, s.chain, s.i, s.j, d0, least(a.qi,b.qi) AS a, greatest(a.qi,b.qi) AS b FROM spr s JOIN {AL} a ON a.structure=s.structure AND a.chain=s.chain AND a.ti=s.i
 JOIN {AL} b ON b.structure=s.structure AND b.chain=s.chain AND b.ti=s.j WHERE source='dna' AND a.qi<>b.qi)
SELECT structure, chain, count(DISTINCT a*1000+b) AS n_springs FROM m GROUP BY ALL""")
def observer_springs(spark, sf):
    s, a = springs(spark, sf, "dna")
    return SP.remap_springs(s, aligned(trace(a)), ["structure", "chain"]).groupBy("structure", "chain").agg(F.count("*").alias("n_springs"))


@query("ptm_attach", BASE + f""", g AS (SELECT structure, serial, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM atoms WHERE kind='ligand' GROUP BY ALL),
 c AS (SELECT a.structure, a.serial, b.chain||b.idx AS residue, {D} AS d FROM g a JOIN ca b USING (structure) WHERE {D}<={num(C.CONTACT * C.PHI)})
SELECT structure, serial, residue, {R('d', 'd')} FROM (SELECT *, row_number() OVER (PARTITION BY structure, serial ORDER BY round(d,9), residue) AS k FROM c) WHERE k=1""")
def ptm_attach(spark, sf):
    a = atoms(spark, sf)
    g = a.filter("kind = 'ligand'").groupBy("structure", "serial").agg(*[F.avg(k).alias(k) for k in "xyz"])
    ca = trace(a).withColumn("residue", F.concat("chain", F.col("idx").cast("string")))
    c = SP.contact_join(side(g, "l", "serial"), side(ca, "r", "residue"), C.CONTACT * C.PHI, ["structure"])
    return SP.nearest(c, ["structure", "serial"], "residue").select("structure", "serial", "residue", r6("d"))


FLAGS = ",".join(f"f_{k} AS (SELECT DISTINCT structure, chain, idx, true AS {k} FROM h_{k})" for k in (*RADII, "ppi"))
SITES = f"""{FLAGS}, rs AS (SELECT DISTINCT structure, chain, idx FROM prot UNION SELECT DISTINCT structure, 'A', 999 FROM prot),
sites AS (SELECT rs.*, CASE WHEN rs.idx=999 THEN 'not_on_chain' WHEN metal THEN 'on_metal_site' WHEN dna THEN 'on_dna_site' WHEN ligand THEN 'on_drug_site' WHEN ppi THEN 'on_ppi_site' ELSE 'off_site' END AS site,
 coalesce(metal,false) AS metal, coalesce(dna,false) AS dna, coalesce(ligand,false) AS ligand, coalesce(ppi,false) AS ppi FROM rs
 {" ".join(f"LEFT JOIN f_{k} USING (structure,chain,idx)" for k in (*RADII, "ppi"))})"""


def sites(spark, sf):
    found, a = contacts(spark, sf)
    p = protein(a)
    rs = p.select("structure", "chain", "idx").union(p.select("structure", F.lit("A"), F.lit(999))).distinct()
    kinds = (*RADII, "ppi")
    flags = found.groupBy("structure", "chain", "idx").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in kinds])
    rs = rs.join(flags, ["structure", "chain", "idx"], "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in kinds})
    return rs.withColumn("site", SP.site_class(F.col("idx") != 999, F.col("metal"), F.col("dna"), F.col("ligand"), F.col("ppi")))


@query("site_class", BASE + f", {SITES} SELECT structure, chain, idx, site FROM sites")
def site_class(spark, sf):
    return sites(spark, sf).select("structure", "chain", "idx", "site")


KNOWN = ["on_drug_site", "on_dna_site", "off_site_polymorphism", "allosteric_state", "activation_loop_near_site"]
CONC = """CASE known WHEN 'off_site_polymorphism' THEN site IN ('off_site','not_on_chain') WHEN 'allosteric_state' THEN site IN ('off_site','activation_loop_near_site','allosteric_state')
 WHEN 'activation_loop_near_site' THEN site IN ('on_drug_site','activation_loop_near_site') ELSE site=known END"""


def known():
    return F.get(F.array(*[F.lit(k) for k in KNOWN]), (F.col("idx") % 5).cast("int"))


@query("concordance_rule", BASE + f", {SITES}, k AS (SELECT *, {KNOWN!r}[idx%5+1] AS known FROM sites) SELECT known, site, count(*) AS n, bool_and({CONC}) AS concordant FROM k GROUP BY known, site")
def concordance_rule(spark, sf):
    k = sites(spark, sf).withColumn("known", known())
    return k.groupBy("known", "site").agg(F.count("*").alias("n"), F.bool_and(SP.concordant("known", "site")).alias("concordant"))


@query("interface_card", BASE + f""", {SITES}, k AS (SELECT *, {KNOWN!r}[idx%5+1] AS known FROM sites), t AS (SELECT structure, chain, count(*) FILTER (ligand) AS n_ligand, count(*) FILTER (metal) AS n_metal,
 count(*) FILTER (dna) AS n_dna, count(*) FILTER (ppi) AS n_ppi FROM sites GROUP BY ALL)
SELECT structure, chain, idx, known, site, {CONC} AS concordant, n_ligand, n_metal, n_dna, n_ppi FROM k JOIN t USING (structure, chain)""")
def interface_card(spark, sf):
    """One card per case; every residue is one."""
    s = sites(spark, sf)
    t = s.groupBy("structure", "chain").agg(*[F.count_if(c).alias(n) for c, n in (
        ("ligand", "n_ligand"), ("metal", "n_metal"), ("dna", "n_dna"), ("ppi", "n_ppi"))])
    cases = s.withColumn("known", known())
    return cases.join(t, ["structure", "chain"]).select(
        "structure", "chain", "idx", "known", "site", SP.concordant("known", "site").alias("concordant"), "n_ligand", "n_metal", "n_dna", "n_ppi")


@query("burial_count", BASE + f""", nb AS (SELECT a.structure, a.chain, a.idx, count(*)-1 AS neighbours FROM ca a JOIN ca b ON a.structure=b.structure AND a.chain=b.chain WHERE {D}<10 GROUP BY ALL)
SELECT structure, chain, idx, neighbours, {R('coalesce(neighbours/nullif(max(neighbours) OVER (PARTITION BY structure, chain),0)::DOUBLE,0)', 'burial')} FROM nb""")
def burial_count(spark, sf):
    return SP.burial_count(trace(atoms(spark, sf)), ["structure", "chain"]).select("structure", "chain", "idx", "neighbours", r6("burial"))


@query("structure_context", BASE + f""", oc AS (SELECT DISTINCT a.structure, a.chain, a.idx FROM ca a JOIN prot b ON a.structure=b.structure AND a.chain<>b.chain WHERE {D}<6),
 het AS (SELECT DISTINCT a.structure, a.chain, a.idx FROM ca a JOIN atoms b ON a.structure=b.structure AND b.kind IN ('metal','ligand') WHERE {D}<6),
 n AS (SELECT structure, chain, count(*) AS n FROM ca GROUP BY ALL)
SELECT n.structure, n.chain, n AS n_residues, {R('(SELECT count(*) FROM oc WHERE oc.structure=n.structure AND oc.chain=n.chain)/n::DOUBLE', 'near_chain')},
 {R('(SELECT count(*) FROM het WHERE het.structure=n.structure AND het.chain=n.chain)/n::DOUBLE', 'near_hetero')} FROM n""")
def structure_context(spark, sf):
    a = stored(atoms(spark, sf))
    ca = stored(trace(a))
    left = side(ca, "l", "chain", "idx")
    keys = ["structure", "chain", "idx"]
    other = SP.contact_join(left, side(protein(a), "r", F.col("chain").alias("oc")), 6.0, ["structure"], strict=True).filter("chain <> oc")
    het = SP.contact_join(left, side(a.filter("kind in ('metal', 'ligand')"), "r"), 6.0, ["structure"], strict=True)
    j = (ca.select(*keys).join(other.select(*keys).distinct().withColumn("c", F.lit(1.0)), keys, "left")
         .join(het.select(*keys).distinct().withColumn("h", F.lit(1.0)), keys, "left"))
    return j.groupBy("structure", "chain").agg(F.count("*").alias("n_residues"), r6(F.avg(F.coalesce("c", F.lit(0.0))), "near_chain"),
                                               r6(F.avg(F.coalesce("h", F.lit(0.0))), "near_hetero"))


@query("interface_mae", with_(PTS) + f""", prs AS (SELECT a.target, a.model//2 AS pair, a.idx AS i, b.idx AS j, {D} AS d FROM pts a JOIN pts b ON a.target=b.target AND b.model=a.model+1 WHERE a.model%2=0)
SELECT p.target, p.pair, count(*) AS n_pairs, {R('avg(abs(p.d-n.d))', 'mae')} FROM prs p JOIN prs n USING (target,i,j) WHERE n.pair=0 AND p.pair>0 AND n.d<{num(C.CONTACT * C.PHI)} GROUP BY ALL""")
def interface_mae(spark, sf):
    """Models in twos are the two sides of an interface: the first two the native one, all others against it."""
    p = points(spark, sf).withColumn("pair", F.floor(F.col("model") / 2))
    pick = lambda m, s: p.filter(F.col("model") % 2 == m).select(
        "target", "pair", F.col("idx").alias("i" if s == "l" else "j"), *[F.col(k).alias(f"{s}{k}") for k in "xyz"])
    native = SP.contact_join(pick(0, "l").filter("pair = 0"), pick(1, "r").filter("pair = 0").drop("pair"), C.CONTACT * C.PHI, ["target"], strict=True)
    native = native.select("target", "i", "j", F.col("d").alias("d0"))
    q = pick(0, "l").filter("pair > 0").join(native, ["target", "i"]).join(pick(1, "r"), ["target", "pair", "j"])
    return q.groupBy("target", "pair").agg(F.count("*").alias("n_pairs"), r6(F.avg(F.abs(dist("l", "r") - F.col("d0"))), "mae"))


@query("identity_match", with_(PTS) + """SELECT p.target, p.model, count(*) AS n_matched FROM pts p JOIN pts q ON q.target=p.target AND q.model=0 AND q.idx=p.idx
 WHERE p.model>0 AND (p.idx*3+p.model)%4=(q.idx*3)%4 GROUP BY ALL""")
def identity_match(spark, sf):
    p = points(spark, sf).withColumn("name", F.concat(F.lit("C"), ((F.col("idx") * 3 + F.col("model")) % 4).cast("string")))
    q = p.filter("model = 0").select("target", "idx", "name")
    return p.filter("model > 0").join(q, ["target", "idx", "name"]).groupBy("target", "model").agg(F.count("*").alias("n_matched"))


SITE = with_(PTS) + """, st AS (SELECT p.target, p.model, p.idx, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM pts p JOIN pts q ON q.target=p.target AND q.idx=p.idx AND q.model=0
 WHERE p.model>0 AND {cond}), """ + kabsch_sql("st", "target,model") + f" SELECT target, model, n, {R('rmsd', 'rmsd')} FROM kb WHERE n>=3"


def subset_rmsd(spark, sf, keep):
    p = points(spark, sf)
    m = ST.match_points(p.filter("model > 0").select("target", "model", "idx", "x", "y", "z"),
                        p.filter("model = 0").select("target", "idx", "x", "y", "z"), ["target", "idx"])
    return ST.kabsch_rmsd(m.join(keep, ["target", "idx"], "left_semi"), ["target", "model"]).filter("n >= 3").select("target", "model", "n", r6("rmsd"))


@query("site_rmsd", SITE.format(cond="p.idx IN (SELECT idx FROM pts s WHERE s.target=p.target AND s.model=0 AND s.x>(SELECT avg(x) FROM pts t WHERE t.target=p.target AND t.model=0))"))
def site_rmsd(spark, sf):
    ref = points(spark, sf).filter("model = 0")
    mid = ref.groupBy("target").agg(F.avg("x").alias("mx"))
    return subset_rmsd(spark, sf, ref.join(mid, "target").filter("x > mx").select("target", "idx"))


@query("modified_base_rmsd", SITE.format(cond="p.idx IN (SELECT idx FROM pts s WHERE s.target=p.target AND s.model=0 AND s.z<(SELECT avg(z) FROM pts t WHERE t.target=p.target AND t.model=0))"))
def modified_base_rmsd(spark, sf):
    """RMSD over the modified residues: those of the reference below its mean z."""
    ref = points(spark, sf).filter("model = 0")
    mid = ref.groupBy("target").agg(F.avg("z").alias("mz"))
    return subset_rmsd(spark, sf, ref.join(mid, "target").filter("z < mz").select("target", "idx"))


@query("domain_rmsd", with_(PTS) + """, dm AS (SELECT p.target, p.model, p.idx//11 AS domain, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM pts p JOIN pts q
 ON q.target=p.target AND q.idx=p.idx AND q.model=0 WHERE p.model>0), """ + kabsch_sql("dm", "target,model,domain") + f""" SELECT target, model, domain::BIGINT AS domain, n,
 {R('CASE WHEN n>=11 THEN rmsd END', 'rmsd')} FROM kb""")
def domain_rmsd(spark, sf):
    """RMSD per domain span, NULL for spans with too few residues."""
    p = points(spark, sf)
    m = ST.match_points(p.filter("model > 0").select("target", "model", "idx", "x", "y", "z"),
                        p.filter("model = 0").select("target", "idx", "x", "y", "z"), ["target", "idx"])
    spans = m.withColumn("domain", F.floor(F.col("idx") / 11))
    return ST.kabsch_rmsd(spans, ["target", "model", "domain"]).select("target", "model", "domain", "n", r6(F.when(F.col("n") >= 11, F.col("rmsd")), "rmsd"))
