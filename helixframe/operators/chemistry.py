"""Parameter-table operators: S of named domains, routings, bonds, chemistry records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import dims
from ..functions import residues as RF


def domain_scalars(spark) -> DataFrame:
    """Every domain row with its S and residual factor."""
    d = dims.domain_dim(spark)
    s = RF.scalar_s("d_eff", "hits", "dpsi", "observed")
    return d.withColumn("s", s).withColumn("residual", RF.residual_scale("s"))


def routing_params(spark) -> DataFrame:
    """Amplitudes and the long-range gate of every named routing."""
    dom = domain_scalars(spark).select("domain", F.abs("s").alias("abs_s"), "d_eff")
    out = dims.routing_dim(spark)
    for role in ("chem", "ss", "region", "packing"):
        side = dom.select(F.col("domain").alias(role), F.col("abs_s").alias(f"{role}_s"),
                          F.col("d_eff").alias(f"{role}_d"))
        out = out.join(F.broadcast(side), role)
    return out.select(
        "routing",
        (F.col("chem_s") * C.P_NEW).alias("chem_amp"),
        (F.col("ss_s") * C.P_NEW).alias("ss_amp"),
        (F.col("region_s") * C.P_NEW * C.C_EFF).alias("region_amp"),
        (F.col("packing_s") * C.P_NEW).alias("packing_amp"),
        RF.long_range_gate("region_d").alias("gate"),
    )


def bond_lookup(pairs: DataFrame) -> DataFrame:
    """Left lookup of (a, b, bond_order); unknown bonds keep NULLs."""
    keyed = pairs.withColumns({"atom_lo": F.least("a", "b"), "atom_hi": F.greatest("a", "b")})
    return keyed.join(F.broadcast(dims.bond_dim(pairs.sparkSession)),
                      ["atom_lo", "atom_hi", "bond_order"], "left")


def observation_scalar(round_idx, n_rounds, chain_len, stress) -> Column:
    """S of one observation round: hits are the round, phase shifts with stress."""
    d, _, dpsi0, _ = C.DOMAINS["Biochemistry"]
    dpsi = dpsi0 + C.B_IN * F.tanh(stress / C.PHI) / C.PHI
    dtheta = 1.0 + round_idx / (n_rounds + C.PHI)
    return RF.scalar_s(F.lit(d), round_idx, dpsi, F.lit(True),
                       F.greatest(chain_len, F.lit(1.0)), dtheta)


#: Residue names in the order in which they are looked for: every full name but the last holds a three-letter one.
AA_NAMES = {**{k: v for k, v in C.AA3.items() if k not in ("MSE", "SEC")}, "TRYPTOPHAN": "W"}


def residue_of(name) -> Column:
    """One letter of a residue name: the letter itself, else the first of ``AA_NAMES`` that starts it or that its part before an underscore holds."""
    head = F.split(name, "_")[0]
    out = F.when(name.rlike(f"^[{C.AA20}]$"), name)
    for alias, aa in AA_NAMES.items():
        out = out.when(name.startswith(alias) | head.contains(alias), aa)
    return out


def section_router(records: DataFrame) -> DataFrame:
    """Route (ord, section, name, value) records into chemistry slots.

    Hydrophobicity and pK records are keyed by residue, radius and polarizability records by element (as written and in
    capitals), folding records by name; the last record of a slot wins.
    """
    name = F.trim("name")
    up = F.upper(name)
    last = F.element_at(F.split(up, "_"), -1)
    slot = (F.when(up.rlike("PK_?R|SIDE"), "pKR").when(up.rlike("PK[2₂]|PK_2"), "pK2").when(up.rlike("PK[1₁]|PK_1"), "pK1")
            .when(last.contains("R"), "pKR").when(up.rlike("[2₂]"), "pK2").otherwise("pK1"))
    kinds = {"§36": "hydro", "§22": "pka", "§25": "vdw", "§26": "polar", "§21": "fold"}
    kind = F.lit(None).cast("string")
    for mark, k in reversed(kinds.items()):
        kind = F.when(F.col("section").contains(mark), k).otherwise(kind)
    element = F.split(name, r"\s+")[0]
    keys = (F.when(kind.isin("hydro", "pka"), F.array(residue_of(up))).when(kind == "fold", F.array(name))
            .otherwise(F.when(F.length(element) > 0, F.array_distinct(F.array(element, F.upper(element))))))
    routed = records.select("ord", "value", kind.alias("kind"), F.explode(keys).alias("key"),
                            F.when(kind == "pka", slot).otherwise(F.lit("value")).alias("slot")).filter("kind IS NOT NULL AND key IS NOT NULL")
    return routed.groupBy("kind", "key").pivot("slot", ["value", "pK1", "pK2", "pKR"]).agg(F.max_by("value", "ord"))
