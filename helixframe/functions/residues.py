"""Residue feature columns and the S law."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .common import col

NON_AA = f"[^{C.AA20}{C.AA20.lower()}]"


def clean_sequence(seq) -> Column:
    """Keep the 20 letters in either case, upper-cased; ASCII is filtered first."""
    return F.upper(F.regexp_replace(col(seq), NON_AA, ""))


def spin() -> Column:
    return (F.col("p") + F.col("v") + F.col("branch") + F.col("aromatic") + F.col("detail")) / 5.0


def charge() -> Column:
    return F.col("c") + F.col("hetero") / C.PHI + F.col("detail") / C.PHI**2


def hydrophobicity() -> Column:
    """Opcode hydrophobicity: base form times the structural factors, in log space."""
    exponent = (
        F.col("v") / C.PI
        + F.when((F.col("hetero") > 0) & F.col("aa").isin("C", "M"), C.GAMMA / C.PI).otherwise(0.0)
        + F.col("detail") / (C.PI * C.PHI)
    )
    power = (
        -F.col("p")
        + F.when(F.col("aromatic") != 0, 1.0).otherwise(0.0)
        + F.when(F.col("branch") > 0, 0.5).otherwise(0.0)
        - F.when(F.col("hetero") < 0, 1.0).otherwise(0.0)
    )
    return F.pow(F.lit(C.PHI), power) * F.exp(exponent)


def side_volume() -> Column:
    power = (
        F.col("v")
        + 0.5 * F.abs(F.col("aromatic"))
        + F.when(F.col("branch") > 0, 0.5).when(F.col("branch") < 0, -1.0).otherwise(0.0)
        - F.when(F.col("aa") == "G", 1.0).otherwise(0.0)
        + F.col("detail") / C.PI
    )
    exponent = (
        F.when(F.col("hetero") > 0, 1.0 / C.PI)
        .when((F.col("hetero") < 0) & (F.col("aa") != "G"), -1.0 / (C.PI * C.PHI))
        .otherwise(0.0)
    )
    return C.PI * C.E * F.pow(F.lit(C.PHI), power) * F.exp(exponent)


def dipole_moment(ring: float = 0.5) -> Column:
    return C.GAMMA * F.exp(F.abs(F.col("c")) + F.col("p") + 1.0 + ring * F.abs(F.col("aromatic")))


def formal_charge(ph: float = C.PH) -> Column:
    """Side-chain charge at a pH; histidine is fractional, the rest are on or off."""
    aa, pk = F.col("aa"), F.col("pkr")
    return (
        F.when(aa.isin("D", "E", "C", "Y"), F.when(pk < ph, -1.0).otherwise(0.0))
        .when(aa.isin("K", "R"), F.when(pk > ph, 1.0).otherwise(0.0))
        .when(aa == "H", 1.0 / (1.0 + F.pow(F.lit(10.0), ph - pk)))
        .otherwise(0.0)
    )


def propensities(expanded: bool = False) -> tuple[Column, Column, Column]:
    """Raw helix, strand and coil weights before normalisation."""
    c, p, v = F.abs(F.col("c")), F.col("p"), F.col("v")
    topology = F.lit(0.0)
    if expanded:
        topology = (F.greatest(F.col("branch"), F.lit(0)) + F.abs(F.col("aromatic"))
                    + F.abs(F.col("hetero")) / C.PHI)
    alpha = C.PHI - p / (C.PI * C.PHI) - c / C.PI**2
    beta = F.exp((v - p + topology) / C.PI)
    coil = F.exp((p - v + c / C.PHI) / C.PI)

    def special(general: Column, for_p: float, for_g: float) -> Column:
        return F.when(F.col("aa") == "P", for_p).when(F.col("aa") == "G", for_g).otherwise(general)

    return (special(alpha, 1 / C.PHI, 1 / C.E), special(beta, 1 / C.PHI, 1 / C.E),
            special(coil, C.PHI, C.E))


def aa_features(base: DataFrame) -> DataFrame:
    """Add every closed-form residue feature to a table of trits and seeds."""
    out = base.select(
        "*",
        spin().alias("spin"),
        charge().alias("charge"),
        hydrophobicity().alias("hydro"),
        side_volume().alias("volume"),
        dipole_moment().alias("mu"),
        formal_charge().alias("q"),
    )
    for suffix, expanded in (("", False), ("_x", True)):
        a, b, k = propensities(expanded)
        total = a + b + k
        out = out.select("*", (a / total).alias(f"p_alpha{suffix}"),
                         (b / total).alias(f"p_beta{suffix}"),
                         (k / total).alias(f"p_coil{suffix}"))
    return out


def chem_base() -> list[Column]:
    """Base chemistry without the structural expansion."""
    return [
        (F.pow(F.lit(C.PHI), -F.col("p")) * F.exp(F.col("v") / C.PI)).alias("h0"),
        (C.PI * C.E * F.pow(F.lit(C.PHI), F.col("v"))).alias("v0"),
        F.col("c").cast("double").alias("q0"),
        dipole_moment(0.0).alias("mu0"),
    ]


def ss_dominant(a="p_alpha", b="p_beta", k="p_coil") -> Column:
    a, b, k = col(a), col(b), col(k)
    return F.when((a >= b) & (a >= k), "H").when(b >= k, "E").otherwise("C")


def region_collapse(a="p_alpha", b="p_beta") -> Column:
    a, b, gate = col(a), col(b), 1.0 / C.E
    return F.when((a > gate) & (a > b), "H").when((b > gate) & (b > a), "E").otherwise("C")


def target_rg(n) -> Column:
    return C.PI * F.pow(F.greatest(col(n), F.lit(1)).cast("double"), F.lit(1.0 / C.PI))


def scalar_s(d, hits, dpsi, observed, n=1.0, dtheta=1.0) -> Column:
    """S = K(T1 + T2 + T3) with unit scale, amplitude, P and rho."""
    d, hits, dpsi, n, dtheta = (col(x).cast("double") for x in (d, hits, dpsi, n, dtheta))
    growth = F.exp(C.ALPHA * (1 - hits / n) * C.GAMMA / C.PHI)
    t1 = (
        n / F.sqrt(d)
        * F.cos((C.PSI + dpsi) / C.ETA)
        * F.exp(-C.ALPHA * hits / n + 1 + C.B_IN * dpsi)
        * (1 + growth * C.C_EFF)
        * (1 + C.P_NEW * F.log(d / 25.0))
    )
    import math

    seen = math.exp(C.C_FACTOR * C.P_VAR) * F.cos(dpsi + C.P_VAR)
    t1 = t1 * F.when(col(observed), seen).otherwise(1.0)
    valve = C.BETA * (1 + C.POOF * math.cos(C.THETA + C.PI) + C.SUCTION * math.sin(C.THETA)) * (
        1 + C.B_IN * C.P_VAR
    )
    t3 = (
        valve * F.cos(dpsi) * n / F.sqrt(d) * chaos_factor(d)
        * (1 + C.A_BLEED * F.pow(F.sin(dtheta), 2) / C.PHI + C.A_IN * F.pow(F.cos(dtheta), 2) / C.PHI)
    )
    return C.K * (t1 + 1.0 + t3)


def chaos_factor(d) -> Column:
    return 1 + C.CHAOS * (col(d) - 25.0) / 25.0


def residual_scale(s) -> Column:
    return 1 + F.abs(col(s)) * C.P_NEW


def long_range_gate(d) -> Column:
    return F.ceil(C.ETA * col(d)).cast("int")
