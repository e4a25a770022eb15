"""Residue-pair column functions.

Each function reads residue features under the ``i_`` and ``j_`` prefixes plus
``sep``, so it can be applied to any table of pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .common import clip, col

I = lambda k: F.col(f"i_{k}")  # noqa: E731,E741
J = lambda k: F.col(f"j_{k}")


def sep_d() -> Column:
    return F.greatest(F.col("sep"), F.lit(1)).cast("double")


def env_scale() -> Column:
    return sep_d() / (sep_d() + C.CONTACT)


def locality() -> Column:
    return F.pow(sep_d(), F.lit(-1 / C.PI))


def pair_weight() -> Column:
    tau = clip(I("spin"), -1, 1) * clip(J("spin"), -1, 1)
    base = tau * C.E + (1 - F.abs(tau)) * C.PI
    elec = -I("charge") * J("charge") * C.E
    return C.PHI * locality() * (base + 0.15 * elec) * (0.35 + 0.65 * env_scale())


def disulfide_gate() -> Column:
    mu = C.CONTACT
    return F.exp(-F.pow(sep_d() - mu, 2) / (mu * C.PHI))


def both(aa: str) -> Column:
    return (I("aa") == aa) & (J("aa") == aa)


def pair_chemistry() -> Column:
    """Disulfide for two cysteines, else packing + charge + dipole + pair + stacking."""
    packing = F.greatest(I("kd"), F.lit(0.0)) * F.greatest(J("kd"), F.lit(0.0)) / (C.PHI * C.E)
    electrostatic = -I("q") * J("q") * C.E
    dipole = F.sqrt(I("mu") * J("mu")) / (C.GAMMA * C.PI * C.E**2)
    stack = F.when((I("aromatic") != 0) & (J("aromatic") != 0), env_scale() / C.PHI).otherwise(0.0)
    return F.when(both("C"), C.PHI**6 * disulfide_gate()).otherwise(
        packing + electrostatic + dipole + pair_weight() / C.CONTACT + stack
    )


def pair_chemistry_opcode() -> Column:
    """Opcode-only form: hydrophobicity centred on 1, composite charge."""
    packing = (I("hydro") - 1) / C.PHI * (J("hydro") - 1) / C.PHI
    electrostatic = -I("charge") * J("charge") * C.E
    dipole = F.sqrt(I("mu") * J("mu")) / (C.GAMMA * C.PI * C.E**2)
    stack = F.when((I("aromatic") != 0) & (J("aromatic") != 0), env_scale() / C.PHI).otherwise(0.0)
    return F.when(both("C"), F.lit(C.PHI**6)).otherwise(
        packing + electrostatic + dipole + pair_weight() / C.CONTACT + stack
    )


def chem_link(suffix: str = "") -> Column:
    """First matching link class. ``suffix`` picks the propensity columns."""
    sep, g = F.col("sep"), 1 / C.E
    pa = (I(f"p_alpha{suffix}") > g) & (J(f"p_alpha{suffix}") > g)
    pb = (I(f"p_beta{suffix}") > g) & (J(f"p_beta{suffix}") > g)
    return (
        F.when(sep <= 2, "backbone_covalent_geometry")
        .when(both("C"), "disulfide_covalent")
        .when(I("q") * J("q") < -1e-9, "salt_bridge_electrostatic")
        .when((I("kd") > 0) & (J("kd") > 0) & (sep >= C.GATE), "hydrophobic_packing")
        .when((sep.isin(3, 4, 7) & pa) | pb, "hbond_secondary")
        .when(sep < C.GATE, "molecular_sidechain")
        .otherwise("tertiary_biochem")
    )


LINK_DOMAIN = {
    "backbone_covalent_geometry": "Physical_Chemistry",
    "disulfide_covalent": "Atomic_Physics",
    "salt_bridge_electrostatic": "Electromagnetism",
    "hydrophobic_packing": "Condensed_Matter",
    "hbond_secondary": "Chemistry",
    "molecular_sidechain": "Molecular_Chemistry",
    "tertiary_biochem": "Biochemistry",
}


def by_link(link, values: dict[str, object]) -> Column:
    out = None
    for name, value in values.items():
        test = col(link) == name
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out


def link_param(link, k: int) -> Column:
    return by_link(link, {name: C.DOMAINS[d][k] for name, d in LINK_DOMAIN.items()})


def delta_psi(dpsi0) -> Column:
    spin = 0.5 * (I("spin") + J("spin"))
    charge = 0.5 * (I("charge") + J("charge"))
    return col(dpsi0) * (1 + spin / C.PHI) + C.B_IN * charge / C.PHI


def delta_theta() -> Column:
    topo = 0.25 * (I("branch") + J("branch") + I("aromatic") + J("aromatic"))
    return 1.0 * (1 + topo / C.PHI**2)


def helix_bonus() -> Column:
    joint = F.sqrt(I("p_alpha") * J("p_alpha"))
    return F.when(F.col("sep").isin(3, 4, 7), F.pow(joint, 3) / C.E).otherwise(0.0)


def sheet_bonus() -> Column:
    envelope = 1 / (1 + F.greatest(F.log(sep_d() / C.PI), F.lit(0.0)))
    return F.when(F.col("sep") >= 3, I("p_beta") * J("p_beta") * envelope / C.PHI).otherwise(0.0)


def heptad_multiplier(i, j, si, sj) -> Column:
    mi, mj = F.pmod(col(i) - col(si), 7), F.pmod(col(j) - col(sj), 7)
    return F.when(mi.isin(0, 3) & mj.isin(0, 3), C.PHI).otherwise(1 / C.PHI)


def strand_multiplier(i, j, si, sj, ej) -> Column:
    step = col(i) - col(si)
    off = F.least(F.abs(col(j) - (col(ej) - step)), F.abs(col(j) - (col(sj) + step)))
    return F.pow(F.lit(C.PHI), -off / C.PI)


def heptad_faces(i, j, si, sj) -> Column:
    """Nine-cell form: faces 0,3 -> +1, 4,6 -> 0, the rest -1; phi to their sum."""
    def face(x, s):
        m = F.pmod(col(x) - col(s), 7)
        return F.when(m.isin(0, 3), 1).when(m.isin(4, 6), 0).otherwise(-1)

    return F.pow(F.lit(C.PHI), (face(i, si) + face(j, sj)).cast("double"))


def strand_cells(i, j, si, sj, ej) -> Column:
    """27-cell form: register trit and pleat parity, decaying past one step."""
    a, b, length = col(i) - col(si), col(j) - col(sj), col(ej) - col(sj)
    anti, par = a + b - length, b - a
    is_anti = F.abs(anti) <= F.abs(par)
    shift = F.abs(F.when(is_anti, anti).otherwise(par)).cast("double")
    half = F.greatest(length * 0.5, F.lit(2.0))
    # off register the pleat trit is never 0, so the cell exponent is -1
    return (
        F.when(shift > half, 1 / C.PHI**2)
        .when(shift == 0, C.PHI)
        .otherwise(F.pow(F.lit(C.PHI), -1.0 - F.greatest(shift - 1, F.lit(0.0)) / C.PI))
    )


def link_target(link, residual, suffix: str = "") -> Column:
    """Target CA distance of a link class, NULL when the class sets none."""
    sep, res, g = F.col("sep"), F.greatest(col(residual), F.lit(1e-9)), 1 / C.E
    helical = sep.isin(3, 4, 7) & (I(f"p_alpha{suffix}") > g) & (J(f"p_alpha{suffix}") > g)
    return (
        F.when(col(link) == "backbone_covalent_geometry",
               F.when(sep == 1, C.CA_CA).when(sep == 2, C.CA_CA * math.sqrt(C.E / C.PHI)))
        .when(col(link) == "disulfide_covalent", (C.PI + C.E / C.PHI) * C.PHI / C.E / res)
        .when(col(link) == "salt_bridge_electrostatic", C.CONTACT / C.PHI / F.sqrt(res))
        .when(col(link) == "hydrophobic_packing", C.CONTACT / F.sqrt(res))
        .when(col(link) == "hbond_secondary",
              F.when(helical, helix_ideal(sep)).otherwise(C.PI + C.E / C.PHI))
        .when(col(link) == "tertiary_biochem", C.CONTACT * C.PHI / res)
    )


def helix_ideal(sep) -> Column:
    s = col(sep).cast("double")
    return F.sqrt(F.pow(s * 1.5, 2) + F.pow(4.6 * F.sin(s * math.radians(100) / 2), 2))


def contact_terms() -> dict[str, Column]:
    """Additive evidence channels besides proximity; needs region_same and register_mult."""
    qq = I("q") * J("q")
    return {
        "hydrophobic": F.when((I("kd") > 0) & (J("kd") > 0),
                              C.PHI * F.sqrt(F.greatest(I("kd") * J("kd"), F.lit(0.0)))).otherwise(0.0),
        "salt": F.when(qq < 0, C.E * C.PHI * F.abs(qq)).otherwise(0.0),
        "disulfide": F.when(both("C"), C.PHI**3 * disulfide_gate()).otherwise(0.0),
        "register_term": F.when(F.col("region_same"), F.col("register_mult") * C.PHI).otherwise(0.0),
        "polarizability": F.sqrt(I("polar") * J("polar")) / (C.PHI * C.E),
    }
