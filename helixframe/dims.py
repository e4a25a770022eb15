"""Small dimension tables. All have a fixed row count, so broadcasting them is safe."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .functions.residues import aa_features


def _values(spark: SparkSession, columns: str, rows) -> DataFrame:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "\\'") + "'"
        if isinstance(v, float):
            return f"{v!r}D"
        return str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def aa_dim(spark: SparkSession) -> DataFrame:
    """20 residues: trits, seeds and every closed-form feature."""
    rows = [
        (aa, *C.AA_WORDS[aa], *(C.ELEMENT[C.AA_WORDS[aa][7]]), C.HYDRO[aa], C.PKR.get(aa))
        for aa in C.AA20
    ]
    base = _values(
        spark,
        "aa, c, p, v, aromatic, branch, hetero, detail, element, vdw, polar, kd, pkr",
        rows,
    )
    return aa_features(base)


def codon_dim(spark: SparkSession) -> DataFrame:
    """64 codons with their residue."""
    order = "TCAG"
    rows = [
        (a + b + c, C.GENETIC_CODE[16 * i + 4 * j + k])
        for i, a in enumerate(order) for j, b in enumerate(order) for k, c in enumerate(order)
    ]
    return _values(spark, "codon, aa", rows)


def aa_alt_dim(spark: SparkSession) -> DataFrame:
    rows = [(aa, *C.AA_PHASE_ALT[aa], aa in "FYW", aa in "AILMFVW") for aa in C.AA20]
    return _values(spark, "aa, alt_c, alt_p, alt_v, is_aromatic, is_hydrophobic", rows)


def domain_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, "domain, d_eff, hits, dpsi, observed",
                   [(n, *r) for n, r in C.DOMAINS.items()])


def routing_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, "routing, chem, ss, region, packing",
                   [(n, *r) for n, r in C.ROUTINGS.items()])


def bond_dim(spark: SparkSession) -> DataFrame:
    """Bond rows keyed on the sorted atom pair, so lookups ignore order."""
    rows = [(*sorted((a, b)), o, float(length), float(energy)) for a, b, o, length, energy in C.BONDS]
    return _values(spark, "atom_lo, atom_hi, bond_order, length_a, energy_kj", rows)


def aa3_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, "res, aa", list(C.AA3.items()))


def na3_dim(spark: SparkSession) -> DataFrame:
    """Nucleotide names per table kind, with modified bases mapped to the parent."""
    rows = [("dna", r, b, False) for r, b in C.DNA3.items()]
    rows += [("rna", r, b, False) for r, b in C.RNA3.items()]
    rows += [("rna", r, b, True) for r, b in C.RNA_MODIFIED.items()]
    return _values(spark, "kind, res, base, is_modified", rows)


def ptm_dim(spark: SparkSession) -> DataFrame:
    return _values(spark, "res, parent_aa, ptm_kind", [(r, *v) for r, v in C.PTM3.items()])


def cell_dim(spark: SparkSession) -> DataFrame:
    rows = [(cell, gene, bias) for cell, biases in C.CELL_BIAS.items()
            for gene, bias in zip(C.GENES, biases)]
    return _values(spark, "cell_class, gene, bias", rows)


def word_column() -> F.Column:
    return F.array(*[F.col(k) for k in ("c", "p", "v", "aromatic", "branch", "hetero", "detail")])


def pauling(sep: int) -> float:
    """Ideal helix CA distance at a separation."""
    return math.sqrt((sep * 1.5) ** 2 + (2 * 2.3 * math.sin(sep * math.radians(100) / 2)) ** 2)
