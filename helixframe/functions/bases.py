"""Nucleotide and codon column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .common import col


def base_primary(b) -> Column:
    """Purine +1, pyrimidine -1, anything else 0."""
    u = F.upper(col(b))
    return F.when(u.isin("A", "G"), 1).when(u.isin("C", "T", "U"), -1).otherwise(0)


def base_secondary(b) -> Column:
    """A +1, T or U -1, anything else 0."""
    u = F.upper(col(b))
    return F.when(u == "A", 1).when(u.isin("T", "U"), -1).otherwise(0)


def codon_bases(codon) -> Column:
    c = F.translate(F.upper(col(codon)), "U", "T")
    return F.array(*[F.substring(c, k, 1) for k in (1, 2, 3)])


def codon_trits(codon) -> Column:
    """Both trit axes of a codon."""
    bases = codon_bases(codon)
    return F.struct(
        F.transform(bases, base_primary).alias("primary"),
        F.transform(bases, base_secondary).alias("secondary"),
    )


def codon_pack(codon) -> Column:
    """Primary axis in base 3 plus 27 times the secondary axis; unique per codon."""
    t = codon_trits(codon)
    axis = lambda name: sum(
        ((t[name][k] + 1) * 3**k for k in range(3)), F.lit(0)
    )
    return axis("primary") + 27 * axis("secondary")


def base_code(b) -> Column:
    u = F.upper(col(b))
    return (F.when(u == "A", 1).when(u == "C", 2).when(u == "G", 3)
            .when(u.isin("T", "U"), 4).otherwise(0))


def codon_key(codon) -> Column:
    """Three base codes in one integer, 4 bits each."""
    b = codon_bases(codon)
    return (F.shiftleft(base_code(b[0]), 8).bitwiseOR(F.shiftleft(base_code(b[1]), 4))
            .bitwiseOR(base_code(b[2])))


def complement(b) -> Column:
    u = F.upper(col(b))
    return (F.when(u == "A", "T").when(u.isin("T", "U"), "A").when(u == "G", "C")
            .when(u == "C", "G").otherwise("N"))


def reverse_complement(seq) -> Column:
    """Whole-sequence form: one translate and one reverse, no explode."""
    s = F.regexp_replace(F.upper(col(seq)), "[^ACGTU]", "N")
    return F.reverse(F.translate(s, "ACGTU", "TGCAA"))


def pair_hbonds(a, b) -> Column:
    ab = F.concat(F.translate(F.upper(col(a)), "U", "T"), F.translate(F.upper(col(b)), "U", "T"))
    return F.when(ab.isin("GC", "CG"), 3).when(ab.isin("AT", "TA"), 2).otherwise(0)


def pair_dg(a, b) -> Column:
    h = pair_hbonds(a, b)
    return (F.when(h == 3, C.PHI * (C.PI + C.E)).when(h == 2, C.PHI * C.PI).otherwise(0.0))


def stack_dg(h1, h2) -> Column:
    """Stacking energy of two neighbouring base pairs given their bond counts."""
    return C.GAMMA * (1 + F.cos(C.PI * F.abs(col(h1) - col(h2)) / 3))


def codons_of(seq) -> Column:
    """In-frame codons of a sequence as an array, in one linear pass."""
    return F.regexp_extract_all(col(seq), F.lit("(...)"), F.lit(1))


def letters_of(seq) -> Column:
    return F.regexp_extract_all(col(seq), F.lit("(.)"), F.lit(1))


def count_of(seq, letter: str) -> Column:
    s = col(seq)
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def mutate_orf(seq, unit, locus) -> Column:
    """Class-preserving base flips, applied one after another.

    Site m is (3*unit + 5*locus + 7*m) mod n for m below 1 + unit mod 4.
    """
    s, u, loc = col(seq), col(unit).cast("bigint"), col(locus).cast("bigint")
    n = F.length(s)

    def flip(acc: Column, m: Column) -> Column:
        site = F.pmod(3 * u + 5 * loc + 7 * m, n) + 1
        base = F.substr(acc, site.cast("int"), F.lit(1))
        new = (F.when(base == "A", "G").when(base == "G", "A").when(base == "C", "T")
               .when(base.isin("T", "U"), "C").otherwise(base))
        return F.overlay(acc, new, site.cast("int"), F.lit(1))

    return F.when(n == 0, s).otherwise(
        F.aggregate(F.sequence(F.lit(0).cast("bigint"), u % 4), s, flip)
    )


def trit_neg(a) -> Column:
    return -col(a)


def trit_pair(a, b) -> Column:
    return col(a) * col(b)


def trit_sum(a, b) -> Column:
    return F.signum(col(a) + col(b)).cast("int")


def trit_consensus(a, b) -> Column:
    return F.when(col(a) == col(b), col(a)).otherwise(0)


def trit_from(s, lo: float, hi: float) -> Column:
    """-1 below lo, +1 above hi, else 0."""
    return F.when(col(s) < lo, -1).when(col(s) > hi, 1).otherwise(0)


def trit_pack(trits) -> Column:
    """Two bits per trit (00, 01, 11), first trit lowest; at most 32 trits fit."""
    bits = lambda t: F.when(t > 0, 1).when(t < 0, 3).otherwise(0).cast("bigint")
    return F.aggregate(F.reverse(col(trits)), F.lit(0).cast("bigint"),
                       lambda acc, t: F.shiftleft(acc, 2).bitwiseOR(bits(t)))


def trit_unpack(word, n) -> Column:
    w = col(word)
    field = lambda i: F.call_function("shiftrightunsigned", w, (2 * i).cast("int")).bitwiseAND(F.lit(3).cast("bigint"))
    return F.transform(
        F.sequence(F.lit(0), col(n) - 1),
        lambda i: F.when(field(i) == 1, 1).when(field(i) == 3, -1).otherwise(0),
    )


def trit_words_pair(a, b) -> Column:
    """Element-wise product of two trit arrays over the shorter length."""
    m = F.least(F.size(col(a)), F.size(col(b)))
    return F.zip_with(F.slice(col(a), 1, m), F.slice(col(b), 1, m), lambda x, y: x * y)
