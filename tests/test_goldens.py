"""Published values and small literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from helixframe import constants as C
from helixframe import dims
from helixframe.functions import bases as B
from helixframe.operators import pairs as PR
from helixframe.operators import regions as RG
from helixframe.operators import sequences as S


def seqs(spark, *rows):
    return spark.createDataFrame(list(rows), "seq_id int, seq string")


def test_observables_of_balanced_dna(spark):
    r = S.genome_observables(seqs(spark, (1, "ACGTACGTACGT"))).first()
    assert (r.gc_frac, r.at_ratio, r.gc_ratio, r.super_density, r.spin_density) == (0.5, 1.0, 1.0, 0.0, 0.0)


def test_chunked_observables_equal_whole(spark):
    whole = "ATGAAATTTCGTTATTGGTAAACGNNN"
    parts = seqs(spark, *[(1, whole[k:k + 9]) for k in range(0, 27, 9)])
    assert S.genome_observables(parts, chunked=True).first() == S.genome_observables(seqs(spark, (1, whole))).first()


def test_translation(spark):
    dna = "ATGGCCCTGTGGATGCGCCTCCTGCCCCTGCTGGCGCTGCTGGCCCTCTGGGGACCTGACCCAGCC"
    assert S.translate_orf(seqs(spark, (1, dna))).first().protein == "MALWMRLLPLLALLALWGPDPA"


def test_gene_program(spark):
    r = S.gene_programs(seqs(spark, (1, "ATGAAATTTCGTTATTGG"))).first()
    assert r.n_codons == 6 and abs(r.spin) < 1e-12 and 1.42 < r.expression < 1.45


def test_codon_axes_and_unique_packs(spark):
    d = dims.codon_dim(spark).select("codon", B.codon_trits("codon").alias("t"), B.codon_pack("codon").alias("p"))
    rows = d.collect()
    atg = next(r for r in rows if r.codon == "ATG")
    assert list(atg.t["primary"]) == [1, -1, 1] and list(atg.t["secondary"]) == [1, -1, 0]
    assert len({r.p for r in rows}) == 64


def test_trit_word_round_trip(spark):
    r = spark.range(1).select(B.trit_unpack(B.trit_pack(F.array(*[F.lit(x) for x in (1, 0, -1, -1, 1)])), F.lit(5)).alias("t")).first()
    assert list(r.t) == [1, 0, -1, -1, 1]


@pytest.mark.parametrize("name,value", [
    ("Atomic_Physics", 0.7358238658627416), ("Chemistry", 0.4078840642307454), ("Biochemistry", 0.3062212293865662),
    ("Biology", 0.4447250077038459), ("Neuroscience", 0.5143619629083619)])
def test_domain_scalars(name, value):
    assert abs(C.S[name] - value) < 1e-12


def test_residuals_and_gate():
    assert abs(C.RESIDUAL["Physical_Chemistry"] - 1.1003049455397496) < 1e-12
    assert abs(C.RESIDUAL["Chemistry"] - 1.122488513106057) < 1e-12
    assert C.GATE == 7


def test_opcode_words_are_unique(spark):
    d = dims.aa_dim(spark)
    assert S.word_collisions(d, ["c", "p", "v", "aromatic", "branch", "hetero", "detail"]).count() <= 1


def brute_regions(seq):
    lab = [RG.label_of(a) for a in seq]
    out = list(lab)
    for i in range(1, len(seq) - 1):
        if RG.is_near_tie(seq[i]):
            x, y = lab[i - 1], lab[i + 1]
            if x == y != "C":
                out[i] = x
            elif "C" not in (x, y) and x != y:
                out[i] = "C"
    return "".join(out)


def test_tunnel_labels_against_loop(spark):
    import random

    rng = random.Random(5)
    cases = [(k, "".join(rng.choice(C.AA20) for _ in range(rng.randint(1, 80)))) for k in range(40)]
    got = {r.seq_id: r.l for r in seqs(spark, *cases).select("seq_id", RG.tunnel_labels("seq").alias("l")).collect()}
    assert got == {k: brute_regions(s) for k, s in cases}


def test_pairs_cross_tile_borders(spark):
    chain = PR.with_residues(seqs(spark, (1, C.AA20 * 20)))
    p = PR.residue_pairs(chain, gate=3, max_sep=9, block=32, features=False)
    n = 400
    assert p.count() == sum(n - s for s in range(3, 10))
    assert p.select("i", "j").distinct().count() == p.count()


def test_helix_ideal():
    assert abs(dims.pauling(4) - math.sqrt(36 + (4.6 * math.sin(math.radians(200))) ** 2)) < 1e-12
