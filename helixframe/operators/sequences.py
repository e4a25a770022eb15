"""Nucleotide sequence operators.

Sequences arrive as ``(seq_id, seq)``. Per-sequence work stays inside the row, so
nothing here shuffles until results of different rows have to be merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import dims
from ..functions import bases as B
from ..functions.common import ratio


def spread(df: DataFrame, *keys, parts: int | None = None) -> DataFrame:
    """Repartition by key with an explicit count.

    Rows that are about to be multiplied look tiny to AQE, which would coalesce
    them into one task; an explicit count keeps the parallelism.
    """
    sc = df.sparkSession.sparkContext
    n = parts or max(sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartition(n, *keys)


def spread_if_few(df: DataFrame, *keys) -> DataFrame:
    """Repartition a scan only when it has fewer partitions than the cluster has slots.

    A table of many files already scans in parallel and is left alone, so large
    inputs are not shuffled; one small file would otherwise be one task.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else spread(df, *keys)


def base_counts(seqs: DataFrame) -> DataFrame:
    """Row-local letter, codon, start and stop counts of each sequence chunk."""
    up = F.translate(F.upper(F.col("seq")), "U", "T")
    # "ATG CCC ..." keeps codons in frame, so a plain substring count is exact
    framed = F.regexp_replace(up, "(...)", "$1 ")
    n = F.length(up)

    def in_frame(codon: str) -> Column:
        return ((F.length(framed) - F.length(F.replace(framed, F.lit(codon + " "), F.lit("")))) / 4).cast("bigint")

    letters = {k: B.count_of(up, k.upper()).cast("bigint") for k in "acgt"}
    return seqs.select(
        "seq_id",
        *[v.alias(k) for k, v in letters.items()],
        (n - sum(letters.values(), F.lit(0))).cast("bigint").alias("n"),
        F.floor(n / 3).cast("bigint").alias("codons_total"),
        in_frame("ATG").alias("codons_start"),
        (in_frame("TAA") + in_frame("TAG") + in_frame("TGA")).alias("codons_stop"),
    )


COUNTS = ["a", "c", "g", "t", "n", "codons_total", "codons_start", "codons_stop"]


def with_densities(counts: DataFrame) -> DataFrame:
    callable_ = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    primary = F.col("a") + F.col("g") - F.col("c") - F.col("t")
    secondary = F.col("a") - F.col("t")
    return counts.select(
        "*",
        primary.alias("primary_sum"),
        secondary.alias("secondary_sum"),
        ratio(F.col("g") + F.col("c"), callable_).alias("gc_frac"),
        ratio("a", "t").alias("at_ratio"),
        ratio("g", "c").alias("gc_ratio"),
        ratio(secondary, callable_).alias("super_density"),
        ratio(primary, callable_).alias("spin_density"),
    )


def genome_observables(seqs: DataFrame, chunked: bool = False) -> DataFrame:
    """Composition observables per sequence.

    With ``chunked`` a sequence may span many rows (chunk lengths divisible by
    three); their counts are added up with a partial aggregate, so one huge
    sequence is never held by one task.
    """
    counts = base_counts(seqs)
    if chunked:
        counts = counts.groupBy("seq_id").agg(*[F.sum(k).alias(k) for k in COUNTS])
    return with_densities(counts)


def explode_codons(seqs: DataFrame) -> DataFrame:
    up = F.translate(F.upper(F.col("seq")), "U", "T")
    return seqs.select("seq_id", F.posexplode(B.codons_of(up)).alias("k", "codon"))


def codon_usage(seqs: DataFrame, *keys: str) -> DataFrame:
    """Counts per codon; codons with an invalid base get residue X."""
    counts = explode_codons(seqs).groupBy(*keys, "codon").agg(F.count("*").alias("n"))
    dim = F.broadcast(dims.codon_dim(seqs.sparkSession))
    return counts.join(dim, "codon", "left").withColumn("aa", F.coalesce("aa", F.lit("X")))


def _neighbours(batches):
    """Pairs of neighbouring characters of each row, counted by one pass over its codes."""
    for batch in batches:
        at, first, second, n = [], [], [], []
        for k, s in enumerate(batch.column("s").to_pylist()):
            if s is None or len(s) < 2:
                continue
            if s.isascii():
                x, base = np.frombuffer(s.encode(), np.uint8).astype(np.int64), 128
                count = np.bincount(x[:-1] * base + x[1:])
                pair = np.flatnonzero(count)
                count = count[pair]
            else:
                x, base = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64), 1 << 21
                pair, count = np.unique(x[:-1] * base + x[1:], return_counts=True)
            at += [k] * len(pair)
            first += [chr(p) for p in pair // base]
            second += [chr(p) for p in pair % base]
            n += count.tolist()
        yield pa.RecordBatch.from_arrays([batch.column("seq_id").take(pa.array(at, pa.int64())), pa.array(first, pa.string()), pa.array(second, pa.string()),
                                          pa.array(n, pa.int64())], ["seq_id", "b1", "b2", "n"])


def neighbours(seqs: DataFrame) -> DataFrame:
    """Counts of neighbouring base pairs of each row; rows of one sequence are not yet added up, and line ends are no letters."""
    s = F.translate(F.translate(F.upper(F.col("seq")), "U", "T"), "\n\r\u0085\u2028\u2029", "")
    kind = seqs.schema["seq_id"].dataType.simpleString()
    return seqs.select("seq_id", s.alias("s")).mapInArrow(_neighbours, f"seq_id {kind}, b1 string, b2 string, n bigint")


def base_pairs(seqs: DataFrame) -> DataFrame:
    """Counts of neighbouring base pairs of each sequence."""
    return neighbours(seqs).groupBy("seq_id", "b1", "b2").agg(F.sum("n").alias("n"))


def duplex_stack_energy(seqs: DataFrame) -> DataFrame:
    """Total and mean stacking energy of each sequence against its complement."""
    bond = lambda b: B.pair_hbonds(b, B.complement(b))
    e = B.stack_dg(bond(F.col("b1")), bond(F.col("b2")))
    return base_pairs(seqs).groupBy("seq_id").agg(
        F.sum("n").alias("n_stacks"),
        F.sum(e * F.col("n")).alias("stack_dg"),
        (F.sum(e * F.col("n")) / F.sum("n")).alias("mean_stack_dg"),
    )


def translate_orf(seqs: DataFrame) -> DataFrame:
    """Residues up to the first stop, inside the row."""
    up = F.translate(F.upper(F.col("seq")), "U", "T")
    pairs = [F.lit(x) for row in codon_pairs() for x in row]
    table = F.create_map(*pairs)
    aa = F.transform(B.codons_of(up), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X")))
    return seqs.select("seq_id", F.regexp_extract(F.array_join(aa, ""), r"^([^*]*)", 1).alias("protein"))


def codon_pairs() -> list[tuple[str, str]]:
    order = "TCAG"
    return [(a + b + c, C.GENETIC_CODE[16 * i + 4 * j + k])
            for i, a in enumerate(order) for j, b in enumerate(order) for k, c in enumerate(order)]


def gene_programs(seqs: DataFrame) -> DataFrame:
    """Spin, expression, charge and aromatic share of each gene's valid codons."""
    spark = seqs.sparkSession
    usage = codon_usage(seqs, "seq_id").filter(F.col("aa") != "X")
    t = usage.join(F.broadcast(dims.aa_alt_dim(spark)), "aa", "left").select(
        "seq_id", "n",
        F.coalesce("alt_c", F.lit(0)).alias("q"),
        F.coalesce("is_aromatic", F.lit(False)).cast("int").alias("ar"),
        B.codon_trits("codon")["primary"].alias("t"),
    )
    n = F.col("n")
    sums = t.groupBy("seq_id").agg(
        F.sum("n").alias("n_codons"),
        F.sum(F.col("q") * n).alias("charge_balance"),
        F.sum(F.col("ar") * n).alias("n_aromatic"),
        *[F.sum(F.col("t")[k] * n).alias(f"t{k}") for k in range(3)],
    )
    nc = F.col("n_codons").cast("double")
    spin = (F.col("t0") + F.col("t1") + F.col("t2")) / (3.0 * nc)
    arom = F.col("n_aromatic") / nc
    raw = (F.pow(F.lit(C.PHI), spin) * F.exp(F.abs("charge_balance") / (C.PI * nc))
           * (1 + C.GAMMA * arom))
    return sums.select(
        "seq_id", "n_codons", spin.alias("spin"),
        F.least(F.greatest(raw, F.lit(0.05)), F.lit(3.0)).alias("expression"),
        "charge_balance", arom.alias("aromatic_fraction"),
        *[(F.col(f"t{k}") / nc).alias(f"mean_trit_{k}") for k in range(3)],
    )


def phenotypes(programs: DataFrame) -> DataFrame:
    """Pivot four gene programs per unit into clamped formula columns.

    ``programs`` has (unit, cell_class, gene, expression, spin, charge_balance).
    """
    biased = programs.join(
        F.broadcast(dims.cell_dim(programs.sparkSession)), ["cell_class", "gene"]
    ).withColumn("expression", clamp(F.col("expression") * F.col("bias"), 0.05, 3.5))
    g = biased.groupBy("unit", "cell_class").agg(
        *[F.max(F.when(F.col("gene") == k, F.col("expression"))).alias(k) for k in C.GENES],
        F.sum(F.col("spin") * F.col("expression")).alias("sw"),
        F.sum("expression").alias("sx"),
        F.sum(F.col("charge_balance") * F.col("expression")).alias("sq"),
    )
    scn, kcn, ca, leak = (F.col(k) for k in C.GENES)
    base = g.select(
        "unit", "cell_class",
        (C.NEURO_CHANNELS * (0.75 + 0.25 * (scn + kcn + ca + leak) / 4.0)).alias("n_channels"),
        clamp(C.NEURO_D + C.PHI * (ca - 1) * 0.35 + C.GAMMA * (scn - kcn) * 0.2, 8, 20).alias("d_eff"),
        clamp(1.05 - 0.12 * (scn - 1) + 0.06 * (kcn - 1), 0.85, 1.25).alias("fire_threshold"),
        clamp(12.0 * (0.85 + 0.30 * kcn), 4, 40).alias("refractory_steps"),
        clamp(0.7 * (0.6 + 0.8 * ca), 0, 8).alias("adapt_step"),
        (0.02 * (0.7 + 0.6 * ca)).alias("adapt_gain"),
        clamp(0.988 - 0.004 * (ca - 1), 0.96, 0.995).alias("adapt_decay"),
        clamp(C.RESTING_S + 0.02 * (scn - leak) * C.ETA, 0.30, 0.65).alias("resting_bias"),
        clamp(0.50 * (0.85 + 0.25 * scn - 0.10 * kcn), 0.25, 0.95).alias("fi_stim"),
        clamp(-70.0 - 3.0 * (leak - 1) + 1.5 * (scn - 1), -80, -55).alias("vrest_mv"),
        F.when(F.col("sx") > 1e-12, F.col("sw") / F.col("sx")).otherwise(0.0).alias("composite_spin"),
        (F.col("sq") / 4.0).alias("composite_charge"),
        F.lit(C.NEURO_P).alias("p_props"),
        *[e.cast("double").alias(f"{g}_expression") for g, e in (("scn", scn), ("kcn", kcn), ("cacna", ca), ("leak", leak))],
    )
    return nudge(base)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def nudge(p: DataFrame) -> DataFrame:
    """Class adjustments on top of the formula columns."""
    k = F.col("cell_class")
    refr, step = F.col("refractory_steps"), F.col("adapt_step")
    fire, fi, d = F.col("fire_threshold"), F.col("fi_stim"), F.col("d_eff")
    return p.withColumns({
        "refractory_steps": F.when(k == "pv", F.greatest(F.lit(3.0), refr * 0.45))
        .when(k == "sst", refr * 1.05).otherwise(refr),
        "adapt_step": F.when(k == "pv", step * 0.35).when(k == "pyr", step * 1.05)
        .when(k == "sst", F.least(F.lit(10.0), step * 1.4)).otherwise(step),
        "fire_threshold": F.when(k == "pv", F.greatest(F.lit(0.85), fire - 0.04)).otherwise(fire),
        "fi_stim": F.when(k == "pv", F.least(F.lit(0.95), fi * 1.15)).when(k == "vip", fi * 0.9)
        .otherwise(fi),
        "d_eff": F.when(k == "vip", F.least(F.lit(20.0), d + 0.3 * C.PHI)).otherwise(d),
    })


def word_collisions(dim: DataFrame, columns: list[str]) -> DataFrame:
    """Feature words shared by more than one residue."""
    return (
        dim.groupBy(F.concat_ws(",", *columns).alias("word"))
        .agg(F.array_join(F.array_sort(F.collect_set("aa")), "").alias("residues"),
             F.count("*").alias("n_residues"))
        .filter(F.col("n_residues") > 1)
    )


TARGET_ROUNDS = math.ceil(C.PI * C.E)
