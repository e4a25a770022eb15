"""Variant effect operators: profiles, missense background, calls, summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import dims
from ..functions.bases import letters_of
from .msa import xlogx
from .ranking import percentile_below

LN20 = math.log(20.0)


def gene_positions(genes: DataFrame) -> DataFrame:
    """(gene, pos, wt) for every residue; pos is 1-based."""
    return genes.select("gene", F.posexplode(letters_of("seq")).alias("k", "wt")).select(
        "gene", (F.col("k") + 1).alias("pos"), "wt")


def position_profile(genes: DataFrame, observations: DataFrame) -> DataFrame:
    """Identity, Shannon and blended conservation plus letter frequencies per position.

    ``observations`` is (gene, pos, aa); letters are counted before anything is
    grouped, so a hot position costs at most 20 rows per task.
    """
    counts = observations.groupBy("gene", "pos", "aa").agg(F.count("*").alias("n"))
    g = counts.groupBy("gene", "pos").agg(
        F.sum("n").alias("cover"), F.sum(xlogx("n")).alias("x"),
        F.map_from_entries(F.collect_list(F.struct("aa", "n"))).alias("by_aa"))
    j = gene_positions(genes).join(g, ["gene", "pos"], "left")
    has = F.col("cover") > 0
    h = F.log(F.col("cover").cast("double")) - F.col("x") / F.col("cover")
    same = F.coalesce(F.try_element_at("by_aa", F.col("wt")), F.lit(0))
    j = j.select(
        "gene", "pos", "wt", F.coalesce("cover", F.lit(0)).alias("cover"),
        F.when(has, same / F.col("cover")).otherwise(0.0).alias("identity_cons"),
        F.when(has, F.greatest(F.lit(0.0), 1 - F.greatest(h, F.lit(0.0)) / LN20)).otherwise(0.0).alias("shannon"),
        F.transform_values("by_aa", lambda k, v: v / F.col("cover")).alias("freq"))
    return j.withColumn("cons", F.greatest("identity_cons", "shannon"))


def mutant_freq(mut) -> Column:
    return F.coalesce(F.try_element_at("freq", mut), F.lit(0.0))


def impact(mut) -> Column:
    return F.round(F.col("cons") * (1 - mutant_freq(mut)), 12)


def missense_background(profile: DataFrame) -> DataFrame:
    """All 19 substitutions of every position with their impact."""
    muts = F.explode(F.array(*[F.lit(a) for a in C.AA20]))
    return (profile.select("*", muts.alias("mut")).filter(F.col("mut") != F.col("wt"))
            .select("gene", "pos", "wt", "mut", impact(F.col("mut")).alias("impact")))


def call_variant(kind, coverage_ok, cons, f_mut, pct, pop_af) -> Column:
    """Ordered gates: kind, coverage, absolute intolerance, percentile, common allele."""
    damaging = ((cons >= C.CONS_HIGH) & (f_mut <= C.FMUT_RARE))
    base = (
        F.when(damaging, "LIKELY DAMAGING")
        .when((cons >= C.CONS_MID) & (f_mut <= C.FMUT_ABSENT), "uncertain")
        .when(pct >= C.PCT_DAMAGING, "LIKELY DAMAGING")
        .when(pct >= C.PCT_UNCERTAIN, "uncertain")
        .when((cons >= C.CONS_MID) & (f_mut <= C.FMUT_RARE), "uncertain")
        .otherwise("likely tolerated")
    )
    common = F.coalesce(pop_af >= C.POP_AF_COMMON, F.lit(False)) & (base == "LIKELY DAMAGING")
    return (
        F.when(kind.startswith("nonsense"), "LIKELY DAMAGING")
        .when(kind.startswith("synonymous"), "likely benign")
        .when(~coverage_ok, "insufficient_MSA_coverage")
        .when(common, "common_polymorphism").otherwise(base)
    )


def call_by_percentile(pct) -> Column:
    return (F.when(pct >= C.PCT_DAMAGING, "LIKELY DAMAGING").when(pct >= C.PCT_UNCERTAIN, "uncertain")
            .otherwise("likely tolerated"))


def validate(variants: DataFrame, genes: DataFrame) -> DataFrame:
    """Attach the reference residue and an error code; no variant is dropped."""
    pos = gene_positions(genes).select("gene", "pos", F.col("wt").alias("seq_wt"))
    j = variants.join(pos, ["gene", "pos"], "left")
    return j.withColumn(
        "error",
        F.when(F.col("seq_wt").isNull(), "position_out_of_range")
        .when(F.col("seq_wt") != F.col("wt"),
              F.concat(F.lit("sequence_mismatch_expected_"), F.col("wt"), F.lit("_found_"), F.col("seq_wt"))))


def score_variants(variants: DataFrame, profile: DataFrame, background: DataFrame) -> DataFrame:
    """Score (gene, pos, wt, mut, pop_af, ...) rows against the gene's background."""
    p = profile.select("gene", "pos", F.col("wt").alias("seq_wt"), "cons", "identity_cons", "shannon", "freq", "cover")
    j = variants.join(p, ["gene", "pos"], "left").withColumn(
        "error",
        F.when(F.col("seq_wt").isNull(), "position_out_of_range")
        .when(F.col("seq_wt") != F.col("wt"),
              F.concat(F.lit("sequence_mismatch_expected_"), F.col("wt"), F.lit("_found_"), F.col("seq_wt"))))
    ok = F.col("error").isNull()
    stop = F.col("mut") == "*"
    j = j.withColumns({
        "kind": F.when(ok, F.when(stop, "nonsense").otherwise("missense")),
        "coverage_ok": F.coalesce((F.col("cover") > 0) & (F.col("cons") > 0), F.lit(False)),
        "f_mut": F.when(ok & ~stop, mutant_freq(F.col("mut"))),
        "impact": F.when(ok, F.when(stop, 1.0).otherwise(impact(F.col("mut")))),
    })
    ranked = percentile_below(j, background, ["gene"], "impact", "pct")
    pct = F.when(F.col("kind") == "nonsense", 100.0).when(F.col("coverage_ok"), F.col("pct"))
    ranked = ranked.withColumn("percentile", F.when(ok, pct))
    return ranked.withColumn("call", F.when(ok, call_variant(
        F.col("kind"), F.col("coverage_ok"), F.col("cons"), F.col("f_mut"), F.col("percentile"), F.col("pop_af"))))


def classify_codon_change(df: DataFrame) -> DataFrame:
    """Residues before and after a base change, and the change's class."""
    dim = dims.codon_dim(df.sparkSession)
    new = F.overlay(F.col("wt_codon"), F.col("alt"), (F.col("codon_pos") + 1).cast("int"), F.lit(1))
    before = dim.select(F.col("codon").alias("wt_codon"), F.col("aa").alias("aa_wt"))
    after = dim.select(F.col("codon").alias("mut_codon"), F.col("aa").alias("aa_mut"))
    j = (df.withColumn("mut_codon", new).join(F.broadcast(before), "wt_codon", "left")
         .join(F.broadcast(after), "mut_codon", "left"))
    return j.withColumn("kind", F.when(F.col("aa_wt") == F.col("aa_mut"), "synonymous")
                        .when(F.col("aa_mut") == "*", "nonsense").otherwise("missense"))


def position_domain(variants: DataFrame, domains: DataFrame, block: int = 16) -> DataFrame:
    """First domain (by ord) containing the position, else the gene default.

    Of domains with the same ends only the first can be asked for, so a block holds no more rows than there are pairs of ends.
    """
    ends = domains.groupBy("gene", "start", "end").agg(F.min("ord").alias("ord"), F.min_by("pfam", "ord").alias("pfam"))
    cut = ends.withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor(F.col("end") / block)))).select("gene", "_b", "ord", "pfam", "start", "end")
    keys = variants.columns
    j = variants.withColumn("_b", F.floor(F.col("pos") / block)).join(cut, ["gene", "_b"], "left")
    hit = F.col("pos").between(F.col("start"), F.col("end"))
    first = F.min_by(F.struct("pfam", "start", "end"), F.when(hit, F.col("ord")))
    return j.groupBy(*keys).agg(first.alias("d")).select(
        *keys, F.coalesce("d.pfam", F.concat(F.lit("default_"), F.col("gene").cast("string"))).alias("pfam"),
        F.col("d.start").alias("start"), F.col("d.end").alias("end"))


def profile_fallback(sources: DataFrame, lengths: DataFrame, min_rows: int = 20, min_cover: float = 0.5) -> DataFrame:
    """First source deep and broad enough, else the family source, else empty.

    ``sources`` is (gene, source, priority, pos); the family source has the
    highest priority number and no depth requirement.
    """
    g = sources.groupBy("gene", "source", "priority", "pos").agg(F.count("*").alias("n"))
    g = g.groupBy("gene", "source", "priority").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_pos"))
    j = lengths.join(g, "gene", "left")
    ok = (F.col("source") == "family") | ((F.col("n_rows") >= min_rows) & (F.col("n_pos") / F.col("length") >= min_cover))
    best = F.min_by(F.struct("source", "n_rows", "n_pos"), F.when(ok, F.col("priority")))
    return j.groupBy("gene", "length").agg(best.alias("b")).select(
        "gene", F.coalesce("b.source", F.lit("empty")).alias("chosen"),
        F.coalesce("b.n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce(F.col("b.n_pos") / F.col("length"), F.lit(0.0)).alias("coverage"))


def cluster_lookup(membership: DataFrame) -> DataFrame:
    """Best cluster per accession and how many other members it has.

    ``membership`` is (accession, cluster, ord). A cluster whose id contains the
    accession wins. Sizes are counted per cluster, so members are never paired up.
    """
    named = F.col("cluster").contains(F.col("accession"))
    pick = membership.groupBy("accession").agg(
        F.min_by("cluster", F.struct((~named).alias("x"), F.col("ord"))).alias("cluster"))
    size = membership.groupBy("cluster").agg(F.count_distinct("accession").alias("n"))
    return pick.join(size, "cluster").select("accession", "cluster", (F.col("n") - 1).alias("other_members"))


def source_fallback(sources: DataFrame) -> DataFrame:
    """First non-empty alignment source per target."""
    return sources.filter(F.col("n_rows") > 0).groupBy("target").agg(
        F.min_by(F.struct("source", "n_rows"), "priority").alias("b")).select("target", "b.source", "b.n_rows")


def panel_summary(scored: DataFrame) -> DataFrame:
    """Per gene and overall: variants, scored, damaging, mean percentile, recall."""
    damaging = F.col("call") == "LIKELY DAMAGING"
    return scored.rollup("gene").agg(
        F.count("*").alias("n_variants"), F.count_if(F.col("error").isNull()).alias("n_scored"),
        F.count_if(damaging).alias("n_damaging"), F.avg("percentile").alias("mean_percentile"),
        F.try_divide(F.count_if(damaging).cast("double"), F.count_if(F.col("error").isNull())).alias("recall"))
