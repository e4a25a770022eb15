"""Residue-pair operators: generation, scoring, ranking, target distances."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import dims
from ..functions import pairs as PF
from ..functions import residues as RF
from ..functions.bases import letters_of
from ..functions.common import dist, freeze, let
from . import regions as RG
from .ranking import rank_within, top_n
from .sequences import spread, spread_if_few
from ..session import stored

FEATURES = ["spin", "charge", "branch", "aromatic", "kd", "q", "mu", "polar", "vdw", "hydro",
            "p_alpha", "p_beta", "p_alpha_x", "p_beta_x"]


def with_residues(seqs: DataFrame, coords=None, cooperative: bool = False) -> DataFrame:
    """Pack a sequence's residues as an array: letter, region and optional point.

    ``coords`` maps a 0-based position column to (x, y, z) columns.
    """
    labels = RG.viterbi_labels("seq") if cooperative else RG.tunnel_labels("seq")

    def pack(regions):
        def item(aa, k):
            rg = F.get(regions, k)
            fields = [aa.alias("aa"), rg["kind"].alias("kind"), rg["start"].alias("start"), rg["end"].alias("end")]
            if coords is not None:
                fields += [v.alias(n) for n, v in zip("xyz", coords(k))]
            return F.struct(*fields)

        return F.transform(letters_of("seq"), item)

    return spread_if_few(seqs, "seq_id").select(*seqs.columns, let(RG.residue_regions(labels), pack).alias("res"))


def residue_pairs(chains: DataFrame, gate: int = 1, max_sep: int | None = None, block: int = 128,
                  features: bool = True) -> DataFrame:
    """Ordered pairs i < j of each chain with sep >= gate, without a self-join.

    A chain is cut into tiles of ``block`` x ``block`` residues that are spread over
    the cluster before they are expanded, so a long chain is many small tasks.
    """
    n = F.size("res")
    last = F.floor((n - 1) / block).cast("int")
    top = last if max_sep is None else F.least(last, F.col("bi") + math.ceil(max_sep / block) + 1)
    tiles = (
        chains.filter(n > 1).select("seq_id", n.alias("n"), "res", F.explode(F.sequence(F.lit(0), last)).alias("bi"))
        .select("*", F.explode(F.sequence(F.col("bi"), top)).alias("bj"))
        .select("seq_id", "n", (F.col("bi") * block).alias("i0"), (F.col("bj") * block).alias("j0"),
                F.slice("res", F.col("bi") * block + 1, block).alias("ri"),
                F.slice("res", F.col("bj") * block + 1, block).alias("rj"))
    )
    tiles = spread(tiles, "seq_id", "i0", "j0")
    names = [f.name for f in chains.schema["res"].dataType.elementType.fields]
    left = tiles.select("seq_id", "n", "i0", "j0", "rj", F.posexplode("ri").alias("k", "a")).select(
        "seq_id", "n", "j0", "rj", (F.col("i0") + F.col("k")).alias("i"),
        *[F.col(f"a.{c}").alias(f"i_{c}") for c in names])
    if features:
        left = attach(left, "i_")
    both = left.select(*[c for c in left.columns if c not in ("j0", "rj")], "j0",
                       F.posexplode("rj").alias("k", "b"))
    both = both.withColumn("j", F.col("j0") + F.col("k")).withColumn("sep", F.col("j") - F.col("i"))
    keep = F.col("sep") >= gate
    if max_sep is not None:
        keep = keep & (F.col("sep") <= max_sep)
    both = both.filter(keep)
    out = both.select(*[c for c in both.columns if c not in ("j0", "k", "b")],
                      *[F.col(f"b.{c}").alias(f"j_{c}") for c in names])
    return attach(out, "j_") if features else out


def attach(df: DataFrame, prefix: str) -> DataFrame:
    """Broadcast join of the 20-row residue table under a prefix."""
    dim = dims.aa_dim(df.sparkSession).select(
        F.col("aa").alias(f"{prefix}aa"), *[F.col(f).alias(f"{prefix}{f}") for f in FEATURES])
    return df.join(F.broadcast(dim), f"{prefix}aa")


def with_regions(pairs: DataFrame) -> DataFrame:
    """Flag pairs in two different regions of one kind, with the register multiplier."""
    same = ((F.col("i_kind") == F.col("j_kind")) & (F.col("i_start") != F.col("j_start")))
    helix = PF.heptad_multiplier("i", "j", "i_start", "j_start")
    strand = PF.strand_multiplier("i", "j", "i_start", "j_start", "j_end")
    flag = F.coalesce(same, F.lit(False))
    return pairs.withColumns({
        "region_same": flag,
        "register_mult": F.when(flag, F.when(F.col("i_kind") == "H", helix).otherwise(strand)).otherwise(1.0),
    })


def scalar_table(spark) -> DataFrame:
    """The S law's factors by (link, residue, residue): without hits S is K (1 + n core), n the chain length up to the law's cap."""
    links = F.explode(F.array(*[F.lit(k) for k in PF.LINK_DOMAIN])).alias("link")
    letters = F.array(*[F.lit(a) for a in C.AA20])
    base = spark.range(1).select(links, letters.alias("all"))
    base = base.select("link", "all", F.explode("all").alias("i_aa")).select("link", "i_aa", F.explode("all").alias("j_aa"))
    t = law_inputs(attach(attach(base, "i_"), "j_"))
    s = RF.scalar_s("link_d", F.lit(0.0), quantised("dpsi"), "observed", F.lit(1.0), quantised("dtheta"))
    return t.select("link", "i_aa", "j_aa", *LAW, (s / C.K - 1.0).alias("core"))


LAW = ["link_d", "dpsi", "dtheta", "observed"]


def law_inputs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({
        "link_d": PF.link_param("link", 0).cast("double"),
        "dpsi": PF.delta_psi(PF.link_param("link", 2)),
        "dtheta": PF.delta_theta(),
        "observed": F.col("link") != "backbone_covalent_geometry",
    })


def quantised(c: str):
    return F.rint(F.col(c) * 1000) / 1000


def pair_scalars(pairs: DataFrame, hits=None, coev=None, cons=None, most_hits: float = 50.0, longest: int = 400) -> DataFrame:
    """Link class, phase offsets, S and residual of each pair.

    ``cons`` (two conservation columns) and ``coev`` feed the packing and tertiary classes; without them those inputs are zero. The law counts at most
    ``most_hits`` hits and a chain length of at most ``longest``. Where there are no hits, a pair looks its factors up in a table of (link, residue,
    residue), 2800 rows, instead of evaluating the law.
    """
    p = pairs.withColumn("link", PF.chem_link())
    length = F.least(F.col("n"), F.lit(longest))
    if hits is None and coev is None and cons is None:
        p = p.join(F.broadcast(scalar_table(pairs.sparkSession)), ["link", "i_aa", "j_aa"])
        p = p.withColumns({"hits": F.lit(0.0), "s": C.K * (1.0 + length * F.col("core"))}).drop("core")
        return p.withColumns({"residual": RF.residual_scale("s"), "chaos": RF.chaos_factor("link_d")})
    p = law_inputs(p).withColumn("hits", F.lit(0.0) if hits is None else F.col(hits))
    far = F.col("link").isin("tertiary_biochem", "hydrophobic_packing")
    if cons is not None:
        evo = F.sqrt(F.greatest(F.col(cons[0]), F.lit(0.0)) * F.greatest(F.col(cons[1]), F.lit(0.0)))
        p = p.withColumn("hits", F.col("hits") + F.when(far, evo * C.PHI * C.E).otherwise(0.0))
    if coev is not None:
        boost = F.least(F.greatest(F.col(coev), F.lit(0.0)), F.lit(C.PHI))
        p = p.withColumns({
            "dpsi": F.when(far, F.col("dpsi") * (1 + boost / C.PHI)).otherwise(F.col("dpsi")),
            "hits": F.col("hits") + F.when(far, boost * C.E * C.PHI).otherwise(0.0)})
    s = RF.scalar_s("link_d", F.rint(F.least(F.col("hits"), F.lit(most_hits))), quantised("dpsi"), "observed", length, quantised("dtheta"))
    p = p.withColumn("s", s)
    return p.withColumns({"residual": RF.residual_scale("s"), "chaos": RF.chaos_factor("link_d")})


CHANNELS = ["locality", "chemistry", "helix", "sheet", "region"]


def proximity_channels(pairs: DataFrame) -> DataFrame:
    """Additive proximity channels and their sum ``m``, default routing."""
    p = with_regions(pair_scalars(pairs))
    local = F.col("link") == "backbone_covalent_geometry"
    p = p.withColumns({
        "res_use": F.when(local, 1.0).otherwise(F.col("residual")),
        "chaos_use": F.when(local, 1.0).otherwise(F.col("chaos")),
    })
    ss = C.SS_AMP / C.CHEM_AMP
    span = lambda k: (F.col(f"{k}_end") - F.col(f"{k}_start") + 1).cast("double")
    joint = F.sqrt(F.when(F.col("i_kind") == "H", F.col("i_p_alpha") * F.col("j_p_alpha"))
                   .otherwise(F.col("i_p_beta") * F.col("j_p_beta")))
    length = F.greatest(F.lit(0.0), F.log(F.sqrt(span("i") * span("j"))))
    region = F.when(
        F.col("region_same") & (F.col("sep") >= C.GATE),
        joint * length * C.REGION_AMP * F.col("register_mult") * F.col("res_use") * F.col("chaos_use"),
    ).otherwise(0.0)
    p = p.withColumns({
        "locality": PF.locality(),
        "chemistry": PF.pair_chemistry() * PF.env_scale() * C.CHEM_AMP * F.col("res_use") * F.col("chaos_use"),
        "helix": PF.helix_bonus() * ss * F.col("res_use"),
        "sheet": PF.sheet_bonus() * ss * F.col("res_use"),
        "region": region,
    })
    return p.withColumn("m", sum((F.col(c) for c in CHANNELS[1:]), F.col("locality")))


def contact_evidence(scored: DataFrame) -> DataFrame:
    """Evidence terms of long-range pairs and their total; each term is kept."""
    terms = PF.contact_terms()
    out = scored.withColumns(terms)
    return out.withColumn("evidence", sum((F.col(t) for t in terms), F.col("m")))


EVIDENCE = ["hydrophobic", "salt", "disulfide", "register_term", "polarizability", "evidence"]


def slim(ev: DataFrame) -> DataFrame:
    """Only what a ranked contact needs, so the sort moves few columns."""
    extra = ["distance"] if "distance" in ev.columns else []
    return ev.select("seq_id", "n", "i", "j", "sep", "i_aa", "j_aa", "m", *EVIDENCE, *extra,
                     F.round("evidence", 9).alias("score"))


def rank_contacts(scored: DataFrame, gate: int = C.GATE) -> DataFrame:
    ev = contact_evidence(scored.filter(F.col("sep") >= gate))
    return rank_within(stored(slim(ev)), ["seq_id"], "score", ["i", "j"])


def top_contacts(scored: DataFrame, gate: int = C.GATE, n="n") -> DataFrame:
    """The top n pairs of each chain by evidence (n defaults to the chain length)."""
    ev = contact_evidence(scored.filter(F.col("sep") >= gate))
    return top_n(stored(slim(ev)), ["seq_id"], "score", n, ["i", "j"])


def native_distance(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("distance", dist("i_", "j_"))


def sparse_pairs(scored: DataFrame, local: int = 12, gate: int = C.GATE) -> DataFrame:
    """Local band plus the 2n strongest long-range pairs of each chain."""
    scored = stored(scored.select("seq_id", "n", "i", "j", "sep", "m"))
    far = freeze(scored.filter(F.col("sep") >= gate).select(
        "seq_id", "i", "j", F.round("m", 9).alias("score"), (F.col("n") * 2).alias("n2")))
    best = top_n(far, ["seq_id"], "score", "n2", ["i", "j"]).select("seq_id", "i", "j")
    return scored.filter(F.col("sep") <= local).select("seq_id", "i", "j").unionByName(best).distinct()


def region_pairs(regions: DataFrame, gate: int = C.GATE) -> DataFrame:
    """Later regions of the same kind in the chain whose midpoints are far enough.

    The join key is (seq_id, kind); each side is one row per region.
    """
    a = regions.select("seq_id", "kind", F.col("region").alias("r1"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = regions.select("seq_id", "kind", F.col("region").alias("r2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    mid = lambda s, e: F.floor((F.col(s) + F.col(e)) / 2).cast("int")
    return (a.join(b, ["seq_id", "kind"]).filter(F.col("r1") < F.col("r2"))
            .withColumns({"mi": mid("s1", "e1"), "mj": mid("s2", "e2")})
            .filter(F.col("mj") - F.col("mi") >= gate))


DISTANCE_INPUTS = {"seq_id", "n", "i", "j", "sep", "m", "link", "residual", "region_same", "register_mult", "distance",
                   *(f"{s}_{k}" for s in "ij" for k in ("aa", "kind", "p_alpha", "vdw", "kd", "q", "polar"))}


def proximity_to_distance(scored: DataFrame, regions: DataFrame, gate: int = C.GATE) -> DataFrame:
    """Layered target distance of every scored pair; the scores are stored once for the ranks and the distances."""
    scored = stored(scored.select(*[c for c in scored.columns if c in DISTANCE_INPUTS]))
    sep = F.col("sep").cast("double")
    m = F.greatest(F.col("m"), F.lit(1e-9))
    poly = C.CA_CA * F.pow(sep, F.lit(1 / C.PI))
    env, bb = PF.env_scale(), PF.locality()
    blend = (1 - env) * poly + env * F.least(C.CA_CA / m, F.lit(C.CONTACT * C.PHI))
    p = freeze(scored).withColumns({
        "target": PF.link_target("link", "residual"),
        "d": F.when(F.col("sep") == 1, C.CA_CA).when(F.col("sep") == 2, C.CA_CA * math.sqrt(C.E / C.PHI)).otherwise(
            F.when(m > bb * C.PHI, F.least(blend, C.CONTACT / (1 + (m - bb) * C.PHI))).otherwise(blend)),
    })
    d, t = F.col("d"), F.col("target")
    strong = m > bb * C.PHI
    tertiary = F.least(d, F.greatest(t, F.lit(C.CONTACT / C.PHI)))
    p = p.withColumn("d", F.when(t.isNull(), d)
        .when(F.col("link").isin("disulfide_covalent", "salt_bridge_electrostatic"), F.least(d, t))
        .when(F.col("link") == "hbond_secondary", (d + C.PHI * t) / (1 + C.PHI))
        .when(F.col("link") == "hydrophobic_packing", F.when(strong, F.least(d, t * C.PHI)).otherwise(d))
        .when(F.col("link") == "tertiary_biochem",
              F.when(m > bb * C.PHI**2, F.least(tertiary, C.CONTACT / F.col("residual"))).otherwise(tertiary))
        .otherwise(d))
    helix = (F.col("i_kind") == "H") & (F.col("j_kind") == "H")
    helix = F.coalesce(helix, F.lit(False))
    alpha = (F.col("i_p_alpha") > 1 / C.E) & (F.col("j_p_alpha") > 1 / C.E)
    ideal = PF.helix_ideal("sep")
    p = p.withColumn("d", F.when(F.col("sep").isin(3, 4, 7) & helix, (d + C.PHI * ideal) / (1 + C.PHI))
                     .when(F.col("sep").isin(3, 4, 7) & alpha, F.least(d, ideal)).otherwise(d))
    on_register = (F.col("region_same") & (F.col("i_kind") == "E") & (F.col("sep") >= gate)
                   & (F.col("register_mult") >= 1.0))
    p = p.withColumn("d", F.when(on_register, F.least(d, F.lit(C.PI + C.E / C.PHI))).otherwise(d))
    span = (F.col("i_vdw") + F.col("j_vdw")) * C.E
    p = p.withColumn("d", F.when(F.col("sep").between(3, gate - 1),
                                 F.least(d, F.greatest(span, F.lit(C.CA_CA * C.PHI)))).otherwise(d))
    p = p.withColumn("d", F.least(F.greatest(d, F.lit(C.CA_CA * 0.95)), F.lit(C.CONTACT * C.PHI**2)))

    boost = 1 + (C.PACKING_AMP / C.REGION_AMP) / C.PHI
    top = top_contacts(scored, gate).select("seq_id", "i", "j", (F.col("rank") - 1).alias("rk"))
    anchors = (region_pairs(regions, gate).select("seq_id", F.col("mi").alias("i"), F.col("mj").alias("j"))
               .distinct().withColumn("anchor", F.lit(True)))
    p = p.join(top, ["seq_id", "i", "j"], "left").join(anchors, ["seq_id", "i", "j"], "left")
    n, rk = F.col("n"), F.col("rk")
    half = rk < F.greatest(F.floor(n / 2), F.lit(1))
    hard = F.col("link").isin("disulfide_covalent", "salt_bridge_electrostatic", "hydrophobic_packing", "hbond_secondary")
    first = rk < F.greatest(F.floor(n / 5), F.lit(1))
    cap = (F.when(rk.isNull(), F.lit(None).cast("double"))
           .when(hard | first, F.when(half & hard, C.CONTACT / C.PHI / boost)
                 .when(half, C.CONTACT / math.sqrt(boost)).otherwise(C.CONTACT))
           .when(half, C.CONTACT))
    p = p.withColumn("cap", F.when(F.col("anchor"), F.least(F.coalesce(cap, F.lit(C.CONTACT)), F.lit(C.CONTACT))).otherwise(cap))
    p = p.withColumn("d", F.when(F.col("cap").isNotNull(), F.least(d, F.col("cap"))).otherwise(d))
    rg = RF.target_rg("n")
    floor_ = F.least(F.greatest(poly, rg / C.PHI), rg * math.sqrt(2) * C.PHI)
    return p.withColumn("d", F.when((F.col("sep") >= gate) & F.col("cap").isNull(), F.greatest(d, floor_)).otherwise(d))


def residue_importance(pairs_scalar: DataFrame, gate: int = C.GATE) -> DataFrame:
    """Mean |S| of each residue over partners at or beyond the gate."""
    far = pairs_scalar.filter(F.col("sep") >= gate).select("seq_id", "n", "i", "j", F.abs("s").alias("a"))
    ends = far.select("seq_id", "n", F.explode(F.array("i", "j")).alias("pos"), "a")
    return ends.groupBy("seq_id", "n", "pos").agg(F.avg("a").alias("importance"))


RESIDUAL_BY_LINK = {link: C.RESIDUAL[d] for link, d in PF.LINK_DOMAIN.items() if link != "backbone_covalent_geometry"}


def measured_springs(pairs: DataFrame) -> DataFrame:
    """Residual-weighted springs from measured distances.

    The n nearest long-range contacts are kept; disulfide, salt and helix pairs
    not among them are added. Helical pairs close to the ideal snap to it.
    """
    p = native_distance(pairs).withColumn("link", PF.chem_link("_x"))
    p = p.withColumn("r", PF.by_link("link", RESIDUAL_BY_LINK)).filter(F.col("sep") >= 3)
    helical = (F.col("i_p_alpha_x") >= F.col("i_p_beta_x")) & (F.col("j_p_alpha_x") >= F.col("j_p_beta_x"))
    ideal = PF.helix_ideal("sep")
    snap = ((F.col("link") == "hbond_secondary") & F.col("sep").isin(3, 4, 7) & helical
            & (F.abs(F.col("distance") - ideal) < C.PHI))
    p = p.withColumn("d0", F.when(snap, ideal).otherwise(F.col("distance")))
    p = freeze(p.select("seq_id", "n", "i", "j", "sep", "distance", "link", "r", "d0"))
    near = p.filter((F.col("sep") >= C.GATE) & (F.col("distance") < C.CONTACT))
    near = top_n(near.withColumn("score", -F.round("distance", 9)), ["seq_id"], "score", "n", ["i", "j"])
    near = near.select("seq_id", "i", "j", "d0", "r", "link", F.lit("contact").alias("source"))
    extra = p.filter(
        ((F.col("link") == "disulfide_covalent") & (F.col("distance") < C.CONTACT))
        | ((F.col("link") == "salt_bridge_electrostatic") & (F.col("distance") < C.CONTACT * C.PHI))
        | ((F.col("link") == "hbond_secondary") & F.col("sep").isin(3, 4, 7) & (F.col("distance") < C.CONTACT)))
    extra = extra.join(near, ["seq_id", "i", "j"], "left_anti").select(
        "seq_id", "i", "j", "d0", "r", "link", F.lit("precision").alias("source"))
    return near.unionByName(extra)


def sep2_springs(pairs: DataFrame) -> DataFrame:
    """i, i+2 springs where propensities and the measured distance agree."""
    g = 1 / C.E
    a = lambda k: F.col(f"{k}_p_alpha_x")
    b = lambda k: F.col(f"{k}_p_beta_x")
    helix, sheet = dims.pauling(2), C.CA_CA * C.E / C.PHI
    p = native_distance(pairs.filter(F.col("sep") == 2))
    is_h = ((a("i") > g) & (a("j") > g) & (a("i") >= b("i")) & (a("j") >= b("j"))
            & (F.abs(F.col("distance") - helix) < C.PHI))
    is_e = ((b("i") > g) & (b("j") > g) & (b("i") >= a("i")) & (b("j") >= a("j"))
            & (F.abs(F.col("distance") - sheet) < C.PHI))
    d0 = F.when(is_h, helix).when(is_e, sheet)
    return freeze(p.select("seq_id", "i", "j", d0.alias("d0"))).filter(F.col("d0").isNotNull()).select(
        "seq_id", "i", "j", "d0", F.lit(1.0).alias("r"))
