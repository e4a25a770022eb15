"""Alignment operators. An alignment row is (family, row_id, codes).

``codes`` is an array of residue codes 0..19 with 20 for a gap; its length is the
alignment width, which bounds every per-row expansion below.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from .. import constants as C
from ..session import cut_lineage
from .ranking import rank_within, top_n

GAP = 20
LN20 = math.log(20.0)


def msa_cells(rows: DataFrame) -> DataFrame:
    return rows.select("family", "row_id", F.posexplode("codes").alias("pos", "aa"))


def column_counts(rows: DataFrame) -> DataFrame:
    """Cells per (family, column, code): the only pass over the cells."""
    return msa_cells(rows).groupBy("family", "pos", "aa").agg(F.count("*").alias("n"))


def xlogx(n) -> F.Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n > 0, n * F.log(n.cast("double"))).otherwise(0.0)


def column_stats(counts: DataFrame) -> DataFrame:
    """Gap fraction, entropy, conservation and letter frequencies of each column."""
    full = F.col("aa") != GAP
    tot, rows = F.sum(F.when(full, F.col("n"))), F.sum("n")
    letter = F.substring(F.lit(C.AA20), F.col("aa") + 1, F.lit(1))
    g = counts.groupBy("family", "pos").agg(
        rows.alias("n_rows"), F.coalesce(tot, F.lit(0)).alias("covered"),
        F.sum(F.when(full, xlogx("n"))).alias("xlx"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(full, F.struct(letter.alias("k"), F.col("n").alias("v")))))).alias("cnt"))
    h = F.when(F.col("covered") > 0, F.greatest(F.log(F.col("covered").cast("double")) - F.col("xlx") / F.col("covered"), F.lit(0.0))).otherwise(LN20)
    g = g.withColumn("entropy", h)
    return g.select(
        "family", "pos", "n_rows", "covered", "entropy",
        (1 - F.col("covered") / F.col("n_rows")).alias("gap_frac"),
        F.when(F.col("covered") > 0, F.greatest(F.lit(0.0), 1 - F.col("entropy") / LN20)).otherwise(0.0).alias("conservation"),
        F.transform_values("cnt", lambda k, v: v / F.col("covered")).alias("freq"))


def query_rows(rows: DataFrame) -> DataFrame:
    """The first row of each family, taken as its query."""
    return rows.groupBy("family").agg(F.min_by("codes", "row_id").alias("codes"), F.min("row_id").alias("row_id"))


def identity_conservation(counts: DataFrame, query: DataFrame) -> DataFrame:
    """Share of covering rows equal to the query residue, and the query's letter."""
    q = query.select("family", F.posexplode("codes").alias("pos", "query_aa")).filter(F.col("query_aa") != GAP)
    g = counts.filter(F.col("aa") != GAP).groupBy("family", "pos").agg(
        F.sum("n").alias("covered"), F.map_from_entries(F.collect_list(F.struct("aa", "n"))).alias("by_aa"))
    same = F.coalesce(F.try_element_at("by_aa", F.col("query_aa")), F.lit(0))
    return q.join(g, ["family", "pos"], "left").select(
        "family", "pos", "query_aa", F.coalesce("covered", F.lit(0)).alias("covered"),
        F.when(F.col("covered") > 0, same / F.col("covered")).otherwise(0.0).alias("identity_cons"))


def mutual_information(rows: DataFrame, min_rows: int = 20) -> DataFrame:
    """MI of every column pair from one joint count per (pair, letters).

    With counts n, MI = ln T + (sum n_ab ln n_ab - sum n_a ln n_a - sum n_b ln n_b) / T.
    The three sums come from one more aggregate over the joint counts.
    """
    left = rows.select("family", "codes", F.posexplode("codes").alias("i", "a")).filter(F.col("a") != GAP)
    pair = left.select("family", "i", "a", F.posexplode("codes").alias("j", "b")).filter(
        (F.col("j") > F.col("i")) & (F.col("b") != GAP))
    joint = pair.groupBy("family", "i", "j", "a", "b").agg(F.count("*").alias("n"))
    none = F.lit(-1)
    sets = F.array(*[F.struct(F.lit(k).alias("s"), x.alias("a"), y.alias("b")) for k, x, y in (
        (0, F.col("a"), F.col("b")), (1, F.col("a"), none), (2, none, F.col("b")))])
    marg = (joint.select("family", "i", "j", "n", F.explode(sets).alias("k"))
            .groupBy("family", "i", "j", "k").agg(F.sum("n").alias("n")))
    sign = F.when(F.col("k.s") == 0, 1.0).otherwise(-1.0)
    g = marg.groupBy("family", "i", "j").agg(
        F.sum(F.when(F.col("k.s") == 0, F.col("n"))).alias("rows"), F.sum(sign * xlogx("n")).alias("x"))
    mi = F.log(F.col("rows").cast("double")) + F.col("x") / F.col("rows")
    return g.select("family", "i", "j", "rows", F.when(F.col("rows") >= min_rows, mi).otherwise(0.0).alias("mi"))


def apc_correction(mi: DataFrame, width: int) -> DataFrame:
    """Average-product correction; means run over the full width x width table."""
    ends = mi.select("family", F.explode(F.array("i", "j")).alias("pos"), "mi")
    means = ends.groupBy("family", "pos").agg((F.sum("mi") / width).alias("mean"))
    whole = mi.groupBy("family").agg((2 * F.sum("mi") / (width * width)).alias("all"))
    side = lambda k: means.select("family", F.col("pos").alias(k), F.col("mean").alias(f"mean_{k}"))
    out = mi.join(side("i"), ["family", "i"]).join(side("j"), ["family", "j"]).join(whole, "family")
    fixed = F.col("mi") - F.col("mean_i") * F.col("mean_j") / (F.col("all") + 1e-12)
    return out.select("family", "i", "j", "mi",
                      F.greatest(F.when(F.col("all") <= 0, F.col("mi")).otherwise(fixed), F.lit(0.0)).alias("coev"))


def numbered_rows(rows: DataFrame) -> DataFrame:
    """0-based row ordinal inside the family, without one task per family."""
    r = rank_within(rows.select("family", "row_id", (-F.col("row_id")).alias("_s")), ["family"], "_s", ["row_id"])
    return rows.join(r.select("family", "row_id", (F.col("rank") - 1).alias("ord")), ["family", "row_id"])


def pair_identity() -> F.Column:
    z = F.zip_with("ca", "cb", lambda x, y: F.when((x != GAP) & (y != GAP), (x == y).cast("int")))
    seen = F.filter(z, lambda v: v.isNotNull())
    n = F.size(seen)
    return F.when(n >= 10, F.aggregate(seen, F.lit(0), lambda s, v: s + v) / n)


def neff_analytic(rows: DataFrame, per_row: int) -> DataFrame:
    """N / (1 + (N - 1) mean identity) over drawn row pairs.

    Every row draws ``per_row`` partners of its family by a hash of its ordinal, so the draws grow with the family and all rows take part; the
    mean's standard error is the deviation of one pair's identity over the root of ``per_row`` times the family's rows.
    """
    numbered = numbered_rows(rows).select("family", "ord", "codes")
    size = rows.groupBy("family").agg(F.count("*").alias("n_seqs"))
    prime = F.lit((1 << 31) - 1)
    k = F.explode(F.sequence(F.lit(0), F.lit(per_row - 1)).cast("array<bigint>"))
    d = numbered.join(size, "family").select("family", "n_seqs", F.col("codes").alias("ca"), F.col("ord").alias("a"), k.alias("k"))
    mixed = (F.col("a") * 48271 + F.col("k") * 104729 + 12345) % prime * 69621 % prime
    d = d.withColumn("b", mixed % F.col("n_seqs")).filter("a <> b")
    j = d.join(numbered.select("family", F.col("ord").alias("b"), F.col("codes").alias("cb")), ["family", "b"])
    ids = j.select("family", pair_identity().alias("identity")).groupBy("family").agg(F.avg("identity").alias("mean_id"))
    n = F.col("n_seqs").cast("double")
    m = F.least(F.greatest("mean_id", F.lit(0.0)), F.lit(1 - 1e-9))
    return size.join(ids, "family", "left").select(
        "family", "n_seqs", "mean_id",
        F.when(F.col("mean_id").isNull(), n).otherwise(n / (1 + (n - 1) * m)).alias("neff_analytic"))


#: Bits of a code; rows and leaders that are compared at a time; leaders in a stored row.
PLANES, TILE, HEAD, PART = 5, 8192, 512, 4096
GAP_WORD = np.array([-(GAP >> k & 1) for k in range(PLANES)], "<i8").tobytes()


@pandas_udf(T.BinaryType())
def packed_codes(codes: pd.Series) -> pd.Series:
    """Codes as bits: for every 64 columns one word per bit of the code. Null codes and missing columns are gaps."""
    codes = codes.map(lambda c: () if c is None else c)
    width = codes.map(len).to_numpy()
    out = np.empty(len(codes), object)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        words = max(1, -(-int(w) // 64))
        m = np.full((len(at), 64 * words), GAP, np.uint8)
        if w:
            given = np.stack(codes.iloc[at].to_numpy()).astype("float64")
            given[np.isnan(given)] = GAP
            if not ((given >= 0) & (given <= GAP)).all():
                raise ValueError(f"codes are 0 to {GAP}")
            m[:, :w] = given
        raw = np.stack([np.packbits(m >> k & 1, axis=1, bitorder="little").view("<u8") for k in range(PLANES)], -1).tobytes()
        size = words * len(GAP_WORD)
        out[at] = [raw[k:k + size] for k in range(0, len(raw), size)]
    return pd.Series(out)


class Packed:
    """Packed rows side by side: ``bits`` (word, plane, row), and their filled columns as words and in number."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.full = ~(bits[:, 2] & bits[:, 4])  # a gap is 10100; no other code has both bits
        self.filled = np.bitwise_count(self.full).sum(0, dtype=np.int64)

    @classmethod
    def of(cls, rows, words: int = 1) -> Packed:
        """Rows as bytes, at ``words`` words or at the widest row's; narrower ones end in gaps."""
        words = max([words, *(len(r) // len(GAP_WORD) for r in rows)])
        raw = b"".join(r + GAP_WORD * (words - len(r) // len(GAP_WORD)) for r in rows)
        return cls(np.ascontiguousarray(np.frombuffer(raw, "<u8").reshape(-1, words, PLANES).transpose(1, 2, 0)))

    def __len__(self) -> int:
        return self.bits.shape[2]

    def __getitem__(self, at) -> Packed:
        return Packed(np.ascontiguousarray(self.bits[:, :, at]))

    def to_bytes(self) -> bytes:
        return self.bits.transpose(2, 0, 1).tobytes()


def nearness(rows: Packed, leaders: Packed):
    """A function from a leader's position to the rows near it.

    Rows are near that share ten filled columns or more and agree on 1/e of them or more. Rows with f and g filled columns share f + g - used at least, of the
    used columns, so the number of columns that agree rules out nearly all rows; shared columns are counted for what is left.
    """
    words, columns = len(rows.bits), 64 * len(rows.bits)
    used = int(np.bitwise_count(np.bitwise_or.reduce(rows.full, 1) | np.bitwise_or.reduce(leaders.full, 1)).sum())
    # a leader's gaps get a code of their own, so that they agree with nothing
    lead = leaders.bits.copy()
    lead[:, 0] |= ~leaders.full
    differ, plane = np.empty(len(rows), np.uint64), np.empty(len(rows), np.uint64)
    most, none = {}, np.empty(0, np.int64)

    def near(k: int) -> np.ndarray:
        f = leaders.filled[k]
        if f not in most:
            least = np.ceil(np.maximum(rows.filled + f - used, 10) / math.e)
            most[f] = (columns - least).astype(np.uint8 if words == 1 else np.int64)
        n = 0
        for w in range(words):
            np.bitwise_xor(rows.bits[w, 0], lead[w, 0, k], out=differ)
            for b in range(1, PLANES):
                np.bitwise_xor(rows.bits[w, b], lead[w, b, k], out=plane)
                np.bitwise_or(differ, plane, out=differ)
            one = np.bitwise_count(differ)
            n = one if words == 1 else n + one.astype(np.int64)
        agree = n <= most[f]
        at = np.flatnonzero(agree) if agree.any() else none
        if len(at):
            shared = np.bitwise_count(rows.full[:, at] & leaders.full[:, k, None]).sum(0, dtype=np.int64)
            at = at[(shared >= 10) & (columns - n[at].astype(np.int64) >= shared / math.e)]
        return at

    return near


def far_rows(rows: Packed, leaders: Packed) -> np.ndarray:
    """Positions of the rows that are near none of the leaders, found a tile of rows at a time."""
    out = [np.empty(0, np.int64)]
    heads = [leaders[k:k + HEAD] for k in range(0, len(leaders), HEAD)]
    for start in range(0, len(rows), TILE):
        left = np.arange(start, min(start + TILE, len(rows)))
        for head in heads:
            if not len(left):
                break
            near, far = nearness(rows[left], head), np.ones(len(left), bool)
            for k in range(len(head)):
                far[near(k)] = False
            left = left[far]
        out.append(left)
    return np.concatenate(out)


def first_leaders(rows: Packed) -> np.ndarray:
    """Positions of the rows that are near no earlier leader: a head of rows one by one, then the rows after it against the head's leaders."""
    left, found = np.arange(len(rows)), [np.empty(0, np.int64)]
    while len(left):
        head, left = left[:HEAD], left[HEAD:]
        some = rows[head]
        near, free, leads = nearness(some, some), np.ones(len(head), bool), []
        for k in range(len(head)):
            if free[k]:
                leads.append(k)
                free[near(k)] = False
        found.append(head[leads])
        left = left[far_rows(rows[left], some[leads])]
    return np.concatenate(found)


def _lead(pdf: pd.DataFrame) -> pd.DataFrame:
    """The leaders among a block's rows, in row order, a part of them a row."""
    pdf = pdf.sort_values("ord")
    rows = Packed.of(pdf["bits"])
    at = first_leaders(rows)
    parts = [at[k:k + PART] for k in range(0, len(at), PART)]
    return pd.DataFrame({"family": pdf["family"].iloc[:len(parts)].to_numpy(), "row_ids": [pdf["row_id"].iloc[p].tolist() for p in parts],
                         "words": len(rows.bits), "bits": [rows[p].to_bytes() for p in parts]})


def _uncovered(rows: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
    """Rows of a chunk that are near none of the leaders; a chunk that gets no leaders was in the block."""
    if not len(rows) or not len(leaders):
        return rows.iloc[:0]
    words = int(leaders["words"].max())
    own = Packed.of(rows["bits"], words)
    left = np.arange(len(rows))
    for n, bits in zip(leaders["words"], leaders["bits"]):
        size = n * len(GAP_WORD)
        some = Packed.of([bits[k:k + size] for k in range(0, len(bits), size)], len(own.bits))
        left = left[far_rows(own[left], some)]
    return rows.iloc[left]


def identity_leaders(rows: DataFrame, block: int = 32_768) -> DataFrame:
    """The greedy leaders of each family: in row order, every row that is near no earlier leader.

    Rows travel as bits, so that two of them are compared by a few operations on words. A round takes the first ``block`` rows of each family that are left, in
    whole chunks, finds the leaders among them, and drops from the other chunks what is near one of these. It ends when nothing is left. So no group holds more
    than a block, or a chunk and a block's leaders; the work is that of the greedy rule, rows times leaders, spread over the chunks.
    """
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("family", "row_id")}
    shape = f"family {kind['family']}, row_id {kind['row_id']}, ord bigint, chunk bigint, bits binary"
    bits = rows.select("family", "row_id", packed_codes("codes").alias("bits"), (-F.col("row_id")).alias("_s"))
    place = F.col("rank") - 1
    left = rank_within(bits.filter("family IS NOT NULL AND row_id IS NOT NULL"), ["family"], "_s", ["row_id"])
    left = cut_lineage(left.select("family", "row_id", place.alias("ord"), F.floor(place / max(1, block // 4)).alias("chunk"), "bits"))
    found = left.select("family", "row_id").limit(0)
    while True:
        counts = left.groupBy("family", "chunk").agg(F.count("*").alias("n"))
        so_far = F.sum("n").over(W.partitionBy("family").orderBy("chunk"))
        counts = cut_lineage(counts.select("family", "chunk", ((so_far <= block) | (so_far == F.col("n"))).alias("now")))
        if counts.isEmpty():
            return found
        first = left.join(counts.filter("now"), ["family", "chunk"]).select("family", "row_id", "ord", "bits")
        leaders = cut_lineage(first.groupBy("family").applyInPandas(_lead, f"family {kind['family']}, row_ids array<{kind['row_id']}>, words int, bits binary"))
        found = found.unionByName(leaders.select("family", F.explode("row_ids").alias("row_id")))
        sent = counts.filter("NOT now").join(leaders, "family").select(F.col("family").alias("to"), F.col("chunk").alias("part"), "words", "bits")
        left = cut_lineage(left.groupBy("family", "chunk").cogroup(sent.groupBy("to", "part")).applyInPandas(_uncovered, shape))


def neff_clusters(rows: DataFrame, sample: int | None = None) -> DataFrame:
    """Greedy identity clusters of each family's rows, or of ``sample`` of them, scaled back."""
    score = F.pmod(F.xxhash64("family", "row_id"), F.lit(1 << 20)).cast("double")
    picked = rows if sample is None else top_n(rows.withColumn("_s", score), ["family"], "_s", sample, ["row_id"], step=1 << 14).drop("_s", "rank")
    size = rows.groupBy("family").agg(F.count("*").alias("n_seqs"))
    taken = size if sample is None else picked.groupBy("family").agg(F.count("*").alias("n_seqs"))
    c = identity_leaders(picked).groupBy("family").agg(F.count("*").alias("n_clusters"))
    c = c.join(taken.withColumnRenamed("n_seqs", "n_sampled"), "family").join(size, "family")
    return c.withColumn("neff_clusters", F.col("n_clusters") * F.col("n_seqs") / F.col("n_sampled").cast("double"))


def depth_ok(n_seqs: str = "n_seqs", neff: str = "neff") -> F.Column:
    return (F.col(n_seqs) >= math.ceil(C.PI * C.E)) & (F.col(neff) >= C.PHI)


def evo_confidence(stats: DataFrame, neff: DataFrame) -> DataFrame:
    depth = 1 - F.exp(-F.col("neff") / C.PHI)
    raw = F.col("conservation") * (1 - F.col("gap_frac")) * depth
    return stats.join(neff, "family").withColumn(
        "confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def fused_confidence(evo, provenance) -> F.Column:
    """Noisy-OR of evolutionary confidence and template provenance."""
    p = (F.when(provenance == "identical", 1.0).when(provenance == "mutated", 1 / C.PHI)
         .otherwise(1 / C.PHI**2))
    return 1 - (1 - evo) * (1 - p)


EVO_AMP = C.S["Biochemistry"] * C.P_NEW * C.C_EFF / C.PHI


def top_l_scale(coev: DataFrame, width: int, gate: int = C.GATE) -> DataFrame:
    """Mean of the ``width`` largest long-range scores of each family."""
    far = coev.filter(F.col("j") - F.col("i") >= gate).withColumn("_s", F.round("coev", 9))
    best = top_n(far, ["family"], "_s", width, ["i", "j"], step=0.01)
    return best.groupBy("family").agg((F.avg("coev") + 1e-12).alias("scale"))


def top_l_normalise(coev: DataFrame, width: int) -> DataFrame:
    return coev.join(top_l_scale(coev, width), "family").withColumn("coev_norm", F.col("coev") / F.col("scale"))


def with_columns(coev: DataFrame, stats: DataFrame) -> DataFrame:
    side = lambda k: stats.select("family", F.col("pos").alias(k), F.col("conservation").alias(f"cons_{k}"),
                                  F.col("gap_frac").alias(f"gap_{k}"))
    return coev.join(side("i"), ["family", "i"]).join(side("j"), ["family", "j"])


def evo_boost(coev: DataFrame, stats: DataFrame, width: int, gate: int = C.GATE) -> DataFrame:
    j = with_columns(top_l_normalise(coev, width), stats).filter(F.col("j") - F.col("i") >= gate)
    pen = 1 - 0.5 * (F.col("gap_i") + F.col("gap_j"))
    value = EVO_AMP * F.col("coev_norm") * F.sqrt(F.col("cons_i") * F.col("cons_j")) * pen
    return j.withColumn("boost", value).filter((pen > 0) & (value > 0))


def top_coev_pairs(coev: DataFrame, stats: DataFrame, n: int, gate: int = C.GATE) -> DataFrame:
    """The n strongest positive pairs by coevolution times conservation."""
    j = with_columns(coev, stats).filter((F.col("j") - F.col("i") >= gate) & (F.col("coev") > 0))
    j = j.withColumn("score", F.round(F.col("coev") * F.sqrt(F.col("cons_i") * F.col("cons_j")), 9))
    return top_n(j.filter(F.col("score") > 0), ["family"], "score", n, ["i", "j"], step=0.01)


def map_to_query(rows: DataFrame) -> DataFrame:
    """Reference row closest to the query, and both ungapped indices per column."""
    q = query_rows(rows).select("family", F.col("codes").alias("cq"), F.col("row_id").alias("query_row"))
    same = F.aggregate(F.zip_with("cq", "codes", lambda x, y: ((x == y) & (x != GAP)).cast("int")), F.lit(0), lambda s, v: s + v)
    scored = rows.join(q, "family").filter(F.col("row_id") != F.col("query_row")).withColumn("_m", same)
    best = scored.groupBy("family").agg(
        F.max_by(F.struct("row_id", "codes", "cq", "_m"), F.struct(F.col("_m"), -F.col("row_id"))).alias("b"))
    index = lambda a: F.transform(
        a, lambda x, k: F.when(x != GAP, F.size(F.filter(F.slice(a, 1, k + 1), lambda y: y != GAP)) - 1))
    z = F.arrays_zip(index(F.col("b.cq")).alias("q"), index(F.col("b.codes")).alias("r"))
    return best.select("family", F.col("b.row_id").alias("ref_row"), F.col("b._m").alias("matches"),
                       F.posexplode(z).alias("col", "z")).select(
        "family", "ref_row", "matches", "col", F.col("z.q").alias("query_index"), F.col("z.r").alias("ref_index"))
