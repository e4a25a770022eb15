"""Template selection: pools, bands, representatives, alignment by candidate pair."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import constants as C
from ..functions.bases import letters_of

BROKEN = 1 / C.PHI**2
IDENTITY_CAP = 0.95
MIN_IDENTITY = 0.45
MIN_COVERAGE = 0.65
TOP_K = 4


def state_representatives(clusters: DataFrame, scored: DataFrame, pairs: DataFrame, max_clusters: int | None = None) -> DataFrame:
    """Representatives of a target's clusters, with the reasons they were kept; ``cluster_rank`` 1 is the largest."""
    m = clusters.join(scored, ["target", "model"])
    size = m.groupBy("target", "leader").agg(F.count("*").alias("size"))
    rank = F.row_number().over(W.partitionBy("target").orderBy(F.desc("size"), "leader"))
    size = size.withColumn("cluster_rank", rank)
    m = m.join(size if max_clusters is None else size.filter(F.col("cluster_rank") <= max_clusters), ["target", "leader"])
    intact = F.col("bond_mse") <= BROKEN
    w = W.partitionBy("target", "leader")
    m = m.withColumn("usable", intact | ~F.max(intact).over(w)).filter("usable")
    low = F.row_number().over(w.orderBy(F.round("energy", 9), F.desc("score"), "model")) == 1
    high = F.row_number().over(w.orderBy(F.desc("score"), "model")) == 1
    m = m.withColumns({"low": low, "high": high, "first": (F.col("cluster_rank") == 1) & intact})
    seeds = m.filter("low").select("target", "leader", F.col("model").alias("seed"))
    p = pairs.select("target", F.explode(F.array(
        F.struct(F.col("m1").alias("model"), F.col("m2").alias("seed")),
        F.struct(F.col("m2").alias("model"), F.col("m1").alias("seed")))).alias("e"), "rmsd").select("target", "e.*", "rmsd")
    far = m.join(seeds, ["target", "leader"]).join(p, ["target", "model", "seed"]).filter(F.col("rmsd") > C.PHI)
    pick = lambda o: F.row_number().over(w.orderBy(*o)) == 1
    far = far.withColumns({"fl": pick([F.round("energy", 9), F.desc("score"), "model"]), "fh": pick([F.desc("score"), "model"])})
    far = far.filter("fl or fh").select("target", "model", F.lit(True).alias("far"))
    out = m.join(far, ["target", "model"], "left").withColumn("far", F.coalesce("far", F.lit(False)))
    return out.filter("low or high or first or far").select("target", "model", "leader", "cluster_rank", "low", "high", "first", "far")


def candidate_pool(hits: DataFrame, budget: int | None = None, cap: float = IDENTITY_CAP) -> DataFrame:
    """Ordered union of source lists, first occurrence wins, filtered.

    ``hits`` is (target, pdb_id, priority, ord, identity, coverage, sane). A ``budget`` keeps so many
    hits of lists other than priority 0. The band is a semantic limit of the search.
    """
    fresh = hits.filter(F.col("pdb_id") != F.col("target"))
    first = fresh.groupBy("target", "pdb_id").agg(F.min_by(
        F.struct("priority", "ord", "identity", "coverage", "sane"), F.struct("priority", "ord")).alias("h")).select("target", "pdb_id", "h.*")
    pool = first
    if budget is not None:
        rest = first.filter("priority > 0").withColumn(
            "rk", F.row_number().over(W.partitionBy("target").orderBy("priority", "ord", "pdb_id"))).filter(F.col("rk") <= budget)
        pool = first.filter("priority = 0").unionByName(rest.drop("rk"))
    fit = (F.col("identity") <= cap) & (F.col("identity") >= MIN_IDENTITY) & (F.col("coverage") >= MIN_COVERAGE) & F.col("sane")
    return pool.filter(fit).withColumn("score", F.col("identity") * F.col("coverage"))


def authority_band(scored: DataFrame) -> DataFrame:
    """Mode and primary of each target by ordered rules; one row per target.

    ``scored`` is (target, model, score, identity, energy, bond_mse).
    """
    by_score = F.struct(F.col("score"), -F.col("model"))
    best = scored.groupBy("target").agg(
        F.max("score").alias("best"), F.max_by(F.struct("model", "energy", "bond_mse"), by_score).alias("top"),
        F.max((F.col("identity") >= IDENTITY_CAP).cast("int")).alias("same"))
    j = scored.join(best, "target")
    band = F.col("score") >= F.col("best") / C.PHI
    same = F.col("identity") >= IDENTITY_CAP
    low = F.struct(F.round("energy", 9), -F.col("score"), F.col("model"))
    g = j.groupBy("target", "best", "top", "same").agg(
        F.count_if(band).alias("n_band"), F.min(F.when(band, F.col("energy"))).alias("e_min"),
        F.min_by("model", F.when(band, low)).alias("band_low"),
        F.min(F.when(same, F.col("energy"))).alias("same_min"), F.min_by("model", F.when(same, low)).alias("same_low"),
        F.max_by(F.struct("model", "energy"), F.when(same, by_score)).alias("same_top"))
    fit = j.join(g.select("target", "e_min"), "target").filter(band & (F.col("energy") <= C.PHI * F.col("e_min")))
    fit = fit.groupBy("target").agg(F.max_by("model", by_score).alias("fit_top"))
    g = g.join(fit, "target", "left")
    unfit = (F.col("top.energy") > C.PHI * F.col("e_min")) & (F.col("top.bond_mse") > BROKEN)
    strong = F.col("best") >= 1 / C.PHI
    mode = (F.when(F.col("same") == 1, "same_protein_consensus").when(strong & unfit, "residual_fit_data_authority")
            .when(strong, "data_authority_measured").otherwise("residual_at_remote_interface"))
    primary = (
        F.when(F.col("same") == 1, F.when(F.col("same_top.energy") > C.PHI * F.col("same_min"), F.col("same_low"))
               .otherwise(F.col("same_top.model")))
        .when(strong & unfit, F.coalesce("fit_top", "top.model")).when(strong, F.col("top.model")).otherwise(F.col("band_low")))
    return g.select("target", mode.alias("mode"), primary.alias("primary"), "n_band")


def flip_partner(dev: DataFrame, pairs: DataFrame, scored: DataFrame, primary: DataFrame) -> DataFrame:
    """Intact model in the primary's band that differs most from it yet shares its core.

    ``dev`` is (target, model, deviation) against the primary, ``pairs`` its RMSD, ``primary`` (target, model).
    """
    best = scored.join(primary, ["target", "model"]).select("target", F.col("score").alias("best"))
    d = dev.groupBy("target", "model").agg(
        F.avg((F.col("deviation") <= C.PHI).cast("double")).alias("core"))
    j = (pairs.join(d, ["target", "model"]).join(scored, ["target", "model"]).join(best, "target"))
    ok = ((F.col("score") >= F.col("best") / C.PHI) & (F.col("rmsd") >= C.PHI) & (F.col("bond_mse") <= BROKEN)
          & (F.col("core") >= 1 / C.PHI**2) & (1 - F.col("core") >= 1 / C.PHI**4))
    return j.filter(ok).groupBy("target").agg(
        F.max_by("model", F.struct(F.round("rmsd", 9), -F.col("model"))).alias("partner"), F.max("rmsd").alias("rmsd"))


def kmer_seeds(queries: DataFrame, homologs: DataFrame, k: int = 4, min_hits: int = 6) -> DataFrame:
    """Candidate (query, homolog) pairs sharing enough distinct k-mers.

    A k-mer's occurrences on one side may be a third of all rows, so its rows are
    salted: the homolog side is split and the query side is copied to each part.
    """
    salt = 16

    def mers(df, name):
        idx = F.sequence(F.lit(1), F.greatest(F.length("seq") - k + 1, F.lit(1)))
        return df.filter(F.length("seq") >= k).select(
            F.col("seq_id").alias(name), F.explode(F.array_distinct(F.transform(idx, lambda i: F.substr(F.col("seq"), i, F.lit(k))))).alias("kmer"))

    q, h = mers(queries, "query"), mers(homologs, "homolog")
    h = h.withColumn("salt", F.pmod(F.xxhash64("homolog"), F.lit(salt)))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")))
    return (q.join(h, ["kmer", "salt"]).filter("query <> homolog").groupBy("query", "homolog")
            .agg(F.count("*").alias("shared")).filter(F.col("shared") >= min_hits))


def length_prefilter(pairs: DataFrame, lo: float = 0.5, hi: float = 1.8) -> DataFrame:
    """Homolog length within [lo, hi] of the query; applied before any alignment."""
    n = F.length("qseq")
    return pairs.filter((F.length("hseq") >= lo * n) & (F.length("hseq") <= hi * n))


def _align(a: str, b: str) -> list[tuple[int, int]]:
    """Global alignment, +1 / -1 / -1; diagonal, then up, then left on ties.

    Each matrix row is one vector step: the left-gap chain is a running maximum. Only every root-th row is kept; the trace walks back block by block
    and computes a block's rows again, so memory is the root of one length times the other.
    """
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    n, m = len(x), len(y)
    cols = np.arange(m + 1)

    def rows(top: np.ndarray, start: int, stop: int):
        """Matrix rows start + 1 to stop below row ``start``."""
        for i in range(start + 1, stop + 1):
            best = np.empty(m + 1, np.int64)
            best[0] = -i
            best[1:] = np.maximum(top[:-1] + np.where(y == x[i - 1], 1, -1), top[1:] - 1)
            top = np.maximum.accumulate(best + cols) - cols
            yield i, top

    step = max(1, math.isqrt(n))
    kept = {0: -cols}
    for i, row in rows(kept[0], 0, n):
        if i % step == 0:
            kept[i] = row
    out, i, j = [], n, m
    while i and j:
        start = (i - 1) // step * step
        dp = {start: kept[start], **dict(rows(kept[start], start, i))}
        while i > start and j:
            if dp[i][j] == dp[i - 1][j - 1] + (1 if x[i - 1] == y[j - 1] else -1):
                out.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif dp[i][j] == dp[i - 1][j] - 1:
                i -= 1
            else:
                j -= 1
    return out[::-1]


def longest_common(a: str, b: str) -> tuple[int, int, int]:
    """Length and starts of the longest common substring, first in (i, j) order; length 0 if there is none.

    Substrings of twice a length are ranked by the ranks of their halves, so equal ranks are equal substrings. Doubling finds the power of two that
    is still common, a search on the length the rest: any length is two overlapping ranks. Work is near (n + m) log n.
    """
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64) for s in (a, b))
    n, m = len(x), len(y)

    def at(length: int):
        """Keys of all substrings of one length, from the ranks of the largest power below."""
        off = length - size
        return x[:n - length + 1] * base + x[off:off + n - length + 1], y[:m - length + 1] * base + y[off:off + m - length + 1]

    size, base = 1, 1 << 21
    if not n or not m or not np.isin(x, y).any():
        return 0, 0, 0
    while 2 * size <= min(n, m):
        p, q = at(2 * size)
        if not np.isin(p, q).any():
            break
        _, ranks = np.unique(np.concatenate((p, q)), return_inverse=True)
        x, y, size, base = ranks[:len(p)], ranks[len(p):], 2 * size, len(p) + len(q)
        # ranks are of shorter arrays; lengths below still index the strings
    low, high = size, min(n, m, 2 * size - 1)
    while low < high:
        middle = (low + high + 1) // 2
        p, q = at(middle)
        low, high = (middle, high) if np.isin(p, q).any() else (low, middle - 1)
    p, q = at(low)
    i = int(np.flatnonzero(np.isin(p, q))[0])
    return low, i, int(np.flatnonzero(q == p[i])[0])


def pairwise_align(pairs: DataFrame) -> DataFrame:
    """Aligned index pairs of (query, homolog, qseq, hseq) rows, one task row at a time."""
    def run(batches):
        for pdf in batches:
            got = [_align(q, h) for q, h in zip(pdf["qseq"], pdf["hseq"])]
            yield pd.DataFrame({"query": pdf["query"], "homolog": pdf["homolog"],
                                "qi": [[i for i, _ in g] for g in got], "ti": [[j for _, j in g] for g in got]})

    t = lambda c: pairs.schema[c].dataType.simpleString()
    return pairs.select("query", "homolog", "qseq", "hseq").mapInPandas(
        run, f"query {t('query')}, homolog {t('homolog')}, qi array<int>, ti array<int>")


def alignment_identity(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Identity over aligned pairs, coverage of the query and their product."""
    j = aligned.join(pairs.select("query", "homolog", "qseq", "hseq"), ["query", "homolog"])
    qa, ha = letters_of("qseq"), letters_of("hseq")
    j = j.withColumns({"qa": qa, "ha": ha, "qlen": F.length("qseq")})
    same = F.aggregate(F.zip_with("qi", "ti", lambda a, b: (F.get(F.col("qa"), a) == F.get(F.col("ha"), b)).cast("int")), F.lit(0), lambda s, v: s + v)
    n = F.size("qi")
    return j.select("query", "homolog", n.alias("n_pairs"), same.alias("n_same"),
                    (same / n).alias("identity"), (n / F.col("qlen")).alias("coverage"),
                    (same / n * n / F.col("qlen")).alias("score"))


def diagonal_seed(pairs: DataFrame, min_seed: int = 4) -> DataFrame:
    """Longest exact common substring of each candidate pair, first in (i, j) order, where it has ``min_seed`` letters."""
    def run(batches):
        for pdf in batches:
            got = np.array([longest_common(q, h) for q, h in zip(pdf["qseq"], pdf["hseq"], strict=True)], np.int64).reshape(-1, 3)
            out = pd.DataFrame({"query": pdf["query"], "homolog": pdf["homolog"], "length": got[:, 0], "qi": got[:, 1], "ti": got[:, 2]})
            yield out[out["length"] >= min_seed]

    t = lambda c: pairs.schema[c].dataType.simpleString()
    return pairs.select("query", "homolog", "qseq", "hseq").mapInPandas(
        run, f"query {t('query')}, homolog {t('homolog')}, length bigint, qi bigint, ti bigint")
