"""Evaluation statistics as aggregates over long tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stored
from .ranking import rank_within, top_n, value_ranks, with_quantiles
from .sequences import spread


def pearson(x, y) -> Column:
    """Correlation, 0 where either side is constant or missing."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def centred_pearson(df: DataFrame, keys: list[str], group: str, x: str, y: str, min_group: int = 2) -> DataFrame:
    """Correlation per key after centring both columns inside each group.

    Sums of squares and products per group are enough, so the rows are read once
    and no window is needed.
    """
    g = df.groupBy(*keys, group).agg(
        F.count("*").alias("n"), F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    g = g.filter(F.col("n") >= min_group)
    total = lambda c: F.sum(F.col(c) * F.col("n"))
    den = F.sqrt(total("vx") * total("vy"))
    return g.groupBy(*keys).agg(F.when(den < 1e-9, 0.0).otherwise(total("cxy") / den).alias("pearson"))


def topk_precision(pairs: DataFrame, thresholds, cutoff: float = 8.0) -> DataFrame:
    """Share of native contacts in the top n/2 scores per separation threshold.

    Expects seq_id, n, i, j, sep, score, distance.
    """
    tagged = pairs.withColumn("min_sep", F.explode(F.array(*[F.lit(t) for t in thresholds]))).filter(
        F.col("sep") >= F.col("min_sep")).withColumn("half", F.greatest(F.floor(F.col("n") / 2), F.lit(1)))
    best = top_n(tagged, ["seq_id", "min_sep"], "score", "half", ["i", "j"])
    return best.groupBy("seq_id", "min_sep").agg(
        F.avg((F.col("distance") < cutoff).cast("double")).alias("precision_half_l"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Average-rank correlation per key."""
    out = df
    for name, col in (("rx", x), ("ry", y)):
        ranks = value_ranks(df, keys, col).select(
            *keys, col, (F.col("below") + (F.col("same") + 1) / 2.0).alias(name))
        out = out.join(ranks, [*keys, col])
    return out.groupBy(*keys).agg(pearson("rx", "ry").alias("spearman"))


def confusion(df: DataFrame, keys: list[str], obs: str = "obs", pred: str = "pred") -> DataFrame:
    """3x3 counts, accuracy, recalls and macro recall per key."""
    kinds = "HEC"
    cell = lambda a, b: F.count_if((F.col(obs) == a) & (F.col(pred) == b))
    cells = {f"{a}{b}": cell(a, b) for a in kinds for b in kinds}
    g = df.groupBy(*keys).agg(F.count("*").alias("total"), *[v.alias(k) for k, v in cells.items()])
    recall = {a: F.try_divide(F.col(a + a).cast("double"), sum((F.col(a + b) for b in kinds), F.lit(0))) for a in kinds}
    return g.withColumns({
        "accuracy": (F.col("HH") + F.col("EE") + F.col("CC")) / F.col("total"),
        **{f"recall_{a.lower()}": r for a, r in recall.items()},
        "macro_recall": (recall["H"] + recall["E"] + recall["C"]) / 3.0,
    })


def bin_error_stats(errors: DataFrame, bins: list[tuple[str, int, int | None]]) -> DataFrame:
    """Count, mean, median, p90 of |error| and signed median per separation bin.

    A separation may belong to several bins, so bins are attached as an array.
    """
    tags = F.array_compact(F.array(*[F.when((F.col("sep") >= lo) & (F.lit(True) if hi is None else F.col("sep") <= hi), name) for name, lo, hi in bins]))
    e = errors.select("*", F.explode(tags).alias("bin"))
    wanted = {"median_abs": (F.abs("err"), 0.5), "p90_abs": (F.abs("err"), 0.9), "signed_median": ("err", 0.5)}
    return with_quantiles(e, ["bin"], wanted, F.count("*").alias("n_pairs"), F.avg(F.abs("err")).alias("mean_abs"))


def bootstrap_ci(values: DataFrame, draws: int, key: str = "id", value: str = "value", stat: str = "mean") -> DataFrame:
    """Percentile bootstrap interval of the mean or the median (``stat``) with Poisson(1) resampling weights.

    Every row draws one weight per replicate from a hash of (row, replicate), so
    rows never meet: a replicate is two partial sums, and the shuffle carries one
    row per replicate and task. Few rows in one file are dealt out before they draw.
    """
    h = F.pmod(F.col(key) * 7919 + F.col("b") * 104729 + F.col(key) * F.col("b") % 99991, F.lit(1000003))
    u = (h * 48271 % 1000003 + 0.5) / 1000003.0
    if stat not in ("mean", "median"):
        raise ValueError(stat)
    # u is at most 1 - 5e-7, so weights end long before 20
    cdf, w, p = 0.0, F.lit(20), 0.36787944117144233
    steps = []
    for k in range(20):
        cdf += p
        steps.append((k, cdf))
        p /= k + 1
    for k, c in reversed(steps):
        w = F.when(u < c, k).otherwise(w)
    r = spread(values.select(key, value), key).select(key, value, F.explode(F.sequence(F.lit(0), F.lit(draws - 1)).cast("array<bigint>")).alias("b"))
    r = r.select("b", value, w.alias("w"))
    if stat == "median":
        m = r.filter("w > 0").groupBy("b").agg(F.percentile(value, 0.5, F.col("w")).alias("m"))
    else:
        m = r.groupBy("b").agg(F.try_divide(F.sum(F.col(value) * F.col("w")), F.sum("w").cast("double")).alias("m"))
    return m.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.count("m").alias("draws"))


#: Rows of a block, rows of a kind's segment and trials of a chunk, which meet in one task; bins of a count, and rows a trial that are put in order at last.
BLOCK, SEGMENT, CHUNK, BINS, LEFT = 65_536, 1_000_000, 625, 64, 512
#: Numbers that a matrix of rows and trials holds.
CELLS = 262_144
#: Orders of the first null lie between these.
ORDERS = 100_003
COUNTED = "chunk bigint, low binary, before binary, total binary, counts binary, sums binary"
REACHED = "chunk bigint, low binary, before binary, total binary"


def _packed(values: np.ndarray, kind=np.int64) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _trials(chunk: int, trials: int, rows: int, size: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The trials of a chunk, as many at a time as make a matrix of bounded size with ``rows``, with their places in the chunk."""
    first, last = chunk * size, min((chunk + 1) * size, trials)
    step = max(1, CELLS // max(rows, 1))
    for t in range(first, last, step):
        yield slice(t - first, min(t + step, last) - first), np.arange(t, min(t + step, last))[:, None]


def _orders(ids: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.fmod(ids * 7919 + t * 104729 + np.fmod(ids * t, 6007), ORDERS)


def _reached(row, size: int) -> tuple[np.ndarray, ...]:
    """Where the search of each trial of a chunk stands: lowest order that is open, rows and their sum before it."""
    if row.low is None:
        return np.full(size, -ORDERS), np.zeros(size, np.int64), np.zeros(size)
    return np.frombuffer(row.low, np.int64), np.frombuffer(row.before, np.int64), np.frombuffer(row.total, np.float64)


def _meetings(spark, n: int) -> int:
    """Tasks for n meetings of blocks and chunks: the usual number of partitions, but none that would be empty beyond the cluster's slots."""
    return max(spark.sparkContext.defaultParallelism, min(n, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))


def _free_null(blocks: DataFrame, k: int, n: int, trials: int, block: int, chunk: int, left: int) -> DataFrame:
    """(t, s): sum of the values of the k first rows of each trial in the order of (hash, id).

    Blocks of rows meet chunks of trials. Bins of the hash are counted over the blocks and the one that holds the k-th row is divided again, until it is
    narrow; only its rows travel and are put in order. So what is shuffled follows trials times blocks, not trials times rows.
    """
    spark = blocks.sparkSession
    state = spark.range(-(-trials // chunk)).select(F.col("id").alias("chunk"), *[F.lit(None).cast("binary").alias(c) for c in ("low", "before", "total")])
    parts = _meetings(spark, -(-n // block) * -(-trials // chunk))

    def met(state):
        return blocks.join(F.broadcast(state)).repartition(parts, "block", "chunk")

    def counted(width):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    ids, values = np.frombuffer(row.ids, np.int64), np.frombuffer(row.vals, np.float64)
                    low, before, total = _reached(row, chunk)
                    counts, sums = np.zeros((chunk, BINS), np.int64), np.zeros((chunk, BINS))
                    for at, t in _trials(row.chunk, trials, len(ids), chunk):
                        b = (_orders(ids, t) - low[at, None]) // width
                        i, j = np.nonzero((b >= 0) & (b < BINS))
                        cell, m = i * BINS + b[i, j], len(t)
                        counts[at] = np.bincount(cell, minlength=m * BINS).reshape(m, BINS)
                        sums[at] = np.bincount(cell, values[j], minlength=m * BINS).reshape(m, BINS)
                    yield pd.DataFrame({"chunk": [row.chunk], "low": [_packed(low)], "before": [_packed(before)], "total": [_packed(total, np.float64)],
                                        "counts": [_packed(counts)], "sums": [_packed(sums, np.float64)]})
        return run

    def narrowed(width):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            low, before, total = _reached(next(pdf.itertuples()), chunk)
            counts = sum(np.frombuffer(c, np.int64) for c in pdf["counts"]).reshape(-1, BINS)
            sums = sum(np.frombuffer(c, np.float64) for c in pdf["sums"]).reshape(-1, BINS)
            # the last chunk has places for trials that there are not
            bin_ = np.minimum((before[:, None] + np.cumsum(counts, axis=1) < k).sum(axis=1), BINS - 1)
            earlier = np.arange(BINS) < bin_[:, None]
            return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "low": [_packed(low + bin_ * width)], "before": [_packed(before + (counts * earlier).sum(axis=1))],
                                 "total": [_packed(total + (sums * earlier).sum(axis=1), np.float64)]})
        return run

    width = 2 * ORDERS
    while width > 1 and n * width > left * ORDERS:
        width = -(-width // BINS)
        state = stored(met(state).mapInPandas(counted(width), COUNTED).groupBy("chunk").applyInPandas(narrowed(width), REACHED))

    def open_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids, values = np.frombuffer(row.ids, np.int64), np.frombuffer(row.vals, np.float64)
                low, before, total = _reached(row, chunk)
                for at, t in _trials(row.chunk, trials, len(ids), chunk):
                    order = _orders(ids, t)
                    i, j = np.nonzero((order >= low[at, None]) & (order < low[at, None] + width))
                    place = at.start + i
                    yield pd.DataFrame({"t": row.chunk * chunk + place, "before": before[place], "total": total[place], "o": order[i, j], "id": ids[j], "v": values[j]})

    rows = met(state).mapInPandas(open_rows, "t bigint, before bigint, total double, o bigint, id bigint, v double")
    rank = F.row_number().over(W.partitionBy("t").orderBy("o", "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") + F.col("before") <= k).groupBy("t").agg((F.max("total") + F.sum("v")).alias("s"))


def _same_null(pc: DataFrame, n: int, trials: int, chunk: int, block: int, segment: int) -> DataFrame:
    """(t, s, n): sum and number of the values drawn for the picked rows, each from its own kind.

    Blocks of a kind's picked rows meet segments of its values, in the order of the ids, and chunks of trials; sums travel.
    """
    spark = pc.sparkSession
    size = pc.groupBy("kind").agg(F.count("*").alias("size"))
    place = rank_within(pc.select("kind", "id", "below", (-F.col("id")).alias("_s")), ["kind"], "_s", ["id"]).select("kind", (F.col("rank") - 1).alias("o"), "below")
    kind = pc.select("kind").schema["kind"].dataType.simpleString()
    values = place.withColumn("segment", F.floor(F.col("o") / segment)).groupBy("kind", "segment").applyInPandas(
        lambda pdf: pd.DataFrame({"kind": pdf["kind"].iloc[:1], "first": pdf["o"].min(), "vals": [_packed(pdf.sort_values("o")["below"], np.float64)]}),
        f"kind {kind}, first bigint, vals binary")
    picked = pc.filter("picked").join(size, "kind").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / block)))
    picked = picked.groupBy("kind", "block").applyInPandas(
        lambda pdf: pd.DataFrame({"kind": pdf["kind"].iloc[:1], "size": pdf["size"].iloc[:1], "ids": [_packed(pdf["id"])]}), f"kind {kind}, size bigint, ids binary")

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = {}, {}
        for pdf in batches:
            for row in pdf.itertuples():
                ids, values = np.frombuffer(row.ids, np.int64), np.frombuffer(row.vals, np.float64)
                s, seen = sums.setdefault(row.chunk, np.zeros(chunk)), counts.setdefault(row.chunk, np.zeros(chunk, np.int64))
                for at, t in _trials(row.chunk, trials, len(ids), chunk):
                    o = np.fmod(np.fmod(np.fmod(ids * 48271 + t * 104729 + 7, 2147483647) * 69621, 2147483647), row.size) - row.first
                    here = (o >= 0) & (o < len(values))
                    s[at] += np.where(here, values[np.where(here, o, 0)], 0.0).sum(axis=1)
                    seen[at] += here.sum(axis=1)
        for c in sums:
            m = min(chunk, trials - c * chunk)
            yield pd.DataFrame({"t": c * chunk + np.arange(m), "s": sums[c][:m], "n": counts[c][:m]})

    parts = _meetings(spark, -(-n // block) * -(-trials // chunk))
    chunks = F.broadcast(spark.range(-(-trials // chunk)).withColumnRenamed("id", "chunk"))
    met = stored(picked).join(stored(values), "kind").crossJoin(chunks).repartition(parts, "kind", "first", "chunk")
    return met.mapInPandas(drawn, "t bigint, s double, n bigint").groupBy("t").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 0")


def permutation_enrichment(values: DataFrame, trials: int = 20_000, block: int = BLOCK, segment: int = SEGMENT, chunk: int = CHUNK, left: int = LEFT) -> DataFrame:
    """Mean percentile of the picked rows against two nulls of ``trials`` draws each, as one row.

    ``values`` is (id, value, kind, picked). The first null draws as many rows as are picked, without replacement, in the order of a hash; the second
    replaces every picked row by one of its own kind. A p-value is the share of draws that reach the observed mean. Rows travel in packed blocks and meet
    the trials within tasks; percentiles are summed as whole numbers of rows below, so sums do not depend on the order of the blocks.
    """
    v = values.withColumn("all", F.lit(0))
    pc = v.join(value_ranks(v, ["all"], "value"), ["all", "value"]).select(F.col("id").cast("bigint").alias("id"), "kind", "picked", F.col("below").cast("double").alias("below"), "total")
    pc = stored(pc)
    n, of, k, obs = pc.agg(F.count("*"), F.max("total"), F.count_if("picked"), F.avg(F.when(F.col("picked"), F.col("below") / F.col("total")))).first()
    if not k:
        return pc.sparkSession.createDataFrame([(None,) * 4], "n_set bigint, observed double, p_value double, p_same_kind double")
    cut = pc.select("id", "below", F.pmod(F.xxhash64("id"), F.lit(-(-n // block))).alias("block"))
    blocks = stored(cut.groupBy("block").applyInPandas(
        lambda pdf: pd.DataFrame({"block": pdf["block"].iloc[:1], "ids": [_packed(pdf["id"])], "vals": [_packed(pdf["below"], np.float64)]}),
        "block bigint, ids binary, vals binary"))
    reach = lambda m, name: F.avg((F.round(m, 12) >= F.round(F.lit(obs), 12)).cast("double")).alias(name)
    free = _free_null(blocks, k, n, trials, block, chunk, left).agg(reach(F.col("s") / of / k, "p_value"))
    same = _same_null(pc, n, trials, chunk, block, segment).agg(reach(F.col("s") / of / F.col("n"), "p_same_kind"))
    return free.select(F.lit(k).cast("bigint").alias("n_set"), F.lit(obs).alias("observed"), "p_value").withColumn("p_same_kind", same.scalar())


def parity_compare(a: DataFrame, b: DataFrame, tol: float) -> DataFrame:
    """Full outer comparison of (key, value) results with a status per key."""
    j = a.withColumnRenamed("value", "va").join(b.withColumnRenamed("value", "vb"), "key", "full_outer")
    return j.withColumn("status", F.when(F.col("va").isNull(), "missing_left").when(F.col("vb").isNull(), "missing_right")
                        .when(F.abs(F.col("va") - F.col("vb")) <= tol, "ok").otherwise("differs"))


def channel_ablation(pairs: DataFrame, channels: list[str], min_sep: int = 6) -> DataFrame:
    """Median and worst separation-centred correlation of every channel subset."""
    masks = F.explode(F.sequence(F.lit(1), F.lit(2 ** len(channels) - 1))).alias("mask")
    p = pairs.filter(F.col("sep") >= min_sep).select("*", masks)
    score = sum((F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.col(c)).otherwise(0.0) for k, c in enumerate(channels)), F.lit(0.0))
    p = p.withColumns({"score": score, "truth": 1 / F.col("distance")})
    r = centred_pearson(p, ["seq_id", "mask"], "sep", "score", "truth")
    return r.groupBy("mask").agg(F.percentile("pearson", 0.5).alias("median"), F.min("pearson").alias("worst"))
