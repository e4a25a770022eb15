"""Exact ranking and top-n per key that do not need a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_n(df: DataFrame, keys: list[str], score: str, n, ties: list[str], step: float = 0.25,
          rank: str = "rank") -> DataFrame:
    """The n best rows per key, ranked 1..n by score (descending) then ties.

    A histogram of coarse score buckets, built with a map-side combine, gives the
    lowest bucket that can still hold a winner. Only rows at or above it are
    sorted, so the sort sees about n rows per key however large the key is.
    """
    n = F.col(n) if isinstance(n, str) else F.lit(n)
    b = F.floor(F.col(score) / step)
    hist = df.groupBy(*keys, n.alias("_n"), b.alias("_b")).agg(F.count("*").alias("_c"))
    seen = F.sum("_c").over(W.partitionBy(*keys).orderBy(F.desc("_b"))) - F.col("_c")
    floor_ = (hist.withColumn("_seen", seen).filter(F.col("_seen") < F.col("_n"))
              .groupBy(*keys).agg(F.min("_b").alias("_min"), F.max("_n").alias("_n")))
    keep = df.join(floor_, keys).filter(b >= F.col("_min"))
    order = [F.desc(score), *[F.asc(t) for t in ties]]
    return (keep.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .filter(F.col(rank) <= F.col("_n")).drop("_min", "_n"))


#: Rows a bucket of a large key holds, about; keys with fewer rows are one bucket. Cuts come from one row in ``SAMPLE``.
BUCKET, SAMPLE, FINEST = 65_536, 64, 1024


def _bucketed(df: DataFrame, keys: list[str], value: str, by: list[str], bucket: int = BUCKET, sample: int = SAMPLE) -> DataFrame:
    """Add ``_b``, the number of the key's cuts below the value.

    A key gets as many buckets as its rows ask for, ``FINEST`` at most. Where the cuts lie does not matter to an exact rank, so they are quantiles of
    a sample by the hash of ``by``.
    """
    some = df.filter(F.pmod(F.xxhash64(*keys, value, *by), F.lit(sample)) == 0)
    cuts = some.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(value, [k / FINEST for k in range(1, FINEST)], F.lit(4 * FINEST)).alias("_q"))
    n = F.least(F.ceil(F.col("_n") * sample / bucket), F.lit(FINEST)).cast("int")
    cuts = cuts.filter(n > 1).select(*keys, F.array_distinct(F.transform(
        F.sequence(F.lit(1), n - 1), lambda i: F.element_at("_q", F.floor(i * FINEST / n).cast("int")))).alias("_cuts"))
    below = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))
    return df.join(cuts, keys, "left").withColumn("_b", F.greatest(below, F.lit(0))).drop("_cuts")


def rank_within(df: DataFrame, keys: list[str], score: str, ties: list[str], rank: str = "rank", bucket: int = BUCKET,
                sample: int = SAMPLE) -> DataFrame:
    """Row number per key by score (descending) then ties, exact.

    A large key is cut at quantiles of its own scores; rows are numbered
    inside a bucket and shifted by the size of the better buckets.
    """
    cut = _bucketed(df, keys, score, ties, bucket, sample)
    sizes = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    above = (F.sum("_c").over(W.partitionBy(*keys).orderBy(F.desc("_b"))) - F.col("_c")).alias("_above")
    sizes = sizes.select(*keys, "_b", above)
    order = [F.desc(score), *[F.asc(t) for t in ties]]
    local = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order))
    return (cut.withColumn("_local", local).join(sizes, [*keys, "_b"])
            .withColumn(rank, (F.col("_local") + F.col("_above")).cast("bigint")).drop("_b", "_local", "_above"))


def value_ranks(df: DataFrame, keys: list[str], value: str, bucket: int = BUCKET, sample: int = SAMPLE) -> DataFrame:
    """Per distinct value of a key: rows strictly below it, rows equal to it, key total.

    Equal values are counted first, so ties never travel as rows.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("same"))
    cut = _bucketed(counts, keys, value, [], bucket, sample)
    sizes = cut.groupBy(*keys, "_b").agg(F.sum("same").alias("_c"))
    by_key = W.partitionBy(*keys)
    sizes = sizes.select(
        *keys, "_b", (F.sum("_c").over(by_key.orderBy("_b")) - F.col("_c")).alias("_below"),
        F.sum("_c").over(by_key).alias("total"))
    running = F.sum("same").over(W.partitionBy(*keys, "_b").orderBy(value)) - F.col("same")
    return (cut.withColumn("_run", running).join(sizes, [*keys, "_b"])
            .select(*keys, value, (F.col("_run") + F.col("_below")).alias("below"), "same", "total"))


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple], accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles per key, one row per key; ``wanted`` maps a name to (column, share). Nulls do not count.

    Two passes, neither of which holds a key's values. A sketch brackets each rank between two values, whatever the distribution. Then every
    row is below, inside or above the bracket; below and above are counted with a map-side combine, and only the values inside (a share of about
    ``6 / accuracy`` of the rows, equal ones as one) are put in order. A key absent from ``df``, or with nulls only, has no row or a null.
    """
    share = 3 / accuracy
    named = {f"_v{i}": (c if not isinstance(c, str) else F.col(c)).cast("double") for i, (c, _) in enumerate(wanted.values())}
    # null keys are keys as well
    same = {k: f"_k{i}" for i, k in enumerate(keys)}
    rows = df.select(*keys, *[c.alias(n) for n, c in named.items()])
    cuts = rows.groupBy(*[F.col(k).alias(n) for k, n in same.items()]).agg(*[
        F.percentile_approx(f"_v{i}", [max(p - share, 0.0), min(p + share, 1.0)], F.lit(accuracy)).alias(f"_c{i}") for i, (_, p) in enumerate(wanted.values())])
    if keys:
        tagged = rows.join(cuts, [F.col(k).eqNullSafe(F.col(n)) for k, n in same.items()])
    else:
        tagged = rows.withColumn("_all", cuts.select(F.struct("*")).scalar()).select("*", "_all.*")
    one = lambda i: F.struct(F.lit(i).alias("q"), F.when(F.col(f"_v{i}") < F.col(f"_c{i}")[0], -1).when(F.col(f"_v{i}") > F.col(f"_c{i}")[1], 1).otherwise(0).alias("side"),
                             F.col(f"_v{i}").alias("v"))
    long = tagged.select(*keys, F.explode(F.array(*[one(i) for i in range(len(wanted))])).alias("r")).select(*keys, "r.*").filter("v IS NOT NULL")
    runs = long.groupBy(*keys, "q", "side", F.when(F.col("side") == 0, F.col("v")).alias("inside")).agg(
        F.count("*").alias("c"), F.when(F.col("side") < 0, F.max("v")).otherwise(F.min("v")).alias("v"))
    by = W.partitionBy(*keys, "q")
    p = F.element_at(F.array(*[F.lit(float(p)) for _, p in wanted.values()]), F.col("q") + 1)
    runs = runs.withColumns({"end": F.sum("c").over(by.orderBy("side", "inside")), "at": p * (F.sum("c").over(by) - 1)})

    def value_at(rank):
        hit = (F.col("end") - F.col("c") <= rank) & (rank < F.col("end"))
        # of the values beside the bracket only the nearest is known; the sketch's error bound says that no other is asked for
        known = (F.col("side") == 0) | ((F.col("side") < 0) & (rank == F.col("end") - 1)) | ((F.col("side") > 0) & (rank == F.col("end") - F.col("c")))
        return F.max(F.when(hit & known, F.col("v")).when(hit, F.raise_error(F.lit("a rank is outside its bracket")).cast("double")))

    low, high = F.floor("at"), F.ceil("at")
    both = runs.groupBy(*keys, "q").agg(value_at(low).alias("a"), value_at(high).alias("b"), F.max("at").alias("at"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    return both.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == i, value)).alias(name) for i, name in enumerate(wanted)])


def with_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple], *aggregates) -> DataFrame:
    """Aggregates per key beside ``quantiles``."""
    a = df.groupBy(*keys).agg(*aggregates)
    q = quantiles(df, keys, wanted)
    if not keys:
        return a.withColumn("_q", q.select(F.struct("*")).scalar()).select(*a.columns, "_q.*")
    q = q.withColumnsRenamed({k: f"_q{i}" for i, k in enumerate(keys)})
    return a.join(q, [F.col(k).eqNullSafe(F.col(f"_q{i}")) for i, k in enumerate(keys)], "left").drop(*[f"_q{i}" for i in range(len(keys))])


def percentile_below(df: DataFrame, background: DataFrame, keys: list[str], value: str,
                     name: str = "percentile") -> DataFrame:
    """100 x share of the key's background strictly below each row's value.

    Background and rows are merged so that values absent from the background
    are ranked too; the rows weigh nothing.
    """
    tagged = (background.select(*keys, F.col(value), F.lit(1).alias("_w"))
              .unionByName(df.select(*keys, F.col(value), F.lit(0).alias("_w"))))
    counts = tagged.groupBy(*keys, value).agg(F.sum("_w").alias("same"))
    cut = _bucketed(counts, keys, value, [])
    sizes = cut.groupBy(*keys, "_b").agg(F.sum("same").alias("_c"))
    by_key = W.partitionBy(*keys)
    sizes = sizes.select(*keys, "_b",
                         (F.sum("_c").over(by_key.orderBy("_b")) - F.col("_c")).alias("_below"),
                         F.sum("_c").over(by_key).alias("_total"))
    running = F.sum("same").over(W.partitionBy(*keys, "_b").orderBy(value)) - F.col("same")
    ranks = (cut.withColumn("_run", running).join(sizes, [*keys, "_b"]).select(
        *keys, value, (100.0 * (F.col("_run") + F.col("_below")) / F.col("_total")).alias(name)))
    return df.join(ranks, [*keys, value], "left")
