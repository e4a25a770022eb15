"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, its source's target over its source's size.
The expected copies are prefix-summed within the source in the order (size, id), one offset that depends on
the seed and the source is added, and a document is emitted once per integer boundary its interval crosses.
Going through the sizes in order keeps the words taken within about one largest document of the target.

A null text has size 0 and keeps its place in the order; a null source is a source of its own, after all
others; a null id sorts first. Repeated rows are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain, count

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WORD, stored, task_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 17


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target words of each source: by weight, at most ``most`` times its size, the excess reshared by weight.

    The input has one row per document (source, size). Sorted by cap over weight, the capped sources are a
    prefix; the level of the rest follows from sums over the sources, of which there is one row each.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % n + 1)
    s = (s.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
         .withColumn("ratio", F.col("cap") / F.col("weight")))
    up = every.orderBy("ratio", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onward = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(every)
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # the first source whose cap is over the level it would get; all before it are capped
    s = s.withColumn("at", F.row_number().over(up))
    s = s.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("at", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.when((F.col("ratio") <= F.col("level")) | F.col("level").isNull(), F.col("cap"))
                    .otherwise(F.col("level") * F.col("weight")).alias("target"))


def offset_of(seed: int):
    """A number in [0, 1) that depends on the seed and the source."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank of each row within its source in this partition, whose rows come sorted by source."""
    last, seen = object(), 0
    for batch in batches:
        source = batch.column(1).to_pandas().to_numpy(object)
        if not len(source):
            continue
        missing = np.array([x is None or x != x for x in source])
        text = np.where(missing, "", source).astype(object)
        new = np.ones(len(source), bool)
        new[1:] = (text[1:] != text[:-1]) | (missing[1:] != missing[:-1])
        first = np.flatnonzero(new)
        rank = np.arange(len(source)) - np.repeat(first, np.diff(np.append(first, len(source)))) + 1
        key = (bool(missing[0]), text[0])
        if key == last:
            end = first[1] if len(first) > 1 else len(source)
            rank[:end] += seen
        last, seen = (bool(missing[-1]), text[-1]), int(rank[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, pa.int64())], [*batch.schema.names, "rank"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        share: float = SHARE, most: float = MOST, seed: int = SEED, with_rows: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document, and all its columns in ``row`` if asked for.

    Ranges over (source, size, id) number the documents: each partition counts its own and gets the counts of
    the partitions before it, so a source of any size is spread over as many tasks as its rows need.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"),
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_rows else []))
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_first()]
    ranged = (slim.repartitionByRange(task_count(spark, 2), *order).sortWithinPartitions(*order)
              .withColumn("part", F.spark_partition_id()))
    ranked = stored(ranged.mapInArrow(_number, StructType([*ranged.schema.fields, StructField("rank", LongType())])))
    parts = ranked.groupBy("source", "part").agg(F.max("rank").alias("n"), F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(parts, weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    starts = (parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
              .select(F.col("source").alias("s"), F.col("part").alias("p"), "before", "source_size", "target",
                      copies.alias("each"), offset_of(seed).alias("u")))
    joined = ranked.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    at = F.col("before") + F.col("rank")
    n = F.floor(F.col("each") * at + F.col("u")) - F.floor(F.col("each") * (at - 1) + F.col("u"))
    return (joined.withColumn("copies", n.cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
                    *(["row"] if with_rows else [])))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixture: every row of ``docs``, all columns kept, as often as it is taken; ``copy`` counts from 0.

    Where the documents have a column ``copy``, the count is ``copy_1``, and so on.
    """
    held = {c.lower() for c in docs.columns}
    name = next(n for n in chain(["copy"], (f"copy_{i}" for i in count(1))) if n not in held)
    taken = mix(docs, with_rows=True, **options).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy")).select("row.*", F.col("copy").alias(name))


def mix_sql(weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, docs: str = "documents") -> str:
    """DuckDB twin of :func:`mix`."""
    pick = " ".join(f"WHEN {i} THEN {float(x)}::DOUBLE" for i, x in enumerate(weights))
    return f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS i FROM d GROUP BY source),
s1 AS (SELECT *, CASE (i - 1) % {len(weights)} {pick} END AS weight, {most}::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS ratio FROM s1),
s3 AS (SELECT *, ({share}::DOUBLE * (SELECT sum(source_size) FROM s2) - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST
 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM s2),
s4 AS (SELECT *, (SELECT own FROM s3 WHERE ratio >= own ORDER BY ratio, source NULLS LAST LIMIT 1) AS level FROM s3),
s AS (SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN cap ELSE level * weight END AS target,
 ('0x' || substr(md5('{seed}:' || coalesce('s' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM s4),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS place FROM d),
j AS (SELECT r.doc_id, r.source, r.size, r.place, s.source_size, s.target, s.u,
 CASE WHEN source_size > 0 THEN target / source_size ELSE 0::DOUBLE END AS per_doc
 FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, ((floor(per_doc * place + u) - floor(per_doc * (place - 1) + u))::BIGINT * size)::BIGINT AS taken FROM j"""
