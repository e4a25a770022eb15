"""Exact top-k by integer inner product, pruned by multi-resolution segment statistics.

A vector is cut into segments; of each the mean and the deviation are kept, for a coarse cut and for finer ones.
For a query q and a vector c the segment statistics give the lower bound of the squared distance
``sum len * ((mq - mc)^2 + (sq - sc)^2)``, and with the two norms the upper bound of the inner product
``sum len * (mq * mc + sq * sc)``. Coarse to fine, pairs whose bound is under the query's k-th best score so far
are left out; the survivors are scored exactly in integers.

Queries are a stated set (ids divisible by ``every``); candidates are all vectors. Both are cut into groups by a
hash of the id, of bounded size, and every (candidate group, query group) cell is one task: candidates are copied once per
query group, queries once per candidate group. Each cell keeps k rows per query, which a window merges.

Vectors that are null, or hold a null or non-finite component, take no part. Only vectors of one length meet.
A vector's own row is known by its id: rows with the same id and components count once, and rows that share an id do not
find each other. A null id takes no part. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEVELS = (4, 8, 16)
CANDIDATES, QUERIES = 16384, 4096


def _segments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, means and deviations of about ``n`` equal segments of each row."""
    edges = np.unique(np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int))
    size = np.diff(edges).astype(float)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
    return size, mean, np.sqrt(np.maximum(square - mean * mean, 0))


def _statistics(x: np.ndarray, n: int) -> np.ndarray:
    """Rows whose plain inner product is the upper bound."""
    size, mean, dev = _segments(x, n)
    return np.concatenate([mean * np.sqrt(size), dev * np.sqrt(size)], axis=1)


def cell_topk(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, levels=LEVELS, block: int = 256):
    """(query id, candidate id, score) of the k best candidates of every query."""
    out = []
    if not len(qid) or not len(cid):
        return out
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    qf, cf = q.astype(float), c.astype(float)
    coarse = [(_statistics(qf, n), _statistics(cf, n)) for n in levels]
    slack = 1e-9 * (1 + np.sqrt((qf * qf).sum(1)) * np.sqrt((cf * cf).sum(1).max()))
    for a in range(0, len(qid), block):
        b = min(len(qid), a + block)
        bound = coarse[0][0][a:b] @ coarse[0][1].T
        for i in range(a, b):
            row = bound[i - a]
            own = cid == qid[i]
            row[own] = -np.inf
            seeds = min(4 * k, len(cid))
            first = np.argpartition(-row, seeds - 1)[:seeds]
            first = first[~own[first]]
            scores = c[first] @ q[i]
            floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
            left = np.flatnonzero((row + slack[i] >= floor) & ~own)
            for mine, theirs in coarse[1:]:
                left = left[theirs[left] @ mine[i] + slack[i] >= floor]
            exact = c[left] @ q[i]
            best = np.lexsort((cid[left], -exact))[:k]
            out += zip([qid[i]] * len(best), cid[left[best]], exact[best], strict=True)
    return out


def _search(k: int, levels):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def side(t: pa.Table):
            ids = t["id"].to_numpy()
            flat = t["v"].combine_chunks()
            values = np.asarray(flat.flatten(), dtype=np.int64)
            return ids, values.reshape(len(ids), -1) if len(ids) else values.reshape(0, 0)

        qid, q = side(left)
        cid, c = side(right)
        found = cell_topk(qid, q, cid, c, k, levels)
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(np.asarray(x, np.int64)) for x in columns], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
           levels=LEVELS, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each query.

    Components become ``floor(scale * x)``. ``candidates`` and ``queries`` bound a cell's rows.
    """
    parts = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
            .where(F.coalesce(fine, F.lit(False)) & (F.size(vector_col) > 0))
            .select(F.col(id_col).cast("long").alias("id"), F.transform(parts, lambda x: F.floor(F.lit(scale) * x)).alias("v")).distinct())
    rows = stored(rows.withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("id", "v")))
    total, asked = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    g, h = max(1, -(-total // candidates)), max(1, -(-asked // queries))
    left = (rows.where(F.col("id") % every == 0).withColumn("qg", F.pmod("h", F.lit(h)))
            .withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(g - 1)))))
    right = (rows.withColumn("cg", F.pmod(F.shiftright("h", 20), F.lit(g)))
             .withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))))
    keys = [F.col("dim"), F.col("qg").cast("long").alias("qg"), F.col("cg").cast("long").alias("cg"), "id", "v"]
    best = (left.select(*keys).groupBy("dim", "qg", "cg").cogroup(right.select(*keys).groupBy("dim", "qg", "cg"))
            .applyInArrow(_search(k, levels), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SEARCH_SQL = """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
e AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x, len(v) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM e q JOIN e c ON q.i = c.i AND q.n = c.n
 WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5"""
