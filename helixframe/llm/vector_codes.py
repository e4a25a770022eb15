"""Product codes of integer vectors, learned and assigned through memoised grid cells.

A vector of integers ``floor(scale * x)`` is cut into equal consecutive parts, and each part is replaced by the number of the nearest
entry of its position's codebook. The space of a part is a grid of cells ``cell`` wide. For a cell, the least and the greatest squared distance
from an entry to any point of the cell are known; an entry whose least is above the smallest greatest is dominated across the whole
cell and never nearest there. A task hashes the cell of each part, remembers the entries that are left, and evaluates only those exactly.

Codebooks start as the parts of the smallest ids and are refined in rounds: assign, sum per entry, replace by the floor of the mean. Only
the sums, one per entry and component, leave the tasks; the codebooks (``entries`` x length numbers) go through the driver.

Rows with a null vector, or null or non-finite components, take no part. The first kept vector (smallest id, nulls last, then smallest
vector) sets the length; vectors of another length, and all if the length is no multiple of the number of parts, take no part.
Repeated rows each count; rows that share an id are ordered by their vectors. With fewer rows than ``entries`` the codebooks are smaller; an empty table
gives an empty result. Ties go to the lower index. A component beyond ``LARGEST`` would not fit the exact 64-bit sums and raises an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LARGEST = 1 << 25
CELL = 32
#: Cells a task remembers per part before it starts afresh.
REMEMBER = 1 << 16
BLOCK = 2048


def undominated(cells: np.ndarray, entries: np.ndarray, cell: int) -> np.ndarray:
    """Mask (cell, entry) of the entries that can be nearest to some integer point of each cell.

    Distances to the cells' centres leave out most entries; the least and the greatest distance over the box decide on the others.
    """
    low = cells * cell
    centre, double = (2 * low + cell - 1).astype(float), 2.0 * entries
    # in half units, so whole numbers
    away = np.sqrt(np.maximum((centre * centre).sum(1)[:, None] - 2 * centre @ double.T + (double * double).sum(1), 0))
    radius = (cell - 1) * math.sqrt(cells.shape[1])
    row, entry = np.nonzero(away <= (away.min(axis=1) + 2 * radius)[:, None] * (1 + 1e-9) + 1e-3)
    below = low[row] - entries[entry]
    above = -below - (cell - 1)
    least = np.maximum(np.maximum(below, above), 0)
    greatest = np.maximum(np.abs(below), np.abs(above))
    least, greatest = np.einsum("ij,ij->i", least, least), np.einsum("ij,ij->i", greatest, greatest)
    smallest = np.minimum.reduceat(greatest, np.searchsorted(row, np.arange(len(cells)))) if len(cells) else greatest
    out = np.zeros((len(cells), len(entries)), bool)
    keep = least <= smallest[row]
    out[row[keep], entry[keep]] = True
    return out


class Codebook:
    """Nearest entries of one part position, through a memo of grid cells."""

    def __init__(self, entries: np.ndarray, cell: int = CELL, remember: int = REMEMBER):
        self.entries, self.cell, self.remember = entries, cell, remember
        self.seen: dict[bytes, int] = {}
        self.left = np.zeros((0, len(entries)), bool)

    def _cells(self, cells: np.ndarray) -> np.ndarray:
        """Row in ``left`` of each cell, learning the new ones."""
        if len(self.seen) > self.remember:
            self.seen, self.left = {}, self.left[:0]
        names = [c.tobytes() for c in cells]
        new = [i for i, n in enumerate(names) if n not in self.seen]
        block = max(1, (1 << 20) // self.entries.size)
        masks = [undominated(cells[new[i:i + block]], self.entries, self.cell) for i in range(0, len(new), block)]
        for i in new:
            self.seen[names[i]] = len(self.seen)
        self.left = np.concatenate([self.left, *masks])
        return np.array([self.seen[n] for n in names], np.int64)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each point, ties to the lower index."""
        cells, inverse = np.unique(np.floor_divide(points, self.cell), axis=0, return_inverse=True)
        point, entry = np.nonzero(self.left_of(cells)[inverse.ravel()])
        distance = np.empty(len(point), np.int64)
        step = max(1, (1 << 21) // max(1, points.shape[1]))
        for i in range(0, len(point), step):
            gap = points[point[i:i + step]] - self.entries[entry[i:i + step]]
            distance[i:i + step] = np.einsum("ij,ij->i", gap, gap)
        first = np.searchsorted(point, np.arange(len(points)))
        best = np.minimum.reduceat(distance, first)
        tied = np.where(distance == best[point], entry, len(self.entries))
        return np.minimum.reduceat(tied, first), best

    def left_of(self, cells: np.ndarray) -> np.ndarray:
        rows = self._cells(cells)
        return self.left[rows]


def _points(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def _blocks(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], cell: int):
    """(rows, their points, indexes and distances by part) of blocks of rows."""
    tools = [Codebook(b, cell) for b in books]
    size = books[0].shape[1]
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            part = batch.slice(i, BLOCK)
            points = _points(part.column(part.schema.get_field_index("v")), size * len(books))
            yield part, points, [t.nearest(points[:, p * size:(p + 1) * size]) for p, t in enumerate(tools)]


def _sums(books: list[np.ndarray], cell: int):
    """(part, entry, place, total): component sums of the points of each entry of a task; place -1 counts them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = books[0].shape[1]
        total = np.zeros((len(books), len(books[0]), size + 1), np.int64)
        for _, points, found in _blocks(batches, books, cell):
            for p, (index, _) in enumerate(found):
                np.add.at(total[p, :, 0], index, 1)
                np.add.at(total[p, :, 1:], index, points[:, p * size:(p + 1) * size])
        part, entry = np.nonzero(total[:, :, 0])
        place = np.tile(np.arange(-1, size), len(part))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, size + 1).astype(np.int32)), pa.array(np.repeat(entry, size + 1).astype(np.int32)),
                                          pa.array(place.astype(np.int32)), pa.array(total[part, entry].ravel())], ["part", "entry", "place", "total"])

    return run


def _encode(books: list[np.ndarray], cell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, found in _blocks(batches, books, cell):
            code = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            error = np.sum([distance for _, distance in found], axis=0)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())],
                                             [*rows.schema.names[:2], "code", "error"])

    return run


def prepared(vectors: DataFrame, parts: int, scale: float, id_col: str, vector_col: str, label_col: str) -> DataFrame | None:
    """(id, label, v) of the rows that take part, stored; None if there are none."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: F.when(F.abs(F.floor(F.lit(scale) * c)) <= LARGEST, F.floor(F.lit(scale) * c).cast("int")).otherwise(
        F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("int"))
    rows = stored(vectors.where(F.col(vector_col).isNotNull()).where(F.coalesce(fine, F.lit(False)) & (F.size(vector_col) > 0))
                  .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(x, whole).alias("v")))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    if first is None or first["n"] % parts:
        return None
    return rows.where(F.size("v") == first["n"])


def learn(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, cell: int = CELL) -> list[np.ndarray]:
    """The codebook of each part position, from the rows of ``prepared``."""
    seeds = np.array([r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()], np.int64)
    books = [b.copy() for b in np.split(seeds, parts, axis=1)]
    for _ in range(rounds):
        sums = (rows.select("v").mapInArrow(_sums(books, cell), "part int, entry int, place int, total long")
                .groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect())
        count = {(r["part"], r["entry"]): r["total"] for r in sums if r["place"] < 0}
        for r in sums:
            if r["place"] >= 0:
                books[r["part"]][r["entry"], r["place"]] = r["total"] // count[r["part"], r["entry"]]
    return books


def books_hash(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, cell: int = CELL, id_col: str = "vec_id",
           vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every vector that takes part, and the codebooks.

    ``entries`` is at most 256: a code has two hex digits a part. ``cell`` is a grid cell's width in scaled units: narrow cells leave fewer
    entries to evaluate, wide ones are met again more often.
    """
    rows = prepared(vectors, parts, scale, id_col, vector_col, label_col)
    kind = vectors.schema[label_col].dataType.simpleString()
    if rows is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), []
    books = learn(rows, parts, entries, rounds, cell)
    return rows.mapInArrow(_encode(books, cell), f"vec_id long, label {kind}, code string, error long"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """Add ``label_error``, the errors summed over equal labels; null labels are equal."""
    codes = stored(codes)
    sums = codes.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, codes["label"].eqNullSafe(F.col("own"))).drop("own")


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The codes in SQL, one pair of common tables a round."""
    assign = ("SELECT rid, p, w, (s).d AS d, (s).e AS e FROM (SELECT rid, v.p, any_value(v.w) AS w, "
              "min({{'d': list_inner_product(v.w, v.w) - 2 * list_inner_product(v.w, b.c) + list_inner_product(b.c, b.c), 'e': b.e}}) AS s "
              "FROM v JOIN b{r} b USING (p) GROUP BY rid, v.p)")
    out = [f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS rid, * FROM (SELECT vec_id, label,
 list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0))""",
           f"""v AS MATERIALIZED (SELECT rid, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS w FROM k, range({parts}) r(p))""",
           f"b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, w AS c FROM v WHERE rid <= {entries})"]
    for r in range(rounds):
        out += [f"a{r} AS MATERIALIZED ({assign.format(r=r)})",
                f"""m{r} AS MATERIALIZED (SELECT p, e, list(((s - ((s % n) + n) % n) / n)::DOUBLE ORDER BY i) AS c FROM (SELECT p, e, i, sum(y)::HUGEINT AS s, count(*)::HUGEINT AS n
 FROM (SELECT p, e, unnest(w) AS y, unnest(range(len(w))) AS i FROM a{r}) GROUP BY p, e, i) GROUP BY p, e)""",
                f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, e))"]
    return f"""WITH {", ".join(out)}, f AS MATERIALIZED ({assign.format(r=rounds)}),
t AS (SELECT rid, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM f GROUP BY rid),
h AS (SELECT sha256(string_agg(y, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c)::BIGINT::VARCHAR AS y, unnest(range(len(c))) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN t USING (rid), h"""
