"""MinHash near-duplicates by an inverted join of signature coordinates.

A document's set are its distinct 5-word shingles (lower-cased A-Z); with fewer words, the whole sequence is the one
shingle. Documents are linked when 100 * intersection >= 85 * union of their sets. The steps:

1. Equal sets are one node, known by the smallest id.
2. A node has ``coordinates`` minima. It is posted under its (coordinate, value) pairs, the rarest first: two nodes that share
   ``least`` pairs share one among the first ``coordinates - least + 1`` of both in the order of frequency (prefix). Pairs
   that occur once are never posted, so most nodes without a near copy are posted nowhere.
3. In every posting list collisions are counted; members with ``least`` or more are joined. A member reached is not compared
   again (skip merging), so a list of many alike costs little more than its length. A long list is dealt to cells, each
   with two of its parts.
4. Joined members form candidate groups. Each group's full sets are compared in cells of bounded size, each with two parts
   of a large group, and links by the exact rule remain. Only edges of a spanning forest are written, never all pairs.
5. Components of the links carry the smallest id.

For a pair at the threshold, 17 or fewer of 32 coordinates agree with probability below 1e-4; such a pair is lost only if
no other link joins the two. Null and empty texts have no set and are linked with nothing. Rows that share an id are one
document to links. A null id takes no part: its component and its mark are null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stored, task_count
from .graph import components, spanning
from .textcore import LOWER, U, doc_shingles, flat, mix, slices, word_bounds, word_hashes

SHINGLE, COORDINATES, LEAST = 5, 32, 18
PERCENT = 85
#: Members of a cell of a posting list, and shingles of a part of a candidate group.
LIST, PART = 4096, 1_000_000


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return x[:n], x[n:] | U(1)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, offsets) of the sets of runs of texts."""
    data, offsets = flat(texts)
    for a, b in slices(offsets):
        part = LOWER[data[offsets[a]:offsets[b]]]
        starts, ends, first = word_bounds(part, offsets[a:b + 1] - offsets[a])
        yield a, b, *doc_shingles(word_hashes(part, starts, ends), first, k)


def _signatures(k: int, coordinates: int):
    """Rows (doc_id, n, k1, k2, e): set size, set key and the 64-bit names of the (coordinate, value) pairs."""
    xor, odd = _salts(coordinates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n, keys, names = np.zeros(m, np.int64), np.zeros((m, 2), np.int64), np.zeros((m, coordinates), np.int64)
            for a, _, hashes, offsets in shingle_sets(batch.column(1), k):
                size = np.diff(offsets)
                full = np.flatnonzero(size)
                n[a:a + len(size)] = size
                if not len(full):
                    continue
                at = offsets[full]
                keys[a + full, 0] = np.add.reduceat(hashes, at).view(np.int64)
                keys[a + full, 1] = np.add.reduceat(mix(hashes ^ U(0x5851F42D4C957F2D)), at).view(np.int64)
                for j in range(coordinates):
                    low = np.minimum.reduceat((hashes ^ xor[j]) * odd[j], at)
                    names[a + full, j] = mix(low + U(j)).view(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(names.reshape(-1)), coordinates).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], ["doc_id", "n", "k1", "k2", "e"])

    return run


def _matched(least: int, percent: int):
    """Spanning edges of the nodes that agree in ``least`` coordinates, per cell; the rows come sorted by cell."""
    def cell(node: np.ndarray, n: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
        def near(i, left):
            fit = 100 * np.minimum(n[i], n[left]) >= percent * np.maximum(n[i], n[left])
            fit[fit] = (names[left[fit]] == names[i]).sum(axis=1) >= least
            return fit

        edges = spanning(near, np.argsort(node, kind="stable"))
        return [(int(node[a]), int(node[b])) for a, b in edges if node[a] != node[b]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def held(parts):
            node, n = (np.concatenate([p.column(j).to_numpy() for p in parts]) for j in (2, 3))
            names = np.concatenate([p.column(4).flatten().to_numpy() for p in parts]).reshape(len(node), -1)
            return cell(node, n, names)

        for edges in _by_cell(batches, held):
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _by_cell(batches: Iterator[pa.RecordBatch], make) -> Iterator[list]:
    """``make`` of the slices of each run of equal first two columns, runs across batches included; joined in lists of many."""
    key, parts, out = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if (x[a], y[a]) != key:
                if parts:
                    out += make(parts)
                key, parts = (x[a], y[a]), []
            parts.append(batch.slice(a, b - a))
        if len(out) > 10_000:
            yield out
            out = []
    if parts:
        out += make(parts)
    yield out


def _linked(k: int, percent: int):
    """Spanning edges of the exact links of each cell of a candidate group."""
    def held(parts) -> list[tuple[int, int]]:
        node, sets = [], []
        for p in parts:
            node.append(p.column(2).to_numpy())
            for _, _, hashes, offsets in shingle_sets(p.column(3), k):
                sets += np.split(hashes, offsets[1:-1])
        node = np.concatenate(node)
        size = np.array([len(s) for s in sets])
        _, term = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(term, kind="stable")
        posting, begin = owner[order], np.concatenate(([0], np.cumsum(np.bincount(term))))
        first = np.concatenate(([0], np.cumsum(size)))

        def near(i, left):
            own = term[first[i]:first[i + 1]]
            length = begin[own + 1] - begin[own]
            flat_at = np.repeat(begin[own] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            shared = np.bincount(posting[flat_at], minlength=len(sets))[left]
            return 100 * shared >= percent * (size[i] + size[left] - shared)

        return [(int(node[a]), int(node[b])) for a, b in spanning(near, np.argsort(node, kind="stable")) if node[a] != node[b]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges in _by_cell(batches, held):
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _cells(parts, own):
    """Cells of a member whose group is dealt to ``parts`` parts: one with each part, itself included."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda x: (F.least(x, own) * parts + F.greatest(x, own)).cast("long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, least: int = LEAST,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    spark = docs.sparkSession
    tasks = task_count(spark, 2)
    rows = rows_of(docs, id_col, text_col)
    signed = stored(rows.mapInArrow(_signatures(shingle, coordinates), "doc_id long, n long, k1 long, k2 long, e array<long>"))
    nodes = stored(signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("k1", "k2", "n")
                   .agg(F.min("doc_id").alias("node"), F.any_value("e").alias("e")))

    posted = nodes.select("node", "k1", F.explode("e").alias("name"))
    counted = stored(posted.groupBy("name").agg(F.count("*").alias("c")).where("c > 1"))
    shared = posted.join(counted, "name").groupBy("node", "k1").agg(F.array_sort(F.collect_list(F.struct("c", "name"))).alias("s"))
    # pairs that occur once come first in the order of frequency and take up their share of the prefix
    open_slots = F.size("s") - (least - 1)
    prefix = (shared.where(open_slots > 0).select("node", "k1", F.explode(F.slice("s", F.lit(1), open_slots)).alias("s"))
              .select("node", "k1", "s.c", "s.name"))
    parts = F.ceil(F.col("c") / LIST).cast("int")
    members = (prefix.join(nodes.select("node", "k1", "n", "e"), ["node", "k1"])
               .select("name", F.explode(_cells(parts, F.pmod(F.xxhash64("node", "k1"), parts).cast("int"))).alias("cell"), "node", "n", "e"))
    matched = (members.repartition(2 * tasks, "name", "cell").sortWithinPartitions("name", "cell")
               .mapInArrow(_matched(least, percent), "a long, b long"))
    groups = stored(components(matched))

    sized = stored(groups.join(nodes.select("node", "k1", "n"), "node").select("label", "node", "n", "k1"))
    total = stored(sized.groupBy("label").agg(F.sum("n").alias("total"))).withColumn("parts", F.ceil(F.col("total") / PART).cast("int"))
    cells = sized.join(total, "label").select("label", F.explode(_cells(F.col("parts"), F.pmod(F.xxhash64("node", "k1"), F.col("parts")).cast("int")))
                                              .alias("cell"), "node", "n")
    texts = rows.select(F.col("doc_id").alias("node"), "text").where(F.col("node").isNotNull())
    compared = (cells.drop("n").distinct().join(texts, "node").select("label", "cell", "node", "text")
                .repartition(2 * tasks, "label", "cell").sortWithinPartitions("label", "cell").mapInArrow(_linked(shingle, percent), "a long, b long"))
    links = components(compared)

    known = stored(nodes.select("k1", "k2", "node").join(links, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("component")))
    key = signed.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2")
    out = key.join(known, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
