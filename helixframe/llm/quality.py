"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from a text's bytes, words and lines alone. Trees of fixed depth are grown on binned values with
the logistic loss and flattened into arrays (feature, threshold, leaf), which a batch walks level by level in numpy.

The fit reads at most ``SAMPLE`` labelled rows, those with the smallest hash of the id, so it does not depend on the
order of the input; ids whose crc32 of the decimal text is a multiple of ``FOLDS`` are held out. Scoring reads every
whole text. Null and empty texts have all statistics 0 and get a score like any other. A null id counts as held out.
Without labels of both kinds the score is the smoothed share of label 1. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .textcore import flat, slices, word_bounds, word_hashes

SAMPLE = 20_000
FOLDS = 5
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.15, 1.0, 5
CUT = 0.3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "line": (10,),
    "stop": b".,;:", "bang": b"!?", "bar": b"|", "quote": b"'\"()-", "mark": b"#$%&*@^~=<>{}[]\\/_+`", "wide": range(128, 256),
}
NAMES = [*_CLASSES, "bytes", "words", "word_bytes", "odd_end", "same_word", "new_word", "lines", "new_line", "line_words"]


def _lut(values) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(values)] = 1
    return out


_LUTS = [_lut(v) for v in _CLASSES.values()]
_PLAIN_END = (_lut(range(48, 58)) | _lut(range(65, 91)) | _lut(range(97, 123)) | _lut(range(128, 256)) | _lut(b".,;:)'\"")).astype(bool)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run ``offsets[i]:offsets[i+1]``; empty runs give 0."""
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], dtype=np.int64)
    return out


def _distinct(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct keys of each run."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(first) - 1).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of float statistics per text."""
    data, offsets = flat(column)
    out = np.zeros((len(offsets) - 1, len(NAMES)), np.float32)
    for a, b in slices(offsets):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        size = np.maximum(np.diff(at), 1)
        starts, ends, first = word_bounds(part, at)
        words = np.diff(first)
        hashes = word_hashes(part, starts, ends)
        same = np.zeros(len(hashes), np.uint8)
        same[1:] = hashes[1:] == hashes[:-1]
        same[first[:-1][words > 0]] = 0
        odd = (~_PLAIN_END[part[ends - 1]]).astype(np.uint8) if len(ends) else np.zeros(0, np.uint8)
        # a line is the words between two line feeds: its hash is the sum of position-weighted word hashes
        breaks = np.concatenate(([0], np.cumsum(part == 10)))
        line = breaks[starts] if len(starts) else np.zeros(0, np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = line[1:] != line[:-1]
        new[first[:-1][words > 0]] = True
        heads = np.flatnonzero(new)
        within = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
        keys = np.add.reduceat(hashes * (within.astype(np.uint64) * np.uint64(2) + np.uint64(1)), heads) if len(heads) else hashes
        line_first = np.searchsorted(heads, first)
        lines = np.diff(line_first)
        n, m = np.maximum(words, 1), np.maximum(lines, 1)
        rows = [_sums(lut[part], at) / size for lut in _LUTS]
        rows += [np.log1p(np.diff(at)), np.log1p(words), _sums(ends - starts, first) / n, _sums(odd, first) / n, _sums(same, first) / n,
                 _distinct(hashes, first) / n, np.log1p(lines), _distinct(keys, line_first) / m, np.log1p(words / m)]
        out[a:b] = np.stack(rows, axis=1)
    return out


class Trees:
    """Flattened trees: node i has children 2i+1 and 2i+2; leaves are the last level."""

    def __init__(self, bias: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.bias, self.feature, self.threshold, self.leaf = bias, feature, threshold, leaf

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2,
        least: int = LEAST) -> Trees:
    """Boosted trees on binned columns; a node that cannot be split sends all rows to one side."""
    n, inner, leaves = len(x), 2 ** depth - 1, 2 ** depth
    prior = (y.sum() + 1) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    if n == 0 or y.min() == y.max():
        return Trees(bias, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    total = np.full(n, bias)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, start = 2 ** level, 2 ** level - 1
            best = np.full(width, 1e-6)
            at = np.full((width, 2), -1)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key, k = (node - start) * (len(e) + 1) + binned[:, j], width * (len(e) + 1)
                sums = [np.cumsum(np.bincount(key, w, k).reshape(width, -1), axis=1) for w in (g, h, None)]
                (gl, gt), (hl, ht), (cl, ct) = [(s[:, :-1], s[:, -1:]) for s in sums]
                gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
                gain[(cl < least) | (ct - cl < least)] = -np.inf
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                at[better] = np.stack([np.full(width, j), top], axis=1)[better]
            for i in np.flatnonzero(at[:, 0] >= 0):
                feature[start + i], threshold[start + i] = at[i, 0], edges[at[i, 0]][at[i, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        own = node - inner
        value = -rate * np.bincount(own, g, leaves) / (np.bincount(own, h, leaves) + l2)
        total += value[own]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(bias, np.array(features), np.array(thresholds), np.array(values))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo the folds; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float32()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled rows that are not held out. Only ids and labels are broadcast, ``sample`` at most."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold() != 0)))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = rows_of(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("label", "text")
    # an id may repeat in the documents: bounded again, in an order that does not depend on the partitions
    got = rows.mapInArrow(_describe, "label int, x array<float>").orderBy(F.xxhash64("x"), "label").limit(sample).toPandas()
    x = np.array(got["x"].tolist(), np.float32).reshape(len(got), len(NAMES))
    return fit(x.astype(float), got["label"].to_numpy(float))


def score(docs: DataFrame, model: Trees, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the score of the text as a last column ``name``."""
    at, columns = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(statistics(batch.column(at)).astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*columns, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(docs, labels, sample)
    return (score(rows_of(docs, "doc_id", "text"), model)
            .select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")))
