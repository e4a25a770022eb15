"""Which hashes occur twice: asked in packed blobs, so a row carries thousands of hashes.

A batch sends each of its hashes to the bucket that the hash names. A hash that is repeated within the batch is known to be
repeated: it goes out once, as a statement, and needs no answer. So a hash that every text holds reaches its bucket
once per batch. The answer to a blob is one bit per asked hash, in the order of asking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import task_count
from .textcore import U, flat, slices


def repeated_in(h: np.ndarray) -> np.ndarray:
    """Mask of the entries whose value occurs twice or more in ``h``."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(h), bool)
    out[order] = twice
    return out


def pack(owners: np.ndarray, counts: np.ndarray, asked: np.ndarray, known: np.ndarray) -> bytes:
    head = np.array([len(owners), len(asked), len(known), asked.dtype.itemsize], np.int64)
    return b"".join([head.tobytes(), owners.astype(np.int64).tobytes(), counts.astype(np.uint32).tobytes(), asked.tobytes(),
                     known.astype(asked.dtype).tobytes()])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, a, k, width = np.frombuffer(blob, np.int64, 4)
    kind, at = np.dtype(f"u{width}"), 32
    out = []
    for dtype, size in ((np.int64, n), (np.uint32, n), (kind, a), (kind, k)):
        out.append(np.frombuffer(blob, dtype, size, at))
        at += size * np.dtype(dtype).itemsize
    return tuple(out)


def by_bucket(bucket: np.ndarray, value: np.ndarray, owner: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A blob per bucket of what a batch holds. ``owner`` is the answer's address; entries keep their order within it."""
    twice = np.flatnonzero(known)
    if len(twice):
        _, first = np.unique(np.stack([bucket[twice].astype(np.uint64), value[twice].astype(np.uint64)]), axis=1, return_index=True)
        twice = twice[first]
        twice = twice[np.argsort(bucket[twice], kind="stable")]
    once = np.flatnonzero(~known)
    once = once[np.lexsort((owner[once], bucket[once]))]
    for b in np.union1d(bucket[once], bucket[twice]):
        a, z = np.searchsorted(bucket[once], [b, b + 1])
        c, d = np.searchsorted(bucket[twice], [b, b + 1])
        o = owner[once[a:z]]
        heads = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1]))) if len(o) else np.zeros(0, int)
        yield int(b), pack(o[heads], np.diff(np.append(heads, len(o))), value[once[a:z]], value[twice[c:d]])


def answers(blobs: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(owner, asked values, whether each is repeated) of every run of one owner in the blobs of one bucket."""
    parts = [unpack(b) for b in blobs]
    asked = np.concatenate([p[2] for p in parts])
    if not len(asked):
        return
    values, inverse, count = np.unique(asked, return_inverse=True, return_counts=True)
    hit = (count > 1) | np.isin(values, np.concatenate([p[3] for p in parts]))
    hit, at = hit[inverse], 0
    for owners, counts, own, _ in parts:
        edges = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
        for o, a, z in zip(owners, edges[:-1], edges[1:], strict=True):
            yield int(o), own[a:z], hit[at + a:at + z]
        at += len(own)


def address(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit value of an anchor hash."""
    return ((h >> U(32)) % U(buckets)).astype(np.int64), h.astype(np.uint32)


def key_of(bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (bucket.astype(U) << U(32)) | value.astype(U)


def _ask_anchors(anchors_of, buckets: int):
    """Rows (to, ask, blob): anchors asked of their bucket, and repeated ones stated to their group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = flat(batch.column(1))
            hashes, owners = [], []
            for a, b in slices(offsets):
                text, h = anchors_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                hashes.append(h)
                owners.append(group[a:b][text])
            h, owner = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((hashes, U), (owners, np.int64)))
            bucket, value = address(h, buckets)
            key = key_of(bucket, value)
            known = repeated_in(key)
            to, ask, blob = [], [], []
            for b, packed in by_bucket(bucket, value, owner, known):
                to.append(b)
                ask.append(True)
                blob.append(packed)
            own, keys = owner[known], key[known]
            order = np.argsort(own, kind="stable")
            own, keys = own[order], keys[order]
            for g in np.unique(own):
                x, y = np.searchsorted(own, [g, g + 1])
                to.append(int(g))
                ask.append(False)
                blob.append(np.unique(keys[x:y]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(ask, pa.bool_()), pa.array(blob, pa.binary())], ["to", "ask", "blob"])

    return run


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Asked blobs become the repeated keys of each group; statements pass."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        ask = batch.column(1).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(ask):
            held.setdefault(batch.column(0)[int(i)].as_py(), []).append(batch.column(2)[int(i)].as_py())
        if not ask.all():
            rest = batch.filter(pa.array(~ask))
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(2)], ["group", "blob"])
    for bucket, blobs in held.items():
        found: dict[int, list[np.ndarray]] = {}
        for owner, values, hit in answers(blobs):
            if hit.any():
                found.setdefault(owner, []).append(values[hit])
        if found:
            out = [key_of(np.full(1, bucket), np.unique(np.concatenate(v))).tobytes() for v in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(out, pa.binary())], ["group", "blob"])


def with_repeated_anchors(rows: DataFrame, anchors_of, buckets: int, groups: int) -> DataFrame:
    """(group, tag, blob, doc_id, text) sorted by group: first the repeated anchor keys of a group, then its texts.

    ``rows`` are (doc_id, text); ``anchors_of(data, offsets)`` gives the text and the hash of every anchor of a piece.
    """
    tasks = task_count(rows.sparkSession, 2)
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    asked = rows.select("group", "text").mapInArrow(_ask_anchors(anchors_of, buckets), "to long, ask boolean, blob binary")
    told = asked.repartition(tasks, "to", "ask").mapInArrow(_answer_anchors, "group long, blob binary")
    both = (told.select("group", F.lit(0).alias("tag"), "blob", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
            .union(rows.select("group", F.lit(1).alias("tag"), F.lit(None).cast("binary").alias("blob"), "doc_id", "text")))
    return both.repartition(max(tasks, min(groups, 4 * tasks)), "group").sortWithinPartitions("group", "tag")


def grouped_texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, pa.Array, np.ndarray]]:
    """(ids, texts, repeated anchor keys of their group) of pieces of about ``size`` bytes, from rows of the frame above."""
    group, keys = None, []
    for batch in batches:
        groups = batch.column(0).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if groups[a] != group:
                group, keys = groups[a], []
            part = batch.slice(a, b - a)
            told = b - a - part.column(2).null_count
            keys += [np.frombuffer(x.as_py(), U) for x in part.column(2).slice(0, told)]
            if told == b - a:
                continue
            keys = [np.unique(np.concatenate(keys))] if keys else [np.zeros(0, U)]
            texts = part.column(4).slice(told).fill_null("")
            for x, y in slices(flat(texts)[1], size):
                yield part.column(3).slice(told + x, y - x).to_pylist(), texts.slice(x, y - x), keys[0]
