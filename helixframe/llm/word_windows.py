"""Substring deduplication over words with difference-cover anchors.

A window of ``window`` words is repeated when its word sequence also starts anywhere else, in the same or another text.
Words that a repeated window covers are removed.

Only words at cover positions are anchors: positions whose index modulo ``period`` is in a difference cover. For any two
positions i and j some shift d < period brings both onto cover positions, so two equal windows share the ``gram``-word sequence at
i + d and j + d, gram = window - period + 1. The steps:

1. Anchors' gram hashes are asked for repetition (see ``asks``). Texts are dealt to groups by a hash, and each group gets the
   repeated hashes among its anchors.
2. Around every repeated anchor, the windows that contain it are candidates. They are extended to the whole window: two
   independent 64-bit hashes of its words, one naming the bucket, the other compared.
3. Texts with a repeated window are cut. Texts without a repeated anchor leave after step 1, those without a candidate after step 2.

Null and empty texts have no words. Repeated rows are texts of their own, so they repeat each other. A null id stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asks import address, answers, by_bucket, grouped_texts, key_of, repeated_in, with_repeated_anchors
from .common import stored, task_count
from .textcore import U, flat, gram_starts, grams, mix, word_bounds, word_hashes

WINDOW, PERIOD = 35, 21
#: Hashes a bucket holds on average, and bytes of text of a group.
BUCKET, GROUP = 250_000, 16 << 20
_SECOND = 0xA24BAED4963EE407


@lru_cache(maxsize=8)
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences are all residues modulo ``period``, by search over growing sizes."""
    def grow(chosen: tuple[int, ...], size: int):
        seen = {(a - b) % period for a in chosen for b in chosen}
        if len(seen) == period:
            return chosen
        left = size - len(chosen)
        # k further residues add at most 2 * (k * |chosen| + k * (k - 1) / 2) differences
        if not left or len(seen) + 2 * left * len(chosen) + left * (left - 1) < period:
            return None
        for r in range(chosen[-1] + 1, period):
            if found := grow((*chosen, r), size):
                return found
        return None

    for size in range(1, period + 1):
        if found := grow((0,), size):
            return found
    raise AssertionError


def _anchors(first: np.ndarray, h: np.ndarray, gram: int, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (in ``h``), texts and hashes of the anchors."""
    at, offsets = gram_starts(first, gram)
    text = np.repeat(np.arange(len(first) - 1), np.diff(offsets))
    covered = np.zeros(period, bool)
    covered[list(difference_cover(period))] = True
    keep = covered[(at - first[text]) % period]
    at, text = at[keep], text[keep]
    return at, text, grams(h, gram)[at] if len(at) else np.zeros(0, U)


def _sha(words) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_C = pa.schema([("kind", pa.int8()), ("to", pa.int64()), ("blob", pa.binary()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())),
                ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_C_SQL = ("kind byte, to long, blob binary, ids array<long>, texts array<string>, doc_id long, n_words long, n_removed long, kept_sha256 string")
FINAL, TEXTS, ASKED = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_C)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _C, strict=True)], schema=_C)


def _windows(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The compared and the naming hash of every window."""
    return grams(h, window), grams(mix(h ^ U(_SECOND)), window)


def _runs(mask: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).astype(np.uint32)


def _mask(runs: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def _extend(window: int, period: int, buckets: int):
    """Texts of a group, after its repeated anchors: final rows, chunks of texts with candidates, and what those ask.

    A chunk holds the texts of one piece of a batch; its blob has the windows known to be repeated and those asked, as runs.
    """
    gram = window - period + 1

    def chunk(uid: int, ids: list, texts: pa.Array, keys: np.ndarray, abuckets: int) -> Iterator[tuple]:
        data, offsets = flat(texts)
        starts, ends, first = word_bounds(data, offsets)
        h = word_hashes(data, starts, ends)
        at, text, a = _anchors(first, h, gram, period)
        found = at[np.isin(key_of(*address(a, abuckets)), keys)] if len(keys) else at[:0]
        candidate = np.zeros(len(h) + 1, np.int64)
        if len(found):
            np.add.at(candidate, np.maximum(found - (period - 1), 0), 1)
            np.add.at(candidate, found + 1, -1)
        candidate = np.cumsum(candidate)[:len(h)] > 0
        whole, _ = gram_starts(first, window)
        inside = np.zeros(len(h), bool)
        inside[whole] = True
        candidate &= inside
        n = np.diff(first)
        has = np.add.reduceat(np.append(candidate, False).astype(np.int64), first[:-1]) * (n > 0) > 0 if len(n) else np.zeros(0, bool)
        for i in np.flatnonzero(~has):
            raw = data[offsets[i]:offsets[i + 1]].tobytes()
            yield (FINAL, None, None, None, None, ids[i], int(n[i]), 0, _sha(raw.split()))
        if has.any():
            keep = np.repeat(has, n)
            h, candidate = h[keep], candidate[keep]
            p = np.flatnonzero(candidate)
            value, name = (x[p] for x in _windows(h, window))
            known = repeated_in(value)
            bucket = (name % U(buckets)).astype(np.int64)
            for b, packed in by_bucket(bucket, value, np.full(len(p), uid, np.int64), known):
                yield (ASKED, b, packed, None, None, None, None, None, None)
            sure, ask = np.zeros(len(h), bool), np.zeros(len(h), bool)
            sure[p[known]], ask[p[~known]] = True, True
            s, q = _runs(sure), _runs(ask)
            blob = np.array([len(s), len(q)], np.int64).tobytes() + s.tobytes() + q.tobytes()
            yield (TEXTS, uid, blob, [ids[i] for i in np.flatnonzero(has)], texts.filter(pa.array(has)).to_pylist(), None, None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 32
        for ids, texts, keys in grouped_texts(batches, 1 << 18):
            uid += 1
            yield _rows(list(chunk(uid, ids, texts, keys, buckets)))

    return run


def _answer_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(to, bucket, bits) for each chunk that asked the bucket and has a repeated window there."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for to, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(to, []).append(blob)
    for bucket, blobs in held.items():
        rows = [(owner, np.packbits(hit).tobytes()) for owner, _, hit in answers(blobs) if hit.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()),
                                          pa.array([r[1] for r in rows], pa.binary())], ["to", "bucket", "blob"])


def _cut(window: int, buckets: int, with_text: bool):
    """Chunks after their answers: the final rows of their texts."""
    def finish(ids, texts: pa.Array, blob: bytes, told: dict[int, bytes]) -> list[tuple]:
        data, offsets = flat(texts)
        starts, ends, first = word_bounds(data, offsets)
        h = word_hashes(data, starts, ends)
        s, q = np.frombuffer(blob, np.int64, 2)
        runs = np.frombuffer(blob, np.uint32, 2 * (s + q), 16).reshape(-1, 2)
        repeated, ask = _mask(runs[:s], len(h)), np.flatnonzero(_mask(runs[s:], len(h)))
        name = _windows(h, window)[1][ask]
        bucket = (name % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1], [True]))) if len(order) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            bits = told.get(int(bucket[order[a]]))
            if bits is not None:
                repeated[ask[order[a:b][np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)]]] = True
        edge = np.zeros(len(h) + window + 1, np.int64)
        p = np.flatnonzero(repeated)
        np.add.at(edge, p, 1)
        np.add.at(edge, p + window, -1)
        gone = np.cumsum(edge)[:len(h)] > 0
        out = []
        for i, doc in enumerate(ids):
            a, b = first[i], first[i + 1]
            words = [data[starts[j]:ends[j]].tobytes() for j in np.flatnonzero(~gone[a:b]) + a]
            joined = b" ".join(words)
            out.append((doc, int(b - a), int(gone[a:b].sum()), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, told = None, {}
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                to, bucket, blob = (batch.column(j)[i].as_py() for j in range(3))
                if to != uid:
                    uid, told = to, {}
                if bucket is not None:
                    told[bucket] = blob
                    continue
                texts = batch.column(4)[i].values
                rows = finish(batch.column(3)[i].as_py(), texts, blob, told)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def remove_repeated(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, with_text: bool = False, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every text, and the kept words where ``with_text``.

    ``with_text`` gives ``kept`` for the texts that lose words; others keep all of theirs and have null there.
    """
    if not 0 < period <= window:
        raise ValueError("the period must be at most the window")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    share = len(difference_cover(period)) / period
    buckets, groups = max(1, int(size / 6 * share / BUCKET)), max(1, int(size / GROUP))
    tasks = task_count(spark, 2)

    def anchors_of(data, offsets):
        starts, ends, first = word_bounds(data, offsets)
        return _anchors(first, word_hashes(data, starts, ends), window - period + 1, period)[1:]

    both = with_repeated_anchors(rows, anchors_of, buckets, groups)
    out = stored(both.mapInArrow(_extend(window, period, buckets), _C_SQL))

    final = out.where(F.col("kind") == FINAL).select("doc_id", "n_words", "n_removed", "kept_sha256", F.lit(None).cast("string").alias("kept"))
    bits = (out.where(F.col("kind") == ASKED).select("to", "blob").repartition(tasks, "to")
            .mapInArrow(_answer_windows, "to long, bucket long, blob binary"))
    chunks = (bits.select("to", "bucket", "blob", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<string>").alias("texts"))
              .union(out.where(F.col("kind") == TEXTS).select("to", F.lit(None).cast("long").alias("bucket"), "blob", "ids", "texts")))
    chunks = chunks.repartition(2 * tasks, "to").sortWithinPartitions("to", F.col("bucket").asc_nulls_last())
    cut = chunks.mapInArrow(_cut(window, buckets, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    got = final.union(cut)
    return got if with_text else got.drop("kept")
