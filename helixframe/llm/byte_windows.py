"""Suffix-array deduplication: bytes of repeated strings, found by merging shards' Burrows-Wheeler transforms.

Every byte that a ``length``-byte string covers which also starts earlier (smaller id, or the same text at an earlier start)
is removed. A transform of a whole corpus does not fit the tasks of a cluster, so strings meet by content first:

1. The ``gram``-byte sequence of smallest hash in a string of ``length`` bytes is its anchor. Equal strings have equal anchors.
   Only strings whose anchor occurs twice in the corpus can be repeated (see ``asks``).
2. Neighbouring strings with one anchor are a fragment. Fragments go to the bucket of their anchor, whole fragments that are
   equal once per piece of the corpus: the earliest stands for them, the later ones are known to be repeated.
3. In a bucket each piece's fragments are a shard. The shards' transforms are merged by interleave refinement (see ``bwt``);
   the intervals with a common prefix of ``length`` are the repeated strings, and all but the earliest of each are answered.
4. Pieces cut what was answered.

A bucket is merged in parts of about ``MERGE`` bytes, cut between anchors. An anchor with more than ``HOT`` bytes of differing
fragments, as a frequent line has, is in no bucket: its windows are dealt by a 96-bit hash of all their bytes, each that a piece
repeats once, and all but the earliest of a hash are answered. Pieces tell how much of an anchor they hold from ``TELL``
fragments on; fewer are a few hundred bytes per piece. Null and empty texts have no bytes. Rows with the
same id are ordered by where they are stored; a null id comes before all others. Repeated rows repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asks import address, grouped_texts, key_of, with_repeated_anchors
from .bwt import merged_blocks
from .common import stored, task_count
from .textcore import U, flat, grams, slices, word_hashes

LENGTH, GRAM = 100, 40
BUCKET, GROUP, PIECE = 250_000, 16 << 20, 8 << 20
#: Fragment bytes of a bucket on average, and of one merge.
FRAGMENTS, MERGE = 1 << 20, 1 << 18
#: Fragment bytes from which an anchor is hot, fragments of a piece from which it tells them, and windows of a hot bucket.
HOT, TELL, WINDOWS = 4 << 20, 4, 1 << 19
#: Windows of a fragment at most; a longer run is several fragments.
RUN = 512
#: Marks, on a fragment's size, that it can repeat a window of its own.
TWICE = 1 << 15
NULL_ID = -(1 << 63)
FINAL, TEXTS, ASKED, TOLD = 0, 1, 2, 3
#: What a blob for a piece and bucket holds, by the offset of its bucket's name: bits of the merge, hot fragments, hot windows.
BITS, SKIP, HITS = 0, 1, 2


def _least(low: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive entries."""
    size = 1
    while size < width:
        step = min(size, width - size)
        low = np.minimum(low[:max(len(low) - step, 0)], low[step:])
        size += step
    return low


def fragments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start in ``data``, windows, anchor, twice) of each run of windows of one text with one anchor.

    ``twice`` tells whether the run can repeat a window of its own. Then the text has a period there, the anchor starts a
    window of the run, ends another one, and these are two places.
    """
    out = []
    for a, b in slices(offsets):
        all_grams = grams(data[offsets[a]:offsets[b]].astype(U), gram)
        low = _least(all_grams, length - gram + 1)
        at = offsets[a:b + 1] - offsets[a]
        n = np.maximum(np.diff(at) - length + 1, 0)
        total = int(n.sum())
        if not total:
            continue
        text = np.repeat(np.arange(b - a), n)
        window = np.arange(total) + np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        h = low[window]
        new = np.ones(total, bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, total))
        last = length - gram
        begins = np.where(all_grams[window] == h, window, len(data))
        ends = np.where(all_grams[window + last] == h, window + last, -1)
        twice = np.maximum.reduceat(ends, heads) > np.minimum.reduceat(begins, heads)
        pieces = -(-size // RUN)
        if (pieces > 1).any():
            within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            heads, twice = np.repeat(heads, pieces) + within * RUN, np.repeat(twice, pieces)
            size = np.diff(np.append(heads, total))
        out.append((text[heads] + a, window[heads] + offsets[a], size, h[heads], twice))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U), np.zeros(0, bool)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate(([0], np.cumsum(size)))
    return data[np.arange(first[-1]) + np.repeat(start - first[:-1], size)], first


_C = pa.schema([("kind", pa.int8()), ("to", pa.int64()), ("blob", pa.binary()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())),
                ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_C_SQL = ("kind byte, to long, blob binary, ids array<long>, texts array<string>, doc_id long, n_bytes long, n_removed long, n_spans long, "
          "kept_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_C)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _C, strict=True)], schema=_C)


#: Arrays of an asked blob: the piece; anchor, id, start and size of each fragment; bytes.
_ASKED = (np.int64, np.uint32, np.int64, np.uint32, np.uint16, np.uint8)


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([a.nbytes for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    size = np.frombuffer(blob, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for n, kind in zip(size, kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _cut_out(length: int, gram: int, anchors: int, buckets: int):
    """Texts of a group after its repeated anchors: final rows, pieces with their fragments, and what those ask."""
    def piece(uid: int, ids: list, texts: pa.Array, keys: np.ndarray) -> Iterator[tuple]:
        data, offsets = flat(texts)
        found = fragments(data, offsets, length, gram)
        keep = np.isin(key_of(*address(found[3], anchors)), keys)
        text, start, size, h, twice = (x[keep] for x in found)
        has = np.zeros(len(ids), bool)
        has[text] = True
        for i in np.flatnonzero(~has):
            raw = data[offsets[i]:offsets[i + 1]].tobytes()
            yield (FINAL, None, None, None, None, ids[i], len(raw), 0, 0, hashlib.sha256(raw).hexdigest())
        if not len(text):
            return
        doc = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        # of equal fragments the earliest asks, all windows of the others are repeated
        name = word_hashes(data, start, start + size + length - 1) ^ h
        order = np.lexsort((start, text, doc[text], name))
        first = np.ones(len(order), bool)
        first[1:] = name[order][1:] != name[order][:-1]
        asks = order[first]
        bucket = (h[asks] % U(buckets)).astype(np.int64)
        asks = asks[np.lexsort((start[asks], bucket))]
        bucket = (h[asks] % U(buckets)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = asks[a:b]
            raw, _ = _gather(data, start[own], size[own] + length - 1)
            yield (ASKED, int(bucket[a]), _pack(np.array([uid]), h[own].astype(np.uint32), doc[text[own]], start[own].astype(np.uint32),
                                                (size[own] + TWICE * twice[own]).astype(np.uint16), raw),
                   None, None, None, None, None, None, None)
        anchor, own, count = np.unique(h[asks].astype(np.uint32) | (bucket.astype(U) << U(32)), return_inverse=True, return_counts=True)
        total = np.bincount(own, size[asks] + length - 1)
        for i in np.flatnonzero(count >= TELL):
            yield (TOLD, int(anchor[i] >> U(32)), None, None, None, int(anchor[i] & U(0xFFFFFFFF)), int(total[i]), None, None, None)
        late = order[~first]
        # texts without fragments have left: number the rest anew
        kept = np.flatnonzero(has)
        at = np.concatenate(([0], np.cumsum(np.diff(offsets)[kept])))
        shift = np.zeros(len(ids), np.int64)
        shift[kept] = at[:-1] - offsets[kept]
        place = lambda f: (start[f] + shift[text[f]]).astype(np.uint32)
        blob = _pack(place(late), size[late].astype(np.uint16), place(asks), size[asks].astype(np.uint16), bucket[edges[:-1]], np.diff(edges))
        yield (TEXTS, uid, blob, [ids[i] for i in kept], texts.filter(pa.array(has)).to_pylist(), None, None, None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 32
        for ids, texts, keys in grouped_texts(batches, PIECE):
            uid += 1
            yield _rows(list(piece(uid, ids, texts, keys)))

    return run


def repeated_windows(source: np.ndarray, anchor: np.ndarray, earlier: tuple[np.ndarray, ...], size: np.ndarray,
                     twice: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Mask of the windows, of all fragments one after the other, that also start earlier.

    ``source`` is a fragment's shard, ``earlier`` its place in the corpus as sort keys, the first one most significant.
    """
    n = len(source)
    rank = np.empty(n, np.int64)
    rank[np.lexsort(earlier[::-1])] = np.arange(n)
    first = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(first[-1], bool)
    # equal fragments: the earliest stands for all
    at = np.concatenate(([0], np.cumsum(size + length - 1)))
    raw, known = data.tobytes(), {}
    name = np.array([known.setdefault(raw[a:b], i) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))], np.int64)
    order = np.lexsort((rank, size, name))
    head = np.ones(n, bool)
    head[1:] = (name[order][1:] != name[order][:-1]) | (size[order][1:] != size[order][:-1])
    for f in order[~head]:
        out[first[f]:first[f + 1]] = True
    left = order[head]
    # fragments meet through their anchors only
    _, inverse, count = np.unique(anchor[left], return_inverse=True, return_counts=True)
    left = left[(count[inverse] > 1) | twice[left]]
    left = left[np.lexsort((source[left], anchor[left]))]
    total = np.cumsum(size[left] + length - 1)
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + MERGE, side="right")))
        b = int(np.searchsorted(anchor[left], anchor[left[b - 1]], side="right"))
        own = left[a:b][np.argsort(source[left[a:b]], kind="stable")]
        text, begin = _gather(data, at[own], size[own] + length - 1)
        _, shard = np.unique(source[own], return_inverse=True)
        entries, block = merged_blocks(text, begin, shard, length)
        real = entries >= 0
        entries, block = entries[real], block[real]
        fragment = np.searchsorted(begin, entries, side="right") - 1
        offset = entries - begin[fragment]
        window = offset < size[own][fragment]
        fragment, offset, block = own[fragment[window]], offset[window], block[window]
        place = np.lexsort((offset, rank[fragment], block))
        later = np.zeros(len(place), bool)
        later[1:] = block[place][1:] == block[place][:-1]
        hit = place[later]
        out[first[fragment[hit]] + offset[hit]] = True
        a = b
    return out


def _without_hot(length: int, hot: dict[int, np.ndarray], parts: int):
    """Rows (to, bucket, part, blob) of asked blobs: the rest of each, with a null part and bucket, what their pieces are told, with a
    null part, and the windows of hot anchors by part of their hash."""
    def windows(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Fragment, place in it and two hashes of every window."""
        out = []
        for a, b in slices(first):
            at = first[a:b + 1] - first[a]
            n = np.diff(at) - length + 1
            begins = np.concatenate(([0], np.cumsum(n)))
            inside = np.arange(begins[-1]) - np.repeat(begins[:-1], n)
            start = inside + np.repeat(at[:-1], n)
            own = data[first[a]:first[b]]
            out.append((np.repeat(np.arange(a, b), n), inside, word_hashes(own, start, start + length), grams(own.astype(U), length)[start].astype(np.uint32)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def split(bucket: int, blob: bytes) -> Iterator[tuple]:
        uid, h, doc, start, size, data = _unpack(blob, *_ASKED)
        is_hot = np.isin(h, hot[bucket]) if bucket in hot else np.zeros(len(h), bool)
        if not is_hot.any():
            yield bucket, None, None, blob
            return
        uid, n = int(uid[0]), (size % TWICE).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(n + length - 1)))
        bit = np.concatenate(([0], np.cumsum(n)))
        rest = np.flatnonzero(~is_hot)
        if len(rest):
            yield bucket, None, None, _pack(np.array([uid]), h[rest], doc[rest], start[rest], size[rest], _gather(data, at[rest], n[rest] + length - 1)[0])
        yield uid, 3 * bucket + SKIP, None, np.packbits(is_hot).tobytes()
        own = np.flatnonzero(is_hot)
        fragment, inside, x, y = windows(*_gather(data, at[own], n[own] + length - 1))
        fragment = own[fragment]
        doc, place, index = doc[fragment], start[fragment].astype(np.int64) + inside, (bit[fragment] + inside).astype(np.uint32)
        # of a piece's equal windows the earliest asks
        order = np.lexsort((place, doc, y, x))
        later = np.zeros(len(order), bool)
        later[1:] = (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
        if later.any():
            yield uid, 3 * bucket + HITS, None, index[order[later]].tobytes()
        order = order[~later]
        part = (x[order] % U(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        order, part = order[by], part[by]
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            o = order[a:b]
            yield uid, bucket, int(part[a]), _pack(x[o], y[o], doc[o], place[o].astype(np.uint32), index[o])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for to, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(split(to, blob.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                                 ["to", "bucket", "part", "blob"])

    return run


def _answer_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of hot anchors that start earlier, by piece and bucket; the rows (part, to, bucket, blob) come sorted by part."""
    def make(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        parts = [_unpack(b, U, np.uint32, np.int64, np.uint32, np.uint32) for _, _, b in held]
        x, y, doc, place, index = (np.concatenate([p[i] for p in parts]) for i in range(5))
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        uid = np.array([u for u, _, _ in held])[source]
        order = np.lexsort((place, uid, doc, y, x))
        later = np.zeros(len(order), bool)
        later[1:] = (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
        hit = np.sort(order[later])
        cuts = np.searchsorted(source[hit], np.arange(len(parts) + 1))
        rows = [(u, 3 * bucket + HITS, index[hit[a:b]].tobytes()) for (u, bucket, _), a, b in zip(held, cuts[:-1], cuts[1:], strict=True) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                                          ["to", "bucket", "blob"])

    part, held = None, []
    for batch in batches:
        for p, to, bucket, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            if p != part:
                if held:
                    yield make(held)
                part, held = p, []
            held.append((to, bucket, blob.as_py()))
    if held:
        yield make(held)


def _answer(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []

        def make() -> pa.RecordBatch:
            parts = [_unpack(b, *_ASKED) for b in blobs]
            uid = np.array([p[0][0] for p in parts])
            count = np.array([len(p[1]) for p in parts])
            h, doc, start, size, data = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
            twice, size, source = size >= TWICE, (size % TWICE).astype(np.int64), np.repeat(np.arange(len(parts)), count)
            hit = repeated_windows(source, h, (doc, uid[source], start), size, twice, data, length)
            edges = np.concatenate(([0], np.cumsum(np.bincount(source, size, len(parts)).astype(np.int64))))
            rows = [(int(u), np.packbits(hit[a:b]).tobytes()) for u, a, b in zip(uid, edges[:-1], edges[1:], strict=True) if hit[a:b].any()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([3 * bucket + BITS] * len(rows), pa.int64()),
                                               pa.array([r[1] for r in rows], pa.binary())], ["to", "bucket", "blob"])

        for batch in batches:
            for to, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if to != bucket:
                    if blobs:
                        yield make()
                    bucket, blobs = to, []
                blobs.append(blob.as_py())
        if blobs:
            yield make()

    return run


def _finish(length: int, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def piece(ids: list, texts: pa.Array, blob: bytes, told: dict[int, list[bytes]]) -> list[tuple]:
        data, offsets = flat(texts)
        late, late_size, asks, asks_size, buckets, counts = _unpack(blob, np.uint32, np.uint16, np.uint32, np.uint16, np.int64, np.int64)
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, late, 1)
        np.add.at(edge, late.astype(np.int64) + late_size + length - 1, -1)
        at = np.concatenate(([0], np.cumsum(counts)))
        for b, x, y in zip(buckets, at[:-1], at[1:], strict=True):
            bits, skip, hits = (told.get(3 * int(b) + i, []) for i in (BITS, SKIP, HITS))
            if not bits and not hits:
                continue
            size = asks_size[x:y].astype(np.int64)
            first = np.concatenate(([0], np.cumsum(size)))
            hit = [np.frombuffer(i, np.uint32).astype(np.int64) for i in hits]
            if bits:
                merged = np.arange(first[-1])
                if skip:
                    merged = merged[~np.repeat(np.unpackbits(np.frombuffer(skip[0], np.uint8), count=len(size)).astype(bool), size)]
                hit.append(merged[np.unpackbits(np.frombuffer(bits[0], np.uint8), count=len(merged)).astype(bool)])
            hit = np.concatenate(hit)
            f = np.searchsorted(first, hit, side="right") - 1
            window = asks[x:y].astype(np.int64)[f] + hit - first[f]
            np.add.at(edge, window, 1)
            np.add.at(edge, window + length, -1)
        gone = np.cumsum(edge)[:len(data)] > 0
        out = []
        for i, doc in enumerate(ids):
            mask = gone[offsets[i]:offsets[i + 1]]
            kept = data[offsets[i]:offsets[i + 1]][~mask].tobytes()
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
            out.append((doc, len(mask), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, told = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                to, bucket, blob = (batch.column(j)[i].as_py() for j in range(3))
                if to != uid:
                    uid, told = to, {}
                if bucket is not None:
                    told.setdefault(bucket, []).append(blob)
                    continue
                rows = piece(batch.column(3)[i].as_py(), batch.column(4)[i].values, blob, told)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every text, and the kept bytes where ``with_text``.

    ``with_text`` gives ``kept`` for the texts that may lose bytes; others keep all of theirs and have null there.
    """
    if not 4 <= gram <= length:
        raise ValueError("a gram has 4 bytes or more and fits the string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # two anchors per length - gram + 2 bytes; fragments repeat length - 1 bytes per anchor
    anchors, groups = max(1, int(size * 2 / (length - gram + 2) / BUCKET)), max(1, int(size / GROUP))
    buckets = max(1, int(size / FRAGMENTS))
    tasks = task_count(docs.sparkSession, 2)

    def anchors_of(data, offsets):
        text, _, _, h, twice = fragments(data, offsets, length, gram)
        n = twice + 1
        return np.repeat(text, n), np.repeat(h, n)

    out = stored(with_repeated_anchors(rows, anchors_of, anchors, groups).mapInArrow(_cut_out(length, gram, anchors, buckets), _C_SQL))
    final = out.where(F.col("kind") == FINAL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    asked = out.where(F.col("kind") == ASKED).select("to", "blob")
    hot = (out.where(F.col("kind") == TOLD).groupBy("to", F.col("doc_id").alias("anchor")).agg(F.sum("n_bytes").alias("total"))
           .where(F.col("total") > HOT).collect())
    told = None
    if hot:
        # at most one anchor per HOT bytes
        by_bucket: dict[int, list[int]] = {}
        for r in hot:
            by_bucket.setdefault(r["to"], []).append(r["anchor"])
        parts = max(1, sum(r["total"] for r in hot) // WINDOWS)
        split = stored(asked.mapInArrow(_without_hot(length, {b: np.array(a, np.uint32) for b, a in by_bucket.items()}, parts),
                                        "to long, bucket long, part long, blob binary"))
        asked = split.where("part is null and bucket is null").select("to", "blob")
        told = (split.where("part is not null").select("part", "to", "bucket", "blob").repartition(max(tasks, min(parts, 8 * tasks)), "part")
                .sortWithinPartitions("part").mapInArrow(_answer_hot, "to long, bucket long, blob binary")
                .union(split.where("part is null and bucket is not null").select("to", "bucket", "blob")))
    bits = (asked.repartition(max(tasks, min(buckets, 8 * tasks)), "to").sortWithinPartitions("to")
            .mapInArrow(_answer(length), "to long, bucket long, blob binary"))
    bits = bits if told is None else bits.union(told)
    pieces = (bits.select("to", "bucket", "blob", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<string>").alias("texts"))
              .union(out.where(F.col("kind") == TEXTS).select("to", F.lit(None).cast("long").alias("bucket"), "blob", "ids", "texts")))
    pieces = pieces.repartition(2 * tasks, "to").sortWithinPartitions("to", F.col("bucket").asc_nulls_last())
    cut = pieces.mapInArrow(_finish(length, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    got = final.union(cut)
    return got if with_text else got.drop("kept")
