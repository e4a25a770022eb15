"""Cross-tokenizer alignment: divide and conquer at shared cuts, and corpus-wide counts of the linked id pairs.

Two tokenizers spell the same bytes, a space and the text. A byte offset where tokens of both end is a cut. An interval between
two cuts is divided at the first common end after its middle, else the last before it, found by bisecting one side's ends for the
other's, and both halves go on; an interval without a common end inside is a leaf, a group. All intervals of a piece of texts are divided together, a level a round.
A and B tokens whose bytes overlap are linked.

Tokenizers see parts, cut at single spaces before letters where neither lets a token cross, and a part that a worker has
seen is not encoded again. Each chunk of documents (about ``CHUNK`` bytes of text) is stored once with its distinct pairs and, per document,
their positions; pairs are counted on Spark, and each chunk gets back the counts of the pairs that it holds.

Null and empty texts, and texts that either tokenizer does not spell byte for byte, have no tokens: zeros and an empty hash.
Rows repeat as given, and each row is a document of its own in the counts, whatever its id.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stored

CHUNK = 1 << 24
PIECE = 1 << 18
#: Characters of parts whose encodings a worker remembers, over its tasks, before it starts afresh.
REMEMBER = 12 << 20
_CUT = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")
_MARK = "▁"

CHUNK_SCHEMA = ("chunk long, doc_id array<long>, n_a binary, n_b binary, n_groups binary, n_links binary, groups array<string>, "
                "groups_sha256 array<string>, pairs binary, held binary, first binary, at binary, times binary")
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level(path: str):
    """(ids of a list of texts, the bytes of each id) of a byte-level .json file; special strings are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    model.encode_special_tokens = True
    table = byte_table()
    spelled = [b""] * model.get_vocab_size()
    for token, i in model.get_vocab().items():
        spelled[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return (lambda texts: [x.ids for x in model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]), spelled


@lru_cache(maxsize=2)
def pieces(path: str):
    """(ids of a list of texts, the bytes of each id) of a sentencepiece model that puts a space first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        spelled.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_MARK, " ").encode())
        if _MARK in piece.lstrip(_MARK):
            raise ValueError(f"a token of {path} crosses a space, so its texts cannot be cut there")
    return (lambda texts: model.encode(texts, num_threads=1)), spelled


class _Codes(dict):
    """Numbers parts in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = code = len(self)
        self.new.append(part)
        return code


class Encodings:
    """Ids of parts under both tokenizers, each part encoded once until ``REMEMBER`` characters of parts are held."""

    def __init__(self, path_a: str, path_b: str):
        (self._a, self._bytes_a), (self._b, self._bytes_b) = byte_level(path_a), pieces(path_b)
        self.length_a = np.array([len(x) for x in self._bytes_a])
        self.length_b = np.array([len(x) for x in self._bytes_b])
        self._clear()

    def _clear(self):
        self._known, self._size = _Codes(), 0
        none = np.zeros(0, np.int64)
        self._ids, self._ends, self._same = [none, none], [np.zeros(1, np.int64)] * 2, np.zeros(0, bool)

    def _learn(self, parts: list[str]):
        same = np.ones(len(parts), bool)
        for i, (encode, spelled) in enumerate(((self._a, self._bytes_a), (self._b, self._bytes_b))):
            lists = encode(parts)
            flat = list(chain.from_iterable(lists))
            if b"".join(map(spelled.__getitem__, flat)) != "".join(" " + p for p in parts).encode():
                same &= [b"".join(map(spelled.__getitem__, x)) == b" " + p.encode() for p, x in zip(parts, lists, strict=True)]
            self._ids[i] = np.concatenate((self._ids[i], np.array(flat, np.int64)))
            self._ends[i] = np.concatenate((self._ends[i], self._ends[i][-1] + np.cumsum(list(map(len, lists)))))
        self._same = np.concatenate((self._same, same))

    def __call__(self, texts: list[str]):
        """A ids, B ids, and the first of each text in both lists; a text that is not spelled by both has none."""
        if self._size > REMEMBER:
            self._clear()
        codes, counts = [], []
        for text in texts:
            parts = _CUT.split(text) if text else []
            codes.extend(map(self._known.__getitem__, parts))
            counts.append(len(parts))
        if new := self._known.new:
            self._size += sum(map(len, new))
            self._learn(new)
            self._known.new = []
        codes, owner = np.array(codes, np.int64), np.repeat(np.arange(len(texts)), counts)
        bad = np.bincount(owner[~self._same[codes]], minlength=len(texts)) > 0
        keep = ~bad[owner]
        codes, owner = codes[keep], owner[keep]
        out = []
        for ids, ends in zip(self._ids, self._ends, strict=True):
            size = ends[codes + 1] - ends[codes]
            out.append(ids[_ranges(ends[codes], size)])
            out.append(np.concatenate(([0], np.cumsum(np.bincount(owner, size, minlength=len(texts)).astype(np.int64)))))
        return out[0], out[2], out[1], out[3]


@lru_cache(maxsize=1)
def remembered(path_a: str, path_b: str) -> Encodings:
    """One memory for all tasks of a worker."""
    return Encodings(path_a, path_b)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def shared_cuts(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of all common values, from known common ones (first and last included).

    ``a`` and ``b`` are ascending byte offsets of token borders. The intervals between known cuts are divided at a common border near
    the middle: a bisect on one side leads to a bisect on the other, outward until both agree.
    """
    mark_a, mark_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    mark_a[cuts_a], mark_b[cuts_b] = True, True
    lo_a, hi_a, lo_b, hi_b = cuts_a[:-1], cuts_a[1:], cuts_b[:-1], cuts_b[1:]
    while len(lo_a):
        # one token on a side leaves no room for a cut
        wide = (hi_a - lo_a > 1) & (hi_b - lo_b > 1)
        lo_a, hi_a, lo_b, hi_b = lo_a[wide], hi_a[wide], lo_b[wide], hi_b[wide]
        middle = (a[lo_a] + a[hi_a]) // 2
        cut_a, cut_b = _outward(a, b, middle, hi_a, hi_b, 1)
        back = np.flatnonzero(cut_a == hi_a)
        cut_a[back], cut_b[back] = _outward(a, b, middle[back], lo_a[back], lo_b[back], -1)
        found = cut_a > lo_a
        cut_a, cut_b = cut_a[found], cut_b[found]
        mark_a[cut_a], mark_b[cut_b] = True, True
        # halves side by side: intervals stay in order, which makes the next bisects cheap
        lo_a, hi_a = np.stack((lo_a[found], cut_a), 1).ravel(), np.stack((cut_a, hi_a[found]), 1).ravel()
        lo_b, hi_b = np.stack((lo_b[found], cut_b), 1).ravel(), np.stack((cut_b, hi_b[found]), 1).ravel()
    return np.flatnonzero(mark_a), np.flatnonzero(mark_b)


def _outward(a, b, middle, end_a, end_b, way: int) -> tuple[np.ndarray, np.ndarray]:
    """The first common value at or beyond each middle, in direction ``way``; the interval's own end where there is none inside."""
    at_a, at_b = end_a.copy(), end_b.copy()
    live, value = np.arange(len(middle)), middle
    while len(live):
        if way > 0:
            i = np.searchsorted(a, value)
            j = np.searchsorted(b, a[i])
        else:
            i = np.searchsorted(a, value, "right") - 1
            j = np.searchsorted(b, a[i], "right") - 1
        same = b[j] == a[i]
        at_a[live[same]], at_b[live[same]] = i[same], j[same]
        live, value = live[~same], b[j[~same]]
    return at_a, at_b


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the A and the B token of every pair whose bytes overlap, by A, then B."""
    first = np.searchsorted(b, a[:-1], "right") - 1
    size = np.searchsorted(b, a[1:]) - first
    return np.repeat(np.arange(len(a) - 1), size), _ranges(first, size)


@lru_cache(maxsize=2)
def _names(n_a: int, n_b: int) -> list[str]:
    """Decimal ids before a comma or a bar, then before a comma or a semicolon."""
    return ([f"{i}," for i in range(n_a)] + [f"{i}|" for i in range(n_a)] + [f"{i}," for i in range(n_b)] + [f"{i};" for i in range(n_b)])


def group_texts(ids_a, ids_b, cuts_a, cuts_b, first_a, n_a: int, n_b: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text; ``first_a`` tells a text's first A token, which a cut precedes."""
    names = _names(n_a, n_b)
    size_a, size_b = np.diff(cuts_a), np.diff(cuts_b)
    start = np.concatenate(([0], np.cumsum(size_a + size_b)))
    stream = np.empty(start[-1], np.int64)
    code_a, code_b = ids_a.copy(), ids_b + 2 * n_a
    code_a[cuts_a[1:] - 1] += n_a
    code_b[cuts_b[1:] - 1] += n_b
    stream[_ranges(start[:-1], size_a)] = code_a
    stream[_ranges(start[:-1] + size_a, size_b)] = code_b
    edge = start[np.searchsorted(cuts_a, first_a)].tolist()
    stream = stream.tolist()
    return ["".join(map(names.__getitem__, stream[x:y]))[:-1] for x, y in zip(edge[:-1], edge[1:], strict=True)]


def aligned(texts: list[str], encodings: Encodings):
    """Per text A, B, group and link counts and the groups' text; then (text, A id, B id) of every link."""
    ids_a, ids_b, first_a, first_b = encodings(texts)
    n_a, n_b = np.diff(first_a), np.diff(first_b)
    groups, group_count = [""] * len(texts), np.zeros(len(texts), np.int64)
    if not len(ids_a):
        none = np.zeros(0, np.int64)
        return (n_a, n_b, group_count, group_count), groups, (none, none, none)
    a = np.concatenate(([0], np.cumsum(encodings.length_a[ids_a])))
    b = np.concatenate(([0], np.cumsum(encodings.length_b[ids_b])))
    some = np.flatnonzero(n_a)
    edges_a, edges_b = np.append(first_a[some], len(ids_a)), np.append(first_b[some], len(ids_b))
    cuts_a, cuts_b = shared_cuts(a, b, edges_a, edges_b)
    group_count[some] = np.diff(np.searchsorted(cuts_a, edges_a))
    for i, text in zip(some, group_texts(ids_a, ids_b, cuts_a, cuts_b, edges_a, len(encodings.length_a), len(encodings.length_b)), strict=True):
        groups[i] = text
    at_a, at_b = links(a, b)
    owner = np.repeat(np.arange(len(texts)), n_a)[at_a]
    return (n_a, n_b, group_count, np.bincount(owner, minlength=len(texts))), groups, (owner, ids_a[at_a], ids_b[at_b])


def _chunks(path_a: str, path_b: str, keep_groups: bool, chunk: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encodings, serial = remembered(path_a, path_b), TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            lengths = [0 if x is None else len(x) for x in batch.column(1).to_pylist()]
            at = 0
            while at < len(ids):
                end, total = at, 0
                while end < len(ids) and (end == at or total + lengths[end] <= piece):
                    total += lengths[end]
                    end += 1
                numbers, groups, (owner, a, b) = aligned([x or "" for x in texts.slice(at, end - at).to_pylist()], encodings)
                key, times = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64), return_counts=True)
                hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                held.append((ids[at:end], numbers, groups if keep_groups else [None] * len(groups), hashes, key, times))
                size, at = size + total, end
                if size >= chunk:
                    yield _chunk_row(serial, held)
                    serial, held, size = serial + 1, [], 0
        if held:
            yield _chunk_row(serial, held)

    return run


def _chunk_row(serial: int, held: list) -> pa.RecordBatch:
    low = np.uint64((1 << 40) - 1)
    pair = np.concatenate([k & low for *_, k, _ in held])
    pairs, at = np.unique(pair, return_inverse=True)
    owner, before = [], 0
    for ids, *_, key, _ in held:
        owner.append((key >> np.uint64(40)).astype(np.int64) + before)
        before += len(ids)
    first = np.concatenate(([0], np.cumsum(np.bincount(np.concatenate(owner), minlength=before))))
    # positions rise within a document, so their differences are small and compress
    at = at.astype(np.int64)
    step = np.diff(at, prepend=0)
    heads = first[:-1][first[:-1] < first[1:]]
    step[heads] = at[heads]
    numbers = [np.concatenate([n[i] for _, n, *_ in held]).astype(np.int64).tobytes() for i in range(4)]
    times = np.concatenate([t for *_, t in held]).astype(np.uint32)
    row = [serial, [i for ids, *_ in held for i in ids], *numbers, [g for _, _, x, *_ in held for g in x], [g for _, _, _, x, *_ in held for g in x],
           pairs.tobytes(), np.bincount(at, minlength=len(pairs)).astype(np.uint32).tobytes(), first.tobytes(), step.astype(np.uint32).tobytes(), times.tobytes()]
    types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 5]
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, place, a, b, n): the distinct pairs of each chunk and the number of its documents that hold them."""
    for batch in batches:
        for i in range(len(batch)):
            pairs = np.frombuffer(batch.column(1)[i].as_py(), np.uint64)
            held = np.frombuffer(batch.column(2)[i].as_py(), np.uint32)
            chunk = batch.column(0)[i].as_py()
            for x in range(0, len(pairs), 1 << 16):
                part = pairs[x:x + (1 << 16)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(part), chunk)), pa.array(np.arange(x, x + len(part))), pa.array((part >> np.uint64(20)).astype(np.int32)),
                    pa.array((part & np.uint64((1 << 20) - 1)).astype(np.int32)), pa.array(held[x:x + len(part)].astype(np.int64))], ["chunk", "place", "a", "b", "n"])


def _scored(key, chunks: pa.Table, told: pa.Table) -> pa.Table:
    """Sums over the links of every document of one chunk."""
    out = []
    place = told["place"].to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = told["n"].to_numpy(), told["best"].to_numpy()
    for r in chunks.to_pylist():
        first, step = np.frombuffer(r["first"], np.int64), np.frombuffer(r["at"], np.uint32).astype(np.int64)
        times = np.frombuffer(r["times"], np.uint32).astype(np.int64)
        total = np.cumsum(step)
        lead = np.concatenate(([0], total))[first[:-1]]
        at = total - np.repeat(lead, np.diff(first))
        sums = []
        for value in (best, count):
            run = np.concatenate(([0], np.cumsum(times * value[at])))
            sums.append(run[first[1:]] - run[first[:-1]])
        out.append(pa.table([pa.array(r["doc_id"], pa.int64()), *[pa.array(np.frombuffer(r[n], np.int64)) for n in NUMBERS], pa.array(sums[0]), pa.array(sums[1]),
                             pa.array(r["groups_sha256"], pa.string()), pa.array(r["groups"], pa.string())], ["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256", "groups"]))
    return pa.concat_tables(out)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False,
          chunk: int = CHUNK, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The documents' alignments, and the linked id pairs.

    The first has doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with ``keep_groups``, the groups themselves. The
    second has a, b, the number n of documents that hold the pair linked and whether it is its A id's best (1 or 0). ``path_a`` is a byte-level .json file,
    ``path_b`` a sentencepiece model; every node can open both. ``chunk`` and ``piece`` are characters of text stored and aligned at a time.
    """
    chunks = stored(rows_of(docs, id_col, text_col).mapInArrow(_chunks(path_a, path_b, keep_groups, chunk, piece), CHUNK_SCHEMA))
    local = chunks.select("chunk", "pairs", "held").mapInArrow(_unpacked, "chunk long, place long, a int, b int, n long")
    counts = stored(local.groupBy("a", "b").agg(F.sum("n").alias("n")))
    top = counts.groupBy(F.col("a").alias("top_a")).agg(F.max("n").alias("top"))
    pairs = counts.join(top, F.col("a") == F.col("top_a")).select("a", "b", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    told = local.select("chunk", "place", "a", "b").join(pairs, ["a", "b"]).select("chunk", "place", "n", "best")
    scored = (chunks.drop("pairs", "held").groupBy("chunk").cogroup(told.groupBy("chunk"))
              .applyInArrow(_scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"))
    return (scored if keep_groups else scored.drop("groups")), pairs
