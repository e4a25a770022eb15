"""Merging Burrows-Wheeler transforms of shards of strings by iterative interleave refinement.

A shard is a list of strings. Its transform lists, in the order of its suffixes, the ``step`` symbols before each suffix. The
merged order is an interleave of the shards' orders, kept as the shard of each entry. A refinement walks the interleave,
takes each entry's symbols and sorts them stably: that is the interleave of the suffixes extended by these symbols. Entries
that agree in the symbols and were in one block stay in one block, so after r rounds the blocks are the intervals of
suffixes with a common prefix of ``step * r`` or more. Suffixes are never compared again.
"""

from __future__ import annotations

import numpy as np

STEPS = (4, 3, 2, 1)


def _small(codes: np.ndarray) -> np.ndarray:
    """The narrowest type, for which a stable sort is a radix sort."""
    top = int(codes.max()) if len(codes) else 0
    return codes.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.int32)


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted suffixes of strings that are joined, each closed by a terminator (at ``ends``); terminators differ, by position."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    h = 1
    while True:
        ahead = rank[np.minimum(np.arange(n) + h, n - 1)]
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        h *= 2


def merged_blocks(data: np.ndarray, first: np.ndarray, shard: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the shards' transforms and return (entries, blocks) in suffix order.

    String i is ``data[first[i]:first[i + 1]]``, of 4 bytes or more, sorted by ``shard``. An entry is the place of a
    suffix in ``data`` (-1 for a terminator); neighbours of one block have ``depth`` bytes in common, at least.
    """
    step = next(x for x in STEPS if depth % x == 0)
    m, n = len(first) - 1, len(data) + len(first) - 1
    present = np.unique(data)
    dense = np.zeros(256, np.int64)
    dense[present] = np.arange(1, len(present) + 1)
    base = len(present) + 1
    # all strings with their terminators, symbol 0
    string = np.repeat(np.arange(m), np.diff(first))
    place = np.arange(len(data)) + string
    symbols = np.zeros(n, np.int64)
    symbols[place] = dense[data]
    source = np.full(n, -1, np.int64)
    source[place] = np.arange(len(data))
    ends = first[1:] + np.arange(m)
    begins = first[:-1] + np.arange(m)
    owner = np.repeat(np.arange(m), np.diff(first) + 1)
    offset = np.arange(n) - begins[owner]

    def four(at: np.ndarray) -> np.ndarray:
        code = np.zeros(len(at), np.int64)
        for j in range(step):
            inside = np.minimum(at + j, ends[owner[at]])
            code = code * base + symbols[inside]
        return code

    # the shards' own orders, one after the other
    orders, cuts = [], np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x, y = begins[a], ends[b - 1] + 1
        orders.append(suffix_order(symbols[x:y], ends[a:b] - x) + x)
    order = np.concatenate(orders)
    size = np.array([len(o) for o in orders])
    z = _small(np.repeat(np.arange(len(orders)), size))
    # suffixes that no extension reaches: those of fewer than ``step`` symbols and their terminator
    fixed = np.flatnonzero(ends[owner] - np.arange(n) < step)
    reached = offset[order] >= step
    codes = np.concatenate([four(fixed), four(order[reached] - step)])
    _, codes = np.unique(codes, return_inverse=True)
    codes = _small(codes)
    fixed_codes, transform = codes[:len(fixed)], np.zeros(n, codes.dtype)
    transform[reached] = codes[len(fixed):]
    fixed_z = _small(np.repeat(np.arange(len(orders)), np.diff(cuts) * step)).astype(z.dtype)
    block = np.zeros(n, np.int32)
    for _ in range(depth // step):
        # the i-th entry of a shard in the interleave is the i-th of its order
        take = np.argsort(z, kind="stable")
        here, live = np.empty(n, codes.dtype), np.empty(n, bool)
        here[take], live[take] = transform, reached
        o = np.argsort(np.concatenate([fixed_codes, here[live]]), kind="stable")
        code = np.concatenate([fixed_codes, here[live]])[o]
        old = np.concatenate([np.arange(-len(fixed), 0, dtype=np.int32), block[live]])[o]
        z = np.concatenate([fixed_z, z[live]])[o]
        new = np.ones(n, bool)
        new[1:] = (code[1:] != code[:-1]) | (old[1:] != old[:-1])
        block = (np.cumsum(new) - 1).astype(np.int32)
    entries = np.empty(n, np.int64)
    entries[np.argsort(z, kind="stable")] = source[order]
    return entries, block
