"""Word windows, byte windows and near-duplicates against brute force, with nulls, repeats, long and empty texts."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.accumulators import AccumulatorParam

from helixframe.llm import byte_windows, near_dedup, word_windows
from helixframe.llm.bwt import merged_blocks
from helixframe.llm.graph import components
from helixframe.llm.queries import queries


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def brute_words(rows, w):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(x[i:i + w]) for _, x in texts for i in range(len(x) - w + 1))
    out = []
    for d, x in texts:
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i:i + w])] > 1:
                gone[i:i + w] = [True] * w
        out.append((d, len(x), sum(gone), sha(b" ".join(y for y, g in zip(x, gone) if not g))))
    return sorted(out, key=str)


def brute_bytes(rows, w):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - w + 1):
            if x[i:i + w] in seen:
                gone[i:i + w] = b"\1" * w
            else:
                seen.add(x[i:i + w])
        spans = sum(1 for z in bytes(gone).split(b"\0") if z)
        out.append((d, len(x), sum(gone), spans, sha(bytes(y for y, g in zip(x, gone) if not g))))
    return sorted(out, key=str)


def shingles(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(x), None if d is None else root(d), None if d is None else root(d) == d) for d, x in sets), key=str)


def passages(rng, n=160):
    words = [f"w{i}é" for i in range(40)]
    shared = [[rng.choice(words) for _ in range(rng.randint(20, 80))] for _ in range(8)]
    rows = []
    for i in range(n):
        t = []
        for _ in range(rng.randint(0, 3)):
            t += [rng.choice(words) for _ in range(rng.randint(0, 50))]
            if rng.random() < .4:
                t += rng.choice(shared)[rng.randint(0, 10):rng.randint(40, 80)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(t)))
    hot = " ".join(shared[0])
    rows += [(i, hot + f" tail{i % 3} " + hot) for i in range(900, 960)]
    return rows + [(800, None), (801, ""), (802, rows[5][1]), (802, rows[5][1]), (None, rows[7][1]), (803, "a " * 200), (804, "b " * 36),
                   (805, "c" * 99), (806, "d" * 1500), (807, "d" * 300), (808, " \n"), (809, "x" * 200_000 + " y")]


@pytest.mark.parametrize("small", [False, True])
def test_word_windows(spark, rng, docs_of, monkeypatch, small):
    if small:
        monkeypatch.setattr(word_windows, "BUCKET", 100)
        monkeypatch.setattr(word_windows, "GROUP", 4000)
    rows = passages(rng)
    got = word_windows.remove_repeated(docs_of(rows), with_text=True)
    assert rows_of(got.drop("kept")) == brute_words(rows, 35)
    for r in got.where("kept is not null").collect():
        assert sha(r["kept"].encode()) == r["kept_sha256"]
    assert rows_of(word_windows.remove_repeated(docs_of(rows[:90]), window=12, period=7)) == brute_words(rows[:90], 12)


def test_difference_cover():
    for v in (1, 2, 5, 13, 21, 24):
        d = word_windows.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert len(word_windows.difference_cover(21)) == 5


@pytest.mark.parametrize("small", [False, True])
def test_byte_windows(spark, rng, docs_of, monkeypatch, small):
    if small:
        for name, value in (("BUCKET", 100), ("GROUP", 4000), ("PIECE", 2000), ("FRAGMENTS", 3000), ("MERGE", 3000)):
            monkeypatch.setattr(byte_windows, name, value)
    rows = passages(rng)
    assert rows_of(byte_windows.remove_repeated(docs_of(rows))) == brute_bytes(rows, 100)
    if small:
        assert rows_of(byte_windows.remove_repeated(docs_of(rows[:90]), length=30, gram=8)) == brute_bytes(rows[:90], 30)


def lines_around(rng, line, n):
    """Texts that share a line and little else; every fifth also shares one side of it."""
    letters = "abcdefghijklmnopqrstuvwxyz "
    side = ["".join(rng.choice(letters) for _ in range(90)) for _ in range(3)]
    fresh = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(60, 160)))
    return [(i, f"{fresh()}{rng.choice(side) if i % 5 == 0 else ''}{line}{rng.choice(side) if i % 10 == 0 else ''}{fresh()}") for i in range(n)]


@pytest.mark.parametrize("line", ["The frequent line of 40 bytes: read on.\n", "A longer line. " * 11 + "End.\n"])
def test_byte_windows_of_a_frequent_line(spark, rng, docs_of, monkeypatch, line):
    for name, value in (("HOT", 3000), ("TELL", 2), ("WINDOWS", 4000), ("PIECE", 20_000), ("GROUP", 20_000), ("FRAGMENTS", 30_000)):
        monkeypatch.setattr(byte_windows, name, value)
    rows = lines_around(rng, line, 300)
    rows += [(700, rows[0][1]), (None, rows[3][1]), (5, rows[5][1]), (701, line * 30), (702, None)] + passages(rng)[:60]
    want = brute_bytes(rows, 100)
    assert sum(r[2] > 0 for r in want) > 50
    assert rows_of(byte_windows.remove_repeated(docs_of(rows))) == want


def test_fragments_of_a_frequent_line_are_merged_nowhere(spark, rng, docs_of, monkeypatch):
    largest = []
    answer = byte_windows._answer

    def watched(length):
        run = answer(length)

        def watch(batches):
            size = {}
            for batch in batches:
                for to, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    size[to] = size.get(to, 0) + len(blob)
                yield from run(iter([batch]))
            seen.add(max(size.values(), default=0))
        return watch

    class Largest(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)

    for name, value in (("HOT", 10_000), ("PIECE", 40_000), ("GROUP", 40_000), ("FRAGMENTS", 20_000)):
        monkeypatch.setattr(byte_windows, name, value, raising=False)
    monkeypatch.setattr(byte_windows, "_answer", watched)
    for n in (200, 1600):
        seen = spark.sparkContext.accumulator(0, Largest())
        byte_windows.remove_repeated(docs_of(lines_around(rng, "The frequent line of 40 bytes: read on.\n", n))).collect()
        largest.append(seen.value)
    # eight times the texts, eight times the buckets: none grows
    assert largest[1] < 2 * max(largest[0], 20_000)


def test_merged_transforms(rng):
    for depth in [8, 8, 6, 9, 7] * 5:
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(4, 50))) for _ in range(rng.randint(1, 12))]
        _, shard = np.unique(np.sort([rng.randint(0, 3) for _ in strings]), return_inverse=True)
        first = np.concatenate(([0], np.cumsum([len(x) for x in strings])))
        entries, blocks = merged_blocks(np.frombuffer(b"".join(strings), np.uint8), first, shard, depth)
        want, got = {}, {}
        for i, x in enumerate(strings):
            for j in range(len(x) - depth + 1):
                want.setdefault(x[j:j + depth], set()).add(int(first[i]) + j)
        places = set().union(*want.values()) if want else set()
        for e, b in zip(entries, blocks):
            if int(e) in places:
                got.setdefault(int(b), set()).add(int(e))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates(spark, rng, docs_of, monkeypatch, small):
    if small:
        monkeypatch.setattr(near_dedup, "LIST", 20)
        monkeypatch.setattr(near_dedup, "PART", 3000)
    words = [f"W{i}é" for i in range(300)]
    families = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(8)]
    rows = []
    for i in range(260):
        t = [rng.choice(words) for _ in range(rng.randint(0, 50))]
        if rng.random() < .6:
            r = rng.choice([0, .01, .03, .06])
            t = [rng.choice(words) if rng.random() < r else x for x in rng.choice(families)]
        rows.append((i, " ".join(t) if rng.random() < .8 else "\n ".join(t).upper().replace("É", "é")))
    rows += [(900, None), (901, ""), (902, rows[3][1]), (902, rows[3][1]), (None, rows[3][1]), (903, "a b"), (904, "A  B"), (905, "a"),
             (906, " ".join(words * 60)), (907, " ".join(words * 60) + " z")]
    assert rows_of(near_dedup.near_duplicates(docs_of(rows))) == brute_near(rows)


def test_long_chain_component(spark):
    n = 150
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1001), (1002, 1002)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_empty_tables(spark, docs_of):
    none = docs_of([(1, "a")]).limit(0)
    for f in (word_windows.remove_repeated, byte_windows.remove_repeated, near_dedup.near_duplicates):
        assert f(none).collect() == []


def test_queries_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    q = queries()
    assert rows_of(q["op1_word_windows"](spark, sf)) == brute_words(rows, 35)
    assert rows_of(q["op7_bwt_windows"](spark, sf)) == brute_bytes(rows, 100)
    assert rows_of(q["op5_minhash"](spark, sf)) == brute_near(rows)
