"""Vector codes against a plain version and SQL."""

import hashlib

import duckdb
import numpy as np
import pandas as pd

from helixframe.llm import vector_codes as vc

EXTRA = ", id long, v string, code int, error string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, "e", 3) for r in rows], f"vec_id long, embedding array<float>, label int{EXTRA}").repartition(4)


def naive(rows, entries=256, rounds=4, parts=4):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], lab) for i, v, lab in rows
            if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    points = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = points[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        gap = points[:, :, None, :] - books[None]
        dist = (gap * gap).sum(3)
        best = dist.argmin(2)
        if r == rounds:
            break
        for p in range(parts):
            for e in range(books.shape[1]):
                own = points[best[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    error = dist.min(2).sum(1)
    by = {}
    for (_, _, lab), e in zip(kept, error, strict=True):
        by[lab] = by.get(lab, 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in c), int(e), by[lab], sha) for (i, _, lab), c, e in zip(kept, best, error, strict=True)), key=str)


def found(df, entries=256, cell=vc.CELL):
    codes, books = vc.encode(df, entries=entries, cell=cell)
    sha = vc.books_hash(books)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, sha) for r in vc.with_label_error(codes).collect()), key=str)


def test_vector_codes(spark):
    rng = np.random.default_rng(3)
    grid = [(i, (rng.integers(-3, 3, 8) / 8).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    wide = [(1000 + i, rng.normal(0, .2, 8).astype(np.float32).tolist(), None) for i in range(300)]
    odd = [(5, None, 1), (6, [], 1), (7, [float("nan")] * 8, 0), (8, [float("inf")] + [0.0] * 7, 0), (9, [None] + [0.0] * 7, 0), (None, [0.5] * 8, 2)]
    rows = grid + wide + odd + grid[:20] + [(3, [0.25] * 8, 1)] + [(2000 + i, [0.125] * 8, 1) for i in range(200)]
    for entries, cell in ((256, vc.CELL), (16, 1), (16, 64), (16, 100_000)):
        assert found(frame(spark, rows), entries, cell) == naive(rows, entries)
    assert found(frame(spark, rows[:5])) == naive(rows[:5])
    assert found(frame(spark, odd[:5])) == []
    assert found(frame(spark, rows).limit(0)) == []


def test_vector_codes_sql(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, .2, 8).astype(np.float32).tolist(), None if i % 5 == 0 else i % 3) for i in range(500)] + [(9, None, 1), (3, [0.0] * 8, 1)]
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(vc.codes_sql()).fetchall(), key=str) == found(frame(spark, rows)) == naive(rows)


def test_memo_forgets():
    rng = np.random.default_rng(5)
    entries, points = rng.integers(-500, 500, (64, 4)), rng.integers(-600, 600, (3000, 4))
    book = vc.Codebook(entries, 64, remember=100)
    for part in np.array_split(points, 7):
        index, distance = book.nearest(part)
        true = ((part[:, None] - entries[None]) ** 2).sum(2)
        assert index.tolist() == true.argmin(1).tolist() and distance.tolist() == true.min(1).tolist()
