"""Top-k search, WARC, mixing, the pipeline and the registered SQL."""

import math
import os
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import mixing, topk, warc
from helixframe.llm.queries import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return v.tolist() if hasattr(v, "tolist") else v


@pytest.mark.parametrize("key", sorted(oracles()))
def test_matches_sql(spark, key):
    df = queries()[key](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(oracles()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert sorted(str([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(str([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


def brute_topk(rows, k=5, every=50):
    fine = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in fine:
        if i % every == 0:
            own = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in fine if j != i and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("cell", [(16384, 4096), (40, 2)])
def test_topk(spark, rng, cell):
    base = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    rows += [(i, [x + rng.gauss(0, .1) for x in base]) for i in range(300, 360)] + [(i, base) for i in range(400, 460)]
    rows += [(500, None), (550, []), (600, [1.0, None] * 8), (601, [float("nan")] + [0.0] * 15), (602, [float("inf")] * 16), (650, [1.0, 2.0]), (651, [2.0, 1.0]),
             (450, base), (700, [0.0] * 16), (None, base)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score long")
    got = topk.search(df, candidates=cell[0], queries=cell[1])
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_topk(rows)
    assert topk.search(df.limit(0)).collect() == []


def test_warc(spark, tmp_path, rng):
    hot = "<p>same</p>"
    rows = [(i, f"http://x/{i} ä\n?q=<>", "".join(rng.choice("abc<é>") for _ in range(rng.randint(0, 4000)))) for i in range(80)]
    rows += [(i, None, hot) for i in range(100, 160)] + [(200, "u", None), (201, "u", ""), (None, "u", "alone"), (None, "u", hot), (202, "u", "twice"), (202, "u", "twice"),
                                                         (203, "u", "z" * 500_000)]
    df = spark.createDataFrame([(i, u, h, "d") for i, u, h in rows], "page_id long, url string, html string, digest string")
    folder, manifest = warc.write_archive(df.repartition(4), f"file://{tmp_path}/a", shard_bytes=20_000, file_bytes=8_000)
    names = sorted(r["file"] for r in manifest.collect())
    files = sorted(f for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))
    assert files == names and len(files) > 5
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, folder).collect())
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        p, first = (h or "").encode(), last[h or ""]
        response = (-1 if i is None else i) == first and not (i == 202 and want[(202, 5, warc.digest32(p), "response", None)])
        want[(i, len(p), warc.digest32(p), "response" if response else "revisit", None if response else first)] += 1
    assert got == want
    texts = {r["page_id"]: r["payload"] for r in warc.read_archive(spark, folder, True).where("record_type = 'response'").collect()}
    assert all(texts[i] == (h or "").encode() for i, _, h in rows[:80] if last[h or ""] == i)
    # the same bytes from other partitions, and files outside the manifest are not read
    folder2, _ = warc.write_archive(df.repartition(7), f"file://{tmp_path}/b", shard_bytes=20_000, file_bytes=8_000)
    assert all((tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() for f in files)
    (tmp_path / "b" / "shard-99999999-00000.warc.gz").write_bytes(b"partial")
    assert warc.read_archive(spark, folder2).count() == len(rows)
    large = warc.write_archive(df, f"file://{tmp_path}/c", least=100)[0]
    assert warc.read_archive(spark, large).where("record_type = 'revisit'").count() == 0
    assert warc.read_archive(spark, warc.write_archive(df.limit(0), f"file://{tmp_path}/d")[0]).collect() == []


def test_mix(spark, docs_of, rng):
    rows = [(i, "w " * int(rng.paretovariate(1) * 5), rng.choice(["a"] * 6 + ["b", "c", "é", None])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "empty"), (902, "x y", "tiny"), (902, "x y", "tiny"), (None, "x y z", "a"), (903, "w " * 20_000, "long")]
    docs = docs_of(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    largest = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] <= 2 * sizes[r["source"]] + 1e-9
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    out = mixing.emit(docs)
    assert out.columns == [*docs.columns, "copy"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({d: n for d, n in ((k, sum(r["copies"] for r in got if r["doc_id"] == k)) for k in {r["doc_id"] for r in got}) if n})
    assert mixing.mix(docs.limit(0)).collect() == []


def test_pipeline_stages(spark, tmp_path, docs_of):
    from test_dedup import brute_near
    from test_text import brute_contained

    sf = str(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    item = bench.first()["text"]
    extra = spark.createDataFrame([(5000, f"Well. {item} And more.", "en", "src1", 1), (5001, "mail a@b.cd of the thing", "en", None, 1), (5002, None, "en", "src1", None),
                                   (None, "thon of the ander", None, "src2", 3), (5003, "", None, None, 0)], docs.schema)
    extra = extra.union(extra.where("doc_id = 5001"))
    docs.union(extra).write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = kept.collect()
        path = f"{sf}/out-{name}"
        stage(spark, kept, sf).write.parquet(path)
        kept = spark.read.parquet(path)
        rows = kept.collect()
        if name != "mix":
            assert kept.columns == docs.columns
        ids = Counter(r["doc_id"] for r in rows)
        if name == "quality":
            left = {r["doc_id"] for r in rows}
            right = [(q == 1) == (d in left) for d, q in truth.items() if zlib.crc32(str(d).encode()) % 5 == 0]
            assert sum(right) >= .9 * len(right)
        elif name == "near_dedup":
            near = brute_near([(r["doc_id"], r["text"]) for r in before], 80)
            assert ids == Counter({**{d: 1 for d, _, _, k in near if k}, **({None: n} if (n := sum(r["doc_id"] is None for r in before)) else {})})
        elif name == "decontaminate":
            held = {d for d, *_ in brute_contained([(r["doc_id"], r["text"]) for r in before], [(r["item_id"], r["text"]) for r in bench.collect()])}
            assert 5000 in held and ids == Counter(r["doc_id"] for r in before if r["doc_id"] not in held)
        elif name == "pii":
            assert len(rows) == len(before) and not any("a@b.cd" in (r["text"] or "") for r in rows)
            assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in rows)
        else:
            assert sum(len((r["text"] or "").split()) for r in rows) > sum(len((r["text"] or "").split()) for r in before)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, rows))


def test_pipeline_judges_rows(spark, tmp_path):
    """Repeated ids with different texts, overlaps between 80 and 85 per cent, clashing columns and a very long text."""
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words[:100])
    near = " ".join([*words[:90], *words[200:208]])  # 86 of 104 shingles
    clean = " ".join(words[300:360])
    item = " ".join(words[360:380])
    rows = [(1, text, "a", 7), (2, near, "a", 1), (3, clean, "b", 2), (3, text, "b", 1), (4, " ".join(words[208:260]), "b", 9), (4, f"{item} and more", "a", 3), (5, item, None, 0), (6, clean + " x", "a", 5),
            (7, "long " + " ".join(f"v{i}" for i in range(100_000)), "a", 5), (8, " ".join(words[260:290]), "a", 1), (8, " ".join(words[260:290]), "a", 2), (None, text, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int").withColumns({"row": F.lit("r"), "Score": F.lit(1.5), "kept": F.lit(True), "label": F.lit(2)})
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    once = stage["near_dedup"](spark, docs, str(tmp_path))
    got = sorted(((r["doc_id"], (r["text"] or "")[:9], r["copy"]) for r in once.collect()), key=str)
    # of the near copies {1, 2, 3: text}, {3: clean, 6} and {4: item, 5} the repeated id comes first
    assert got == sorted([(3, clean[:9], 2), (3, text[:9], 1), (4, rows[4][1][:9], 9), (4, item[:9], 3), (7, "long v0 v", 5), (8, rows[9][1][:9], 1), (None, text[:9], 1)], key=str)
    assert once.columns == docs.columns
    left = stage["decontaminate"](spark, once, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["copy"]) for r in left.collect()) == [(0, 1), (3, 1), (3, 2), (4, 9), (7, 5), (8, 1)]
    mixed = stage["mix"](spark, stage["pii"](spark, left, str(tmp_path)), str(tmp_path))
    mixed.write.parquet(f"{tmp_path}/mixed")
    assert mixed.columns == [*docs.columns, "copy_1"]


def test_pipeline_on_nothing(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
