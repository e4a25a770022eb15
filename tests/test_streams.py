"""Streams read a table whether it is one file or a folder of part files."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe import constants as C
from helixframe.operators.tracks import assign, frame_step_join, link_frames
from helixframe.plans import load
from helixframe.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_stream_of_a_folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    query = load()[0]["stream_genome_observables"]
    rows = lambda sf: sorted(map(str, query(spark, sf).collect()))
    assert rows(str(tmp_path)) == rows(SF) != []


def scene(spark):
    rng = np.random.default_rng(8)
    rows = []
    for ds in (0, 1):
        for k in range(5):
            p, v = rng.uniform(0, 16, 3), rng.normal(0, 2, 3)
            for t in range(24):
                q = (p + t % 6 * v + rng.normal(0, 1, 3)) / np.array(C.SCALE_ZYX)
                rows.append((ds, t * 10 + k, t, *map(float, q), float(rng.uniform(1, 9))))
    dets = spark.createDataFrame(rows, "dataset bigint, det_id bigint, t bigint, z double, y double, x double, intensity double")
    return dets.withColumn("ft", F.timestamp_seconds(1_704_067_200 + F.col("t") * 21_600))


def test_linked_stream_equals_the_batch(spark, tmp_path):
    dets = scene(spark)
    want = sorted(map(tuple, link_frames(dets).select("dataset", "src", "dst").collect()))
    # in order, and with frames that come up to three frames late
    for name, order in (("ordered", list(range(24))), ("late", [2, 0, 3, 1, 5, 6, 4, 7, 10, 9, 8, 11, 12, 15, 14, 13, 17, 16, 18, 21, 20, 19, 23, 22])):
        folder = f"{tmp_path}/{name}"
        for i in range(0, 24, 2):
            part = dets.filter(F.col("t").isin(order[i:i + 2])).coalesce(1)
            part.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(dets.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        out = J.run_to_table(J.frame_links(stream, "1 day"), f"{tmp_path}/out-{name}", "append")
        assert out.agg(F.max("version")).first()[0] > 5
        assert sorted(map(tuple, J.latest_links(out).select("dataset", "src", "dst").collect())) == want


def test_rows_after_the_watermark_are_told(spark, tmp_path):
    dets = scene(spark)
    folder = f"{tmp_path}/in"
    for t in (10, 20, 1, 21):
        dets.filter(F.col("t") == t).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(dets.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with pytest.warns(UserWarning, match="10 rows came after the watermark"):
        J.run_to_table(J.frame_links(stream, "1 day"), f"{tmp_path}/out", "append")


def test_registered_stream_equals_the_batch(spark):
    queries = load()[0]
    rows = lambda name: sorted(map(tuple, queries[name](spark, SF).select("dataset", "src", "dst").collect()))
    assert rows("stream_link_frames") == rows("link_frames") != []


class _Kept:
    """State of one key in plain memory that counts what is read."""

    def __init__(self, reads):
        self.reads, self.rows, self.at = reads, [], {}

    exists = lambda self: bool(self.rows)

    def get(self):
        self.reads.append(len(self.rows) if isinstance(self.rows, list) else 1)
        return self.rows

    def put(self, rows):
        self.rows = list(rows)

    def update(self, row):
        self.rows = row

    def appendList(self, rows):
        self.rows.extend(rows)

    def containsKey(self, k):
        return k in self.at

    def getValue(self, k):
        self.reads.append(len(self.at[k][0]) // J.DETECTION.itemsize)
        return self.at[k]

    def updateValue(self, k, v):
        self.at[k] = v

    def removeKey(self, k):
        self.at.pop(k, None)


class _Handle:
    def __init__(self):
        self.reads, self.timers = [], set()

    getListState = getMapState = getValueState = lambda self, *a: _Kept(self.reads)

    def registerTimer(self, ms):
        self.timers.add(ms)


def run_linker(pdf, chunk=10_000):
    linker, handle = J.FrameLinker(C.LINK_UM, 1000), _Handle()
    linker.init(handle)
    parts = (pdf.iloc[k:k + chunk] for k in range(0, len(pdf), chunk))
    out = list(linker.handleInputRows((0,), parts, None))
    for ms in sorted(handle.timers):
        list(linker.handleExpiredTimer((0,), None, type("E", (), {"getExpiryTimeInMs": lambda _, ms=ms: ms})()))
    return pd.concat(out), handle


def test_a_batch_of_many_frames_reads_each_a_few_times():
    rng = np.random.default_rng(3)
    n, frames = 40, 60
    pdf = pd.DataFrame({"t": np.repeat(np.arange(frames), n), "det_id": np.arange(n * frames), "intensity": rng.uniform(1, 9, n * frames),
                        **{k: rng.uniform(0, 60, n * frames) for k in "xyz"}})
    out, handle = run_linker(pdf, 500)
    assert out["src"].notna().sum() > 300 and out["t"].nunique() == frames
    # closing a frame used to read and link everything held again
    assert sum(handle.reads) < 6 * len(pdf)


def test_near_pairs_equals_all_pairs():
    rng = np.random.default_rng(4)
    for scale, r in ((30, 5.0), (1e9, 5.0), (3, 5.0)):
        a, b = np.round(rng.uniform(-scale, scale, (200, 3))), np.round(rng.uniform(-scale, scale, (300, 3)))
        b[:50] = a[:50] + [[r, 0, 0]]
        a[60], b[60] = np.nan, np.inf
        want = np.argwhere(np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)) <= r)
        assert sorted(zip(*(x.tolist() for x in J.near_pairs(a, b, r)))) == sorted(map(tuple, want.tolist())) != []
    assert len(J.near_pairs(a[:0], b, 5.0)[0]) == 0


def test_candidates_alone_are_chosen_with_the_rest():
    rng = np.random.default_rng(5)
    row, col = np.array([0, 1, 1, 2, 7]), np.array([3, 4, 5, 5, 9])
    assert sorted(assign(row, col, np.array([1.0, 1.0, 3.0, 2.5, 9.0]), 10.0).tolist()) == [0, 1, 3, 4]
    assert len(assign(row[:0], col[:0], rng.uniform(size=0), 10.0)) == 0


def test_step_stream_equals_the_batch_with_packed_state(spark, tmp_path):
    rng = np.random.default_rng(6)
    n, frames = 80, 6
    pdf = pd.DataFrame({"dataset": 1, "t": np.repeat(np.arange(frames), n), "det_id": np.arange(n * frames), "intensity": 1.0,
                        **{k: rng.uniform(-40, 60, n * frames) / s for k, s in zip("zyx", C.SCALE_ZYX, strict=True)}})
    dets = spark.createDataFrame(pdf).withColumn("ft", F.timestamp_seconds(1_704_067_200 + F.col("t") * 21_600)).cache()
    want = sorted((r.src, r.dst, round(r.d, 9)) for r in frame_step_join(dets, dets, C.STEP_UM).collect())
    for t in (1, 0, 2, 4, 3, 5):
        # two files a frame, so that a frame's later detections meet earlier ones of both neighbours
        for k in (0, 1):
            dets.filter((F.col("t") == t) & (F.col("det_id") % 2 == k)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(dets.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
    got, state = [], []
    q = J.frame_steps(stream, "1 day").writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(
        lambda b, _: got.extend((r.src, r.dst, round(r.d, 9)) for r in b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    state = [s.numRowsTotal for p in q.recentProgress for s in p.stateOperators]
    assert sorted(got) == want != []
    # the joined stream held each detection several times
    assert 0 < max(state) < n * frames / 2
