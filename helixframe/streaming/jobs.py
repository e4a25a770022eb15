"""Structured Streaming jobs over file sources."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .. import constants as C
from ..operators.sequences import COUNTS, base_counts
from ..operators.spatial import CELL, with_cell
from ..operators.tracks import step_links, to_um


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder, one file or many, as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a pattern for this one name: a stream takes a plain path for a folder only
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def genome_observables(chunks: DataFrame) -> DataFrame:
    """Running totals per sequence over a stream of (seq_id, seq) chunks."""
    return base_counts(chunks).groupBy("seq_id").agg(*[F.sum(k).alias(k) for k in COUNTS])


LINK_ROWS = "dataset long, t long, version long, src long, dst long, d double"
#: A detection of a frame, and the place of the parent of one, as they lie in the state.
DETECTION = np.dtype([("det_id", "<i8"), *((k, "<f8") for k in ("x", "y", "z", "intensity"))])
PARENT = np.dtype([("det_id", "<i8"), *((k, "<f8") for k in ("pz", "py", "px"))])
#: Rows of a batch that are kept in memory before they go to the state.
WAITING = 1_000_000


def _dense(v: np.ndarray) -> np.ndarray:
    """Cell numbers from 1 up without wide gaps; neighbours stay neighbours and others do not become ones."""
    u, at = np.unique(v, return_inverse=True)
    return np.concatenate([[1], 1 + np.cumsum(np.minimum(np.diff(u), 2))]).astype(np.int64)[at]


def near_pairs(a: np.ndarray, b: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of points within r, by grid cells.

    The points of ``b`` are sorted by cell, so the three cells along the last axis are one range of them.
    """
    at, bt = (np.flatnonzero(np.isfinite(p).all(axis=1)) for p in (a, b))
    if not len(at) or not len(bt):
        return np.empty(0, int), np.empty(0, int)
    cells = np.floor(np.concatenate([a[at], b[bt]]) / (r * (1 + 1e-9)))
    ca, cb = np.split(np.column_stack([_dense(c) for c in cells.T]), [len(at)])
    wide = np.maximum(ca.max(axis=0), cb.max(axis=0)) + 2
    known, place = np.unique(cb[:, 0] * wide[1] + cb[:, 1], return_inverse=True)
    key = place * wide[2] + cb[:, 2]
    order = np.argsort(key, kind="stable")
    key = key[order]
    left, right = [], []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            column = (ca[:, 0] + dx) * wide[1] + ca[:, 1] + dy
            k = np.minimum(np.searchsorted(known, column), len(known) - 1)
            i = np.flatnonzero(known[k] == column)
            mid = k[i] * wide[2] + ca[i, 2]
            lo, hi = np.searchsorted(key, mid - 1, "left"), np.searchsorted(key, mid + 1, "right")
            n = hi - lo
            left.append(np.repeat(i, n))
            right.append(order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
    left, right = at[np.concatenate(left)], bt[np.concatenate(right)]
    near = np.sqrt(((a[left] - b[right]) ** 2).sum(axis=1)) <= r
    return left[near], right[near]


def _packed(columns: pd.DataFrame, kind: np.dtype) -> bytes:
    out = np.empty(len(columns), kind)
    for k in kind.names:
        out[k] = columns[k].to_numpy()
    return out.tobytes()


STEP_ROWS = "dataset long, src long, dst long, d double"
#: Side of a tile of the step stream, in radii, and the rows that one of its output batches may hold.
TILE, OUT_ROWS = 64.0, 100_000
#: A detection in a tile; ``home`` tells the tile it lies in from those it only comes near to.
TILED = np.dtype([("det_id", "<i8"), *((k, "<f8") for k in "xyz"), ("home", "?")])


class StepFinder(StatefulProcessor):
    """Pairs of detections in consecutive frames of one tile, within the radius.

    The state holds a tile's open frames, each packed in one value. A batch meets what it brings with the frames before and after, old and new, so
    every pair is written once, when its later detection comes. Frames that can have no more partners leave the state.
    """

    def __init__(self, r: float, step_ms: int):
        self.r, self.step_ms = r, step_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long")
        self.frames = handle.getMapState("frames", "t long", "rows binary")

    def _held(self) -> set[int]:
        return {int(r[0]) for r in self.held.get()} if self.held.exists() else set()

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        a = a[a["home"]]
        if not len(a) or not len(b):
            return []
        i, j = near_pairs(*(np.column_stack([p[k] for k in "xyz"]) for p in (a, b)), self.r)
        return [(a["det_id"][i], b["det_id"][j], np.sqrt(sum((a[k][i] - b[k][j]) ** 2 for k in "xyz")))]

    def _drop(self, held: set[int], end_ms: int) -> None:
        """Forget the frames whose next one is over at ``end_ms``."""
        gone = {t for t in held if (t + 2) * self.step_ms <= end_ms}
        for t in gone:
            self.frames.removeKey((t,))
        if gone == held:
            self.held.clear()
        elif gone:
            self.held.put([(t,) for t in sorted(held - gone)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts: dict[int, list[bytes]] = {}
        for pdf in rows:
            for t, part in pdf.groupby("t"):
                parts.setdefault(int(t), []).append(_packed(part, TILED))
        new = {t: np.frombuffer(b"".join(p), TILED) for t, p in parts.items()}
        held, none = self._held(), np.empty(0, TILED)
        near = {t + k for t in new for k in (-1, 0, 1)}
        old = {t: np.frombuffer(bytes(self.frames.getValue((t,))[0]), TILED) for t in held & near}
        out, n = [], 0
        for t in sorted(near):
            late, after = new.get(t + 1, none), old.get(t + 1, none)
            found = self._pairs(new.get(t, none), np.concatenate([after, late])) + self._pairs(old.get(t, none), late)
            out, n = out + found, n + sum(len(f[0]) for f in found)
            if n >= OUT_ROWS:
                yield self._rows(key, out)
                out, n = [], 0
        if n:
            yield self._rows(key, out)
        for t, rows_ in new.items():
            self.frames.updateValue((t,), (old[t].tobytes() + rows_.tobytes() if t in old else rows_.tobytes(),))
        held |= new.keys()
        self.held.put([(t,) for t in sorted(held)])
        self.handle.registerTimer((max(held) + 2) * self.step_ms)
        self._drop(held, timerValues.getCurrentWatermarkInMs())

    def _rows(self, key, found: list[tuple]) -> pd.DataFrame:
        src, dst, d = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.DataFrame({"dataset": key[0], "src": src, "dst": dst, "d": d})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._drop(self._held(), expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass


def frame_steps(dets: DataFrame, delay: str, step_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """Detections of a stream with those one frame later, within the gate.

    ``dets`` has an event time ``ft`` at the start of its frame; frames are ``step_ms`` long. Space is cut into wide tiles, and a detection
    is sent to every tile it comes within the gate of, so a pair meets in the tile of its first detection.
    """
    timed = dets.withWatermark("ft", delay).withColumn("t", F.floor(F.unix_millis("ft") / step_ms))
    points = to_um(timed, "", "dataset", "ft", "t", "det_id").dropna(subset=["dataset", "t", "det_id", *"xyz"])
    tiles = with_cell(points, "", C.STEP_UM, spread=True, side=TILE)
    home = [F.floor(F.col(k) / (C.STEP_UM * TILE)) == F.col(c) for k, c in zip("xyz", CELL)]
    rocksdb(dets.sparkSession)
    return (tiles.withColumn("home", home[0] & home[1] & home[2]).groupBy("dataset", *CELL)
            .transformWithStateInPandas(StepFinder(C.STEP_UM, step_ms), STEP_ROWS, outputMode="append", timeMode="eventTime"))


def rocksdb(spark: SparkSession) -> None:
    """The state store that arbitrary state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FrameLinker(StatefulProcessor):
    """Links of one dataset's open frames, with the places of the parents of their detections.

    The state holds the frames that the watermark has not passed and the one before them, each under its own keys, and the parents of each
    frame. A batch links the steps that its detections touch, two frames in memory at a time, and those after them as long as the
    parents differ from what was known, and writes their links with a higher version. So a detection that comes late, but within the delay, changes what
    follows from it and nothing else is done again. A timer at the end of each frame closes it: what is before it leaves the state.
    """

    def __init__(self, gate: float, step_ms: int):
        self.gate, self.step_ms = gate, step_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long, parts long")
        self.frames = handle.getMapState("frames", "t long, part long", "rows binary")
        self.parents = handle.getMapState("parents", "t long", "rows binary")
        self.version = handle.getValueState("version", "n long")

    def _held(self) -> dict[int, int]:
        return {int(r[0]): int(r[1]) for r in self.held.get()} if self.held.exists() else {}

    def _frame(self, t: int, parts: int) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(self.frames.getValue((t, k))[0]) for k in range(parts)), DETECTION)

    def _parents(self, t: int) -> bytes:
        return bytes(self.parents.getValue((t,))[0]) if self.parents.containsKey((t,)) else b""

    def _step(self, t: int, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        i, j = near_pairs(*(np.column_stack([p[k] for k in "xyz"]) for p in (a, b)), C.STEP_UM)
        left, right = a[i], b[j]
        part = {"t": t, "src": left["det_id"], "dst": right["det_id"], "li": left["intensity"], "ri": right["intensity"], "gate": self.gate, "dataset": 0}
        for k in "zyx":
            part[f"l{k}"], part[f"r{k}"] = left[k], right[k]
        return pd.DataFrame({**part, "d": np.sqrt(sum((left[k] - right[k]) ** 2 for k in "xyz"))})

    def _store(self, held: dict[int, int], waiting: dict[int, list[bytes]]) -> None:
        for t, parts in waiting.items():
            self.frames.updateValue((t, held.get(t, 0)), (b"".join(parts),))
            held[t] = held.get(t, 0) + 1
        waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, new, waiting, n = self._held(), set(), {}, 0
        for pdf in rows:
            for t, part in pdf.groupby("t"):
                waiting.setdefault(int(t), []).append(_packed(part, DETECTION))
            new.update(waiting)
            n += len(pdf)
            if n >= WAITING:
                self._store(held, waiting)
                n = 0
        self._store(held, waiting)
        self.held.put(sorted(held.items()))
        for t in new:
            self.handle.registerTimer((t + 1) * self.step_ms)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        ready, changed = (None, None), None
        for t in sorted(held):
            if not (t in new or t + 1 in new or t == changed):
                continue
            links, frame = None, None
            if t + 1 in held:
                own = np.frombuffer(self._parents(t), PARENT)
                frame = self._frame(t + 1, held[t + 1])
                before = ready[1] if ready[0] == t else self._frame(t, held[t])
                links = step_links(self._step(t, before, frame), dict(zip(own["det_id"].tolist(), zip(*(own[k].tolist() for k in ("pz", "py", "px")), strict=True), strict=True)))
                after = _packed(links.rename(columns={"dst": "det_id"}).sort_values("det_id"), PARENT)
                if after != self._parents(t + 1):
                    self.parents.updateValue((t + 1,), (after,))
                    changed = t + 1
            ready = (t + 1, frame)
            # a step without links still says so: an earlier version may have had some
            out = links[["src", "dst", "d"]] if links is not None and len(links) else pd.DataFrame({"src": [None], "dst": [None], "d": [None]})
            out = out.assign(dataset=key[0], t=t, version=version)[["dataset", "t", "version", "src", "dst", "d"]]
            yield out.astype({"src": "Int64", "dst": "Int64", "d": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = expiredTimerInfo.getExpiryTimeInMs() // self.step_ms - 1
        held = self._held()
        # the frame and its parents stay until the next one closes: what comes may still be linked to it
        gone = [t for t in held if t < last]
        for t in gone:
            for part in range(held.pop(t)):
                self.frames.removeKey((t, part))
            self.parents.removeKey((t,))
        if gone:
            self.held.put(sorted(held.items()))
        return iter(())

    def close(self) -> None:
        pass


def frame_links(dets: DataFrame, delay: str, gate: float = C.LINK_UM, step_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """Motion-predicted one-to-one links of a stream of detections, as versions of each step's links.

    ``dets`` has an event time ``ft`` at the start of its frame; frames are ``step_ms`` long. A detection may come up to ``delay`` after later
    ones; what is later is dropped by the watermark and counted by ``run_to_table``. ``latest_links`` keeps the last version of each step.
    """
    points = to_um(dets.withColumn("t", F.floor(F.unix_millis("ft") / step_ms)), "", "dataset", "ft", "t", "det_id", "intensity")
    rocksdb(dets.sparkSession)
    return (points.withWatermark("ft", delay).groupBy("dataset")
            .transformWithStateInPandas(FrameLinker(gate, step_ms), LINK_ROWS, outputMode="append", timeMode="eventTime"))


def latest_links(versions: DataFrame) -> DataFrame:
    """The last version of each step's links."""
    top = versions.groupBy("dataset", "t").agg(F.max("version").alias("version"))
    return versions.join(top, ["dataset", "t", "version"]).filter(F.col("src").isNotNull()).select("dataset", "t", "src", "dst", "d")


def late_rows(query) -> int:
    """Rows that the watermark dropped in the batches of a query."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def run_to_table(stream: DataFrame, out: str, mode: str) -> DataFrame:
    """Process what is available, writing each batch to a folder; returns the written table.

    Rows that came too late for the watermark are told by a warning.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/data/id={batch_id}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{out}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if late := late_rows(q):
        warnings.warn(f"{late} rows came after the watermark and were dropped", stacklevel=2)
    spark = stream.sparkSession
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{out}/data/id=*")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key."""
    cols = [c for c in updates.columns if c not in (*keys, "batch", "id")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*keys, "r.*")
