"""Secondary-structure segmentation without leaving the row.

A residue's initial label depends on its letter alone, so a sequence is labelled
with ``translate``; neighbour rules are look-around regular expressions over the
label string; runs are matches of one more expression. Nothing is exploded,
sorted or shuffled until the caller wants one row per region or residue.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.bases import letters_of
from ..functions.common import col, let

MIN_HELIX = math.ceil(C.PI + 1 / (C.PI - 1))  # 4
MIN_STRAND = 3
TUNNEL = 1 / C.PHI**2


def propensity(aa: str, expanded: bool = False) -> tuple[float, float, float]:
    """Normalised helix, strand and coil weights of one letter, for literals."""
    c, p, v, aromatic, branch, hetero, _, _ = C.AA_WORDS[aa]
    if aa == "P":
        raw = (1 / C.PHI, 1 / C.PHI, C.PHI)
    elif aa == "G":
        raw = (1 / C.E, 1 / C.E, C.E)
    else:
        extra = max(branch, 0) + abs(aromatic) + abs(hetero) / C.PHI if expanded else 0.0
        raw = (C.PHI - p / (C.PI * C.PHI) - abs(c) / C.PI**2,
               math.exp((v - p + extra) / C.PI),
               math.exp((p - v + abs(c) / C.PHI) / C.PI))
    return tuple(x / sum(raw) for x in raw)


def label_of(aa: str) -> str:
    a, b, _ = propensity(aa)
    if a > 1 / C.E and a > b:
        return "H"
    return "E" if b > 1 / C.E and b > a else "C"


def is_near_tie(aa: str) -> bool:
    a, b, _ = propensity(aa)
    return (max(a, b) - min(a, b)) / max(a, b) < TUNNEL


def initial_labels(seq) -> Column:
    return F.translate(col(seq), C.AA20, "".join(label_of(a) for a in C.AA20))


def tunnel_labels(seq, mode: str = "frustrated") -> Column:
    """Near-tied residues take their neighbours' label.

    Near-tied residues are written in lower case and replaced by digits that
    still tell the initial label, so every rule sees initial neighbours only.
    """
    codes = "".join(label_of(a).lower() if is_near_tie(a) else label_of(a) for a in C.AA20)
    s = F.translate(col(seq), C.AA20, codes)
    helix, strand = "[Hh35]", "[Ee16]"
    depth = "{3}" if mode == "coherence" else ""
    agree = [("e", helix, "1"), ("c", helix, "2"), ("h", strand, "3"), ("c", strand, "4")]
    for letter, side, code in agree:
        s = F.regexp_replace(s, f"(?<={side}{depth}){letter}(?={side}{depth})", code)
    if mode == "frustrated":
        for letter, code in (("h", "5"), ("e", "6")):
            s = F.regexp_replace(
                s, f"(?<={helix}){letter}(?={strand})|(?<={strand}){letter}(?={helix})", code)
    return F.translate(s, "hec123456", "HECHHEECC")


def viterbi_labels(seq, expanded: bool = True) -> Column:
    """Best H/E/C path with a same-state bonus, as a fold over the letters.

    The state holds the three scores and the three best paths. Ties prefer H,
    then E, then C.
    """
    bonus = math.log(C.PHI) / C.PHI
    logs = F.array(*[
        F.struct(*[F.lit(math.log(x)).alias(k) for k, x in zip("hec", propensity(a, expanded))])
        for a in C.AA20
    ])
    emit = lambda x: F.get(logs, F.instr(F.lit(C.AA20), x) - 1)
    letters = letters_of(seq)

    def step(acc: Column, x: Column) -> Column:
        e = emit(x)
        fields = []
        for state in "hec":
            cand = {k: acc[k] + (bonus if k == state else 0.0) for k in "hec"}
            best = F.greatest(*cand.values())
            path = (F.when(cand["h"] == best, acc["ph"]).when(cand["e"] == best, acc["pe"])
                    .otherwise(acc["pc"]))
            fields.append((best + e[state]).alias(state))
            fields.append(F.concat(path, F.lit(state.upper())).alias(f"p{state}"))
        return F.struct(*fields)

    first = emit(F.get(letters, 0))
    init = F.struct(*[f for k in "hec" for f in (first[k].alias(k), F.lit(k.upper()).alias(f"p{k}"))])

    def finish(acc: Column) -> Column:
        best = F.greatest(acc["h"], acc["e"], acc["c"])
        return F.when(acc["h"] == best, acc["ph"]).when(acc["e"] == best, acc["pe"]).otherwise(acc["pc"])

    rest = F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0)))
    return F.when(F.length(col(seq)) == 0, "").otherwise(F.aggregate(rest, init, step, finish))


def kept(kind: Column, start: Column, end: Column) -> Column:
    n = end - start + 1
    return ((kind == "H") & (n >= MIN_HELIX)) | ((kind == "E") & (n >= MIN_STRAND))


def run_array(labels) -> Column:
    """All maximal runs as (kind, start, end), in one linear pass."""
    def runs(letters: Column) -> Column:
        n = F.size(letters)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(letters, i) != F.get(letters, F.greatest(i - 1, F.lit(0)))),
        )
        return let(starts, lambda st: F.transform(st, lambda s, k: F.struct(
            F.get(letters, s).alias("kind"), s.alias("start"),
            (F.coalesce(F.get(st, k + 1), n) - 1).alias("end"))))

    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return F.when(F.length(col(labels)) == 0, empty).otherwise(let(letters_of(labels), runs))


def region_array(labels) -> Column:
    """Runs long enough to be a region, numbered in order."""
    found = F.filter(run_array(labels), lambda r: kept(r["kind"], r["start"], r["end"]))
    return F.transform(found, lambda r, k: F.struct(
        k.alias("region"), r["kind"].alias("kind"), r["start"].alias("start"), r["end"].alias("end")))


def residue_regions(labels) -> Column:
    """Region struct of every residue in order; NULL outside regions."""
    def paint(r: Column) -> Column:
        region = F.when(kept(r["kind"], r["start"], r["end"]), r)
        return F.array_repeat(region, r["end"] - r["start"] + 1)

    return F.flatten(F.transform(run_array(labels), paint))


def membership_array(labels) -> Column:
    """Numbered region of every residue in order, as ``region_array`` counts them; NULL outside regions."""
    none = F.lit(None).cast("struct<region:int,kind:string,start:int,end:int>")

    def paint(found: Column, n: Column) -> Column:
        before = lambda k: F.coalesce(F.get(found, k - 1)["end"], F.lit(-1))
        parts = F.transform(found, lambda r, k: F.concat(
            F.array_repeat(none, r["start"] - before(k) - 1), F.array_repeat(r, r["end"] - r["start"] + 1)))
        return F.concat(F.flatten(parts), F.array_repeat(none, n - 1 - before(F.size(found))))

    return let(col(labels), lambda s: let(region_array(s), lambda found: paint(found, F.length(s))))


def sequence_membership(seqs: DataFrame, mode: str = "frustrated") -> DataFrame:
    """Every residue with the region that holds it, as ``region_membership`` gives it for ``detect_regions``, without leaving the row."""
    labels = viterbi_labels("seq") if mode == "viterbi" else tunnel_labels("seq", mode)
    both = F.arrays_zip(letters_of("seq").alias("aa"), membership_array(labels).alias("r"))
    return (seqs.filter(F.length("seq") > 0).select("seq_id", F.posexplode(both).alias("pos", "p"))
            .select("seq_id", "pos", F.col("p.aa").alias("aa"), *[F.col(f"p.r.{k}").alias(k) for k in ("region", "kind", "start", "end")]))


def painted(labels) -> Column:
    """Labels with runs too short to be a region turned to coil, same length."""
    s = col(labels)
    for letter, shortest in (("H", MIN_HELIX), ("E", MIN_STRAND)):
        for k in range(1, shortest):
            s = F.regexp_replace(s, f"(?<!{letter}){letter}{{{k}}}(?!{letter})", "C" * k)
    return s


def _regions(batches):
    """The regions of each row's labels; the starts of runs are found in one pass over the bytes."""
    for batch in batches:
        at, parts = [], [[] for _ in range(4)]
        for k, s in enumerate(batch.column("labels").to_pylist()):
            if not s:
                continue
            x = np.frombuffer(s.encode(), np.uint8)
            start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            end = np.r_[start[1:], len(x)] - 1
            n, kind = end - start + 1, x[start]
            keep = ((kind == ord("H")) & (n >= MIN_HELIX)) | ((kind == ord("E")) & (n >= MIN_STRAND))
            for part, v in zip(parts, (np.arange(keep.sum()), kind[keep], start[keep], end[keep])):
                part.append(v)
            at.append(np.full(keep.sum(), k))
        flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (at, *parts)]
        region, start, end = (pa.array(v.astype(np.int32)) for v in (flat[1], flat[3], flat[4]))
        kind = pa.array(np.where(flat[2] == ord("H"), "H", "E").tolist(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("seq_id").take(pa.array(flat[0].astype(np.int64))), region, kind, start, end],
                                         ["seq_id", "region", "kind", "start", "end"])


def detect_regions(seqs: DataFrame, mode: str = "frustrated") -> DataFrame:
    """One row per region: (seq_id, region, kind, start, end), 0-based inclusive."""
    labels = viterbi_labels("seq") if mode == "viterbi" else tunnel_labels("seq", mode)
    kind = seqs.schema["seq_id"].dataType.simpleString()
    return seqs.select("seq_id", labels.alias("labels")).mapInArrow(_regions, f"seq_id {kind}, region int, kind string, `start` int, `end` int")


def label_sequence(seqs: DataFrame, cooperative: bool = False) -> DataFrame:
    labels = viterbi_labels("seq") if cooperative else tunnel_labels("seq")
    return (seqs.select("seq_id", "seq", labels.alias("labels"))
            .select("seq_id", "seq", painted("labels").alias("labels")))


def region_membership(residues: DataFrame, regions: DataFrame) -> DataFrame:
    """Attach the last region covering each residue.

    Intervals are cut into fixed-size blocks, so the join is an equi-join on
    (seq_id, block) instead of a range scan.
    """
    block = 64
    cut = regions.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
    joined = residues.withColumn("block", F.floor(F.col("pos") / block)).join(
        cut.select("seq_id", "block", "region", "kind", "start", "end"), ["seq_id", "block"], "left"
    )
    hit = F.col("pos").between(F.col("start"), F.col("end"))
    keep = F.when(hit, F.struct("region", "kind", "start", "end"))
    keys = residues.columns
    return (joined.groupBy(*keys).agg(F.max_by(keep, F.when(hit, F.col("region"))).alias("r"))
            .select(*keys, "r.region", "r.kind", "r.start", "r.end"))
