"""Streaming queries, checked against the same SQL as their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sequences import with_densities
from ..streaming import jobs as J
from .base import BASES26, LETTERS26, R, query, r6, with_
from .codons import OBS_SQL, rounded_observables
from .files import scratch
from .tracks import CAND, DET


@query("stream_genome_observables", OBS_SQL)
def stream_genome_observables(spark, sf):
    docs = J.table_stream(spark, sf, "documents")
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    chunks = docs.select(F.col("doc_id").alias("seq_id"), F.translate(letters, LETTERS26, BASES26).alias("seq")).filter(F.length("seq") > 0)
    out = J.run_to_table(J.genome_observables(chunks), scratch(spark), "update")
    return rounded_observables(with_densities(J.latest(out, ["seq_id"])))


def detections(spark, sf):
    """Detections of the events with the start of their six-hour frame."""
    e = J.table_stream(spark, sf, "events")
    frame = F.date_trunc("DAY", F.col("ts")) + F.make_dt_interval(F.lit(0), (F.floor(F.hour("ts") / 6) * 6).cast("int"), F.lit(0), F.lit(0))
    return e.select(
        F.col("event_id").alias("det_id"), (F.col("user_id") % 4).alias("dataset"), frame.cast("timestamp").alias("ft"),
        (F.round(F.col("value") * 100).cast("bigint") % 7).alias("z"), ((F.col("user_id") % 13) * 40 + F.col("event_id") % 9).alias("y"),
        (F.floor(F.col("user_id") / 13) * 40 + F.floor(F.col("value") * 10) % 9).alias("x"), F.col("value").alias("intensity"))


@query("stream_frame_steps", with_(DET, CAND) + f"SELECT dataset, src, dst, {R('d', 'd')} FROM cand")
def stream_frame_steps(spark, sf):
    out = J.run_to_table(J.frame_steps(detections(spark, sf), "1 day"), scratch(spark), "append")
    return out.select("dataset", "src", "dst", r6("d"))


@query("stream_link_frames")
def stream_link_frames(spark, sf):
    """The links of ``link_frames``, kept up by a stateful stream."""
    out = J.run_to_table(J.frame_links(detections(spark, sf), "1 day"), scratch(spark), "append")
    return J.latest_links(out).select("dataset", "src", "dst", "d")
