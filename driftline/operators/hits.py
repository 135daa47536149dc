"""From traces to hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import traces as tr
from .clouds import drift_z
from .pads import pad_lookup
from .predicates import veto_bitflip

HIT_HEIGHT, HIT_SCALE = 40.0, 20.0


def build_hits(traces: DataFrame, pads: DataFrame, bad_events: DataFrame | None = None, bitflip_threshold: float = tr.BITFLIP_THRESHOLD, min_flips: int = 1, separation: float = tr.SEPARATION, prominence: float = tr.PROMINENCE, max_width: float = tr.MAX_WIDTH, height: float = HIT_HEIGHT) -> DataFrame:
    """Hits of all events: cleaned traces without bit flips, one hit per peak of enough height, placed by its pad and drift time.

    The integral is the sum of samples within the peak's width; peaks of unknown pads are dropped.
    """
    rows = veto_bitflip(tr.trace_scan(traces, bad_events, scale=HIT_SCALE), bitflip_threshold, min_flips)
    peaks = tr.find_peaks("cleaned", separation, prominence, max_width, tr.REL_HEIGHT, height)
    found = rows.select(*tr.KEYS, "hardware.cobo", "hardware.asad", "hardware.aget", "hardware.channel", F.col("hardware.pad").alias("fallback_pad"), "cleaned", F.explode(peaks).alias("p"))
    span = F.slice("cleaned", F.floor("p.left").cast("int") + 1, F.floor("p.right").cast("int") - F.floor("p.left").cast("int") + 1)
    found = found.withColumn("integral", F.aggregate(span, F.lit(0.0), lambda a, b: a + b)).drop("cleaned")
    placed = pad_lookup(found, pads).where("pad_id IS NOT NULL")
    order = Window.partitionBy(*tr.EVENT).orderBy("trace_id", "p.pos")
    bucket = F.col("p.pos").cast("double")
    return placed.select(*tr.EVENT, (F.row_number().over(order) - 1).alias("hit_id"), "x", "y", drift_z(bucket).alias("z"), F.col("p.height").alias("amplitude"), "integral", "pad_id", bucket.alias("time_bucket"), "scale", "trace_id", F.col("run").alias("orig_run"), F.col("event_id").alias("orig_event"))
