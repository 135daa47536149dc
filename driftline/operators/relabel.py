"""Relabelling of labelled traces by what their signals show, and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import traces as tr
from .labels import label_key

NOISE_AMPLITUDE = 40.0
TARGETS = {"noise": "normal:0", "oscillation": "strange:oscillation", "saturation": "strange:saturation"}


def relabel(kind: str, traces: DataFrame, labels: DataFrame, scale: float = tr.SCALE, **p) -> DataFrame:
    """(run, event_id, trace_id, old_label, new_label) of every labelled trace that exists.

    noise: no peak of 40 or more. oscillation: a qualified bit flip (``min_count``). saturation: a plateau of 2 (``min_plateau``).
    """
    rows = traces.join(labels.select(*tr.KEYS, label_key(F.col("family"), F.col("label")).alias("old_label")), tr.KEYS).withColumn("cleaned", tr.clean("samples", scale))
    if kind == "noise":
        peaks = tr.find_peaks("cleaned", p.get("separation", tr.SEPARATION), p.get("prominence", tr.PROMINENCE), p.get("max_width", tr.MAX_WIDTH))
        hit = tr.peak_amplitude(peaks) < NOISE_AMPLITUDE
    elif kind == "oscillation":
        hit = tr.bitflip_count(tr.bitflip_segments("cleaned", p.get("threshold", tr.BITFLIP_THRESHOLD))) >= p.get("min_count", 1)
    elif kind == "saturation":
        hit = tr.saturation_stats("cleaned", p.get("threshold", tr.SATURATION_THRESHOLD), p.get("drop", tr.SATURATION_DROP))["plateau"] >= p.get("min_plateau", 2)
    else:
        raise ValueError(f"no such relabelling: {kind}")
    return rows.select(*tr.KEYS, "old_label", F.when(hit, TARGETS[kind]).otherwise(F.col("old_label")).alias("new_label"))


def relabel_metrics(kind: str, rows: DataFrame) -> DataFrame:
    """(source, target, numerator, denominator, ratio): labels that stayed the target, and normal:1 that became it."""
    target = TARGETS[kind]
    counts = rows.agg(*[x for i, source in enumerate((target, "normal:1")) for x in (F.count_if((F.col("old_label") == source) & (F.col("new_label") == target)).alias(f"n{i}"), F.count_if(F.col("old_label") == source).alias(f"d{i}"))])
    out = counts.select(F.explode(F.array(*[F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"), F.col(f"n{i}").alias("numerator"), F.col(f"d{i}").alias("denominator")) for i, source in enumerate((target, "normal:1"))])).alias("m"))
    return out.select("m.*").withColumn("ratio", F.try_divide("numerator", "denominator"))


def relabel_confusions(kind: str, rows: DataFrame) -> DataFrame:
    """Keys of target labels that were lost and of normal:1 that became the target, with their section."""
    target = TARGETS[kind]
    lost = (F.col("old_label") == target) & (F.col("new_label") != target)
    won = (F.col("old_label") == "normal:1") & (F.col("new_label") == target)
    section = F.when(lost, f"old {target} -> not {target}").when(won, f"old normal:1 -> new {target}")
    return rows.select(section.alias("section"), *tr.KEYS).where("section IS NOT NULL")
