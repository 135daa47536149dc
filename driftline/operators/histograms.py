"""Trace histograms: (run, metric, mode, variant, series_key, bin_x, bin_y, count; bin_y is 0 in one dimension), for whole runs, per label, and with selected or vetoed traces."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import traces as tr
from .labels import GROUPS, join_labeled, label_counts

METRICS = ("amplitude", "baseline", "cdf", "bitflip", "saturation")
MODES = ("all", "labeled", "filtered", "veto")


# The bins of each metric's variants (of cdf, those of the value), and the names of the axes.
AXES = {
    "amplitude": {"peaks": (8192, "Amplitude", "Peak count")},
    "baseline": {"samples": (8193, "Baseline value", "Sample count")},
    "cdf": {"cdf": (100, None, None)},
    "bitflip": {
        "baseline": (8193, "Second-derivative value", "Sample count"),
        "value": (8192, "Absolute second-derivative value", "Count"),
        "length": (256, "Qualified alternating-run length", "Trace count"),
        "count": (256, "Found bitflip structures", "Trace count"),
    },
    "saturation": {"drop": (500, "Drop from local maximum", "Count"), "length": (256, "Plateau length", "Trace count")},
}


def _point(variant: str, x: Column, y: Column | None = None) -> Column:
    return F.struct(F.lit(variant).alias("variant"), x.cast("int").alias("bin_x"), (F.lit(0) if y is None else y).cast("int").alias("bin_y"))


def _near_zero(x: Column) -> Column:
    return F.greatest(F.least(F.rint(x) + 4096, F.lit(8192.0)), F.lit(0.0))


def _clipped(x: Column, most: int) -> Column:
    return F.greatest(F.least(x, F.lit(float(most))), F.lit(0.0))


def _none() -> Column:
    return F.array().cast("array<struct<variant:string,bin_x:int,bin_y:int>>")


def bins(traces: DataFrame, metric: str, **p) -> DataFrame:
    """One row per counted value: the columns of ``traces`` but samples and hardware, and variant, bin_x, bin_y. ``variant`` asks for one of several."""
    scale = p.get("scale", 20.0 if metric == "cdf" else tr.SCALE)
    rest = [c for c in traces.columns if c not in ("samples", "hardware", "cleaned")]
    x, rows = F.col("cleaned"), traces.withColumn("cleaned", tr.clean("samples", scale))
    if metric == "amplitude":
        peaks = tr.find_peaks("cleaned", p.get("separation", tr.SEPARATION), p.get("prominence", tr.PROMINENCE), p.get("max_width", tr.MAX_WIDTH))
        found = F.transform(peaks, lambda q: _point("peaks", _clipped(q["height"], 8191)))
    elif metric == "baseline":
        found = F.transform(x, lambda v: _point("samples", _near_zero(v)))
    elif metric == "cdf":
        points = tr.cdf_points(tr.spectrum("cleaned"))
        found = F.transform(points, lambda v, i: _point("cdf", i + 1, F.when(v <= 0, 0).when(v >= 1, 99).otherwise(F.floor(v * 100))))
    elif metric == "bitflip":
        rows = rows.withColumn("_bits", tr.bitflip_segments("cleaned", p.get("threshold", tr.BITFLIP_THRESHOLD)))
        good = F.filter("_bits", lambda s: s["qualified"])
        found = {
            "baseline": F.transform(tr.second_derivative(x), lambda d: _point("baseline", _near_zero(d))),
            "value": F.transform(F.flatten(F.transform("_bits", lambda s: s["steps"])), lambda v: _point("value", _clipped(v, 8191))),
            "length": F.transform(good, lambda s: _point("length", F.least(s["length"], F.lit(255)))),
            "count": F.when(F.size(good) > 0, F.array(_point("count", F.least(F.size(good), F.lit(255))))).otherwise(_none()),
        }
    elif metric == "saturation":
        rows = rows.withColumn("_sat", tr.saturation_stats("cleaned", p.get("threshold", tr.SATURATION_THRESHOLD), p.get("drop", tr.SATURATION_DROP), p.get("radius", tr.SATURATION_RADIUS)))
        length = F.col("_sat.plateau")
        found = {
            "drop": F.transform(F.filter("_sat.drops", lambda v: (v >= 0) & (v < 500)), lambda v: _point("drop", v)),
            "length": F.when(length.between(2, 255), F.array(_point("length", length))).otherwise(_none()),
        }
    else:
        raise ValueError(f"no such metric: {metric}")
    if isinstance(found, dict):
        found = F.concat(*[v for k, v in found.items() if p.get("variant") in (None, k)])
    return rows.select(*rest, F.explode(found).alias("_b")).select(*rest, "_b.*")


def histogram(metric: str, traces: DataFrame, mode: str = "all", labels: DataFrame | None = None, strange: DataFrame | None = None, filter_rows: DataFrame | None = None, **p) -> DataFrame:
    """Counts per bin. Traces are chosen before anything is computed of them.

    labeled: one series per group of labels. filtered: traces named by ``filter_rows``, as often as they are
    named. veto: all others. Only counts of bins are shuffled.
    """
    if mode == "labeled":
        chosen = join_labeled(traces, labels, strange)
    elif mode == "filtered":
        chosen = traces.join(filter_rows.select(*tr.KEYS), tr.KEYS).withColumn("series_key", F.lit("filtered"))
    elif mode == "veto":
        chosen = traces.join(filter_rows.select(*tr.KEYS), tr.KEYS, "left_anti").withColumn("series_key", F.lit("veto"))
    elif mode == "all":
        chosen = traces.withColumn("series_key", F.lit("all"))
    else:
        raise ValueError(f"no such mode: {mode}")
    if mode in ("filtered", "veto") and metric == "amplitude":
        p = {k: v for k, v in p.items() if k not in ("separation", "prominence", "max_width")}  # fixed in these modes
    if mode in ("filtered", "veto") and metric == "cdf":
        p.setdefault("scale", tr.SCALE)
    counted = bins(chosen, metric, **p).groupBy("run", "variant", "series_key", "bin_x", "bin_y").agg(F.count("*").alias("count"))
    return counted.select("run", F.lit(metric).alias("metric"), F.lit(mode).alias("mode"), "variant", "series_key", "bin_x", "bin_y", "count")


def labeled_series(histograms: DataFrame, labels: DataFrame, strange: DataFrame) -> DataFrame:
    """Read form of labelled histograms: buckets of 4 and more merged, series without labelled traces left out, with their counts."""
    merged = F.when(F.col("series_key").rlike("^normal:[4-9]$"), "normal:4+").otherwise(F.col("series_key"))
    rows = histograms.withColumn("series_key", merged).groupBy("run", "metric", "variant", "series_key", "bin_x", "bin_y").agg(F.sum("count").alias("count"))
    return rows.join(label_counts(labels, strange).where("traces > 0"), ["run", "series_key"])


def histogram_trace_count(histograms: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(run, mode, metric, series_key, traces): the known count, else for cdf the 150th part of the sum."""
    sums = histograms.groupBy("run", "mode", "metric", "series_key").agg(F.sum("count").alias("_sum"))
    if known is not None:
        sums = sums.join(known, ["run", "series_key"], "left")
    else:
        sums = sums.withColumn("traces", F.lit(None).cast("long"))
    return sums.select("run", "mode", "metric", "series_key", F.coalesce("traces", F.when(F.col("metric") == "cdf", F.floor(F.col("_sum") / 150))).alias("traces"))


def filtered_trace_count(filter_rows: DataFrame) -> DataFrame:
    """Named traces of each run, read or not, repeats included."""
    return filter_rows.groupBy("run").agg(F.count("*").alias("traces"))


class FilteredHistogram(NamedTuple):
    """Counts of bins, of which there may be none, and a row of metadata for every run and variant."""

    rows: DataFrame
    metadata: DataFrame


def filtered_histogram(metric: str, traces: DataFrame, runs: DataFrame, filter_rows: DataFrame, filter_name: str, veto: bool = False, **p) -> FilteredHistogram:
    """The histogram of traces that a filter set names, or with ``veto`` of all others, of each of ``runs``, and what it is of.

    metadata: (run, metric, mode, variant, filter_name, veto, title, trace_count, series, bin_count, bin_label, count_label,
    parameters). It outlives an empty selection, with trace_count 0 and no series. trace_count is that of the names, repeats
    included, read or not; with veto that of the traces left. Counts of traces read keys only.
    """
    mode = "veto" if veto else "filtered"
    rows = histogram(metric, traces, mode, filter_rows=filter_rows, **p)
    counts = filtered_trace_count(traces.select(*tr.KEYS).join(filter_rows.select(*tr.KEYS), tr.KEYS, "left_anti") if veto else filter_rows)
    wanted = {v: axes for v, axes in AXES[metric].items() if p.get("variant") in (None, v)}
    kind = "array<struct<variant:string,bin_count:int,bin_label:string,count_label:string>>"
    axes = F.array(*[F.struct(*map(F.lit, (v, *a))) for v, a in wanted.items()]).cast(kind)
    used = {"scale": tr.SCALE} | {k: float(v) for k, v in p.items() if isinstance(v, (int, float))}
    every = runs.select("run").distinct().join(counts, "run", "left").withColumn("trace_count", F.coalesce("traces", F.lit(0)))
    about = every.select("run", "trace_count", F.explode(axes).alias("_a")).select("run", "trace_count", "_a.*")
    title = f"{'Vetoed' if veto else 'Filtered'} traces · {filter_name}"
    parameters = F.create_map(*[F.lit(x) for k in sorted(used) for x in (k, used[k])])
    named = {"metric": F.lit(metric), "mode": F.lit(mode), "filter_name": F.lit(filter_name), "veto": F.lit(veto), "title": F.lit(title), "series": (F.col("trace_count") > 0).cast("int"), "parameters": parameters}
    order = ["run", "metric", "mode", "variant", "filter_name", "veto", "title", "trace_count", "series", "bin_count", "bin_label", "count_label", "parameters"]
    return FilteredHistogram(rows, about.withColumns(named).select(*order))


def cdf_projection(histograms: DataFrame, threshold: int) -> DataFrame:
    """The row of a cdf histogram whose threshold is nearest, the first on ties."""
    cdf = histograms.where("metric = 'cdf'")
    near = cdf.groupBy("run", "mode", "series_key").agg(F.min_by("bin_x", F.struct(F.abs(F.col("bin_x") - threshold), "bin_x")).alias("bin_x"))
    return cdf.join(near, ["run", "mode", "series_key", "bin_x"]).select("run", "mode", "series_key", F.col("bin_x").alias("threshold"), F.col("bin_y").alias("bin"), "count")


def log_counts(count: Column) -> Column:
    return F.when(count > 0, F.log10(count + 1))


def availability(histograms: DataFrame, runs: DataFrame, phases: dict[str, tuple[str, ...]], filters: DataFrame) -> DataFrame:
    """(run, metric, mode, available) for every run and the modes of each metric; filtered is available if any filter set exists."""
    modes = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(x).alias("mode")) for m, xs in phases.items() for x in xs])
    every = runs.select("run", F.explode(modes).alias("m")).select("run", "m.metric", "m.mode")
    stored = histograms.select("run", "metric", "mode").distinct().withColumn("_has", F.lit(True))
    has_filters = not filters.isEmpty()
    return every.join(stored, ["run", "metric", "mode"], "left").select("run", "metric", "mode", F.when(F.col("mode") == "filtered", F.lit(has_filters)).otherwise(F.col("_has").isNotNull()).alias("available"))


__all__ = ["AXES", "GROUPS", "METRICS", "MODES", "FilteredHistogram", "availability", "bins", "cdf_projection", "filtered_histogram", "filtered_trace_count", "histogram", "histogram_trace_count", "labeled_series", "log_counts"]
