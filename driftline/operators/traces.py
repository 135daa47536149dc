"""Scans and per-trace projections. A traces table has (run, event_id, trace_id, hardware, samples array<double>)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals
from ..functions.arrays import arrow_rows_udf, matrix_udf
from ..sources.tables import demanded

KEYS = ["run", "event_id", "trace_id"]
EVENT = ["run", "event_id"]
THRESHOLDS = range(1, 151)

# Defaults: the slow part's scale, and what a peak needs.
SCALE, SEPARATION, PROMINENCE, MAX_WIDTH, REL_HEIGHT = 10.0, 50.0, 20.0, 50.0, 0.95
BITFLIP_THRESHOLD, SATURATION_THRESHOLD, SATURATION_DROP, SATURATION_RADIUS = 10.0, 2000.0, 10.0, 16
OSCILLATION_BIN, OSCILLATION_CUTOFF = 60, 0.6

_PEAK = "array<struct<pos:int,height:double,prominence:double,left:double,right:double,width:double>>"
_PEAK_ARROW = pa.list_(pa.struct([("pos", pa.int32()), *[(n, pa.float64()) for n in ("height", "prominence", "left", "right", "width")]]))
_SEGMENT = "array<struct<start:int,end:int,length:int,qualified:boolean,steps:array<double>>>"
_SEGMENT_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("length", pa.int32()), ("qualified", pa.bool_()), ("steps", pa.list_(pa.float64()))]))
_PLATEAU = "struct<plateau:int,drops:array<double>>"
_PLATEAU_ARROW = pa.struct([("plateau", pa.int32()), ("drops", pa.list_(pa.float64()))])


def trace_scan(traces: DataFrame, bad_events: DataFrame | None = None, run: int | None = None, scale: float = SCALE) -> DataFrame:
    """Traces of one run (or all) outside bad events, with a column ``cleaned``. Bad events go before anything is computed."""
    if run is not None:
        traces = traces.where(F.col("run") == run)
    if bad_events is not None:
        traces = traces.join(bad_events, EVENT, "left_anti")
    return traces.withColumn("cleaned", clean("samples", scale))


def map_batches(cleaned: DataFrame, handler: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A user's handler over batches of cleaned traces; it sees an iterator of frames and may leave off early."""
    return cleaned.mapInPandas(handler, schema)


def trace_lookup(traces: DataFrame, wanted: DataFrame) -> DataFrame:
    """The traces that ``wanted`` (run, event_id, trace_id and more) names, with its other columns; a trace named twice comes twice.

    Without trace_id it names events, of which all traces come. What is not there is an error, which the join's own tasks raise.
    """
    keys = KEYS if "trace_id" in wanted.columns else EVENT
    found = wanted.join(traces.withColumn("_found", F.lit(True)), keys, "left")
    missing = F.concat(F.lit("no trace "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    return demanded(found, F.coalesce("_found", F.lit(False)), missing).drop("_found")


def split_pad_row(row: Column) -> list[Column]:
    """The five hardware numbers of a stored row, and its samples."""
    hardware = F.struct(*[row[i].cast("int").alias(n) for i, n in enumerate(("cobo", "asad", "aget", "channel", "pad"))])
    return [hardware.alias("hardware"), F.slice(row, 6, F.size(row) - 5).alias("samples")]


def repair_edges(x: Column) -> Column:
    n = F.size(x)
    ends = F.concat(F.array(x[1]), F.slice(x, 2, F.greatest(n - 2, F.lit(0))), F.array(F.when(n == 2, x[1]).otherwise(F.get(x, n - 2))))
    return F.when(n >= 2, ends).otherwise(x)


@lru_cache
def _matrix(name: str, *parameters):
    function = {"clean": signals.clean, "spectrum": signals.spectrum, "mask": signals.mask_peaks, "cdf": signals.cdf_points}[name]
    return matrix_udf(lambda x: function(x, *parameters))


def _bitflip_rows(x: np.ndarray, threshold: float) -> pa.Array:
    trace, begin, end, qualified, sizes = signals.bitflip_runs(x, threshold)
    steps = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - begin)]), pa.int32()), pa.array(sizes))
    runs = pa.StructArray.from_arrays([pa.array(begin - 1, pa.int32()), pa.array(end, pa.int32()), pa.array(end - begin, pa.int32()), pa.array(qualified), steps], names=["start", "end", "length", "qualified", "steps"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(trace, np.arange(len(x) + 1)), pa.int32()), runs)


def _saturation_rows(x: np.ndarray, threshold: float, drop: float, radius: int) -> pa.Array:
    plateau, drops, sizes = signals.saturations(x, threshold, drop, radius)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(drops))
    return pa.StructArray.from_arrays([pa.array(plateau, pa.int32()), lists], names=["plateau", "drops"])


def _peak_rows(x: np.ndarray, *parameters) -> pa.Array:
    found = signals.peaks(x, *parameters)
    trace, names = found.pop("trace"), list(found)
    structs = pa.StructArray.from_arrays([pa.array(found[k], pa.int32() if k == "pos" else pa.float64()) for k in names], names=names)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(trace, np.arange(len(x) + 1)), pa.int32()), structs)


@lru_cache
def _rows(name: str, *parameters):
    """Functions of whole matrices of traces that give one value of any kind for each."""
    function, kind, arrow = {"peaks": (_peak_rows, _PEAK, _PEAK_ARROW), "bitflips": (_bitflip_rows, _SEGMENT, _SEGMENT_ARROW), "saturation": (_saturation_rows, _PLATEAU, _PLATEAU_ARROW)}[name]
    return arrow_rows_udf(lambda x: function(x, *parameters), kind, arrow)


def clean(x: str | Column, scale: float = SCALE) -> Column:
    return _matrix("clean", float(scale))(x)


def mask_peaks(x: str | Column) -> Column:
    return _matrix("mask")(x)


def spectrum(x: str | Column) -> Column:
    return _matrix("spectrum")(x)


def cdf_points(spectra: str | Column, thresholds: tuple[int, ...] = tuple(THRESHOLDS)) -> Column:
    return _matrix("cdf", tuple(thresholds))(spectra)


def cdf_value(spectra: Column, at: int = OSCILLATION_BIN) -> Column:
    """The share of the spectrum below one bin."""
    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, b: a + b)

    share = F.try_divide(total(F.slice(spectra, 1, at)), total(spectra))
    return F.when(F.size(spectra) <= at, F.when(total(spectra) > 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def find_peaks(x: str | Column, separation: float = SEPARATION, prominence: float = PROMINENCE, max_width: float = MAX_WIDTH, rel_height: float = REL_HEIGHT, height: float | None = None) -> Column:
    return _rows("peaks", float(separation), float(prominence), float(max_width), float(rel_height), height)(x)


def peak_amplitude(peaks: Column) -> Column:
    """The highest peak, 0 without one."""
    return F.coalesce(F.array_max(F.transform(peaks, lambda p: p["height"])), F.lit(0.0))


def first_derivative(x: Column) -> Column:
    """Differences of neighbours, after a leading 0."""
    n = F.size(x)
    return F.when(n < 2, F.transform(x, lambda _: F.lit(0.0))).otherwise(F.concat(F.array(F.lit(0.0)), F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda b, a: b - a)))


def second_derivative(x: Column, padded: bool = False) -> Column:
    """Both neighbours less twice the sample; ``padded`` with a 0 at either end."""
    n = F.size(x)
    inner = F.zip_with(F.zip_with(F.slice(x, 1, n - 2), F.slice(x, 3, n - 2), lambda a, c: a + c), F.slice(x, 2, n - 2), lambda s, b: s - 2 * b)
    none = F.array().cast("array<double>")
    if not padded:
        return F.when(n < 3, none).otherwise(inner)
    zero = F.array(F.lit(0.0))
    return F.when(n < 3, F.transform(x, lambda _: F.lit(0.0))).otherwise(F.concat(zero, inner, zero))


def bitflip_segments(x: str | Column, threshold: float = BITFLIP_THRESHOLD) -> Column:
    """Valid runs of the second derivative; see ``functions.signals.bitflip_segments``."""
    return _rows("bitflips", float(threshold))(x)


def bitflip_count(segments: Column) -> Column:
    return F.size(F.filter(segments, lambda s: s["qualified"]))


def saturation_stats(x: str | Column, threshold: float = SATURATION_THRESHOLD, drop: float = SATURATION_DROP, radius: int = SATURATION_RADIUS) -> Column:
    return _rows("saturation", float(threshold), float(drop), int(radius))(x)


def event_catalog(traces: DataFrame, bad_events: DataFrame) -> DataFrame:
    """Each run's events from its first to its last, with the number of traces: 0 for bad and for absent ones."""
    counts = traces.groupBy(*EVENT).agg(F.count("*").alias("n")).join(bad_events.withColumn("bad", F.lit(True)), EVENT, "left").withColumn("n", F.when(F.col("bad"), 0).otherwise(F.col("n")))
    spans = traces.groupBy("run").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    every = spans.withColumn("event_id", F.explode(F.sequence("first_event", "last_event")))
    return every.join(counts.drop("bad"), EVENT, "left").select("run", "event_id", "first_event", "last_event", F.coalesce("n", F.lit(0)).cast("long").alias("n_traces"))


def trace_neighbor(traces: DataFrame) -> DataFrame:
    """For every trace the next and the previous of its event, itself at the ends."""
    w = Window.partitionBy(*EVENT).orderBy("trace_id")
    return traces.select(*KEYS, F.coalesce(F.lead("trace_id").over(w), "trace_id").alias("next_trace"), F.coalesce(F.lag("trace_id").over(w), "trace_id").alias("previous_trace"))


#: Event ids of a bucket: neighbours are sought within buckets, then over their edges.
BUCKET = 4096


def neighbours(rows: DataFrame, *carried: str) -> DataFrame:
    """``rows`` (with run and event_id) with next and previous: the carried columns of the run's neighbouring events, null at its ends.

    A task sorts one bucket of a run's event ids. Only the first and last event of each bucket are sorted by run.
    """
    rows = rows.withColumn("_bucket", F.floor(F.col("event_id") / BUCKET))
    inside, own = Window.partitionBy("run", "_bucket").orderBy("event_id"), F.struct(*carried)
    ends = rows.groupBy("run", "_bucket").agg(F.min_by(own, "event_id").alias("_first"), F.max_by(own, "event_id").alias("_last"))
    across = Window.partitionBy("run").orderBy("_bucket")
    edges = ends.select("run", "_bucket", F.lead("_first").over(across).alias("_after"), F.lag("_last").over(across).alias("_before"))
    found = rows.withColumns({"next": F.lead(own).over(inside), "previous": F.lag(own).over(inside)}).join(edges, ["run", "_bucket"])
    return found.withColumns({"next": F.coalesce("next", "_after"), "previous": F.coalesce("previous", "_before")}).drop("_bucket", "_after", "_before")


def event_neighbor(catalog: DataFrame) -> DataFrame:
    """For every event with traces the next and the previous such event, itself at the ends, and the highest trace id of each."""
    found = neighbours(catalog.where("n_traces > 0").select(*EVENT, "n_traces"), "event_id", "n_traces")
    columns = [F.coalesce(f"{n}.event_id", "event_id").alias(f"{n}_event") for n in ("next", "previous")]
    return found.select(*EVENT, *columns, *[(F.coalesce(f"{n}.n_traces", "n_traces") - 1).alias(f"{n}_last_trace") for n in ("next", "previous")])


def trace_profile(traces: DataFrame, labels: DataFrame | None = None, scale: float = SCALE, threshold: float = BITFLIP_THRESHOLD) -> DataFrame:
    """Raw and cleaned samples, spectrum, padded derivatives, bit-flip structures (in sample positions) and label of each trace."""
    rows = traces.withColumn("cleaned", clean("samples", scale)).withColumn("_bits", bitflip_segments("cleaned", threshold))
    x = F.col("cleaned")
    out = rows.select(*KEYS, "samples", "cleaned", spectrum("cleaned").alias("spectrum"), first_derivative(x).alias("first_derivative"), second_derivative(x, True).alias("second_derivative"), F.transform(F.filter("_bits", lambda s: s["qualified"]), lambda s: F.struct((s["start"] + 1).alias("start"), (s["end"] + 1).alias("end"))).alias("bitflips"))
    return out if labels is None else join_labels(out, labels)


def join_labels(traces: DataFrame, labels: DataFrame) -> DataFrame:
    return traces.join(labels.select(*KEYS, "family", "label"), KEYS, "left")


def unlabeled_traces(traces: DataFrame, labels: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    left = traces.join(labels, KEYS, "left_anti")
    return left if shown is None else left.join(shown, KEYS, "left_anti")


def drawn(keys: list[str], seed: int) -> Column:
    """A text whose order is a random order of the keys, another one for each seed."""
    return F.md5(F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample_unlabeled_traces(traces: DataFrame, labels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` unlabelled traces: a random one from each of ``n`` random events, so that traces of small events are likelier."""
    within = Window.partitionBy(*EVENT).orderBy(drawn(KEYS, seed), "trace_id")
    one = unlabeled_traces(traces, labels).select(*KEYS).withColumn("_r", F.row_number().over(within)).where("_r = 1")
    return one.orderBy(drawn(EVENT, seed + 1), *EVENT).limit(n).select(*KEYS)
