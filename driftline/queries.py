"""Registered queries over the bound tables, one per operator, and the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lines import FindParams
from .operators import clouds, hits, histograms, labels, pads, predicates, probing, relabel
from .operators import traces as tr
from .sources import bind, runs, tables
from .sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The bound traces are small signals: thresholds that fit them.
FLIP, SAT, DROP = 50.0, 200.0, 20.0
KEYS = "run, event_id, trace_id"


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {bind.BINDINGS}{',' + ctes if ctes else ''}\n{sql}"
        return f

    return register


def _traces(s: SparkSession, d: str) -> DataFrame:
    return bind.traces(s, d)


def _good(s: SparkSession, d: str) -> DataFrame:
    rows = bind.traces(s, d)
    return rows.join(bind.bad_events(rows), tr.EVENT, "left_anti")


def _cleaned(s: SparkSession, d: str, scale: float = 10.0) -> DataFrame:
    return bind.traces(s, d).withColumn("cleaned", tr.clean("samples", scale))


def _long(rows: DataFrame, column: str, digits: int | None = None) -> DataFrame:
    out = rows.select(*tr.KEYS, F.posexplode(column).alias("i", "value"))
    return out if digits is None else out.withColumn("value", F.round("value", digits) + 0.0)


GOOD = "good AS (SELECT * FROM samples ANTI JOIN bad_events USING (run, event_id))"
CLEAN = bind.cleaned_sql(10)
CLEAN20 = bind.cleaned_sql(20)
D2 = f"d2 AS (SELECT {KEYS}, i - 1 AS p, n, d FROM (SELECT {KEYS}, i, n, lag(x) OVER w + lead(x) OVER w - 2 * x AS d FROM cleaned WINDOW w AS (PARTITION BY {KEYS} ORDER BY i)) WHERE i BETWEEN 1 AND n - 2)"
STEPS = "[61, 121, 450, 512, 574, 902, 1024, 3584, 3646, 4096]"
RUNS = f"""
_large AS (SELECT *, p - row_number() OVER (PARTITION BY {KEYS} ORDER BY p) AS island FROM d2 WHERE abs(d) > {FLIP}),
_signs AS (SELECT *, coalesce((d > 0) <> (lag(d) OVER (PARTITION BY {KEYS}, island ORDER BY p) > 0), true) AS turns, len(list_filter({STEPS}, lambda s: abs(abs(d) - s) <= 15)) > 0 AS near FROM _large),
flips AS (
  SELECT {KEYS}, island, CAST(min(p) - 1 AS INT) AS a, CAST(max(p) + 1 AS INT) AS b, CAST(count(*) AS INT) AS length, bool_and(near) AS qualified FROM _signs
  GROUP BY {KEYS}, island HAVING min(p) > 0 AND max(p) < max(n) - 3 AND count(*) >= 2 AND bool_and(turns)),
keys AS (SELECT DISTINCT {KEYS} FROM samples),
flip_count AS (SELECT {KEYS}, CAST(coalesce(sum(CAST(qualified AS INT)), 0) AS INT) AS flips FROM keys LEFT JOIN flips USING ({KEYS}) GROUP BY {KEYS})"""
SPECTRUM = f"""
spectra AS (
  SELECT {KEYS}, n, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2)) AS s
  FROM (SELECT *, unnest(range(n // 2 + 1)) AS k FROM cleaned) GROUP BY {KEYS}, n, k)"""
CDF = f"""
_sums AS (SELECT {KEYS}, k, n // 2 + 1 AS bins, sum(s) OVER (PARTITION BY {KEYS} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below, sum(s) OVER (PARTITION BY {KEYS}) AS total FROM spectra),
cdf AS (
  SELECT {KEYS}, t, CASE WHEN t >= bins THEN 1.0 ELSE coalesce(below, 0) / total END AS v
  FROM (SELECT DISTINCT {KEYS}, bins, t FROM _sums, (SELECT CAST(unnest(range(1, 151)) AS INT) AS t)) LEFT JOIN (SELECT {KEYS}, k AS t, below, total FROM _sums) USING ({KEYS}, t))"""
SATURATION = f"""
_top AS (SELECT *, max(x) OVER (PARTITION BY {KEYS}) AS top FROM cleaned),
_at AS (SELECT *, min(CASE WHEN x = top THEN i END) OVER (PARTITION BY {KEYS}) AS m FROM _top),
_edges AS (SELECT {KEYS}, max(CASE WHEN i < m AND top - x > {DROP} THEN i END) AS l, min(CASE WHEN i > m AND top - x > {DROP} THEN i END) AS r, any_value(n) AS n, any_value(top) AS top FROM _at GROUP BY {KEYS}),
plateaus AS (SELECT {KEYS}, top, CAST(CASE WHEN top < {SAT} THEN 0 ELSE coalesce(r, n) - coalesce(l + 1, 0) END AS INT) AS plateau FROM _edges),
drops AS (SELECT {KEYS}, i, top - x AS dr FROM _at WHERE top >= {SAT} AND abs(i - m) <= 16)"""


def _peaks_sql(separation: float = 50, prominence: float = 20, width: float = 50, height: float | None = None) -> str:
    """CTEs that end in peaks(run, event_id, trace_id, pos, height, prominence, l, r)."""
    return f"""
_xs AS (SELECT {KEYS}, any_value(n) AS n, list(x ORDER BY i) AS xs FROM cleaned GROUP BY {KEYS}),
_cand AS (SELECT {KEYS}, i, x FROM (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM cleaned WINDOW w AS (PARTITION BY {KEYS} ORDER BY i)) WHERE x > a AND x > b{'' if height is None else f' AND x >= {height}'}),
_ordered AS (SELECT {KEYS}, list(i ORDER BY x DESC, i DESC) AS c FROM _cand GROUP BY {KEYS}),
_far AS (SELECT {KEYS}, unnest(list_reduce(c, lambda kept, y: CASE WHEN len(list_filter(kept, lambda k: abs(k - y) < {separation})) > 0 THEN kept ELSE kept || [y] END, CAST([] AS INT[]))) AS pos FROM _ordered),
_reach AS (SELECT f.*, n, xs, xs[pos + 1] AS h, coalesce(list_max(list_filter(range(pos), lambda j: xs[j + 1] > xs[pos + 1])) + 1, 0) AS a, coalesce(list_min(list_filter(range(pos + 1, n), lambda j: xs[j + 1] > xs[pos + 1])) - 1, n - 1) AS b FROM _far f JOIN _xs USING ({KEYS})),
_base AS (SELECT *, list_min(xs[a + 1:pos + 1]) AS lm, list_min(xs[pos + 1:b + 1]) AS rm FROM _reach),
_rise AS (SELECT *, h - greatest(lm, rm) AS prominence, list_max(list_filter(range(a, pos + 1), lambda j: xs[j + 1] = lm)) AS lb, list_min(list_filter(range(pos, b + 1), lambda j: xs[j + 1] = rm)) AS rb FROM _base),
_cut AS (SELECT *, h - CAST(0.95 AS DOUBLE) * prominence AS cut FROM _rise WHERE prominence >= {prominence}),
_cross AS (SELECT *, coalesce(list_max(list_filter(range(lb, pos + 1), lambda j: xs[j + 1] <= cut)), lb) AS lj, coalesce(list_min(list_filter(range(pos, rb + 1), lambda j: xs[j + 1] <= cut)), rb) AS rj FROM _cut),
_ends AS (SELECT *, CASE WHEN xs[lj + 1] < cut THEN lj + (cut - xs[lj + 1]) / (xs[lj + 2] - xs[lj + 1]) ELSE lj END AS l, CASE WHEN xs[rj + 1] < cut THEN rj - (cut - xs[rj + 1]) / (xs[rj] - xs[rj + 1]) ELSE rj END AS r FROM _cross),
peaks AS (SELECT {KEYS}, CAST(pos AS INT) AS pos, h AS height, prominence, l, r FROM _ends WHERE r - l BETWEEN 1 AND {width}),
amplitudes AS (SELECT {KEYS}, coalesce(max(height), 0) AS amp FROM (SELECT DISTINCT {KEYS} FROM samples) LEFT JOIN peaks USING ({KEYS}) GROUP BY {KEYS})"""


PEAKS = _peaks_sql()

# --- scans -----------------------------------------------------------------------------------------------------------


@query("trace_scan", f"SELECT {KEYS}, i, round(x, 4) + 0.0 AS value FROM cleaned", f"{GOOD}, {bind.cleaned_sql(10, 'good')}")
def trace_scan(s, d):
    rows = _traces(s, d)
    return _long(tr.trace_scan(rows, bind.bad_events(rows)), "cleaned", 4)


@query("trace_lookup", f"SELECT pos, {KEYS}, len(list(v)) AS samples, sum(v) AS total FROM filter_rows JOIN samples USING ({KEYS}) GROUP BY pos, {KEYS}")
def trace_lookup(s, d):
    found = tr.trace_lookup(_traces(s, d), bind.filter_rows(s, d).select(*tr.KEYS, "pos"))
    return found.select("pos", *tr.KEYS, F.size("samples").cast("long").alias("samples"), F.aggregate("samples", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("event_traces", f"SELECT {KEYS}, sum(v) AS total FROM samples SEMI JOIN filter_rows USING (run, event_id) GROUP BY {KEYS}")
def event_traces(s, d):
    """All traces of the events that a filter set names."""
    found = tr.trace_lookup(_traces(s, d), bind.filter_rows(s, d).select(*tr.EVENT).distinct())
    return found.select(*tr.KEYS, F.aggregate("samples", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("labeled_trace_scan", f"SELECT {KEYS}, family, label, sum(v) AS total FROM samples JOIN trace_labels USING ({KEYS}) GROUP BY ALL")
def labeled_trace_scan(s, d):
    rows = _traces(s, d).join(labels.label_scan(bind.trace_labels(s, d)), tr.KEYS)
    return rows.select(*tr.KEYS, "family", "label", F.aggregate("samples", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("run_catalog", "SELECT run, printf('run_%04d', run) AS name, '/data/' || printf('run_%04d', run) || '.h5' AS path FROM (SELECT DISTINCT run FROM trace_keys)")
def run_catalog(s, d):
    files = _traces(s, d).select("run").distinct().select(F.concat(F.lit("/data/"), tables.run_name(F.col("run")), F.lit(".h5")).alias("path"))
    return tables.run_catalog(files)


def _stored(s, d) -> str:
    path = shared_folder(s, "runs")
    runs.write_traces(_traces(s, d), path)
    return path


@query("run_files", "SELECT run, printf('run_%04d', run) AS name, printf('run_%04d.parquet', run) AS file, count(*) AS traces FROM trace_keys GROUP BY run")
def run_files(s, d):
    path = _stored(s, d)
    counts = runs.read_runs(s, path).groupBy("run").agg(F.count("*").alias("traces"))
    return runs.run_files(s, path, "parquet").select("run", "name", "file").join(counts, "run")


@query("run_file_scan", f"SELECT {KEYS}, sum(v) AS total FROM samples WHERE run = 2 GROUP BY {KEYS}")
def run_file_scan(s, d):
    return runs.read_runs(s, _stored(s, d), 2).select(*tr.KEYS, F.aggregate("samples", F.lit(0.0), lambda a, b: a + b).alias("total"))


CATALOG = "spans AS (SELECT run, min(event_id) AS first_event, max(event_id) AS last_event FROM trace_keys GROUP BY run), catalog AS (SELECT s.run, CAST(e AS BIGINT) AS event_id, first_event, last_event, CASE WHEN e % 11 = 10 THEN 0 ELSE (SELECT count(*) FROM trace_keys t WHERE t.run = s.run AND t.event_id = e) END AS n_traces FROM (SELECT *, unnest(range(first_event, last_event + 1)) AS e FROM spans) s)"


@query("event_catalog", "SELECT * FROM catalog", CATALOG)
def event_catalog(s, d):
    rows = _traces(s, d)
    return tr.event_catalog(rows, bind.bad_events(rows))


@query("hit_scan", "SELECT run, event_id, hit_id, x, round(y, 6) + 0.0 AS y, round(z, 6) AS z, amplitude, pad_id, trace_id FROM hits")
def hit_scan(s, d):
    return bind.hits(s, d).select("run", "event_id", "hit_id", "x", (F.round("y", 6) + 0.0).alias("y"), F.round("z", 6).alias("z"), "amplitude", "pad_id", "trace_id")


@query("processing_params", "SELECT run, coalesce(max(CASE WHEN key = 'detector_length' THEN value END), 1000.0)::DOUBLE AS detector_length, coalesce(max(CASE WHEN key = 'window_time_bucket' THEN value END), 560.0)::DOUBLE AS window_time_bucket FROM cloud_events LEFT JOIN (SELECT run, 'detector_length' AS key, max(z) AS value FROM hits WHERE run = 1 GROUP BY run) USING (run) GROUP BY run")
def processing_params(s, d):
    stored = bind.hits(s, d).where("run = 1").groupBy("run").agg(F.lit("detector_length").alias("key"), F.max("z").alias("value"))
    return tables.processing_params(bind.cloud_events(s, d).select("run").distinct(), stored, {"detector_length": 1000.0, "window_time_bucket": 560.0})


CENTROIDS = "centroids AS (SELECT *, -x AS cy, CASE WHEN direction = 0 THEN -y + CAST(4.908235 AS DOUBLE) * sqrt(3) / 6 * scale ELSE -y - CAST(4.908235 AS DOUBLE) * sqrt(3) / 6 * scale END AS cx FROM pads)"


@query("pad_scan", "SELECT pad, x, y, scale, direction, cobo, asad, aget, channel, round(cy, 6) + 0.0 AS cy, round(cx, 6) AS cx FROM centroids", CENTROIDS)
def pad_scan(s, d):
    path = shared_folder(s, "pads")
    tables.write_pads(pads.pad_centroid(bind.pads(s, d)).select("pad", "x", "y", "scale", "direction", "cobo", "asad", "aget", "channel", "cy", "cx"), path)
    return pads.pad_scan(s, f"{path}/csv").withColumn("cy", F.round("cy", 6) + 0.0).withColumn("cx", F.round("cx", 6))


@query("filter_rows_scan", f"SELECT filter_name, pos, {KEYS} FROM filter_rows")
def filter_rows_scan(s, d):
    return tables.filter_rows_scan(bind.filter_rows(s, d), _traces(s, d).select("run").distinct())


@query("label_scan", f"SELECT {KEYS}, family, label FROM trace_labels WHERE run = 1")
def label_scan(s, d):
    return labels.label_scan(bind.trace_labels(s, d), 1)


@query("event_label_scan", "SELECT * FROM event_labels WHERE run = 2 AND label = '6+'")
def event_label_scan(s, d):
    return labels.label_scan(bind.event_labels(s, d), 2, "6+")


# --- projections -----------------------------------------------------------------------------------------------------


@query("split_pad_row", f"SELECT {KEYS}, CAST(_p // 1000 AS INT) AS cobo, CAST(vec_id % 100 AS INT) AS pad, 64::INT AS n, v AS first FROM trace_keys JOIN (SELECT * FROM samples WHERE i = 0) USING ({KEYS})")
def split_pad_row(s, d):
    stored = _traces(s, d).select(*tr.KEYS, F.concat(F.array(*[F.col(f"hardware.{n}").cast("double") for n in ("cobo", "asad", "aget", "channel", "pad")]), "samples").alias("row"))
    rows = stored.select(*tr.KEYS, *tr.split_pad_row(F.col("row")))
    return rows.select(*tr.KEYS, "hardware.cobo", "hardware.pad", F.size("samples").alias("n"), F.col("samples")[0].alias("first"))


@query("repair_edges", f"SELECT {KEYS}, i, v AS value FROM _edge", CLEAN)
def repair_edges(s, d):
    return _long(_traces(s, d).withColumn("x", tr.repair_edges(F.col("samples"))), "x")


@query("mask_peaks", f"SELECT {KEYS}, i, round(b, 6) + 0.0 AS value FROM masked", CLEAN)
def mask_peaks(s, d):
    return _long(_traces(s, d).withColumn("x", tr.mask_peaks(tr.repair_edges(F.col("samples")))), "x", 6)


@query("clean_trace", f"SELECT {KEYS}, i, round(x, 4) + 0.0 AS value FROM cleaned", CLEAN)
def clean_trace(s, d):
    return _long(_cleaned(s, d), "cleaned", 4)


@query("spectrum", f"SELECT {KEYS}, CAST(k AS INT) AS i, round(s, 4) + 0.0 AS value FROM spectra", f"{CLEAN}, {SPECTRUM}")
def spectrum(s, d):
    return _long(_cleaned(s, d).withColumn("x", tr.spectrum("cleaned")), "x", 4)


@query("cdf_points", f"SELECT {KEYS}, t - 1 AS i, round(v, 6) AS value FROM cdf", f"{CLEAN}, {SPECTRUM}, {CDF}")
def cdf_points(s, d):
    return _long(_cleaned(s, d).withColumn("x", tr.cdf_points(tr.spectrum("cleaned"))), "x", 6)


@query("cdf_value", f"SELECT {KEYS}, round(v, 6) AS value FROM cdf WHERE t = 20", f"{CLEAN}, {SPECTRUM}, {CDF}")
def cdf_value(s, d):
    return _cleaned(s, d).withColumn("s", tr.spectrum("cleaned")).select(*tr.KEYS, F.round(tr.cdf_value(F.col("s"), 20), 6).alias("value"))


@query("find_peaks", f"SELECT {KEYS}, pos, round(height, 4) AS height, round(prominence, 4) AS prominence, round(r - l, 4) AS width FROM peaks", f"{CLEAN}, {PEAKS}")
def find_peaks(s, d):
    rows = _cleaned(s, d).select(*tr.KEYS, F.explode(tr.find_peaks("cleaned")).alias("p"))
    return rows.select(*tr.KEYS, "p.pos", *[F.round(f"p.{n}", 4).alias(n) for n in ("height", "prominence", "width")])


@query("peak_amplitude", f"SELECT {KEYS}, round(amp, 4) AS amplitude FROM amplitudes", f"{CLEAN}, {PEAKS}")
def peak_amplitude(s, d):
    return _cleaned(s, d).withColumn("p", tr.find_peaks("cleaned")).select(*tr.KEYS, F.round(tr.peak_amplitude(F.col("p")), 4).alias("amplitude"))


@query("first_derivative", f"SELECT {KEYS}, i, coalesce(v - lag(v) OVER (PARTITION BY {KEYS} ORDER BY i), 0) AS value FROM samples")
def first_derivative(s, d):
    return _long(_traces(s, d).withColumn("x", tr.first_derivative(F.col("samples"))), "x")


@query("second_derivative", f"SELECT {KEYS}, i, coalesce(lag(v) OVER w + lead(v) OVER w - 2 * v, 0) AS value FROM samples WINDOW w AS (PARTITION BY {KEYS} ORDER BY i)")
def second_derivative(s, d):
    return _long(_traces(s, d).withColumn("x", tr.second_derivative(F.col("samples"), True)), "x")


@query("bitflip_segments", f"SELECT {KEYS}, a AS start, b AS \"end\", length, qualified FROM flips", f"{CLEAN}, {D2}, {RUNS}")
def bitflip_segments(s, d):
    rows = _cleaned(s, d).select(*tr.KEYS, F.explode(tr.bitflip_segments("cleaned", FLIP)).alias("b"))
    return rows.select(*tr.KEYS, "b.start", "b.end", "b.length", "b.qualified")


@query("bitflip_count", f"SELECT {KEYS}, flips FROM flip_count", f"{CLEAN}, {D2}, {RUNS}")
def bitflip_count(s, d):
    return _cleaned(s, d).withColumn("b", tr.bitflip_segments("cleaned", FLIP)).select(*tr.KEYS, tr.bitflip_count(F.col("b")).alias("flips"))


@query("saturation_stats", f"SELECT {KEYS}, plateau, n_drops, round(total, 4) + 0.0 AS drop_sum FROM plateaus JOIN (SELECT {KEYS}, CAST(count(dr) AS INT) AS n_drops, coalesce(sum(dr), 0) AS total FROM plateaus LEFT JOIN drops USING ({KEYS}) GROUP BY {KEYS}) USING ({KEYS})", f"{CLEAN}, {SATURATION}")
def saturation_stats(s, d):
    rows = _cleaned(s, d).withColumn("t", tr.saturation_stats("cleaned", SAT, DROP))
    return rows.select(*tr.KEYS, "t.plateau", F.size("t.drops").alias("n_drops"), (F.round(F.aggregate("t.drops", F.lit(0.0), lambda a, b: a + b), 4) + 0.0).alias("drop_sum"))


@query("trace_profile", f"SELECT {KEYS}, family, label, flips, round(s.s, 4) AS mean_weight FROM keys JOIN flip_count USING ({KEYS}) LEFT JOIN trace_labels USING ({KEYS}) JOIN spectra s USING ({KEYS}) WHERE k = 1", f"{CLEAN}, {D2}, {RUNS}, {SPECTRUM}")
def trace_profile(s, d):
    rows = tr.trace_profile(_traces(s, d), bind.trace_labels(s, d), threshold=FLIP)
    return rows.select(*tr.KEYS, "family", "label", F.size("bitflips").alias("flips"), F.round(F.col("spectrum")[1], 4).alias("mean_weight"))


# --- filters ---------------------------------------------------------------------------------------------------------


def _filter(s, d, *p, limit=0):
    rows = _traces(s, d)
    return predicates.filter_traces(rows, p, bind.bad_events(rows), limit=limit)


NOT_BAD = "event_id % 11 <> 10"


@query("filter_amplitude", f"SELECT {KEYS} FROM amplitudes WHERE amp BETWEEN 100 AND 250 AND {NOT_BAD}", f"{CLEAN}, {PEAKS}")
def filter_amplitude(s, d):
    return _filter(s, d, predicates.Amplitude(100, 250))


@query("filter_cdf", f"SELECT {KEYS} FROM cdf WHERE t = 20 AND v < 0.6 AND {NOT_BAD}", f"{CLEAN}, {SPECTRUM}, {CDF}")
def filter_cdf(s, d):
    return _filter(s, d, predicates.Oscillation(20))  # the bound spectra have 33 bins


@query("filter_bitflip", f"SELECT {KEYS} FROM flip_count WHERE flips >= 1 AND {NOT_BAD}", f"{CLEAN}, {D2}, {RUNS}")
def filter_bitflip(s, d):
    return _filter(s, d, predicates.BitFlip(FLIP))


@query("filter_saturation", f"SELECT {KEYS} FROM plateaus WHERE plateau >= 2 AND {NOT_BAD}", f"{CLEAN}, {SATURATION}")
def filter_saturation(s, d):
    return _filter(s, d, predicates.Saturation(SAT, DROP))


@query("filter_traces", f"SELECT {KEYS} FROM amplitudes JOIN plateaus USING ({KEYS}) WHERE amp BETWEEN 100 AND 1000 AND plateau >= 2 AND {NOT_BAD} ORDER BY {KEYS} LIMIT 1000", f"{CLEAN}, {PEAKS}, {SATURATION}")
def filter_traces(s, d):
    return _filter(s, d, predicates.Amplitude(100, 1000), predicates.Saturation(SAT, DROP), limit=1000)


class Swing(NamedTuple):
    """A predicate of a user's own: more than ``least`` between the lowest and the highest sample."""

    least: float

    def column(self, cleaned: Column) -> Column:
        return F.array_max(cleaned) - F.array_min(cleaned) > self.least

    def token(self) -> str:
        return f"swing_{self.least:.0f}"


@query("trace_predicate", f"SELECT 'filter_run_0001_swing_500' AS name, {KEYS} FROM cleaned WHERE run = 1 AND {NOT_BAD} GROUP BY {KEYS} HAVING max(x) - min(x) > 500", CLEAN)
def trace_predicate(s, d):
    rows, own = _traces(s, d), [Swing(500)]
    found = predicates.filter_traces(rows, own, bind.bad_events(rows), run=1, limit=0)
    return found.select(F.lit(predicates.filter_name(1, own)).alias("name"), *tr.KEYS)


@query("batch_handler", f"SELECT {KEYS}, round(max(x), 4) AS top FROM cleaned GROUP BY {KEYS}", CLEAN)
def batch_handler(s, d):
    def tops(frames):
        for frame in frames:
            yield frame[tr.KEYS].assign(top=[round(float(x.max()), 4) for x in frame["cleaned"]])

    return tr.map_batches(_cleaned(s, d).select(*tr.KEYS, "cleaned"), tops, "run int, event_id long, trace_id int, top double")


_STOP, _WAVE = 340, 4


@query("batch_handler_stop", f"""
SELECT {KEYS}, round(top, 4) AS top, (SELECT count(DISTINCT (run, event_id)) FROM tops, halt WHERE run < halt_run OR run = halt_run AND event_id - low < wave) AS events_read
FROM tops, halt WHERE run < halt_run OR run = halt_run AND event_id <= halt_event""", f"""
{GOOD}, {bind.cleaned_sql(10, 'good')}, tops AS (SELECT {KEYS}, max(x) AS top FROM cleaned GROUP BY {KEYS}),
halt AS (
  SELECT run AS halt_run, event_id AS halt_event, low, {_WAVE} * (power(2, floor(log2((event_id - low) / {_WAVE}::DOUBLE + 1)) + 1) - 1) AS wave
  FROM tops JOIN (SELECT run, min(event_id) AS low FROM trace_keys GROUP BY run) USING (run) WHERE top > {_STOP} ORDER BY run, event_id LIMIT 1)""")
def batch_handler_stop(s, d):
    """The highest samples of each event's traces, up to the first event with one over a limit; later waves of events are never read."""
    def tops(event):
        top = [float(x.max()) for x in event["cleaned"]]
        return event[tr.KEYS].assign(top=[round(x, 4) for x in top]), max(top) <= _STOP

    rows = runs.read_runs(s, _stored(s, d))
    scan = probing.scan_until(rows, tops, "run int, event_id long, trace_id int, top double", bind.bad_events(rows), first_wave=_WAVE, growth=2)
    return scan.rows.withColumn("events_read", F.lit(scan.events).cast("long"))


@query("filter_review", f"SELECT {KEYS} FROM trace_labels WHERE run = 1 AND family = 'normal' AND label IN ('4', '5', '6', '7', '8', '9')")
def filter_review(s, d):
    return labels.filter_review(bind.trace_labels(s, d), 1, "normal", "4+")


@query("filter_hits_z", "SELECT run, event_id, hit_id, round(z, 6) AS z FROM hits WHERE z BETWEEN 0 AND 500")
def filter_hits_z(s, d):
    return clouds.filter_hits_z(bind.hits(s, d), 500.0).select("run", "event_id", "hit_id", F.round("z", 6).alias("z"))


@query("veto_bitflip", f"SELECT {KEYS} FROM flip_count WHERE flips < 1", f"{CLEAN}, {D2}, {RUNS}")
def veto_bitflip(s, d):
    return predicates.veto_bitflip(_cleaned(s, d), FLIP).select(*tr.KEYS)


# --- joins -----------------------------------------------------------------------------------------------------------


@query("join_labels", f"SELECT {KEYS}, family, label FROM trace_keys LEFT JOIN trace_labels USING ({KEYS})")
def join_labels(s, d):
    return tr.join_labels(_traces(s, d).select(*tr.KEYS), bind.trace_labels(s, d))


DIMENSION = "dimension AS (SELECT CAST(pos AS INT) AS pos, 'normal:' || g AS series_key, g || CASE WHEN g IN ('0', '1') THEN ' peak' ELSE ' peaks' END AS title FROM (VALUES (0, '0'), (1, '1'), (2, '2'), (3, '3'), (4, '4+')) t(pos, g) UNION ALL SELECT CAST(row_number() OVER (ORDER BY lower(name), name) + 4 AS INT), 'strange:' || name, name FROM strange_labels)"
GROUPED = f"{DIMENSION}, grouped AS (SELECT {KEYS}, CASE WHEN family = 'normal' AND label IN ('4', '5', '6', '7', '8', '9') THEN 'normal:4+' ELSE family || ':' || label END AS series_key FROM trace_labels), labeled AS (SELECT * FROM grouped SEMI JOIN dimension USING (series_key))"


@query("join_labeled", f"SELECT {KEYS}, series_key FROM trace_keys JOIN labeled USING ({KEYS})", GROUPED)
def join_labeled(s, d):
    return labels.join_labeled(_traces(s, d).select(*tr.KEYS), bind.trace_labels(s, d), bind.strange_labels(s, d))


@query("filter_select", f"SELECT {KEYS}, sum(v) AS total, pos FROM filter_rows JOIN samples USING ({KEYS}) GROUP BY {KEYS}, pos")
def filter_select(s, d):
    rows = bind.filter_rows(s, d).join(_traces(s, d), tr.KEYS)
    return rows.select(*tr.KEYS, F.aggregate("samples", F.lit(0.0), lambda a, b: a + b).alias("total"), "pos")


@query("filter_veto", f"SELECT {KEYS} FROM trace_keys ANTI JOIN filter_rows USING ({KEYS})")
def filter_veto(s, d):
    return _traces(s, d).select(*tr.KEYS).join(bind.filter_rows(s, d), tr.KEYS, "left_anti")


@query("unlabeled_traces", f"SELECT {KEYS} FROM trace_keys ANTI JOIN trace_labels USING ({KEYS}) ANTI JOIN filter_rows USING ({KEYS})")
def unlabeled_traces(s, d):
    return tr.unlabeled_traces(_traces(s, d).select(*tr.KEYS), bind.trace_labels(s, d), bind.filter_rows(s, d))


EVENT_SPAN = "event_span AS (SELECT run, CAST(unnest(range(min(event_id), max(event_id) + 1)) AS BIGINT) AS event_id FROM cloud_events GROUP BY run)"


@query("unlabeled_events", "SELECT run, event_id FROM event_span ANTI JOIN event_labels USING (run, event_id)", EVENT_SPAN)
def unlabeled_events(s, d):
    return labels.unlabeled_events(bind.cloud_events(s, d), bind.event_labels(s, d))


@query("pad_lookup", f"SELECT {KEYS}, coalesce(a.pad, b.pad) AS pad_id, round(CASE WHEN a.pad IS NULL THEN b.cx ELSE a.cx END, 6) AS x, coalesce(a.scale, b.scale) AS scale FROM trace_keys k LEFT JOIN centroids a ON a.cobo = _p // 1000 AND a.asad = _p // 100 % 10 AND a.aget = _p // 10 % 10 AND a.channel = _p % 10 AND a.pad = _last.pad LEFT JOIN centroids b ON b.pad = k.vec_id % 100".replace("AND a.pad = _last.pad", "AND a.last"), CENTROIDS.replace("SELECT *, -x", "SELECT *, row_number() OVER (PARTITION BY cobo, asad, aget, channel ORDER BY pad DESC) = 1 AS last, -x"))
def pad_lookup(s, d):
    rows = _traces(s, d).select(*tr.KEYS, "hardware.cobo", "hardware.asad", "hardware.aget", "hardware.channel", F.col("hardware.pad").alias("fallback_pad"))
    return pads.pad_lookup(rows, pads.pad_centroid(bind.pads(s, d))).select(*tr.KEYS, "pad_id", F.round("x", 6).alias("x"), "scale")


@query("pad_map_join", "SELECT pad, x, y, scale, direction, CASE WHEN pad % 5 > 0 THEN cobo ELSE -1 END AS cobo, CASE WHEN pad % 5 > 0 THEN channel ELSE -1 END AS channel FROM pads")
def pad_map_join(s, d):
    p = bind.pads(s, d)
    channels = p.select("pad", "cobo", "asad", "aget", "channel", F.when(F.col("pad") % 5 > 0, "pad").otherwise("reference").alias("keyword"))
    return pads.pad_map_join(p.select("pad", "x", "y"), p.select("pad", "scale"), p.select("pad", "direction"), channels).select("pad", "x", "y", "scale", "direction", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("cobo", "channel")])


@query("pad_map_files", "SELECT CAST(row_number() OVER (ORDER BY pad) - 1 AS INT) AS pad, x, y, scale, direction, CASE WHEN pad % 5 > 0 THEN cobo ELSE -1 END AS cobo, CASE WHEN pad % 5 > 0 THEN channel ELSE -1 END AS channel FROM pads")
def pad_map_files(s, d):
    """The parts are written without pad numbers, so that the order of rows alone joins them."""
    p, path = bind.pads(s, d), shared_folder(s, "pad-parts")
    for name, columns in (("xy", ["x", "y"]), ("scale", ["scale"]), ("direction", ["direction"])):
        p.orderBy("pad").select(*columns).write.csv(f"{path}/{name}", header=True)
    least = p.agg(F.min("pad")).first()[0]
    named = p.select("cobo", "asad", "aget", F.col("channel").alias("aget channel"), (F.col("pad") - least).alias("det channel"), F.when(F.col("pad") % 5 > 0, "pad").otherwise("reference").alias("det keyword"))
    named.write.csv(f"{path}/channels", header=True)
    found = pads.pad_map_from_files(s, f"{path}/xy", f"{path}/scale", f"{path}/channels", f"{path}/direction")
    return found.select("pad", "x", "y", "scale", "direction", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("cobo", "channel")])


@query("pad_centroid", "SELECT pad, round(cx, 6) AS cx, round(cy, 6) + 0.0 AS cy FROM centroids", CENTROIDS)
def pad_centroid(s, d):
    return pads.pad_centroid(bind.pads(s, d)).select("pad", F.round("cx", 6).alias("cx"), (F.round("cy", 6) + 0.0).alias("cy"))


PAIRS = "cells AS (SELECT *, floor(x / 12) AS i, floor(y / 12) AS j FROM pads), pairs AS (SELECT a.pad, b.pad AS pad2, a.scale AS scale, b.scale AS scale2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance, a.scale + b.scale AS scale_sum FROM (SELECT *, unnest([-1, 0, 1]) AS di FROM cells) a0 JOIN (SELECT unnest([-1, 0, 1]) AS dj) ON true JOIN cells b ON b.i = a0.i + di AND b.j = a0.j + dj JOIN pads a ON a.pad = a0.pad WHERE a.pad <> b.pad AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 12)"
NEIGHBORS = f"{PAIRS}, neighbors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pad ORDER BY distance, pad2) AS rank FROM pairs) WHERE rank <= 12)"


@query("pad_pairs", "SELECT pad, pad2, round(distance, 6) AS distance, scale_sum FROM pairs WHERE scale = scale2", PAIRS)
def pad_pairs(s, d):
    return pads.pad_pairs(bind.pads(s, d), 12.0).withColumn("distance", F.round("distance", 6))


@query("pad_neighbors", "SELECT pad, pad2, CAST(rank AS INT) AS rank, round(distance, 6) AS distance FROM neighbors", NEIGHBORS)
def pad_neighbors(s, d):
    return pads.pad_neighbors(pads.pad_pairs(bind.pads(s, d), 12.0, False), 12).select("pad", "pad2", "rank", F.round("distance", 6).alias("distance"))


@query("pad_distance_classes", "SELECT scale_sum, count(*) AS pairs, round(min(distance), 6) AS least, round(max(distance), 6) AS most FROM neighbors GROUP BY scale_sum", NEIGHBORS)
def pad_distance_classes(s, d):
    near = pads.pad_neighbors(pads.pad_pairs(bind.pads(s, d), 12.0, False), 12)
    return pads.pad_distance_classes(near).withColumn("least", F.round("least", 6)).withColumn("most", F.round("most", 6))


@query("first_match_rules", "SELECT pad, CASE WHEN cobo = 0 AND channel = 3 THEN 'red' WHEN asad = 1 THEN 'blue' WHEN cobo = 0 THEN 'green' ELSE 'gray' END AS color FROM pads")
def first_match_rules(s, d):
    rules = s.sql("SELECT * FROM VALUES (0, '0', '*', '*', '3', 'red'), (1, '*', '1', '*', '*', 'blue'), (2, '0', '*', '*', '*', 'green') AS r(pos, cobo, asad, aget, channel, color)")
    return pads.first_match_rules(bind.pads(s, d), rules, "gray")


@query("trace_hits", f"SELECT run, event_id, trace_id, pos, total, coalesce(n_hits, 0) AS n_hits, round(coalesce(charge, 0), 4) AS charge FROM (SELECT {KEYS}, min(pos) AS pos FROM filter_rows GROUP BY {KEYS}) JOIN (SELECT {KEYS}, sum(v) AS total FROM samples GROUP BY {KEYS}) USING ({KEYS}) LEFT JOIN (SELECT {KEYS}, CAST(count(*) AS INT) AS n_hits, sum(amplitude) AS charge FROM hits GROUP BY {KEYS}) USING ({KEYS})")
def trace_hits(s, d):
    rows = clouds.trace_hits(bind.filter_rows(s, d), _traces(s, d), bind.hits(s, d))
    return rows.select("run", "event_id", "trace_id", "pos", F.aggregate("samples", F.lit(0.0), lambda a, b: a + b).alias("total"), F.coalesce(F.when(F.col("hits").isNotNull(), F.size("hits")), F.lit(0)).alias("n_hits"), F.round(F.coalesce(F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["amplitude"]), F.lit(0.0)), 4).alias("charge"))


@query("closest_labeled_event", "SELECT run, event_id, coalesce((SELECT min(l.event_id) FROM event_labels l WHERE l.run = e.run AND l.event_id >= e.event_id), (SELECT max(l.event_id) FROM event_labels l WHERE l.run = e.run)) AS labeled_event FROM cloud_events e")
def closest_labeled_event(s, d):
    return labels.closest_labeled_event(bind.cloud_events(s, d), bind.event_labels(s, d))


# --- trace histograms ------------------------------------------------------------------------------------------------

_NEAR = "CAST(greatest(least(round_even({0}, 0) + 4096, 8192), 0) AS INT)"
_CLIP = "CAST(trunc(greatest(least({0}, 8191), 0)) AS INT)"


def _bins_sql(metric: str, scale: float) -> str:
    """CTEs that end in bins(run, event_id, trace_id, variant, bin_x, bin_y)."""
    start = f"{bind.cleaned_sql(scale)}"
    none = "CAST(0 AS INT)"
    if metric == "amplitude":
        return f"{start}, {PEAKS}, bins AS (SELECT {KEYS}, 'peaks' AS variant, {_CLIP.format('height')} AS bin_x, {none} AS bin_y FROM peaks)"
    if metric == "baseline":
        return f"{start}, bins AS (SELECT {KEYS}, 'samples' AS variant, {_NEAR.format('x')} AS bin_x, {none} AS bin_y FROM cleaned)"
    if metric == "cdf":
        return f"{start}, {SPECTRUM}, {CDF}, bins AS (SELECT {KEYS}, 'cdf' AS variant, t AS bin_x, CAST(CASE WHEN v <= 0 THEN 0 WHEN v >= 1 THEN 99 ELSE floor(v * 100) END AS INT) AS bin_y FROM cdf)"
    if metric == "bitflip":
        steps = f"SELECT {KEYS}, 'value', {_CLIP.format('abs(d)')}, {none} FROM _signs SEMI JOIN flips USING ({KEYS}, island)"
        return f"{start}, {D2}, {RUNS}, bins AS (SELECT {KEYS}, 'baseline' AS variant, {_NEAR.format('d')} AS bin_x, {none} AS bin_y FROM d2 UNION ALL {steps} UNION ALL SELECT {KEYS}, 'length', least(length, 255), {none} FROM flips WHERE qualified UNION ALL SELECT {KEYS}, 'count', least(flips, 255), {none} FROM flip_count WHERE flips > 0)"
    return f"{start}, {SATURATION}, bins AS (SELECT {KEYS}, 'drop' AS variant, CAST(trunc(dr) AS INT) AS bin_x, {none} AS bin_y FROM drops WHERE dr >= 0 AND dr < 500 UNION ALL SELECT {KEYS}, 'length', plateau, {none} FROM plateaus WHERE plateau BETWEEN 2 AND 255)"


_MODE_SQL = {
    "all": "SELECT *, 'all' AS series_key FROM bins",
    "labeled": f"SELECT * FROM bins JOIN labeled USING ({KEYS})",
    "filtered": f"SELECT bins.*, 'filtered' AS series_key FROM bins JOIN filter_rows USING ({KEYS})",
    "veto": f"SELECT *, 'veto' AS series_key FROM bins ANTI JOIN filter_rows USING ({KEYS})",
}
_PARAMS = {"bitflip": {"threshold": FLIP}, "saturation": {"threshold": SAT, "drop": DROP}}


def _histogram(s, d, metric: str, mode: str, variant: str | None = None) -> DataFrame:
    return histograms.histogram(metric, _traces(s, d), mode, bind.trace_labels(s, d), bind.strange_labels(s, d), bind.filter_rows(s, d), variant=variant, **_PARAMS.get(metric, {}))


def _histogram_sql(metric: str, mode: str) -> tuple[str, str]:
    scale = 20 if metric == "cdf" and mode in ("all", "labeled") else 10
    sql = f"SELECT run, '{metric}' AS metric, '{mode}' AS mode, variant, series_key, bin_x, bin_y, count(*) AS count FROM ({_MODE_SQL[mode]}) GROUP BY run, variant, series_key, bin_x, bin_y"
    return sql, f"{GROUPED}, {_bins_sql(metric, scale)}"


_VARIANTS = {"amplitude_histogram": ("amplitude", None), "baseline_histogram": ("baseline", None), "cdf_histogram": ("cdf", None), "bitflip_baseline_histogram": ("bitflip", "baseline"), "bitflip_value_histogram": ("bitflip", "value"), "bitflip_length_histogram": ("bitflip", "length"), "bitflip_count_histogram": ("bitflip", "count"), "saturation_drop_histogram": ("saturation", "drop"), "saturation_length_histogram": ("saturation", "length")}


def _register_histograms() -> None:
    for name, (metric, variant) in _VARIANTS.items():
        sql, ctes = _histogram_sql(metric, "all")
        where = "" if variant is None else f" WHERE variant = '{variant}'"
        query(name, f"SELECT * FROM ({sql}){where}", ctes)(lambda s, d, m=metric, v=variant: _histogram(s, d, m, "all", v))
    for metric in histograms.METRICS:
        for mode in histograms.MODES[1:]:
            name = f"{metric}_histogram_{mode}" if mode != "filtered" else f"filtered_histogram_{metric}"
            query(name, *_histogram_sql(metric, mode))(lambda s, d, m=metric, o=mode: _histogram(s, d, m, o))


_register_histograms()

LABEL_COUNTS = "counts AS (SELECT run, series_key, count(*) AS traces FROM labeled GROUP BY run, series_key)"


@query("labeled_series", f"SELECT h.run, 'baseline' AS metric, variant, series_key, bin_x, bin_y, CAST(n AS BIGINT) AS count, traces FROM (SELECT run, variant, series_key, bin_x, bin_y, count(*) AS n FROM bins JOIN labeled USING ({KEYS}) GROUP BY ALL) h JOIN counts USING (run, series_key)", f"{GROUPED}, {LABEL_COUNTS}, {_bins_sql('baseline', 10)}")
def labeled_series(s, d):
    return histograms.labeled_series(_histogram(s, d, "baseline", "labeled"), bind.trace_labels(s, d), bind.strange_labels(s, d))


@query("histogram_trace_count", "SELECT run, 'all' AS mode, 'cdf' AS metric, 'all' AS series_key, count(*) AS traces FROM trace_keys GROUP BY run")
def histogram_trace_count(s, d):
    return histograms.histogram_trace_count(_histogram(s, d, "cdf", "all"))


@query("filtered_trace_count", "SELECT run, count(*) AS traces FROM filter_rows GROUP BY run")
def filtered_trace_count(s, d):
    return histograms.filtered_trace_count(bind.filter_rows(s, d))


@query("filtered_histogram_empty", f"""
SELECT run, a.variant, veto, CASE WHEN veto THEN 'Vetoed' ELSE 'Filtered' END || ' traces · first_run' AS title, traces AS trace_count, CAST(traces > 0 AS INT) AS series, bin_count, bin_label, count_label, {DROP}::DOUBLE AS "drop", coalesce(filled, 0) AS filled, CAST(coalesce(total, 0) AS BIGINT) AS total
FROM counts CROSS JOIN (VALUES ('drop', 500, 'Drop from local maximum', 'Count'), ('length', 256, 'Plateau length', 'Trace count')) a(variant, bin_count, bin_label, count_label)
LEFT JOIN (SELECT run, veto, variant, count(*) AS filled, sum(n) AS total FROM (SELECT run, veto, variant, bin_x, count(*) AS n FROM selected GROUP BY ALL) GROUP BY ALL) USING (run, veto, variant)""", f"""
{_bins_sql("saturation", 10)}, first_run AS (SELECT * FROM filter_rows WHERE run = 1),
selected AS (SELECT run, variant, bin_x, false AS veto FROM bins JOIN first_run USING ({KEYS}) UNION ALL SELECT run, variant, bin_x, true FROM bins ANTI JOIN first_run USING ({KEYS})),
counts AS (
  SELECT run, false AS veto, (SELECT count(*) FROM first_run f WHERE f.run = r.run) AS traces FROM (SELECT DISTINCT run FROM trace_keys) r
  UNION ALL SELECT run, true, count(*) FROM trace_keys ANTI JOIN first_run USING ({KEYS}) GROUP BY run)""")
def filtered_histogram_empty(s, d):
    """A filter set that names traces of run 1 only: of run 2 there is nothing but the metadata."""
    rows, own = _traces(s, d), bind.filter_rows(s, d).where("run = 1")
    out = []
    for veto in (False, True):
        found = histograms.filtered_histogram("saturation", rows, rows.select("run"), own, "first_run", veto, **_PARAMS["saturation"])
        filled = found.rows.groupBy("run", "variant").agg(F.count("*").alias("filled"), F.sum("count").alias("total"))
        out.append(found.metadata.join(filled, ["run", "variant"], "left"))
    both = out[0].unionByName(out[1])
    return both.select("run", "variant", "veto", "title", "trace_count", "series", "bin_count", "bin_label", "count_label", F.col("parameters")["drop"].alias("drop"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("filled", "total")])


@query("cdf_projection", f"SELECT run, 'all' AS mode, 'all' AS series_key, bin_x AS threshold, bin_y AS bin, count(*) AS count FROM bins WHERE bin_x = 20 GROUP BY run, bin_x, bin_y", _bins_sql("cdf", 20))
def cdf_projection(s, d):
    return histograms.cdf_projection(_histogram(s, d, "cdf", "all"), 20)


@query("log_counts", f"SELECT run, bin_x, round(log10(count(*) + 1), 6) AS log_count FROM bins GROUP BY run, bin_x", _bins_sql("baseline", 10))
def log_counts(s, d):
    return _histogram(s, d, "baseline", "all").select("run", "bin_x", F.round(histograms.log_counts(F.col("count")), 6).alias("log_count"))


@query("label_dimension", "SELECT * FROM dimension", DIMENSION)
def label_dimension(s, d):
    return labels.label_dimension(bind.strange_labels(s, d))


# --- sinks -----------------------------------------------------------------------------------------------------------


@query("write_histogram", *_histogram_sql("saturation", "all"))
def write_histogram(s, d):
    path = shared_folder(s, "histograms")
    tables.write_histogram(_histogram(s, d, "saturation", "all"), path)
    tables.write_histogram(_histogram(s, d, "saturation", "all"), path)  # replaces itself
    return tables.histogram_scan(s, path).select("run", "metric", "mode", "variant", "series_key", "bin_x", "bin_y", "count")


_SCAN_SQL = _histogram_sql("baseline", "veto")


@query("histogram_scan", f"SELECT * FROM ({_SCAN_SQL[0]}) WHERE run = 1", _SCAN_SQL[1])
def histogram_scan(s, d):
    path = shared_folder(s, "histograms")
    for mode in ("all", "veto"):
        tables.write_histogram(_histogram(s, d, "baseline", mode), path)
    return tables.histogram_scan(s, path, "baseline", "veto", 1).select("run", "metric", "mode", "variant", "series_key", "bin_x", "bin_y", "count")


@query("histogram_availability", "SELECT run, metric, mode, mode = 'filtered' OR (metric = 'saturation' AND mode = 'all' AND run IN (SELECT run FROM plateaus WHERE top >= 200)) AS available FROM (SELECT DISTINCT run FROM trace_keys), (VALUES ('saturation', 'all'), ('saturation', 'labeled'), ('saturation', 'filtered'), ('line_count', 'all')) t(metric, mode)", f"{CLEAN}, {SATURATION}")
def histogram_availability(s, d):
    stored = _histogram(s, d, "saturation", "all")
    return histograms.availability(stored, _traces(s, d).select("run").distinct(), {"saturation": ("all", "labeled", "filtered"), "line_count": ("all",)}, bind.filter_rows(s, d))


@query("write_filter_rows", f"SELECT 'filter_run_all_saturation_200_20_2' AS filter_name, row_number() OVER (ORDER BY {KEYS}) - 1 AS pos, {KEYS} FROM plateaus WHERE plateau >= 2 AND {NOT_BAD}", f"{CLEAN}, {SATURATION}")
def write_filter_rows(s, d):
    chosen = [predicates.Saturation(SAT, DROP)]
    path = shared_folder(s, "filters")
    rows = tables.numbered(_filter(s, d, *chosen), *tr.KEYS)
    tables.write_table(rows.selectExpr(f"'{predicates.filter_name(None, chosen)}' AS filter_name", "pos", *tr.KEYS), path)
    return s.read.parquet(path)


RELABELED = f"old AS (SELECT {KEYS}, family || ':' || label AS old_label FROM trace_labels SEMI JOIN trace_keys USING ({KEYS}))"
NOISE = f"{CLEAN}, {PEAKS}, {RELABELED}, renamed AS (SELECT {KEYS}, old_label, CASE WHEN amp < 40 THEN 'normal:0' ELSE old_label END AS new_label FROM old JOIN amplitudes USING ({KEYS}))"
OSCILLATION = f"{CLEAN}, {D2}, {RUNS}, {RELABELED}, renamed AS (SELECT {KEYS}, old_label, CASE WHEN flips >= 1 THEN 'strange:oscillation' ELSE old_label END AS new_label FROM old JOIN flip_count USING ({KEYS}))"
SATURATED = f"{CLEAN}, {SATURATION}, {RELABELED}, renamed AS (SELECT {KEYS}, old_label, CASE WHEN plateau >= 2 THEN 'strange:saturation' ELSE old_label END AS new_label FROM old JOIN plateaus USING ({KEYS}))"


def _relabel(s, d, kind: str) -> DataFrame:
    return relabel.relabel(kind, _traces(s, d), bind.trace_labels(s, d), **{"oscillation": {"threshold": FLIP}, "saturation": {"threshold": SAT, "drop": DROP}}.get(kind, {}))


for _kind, _ctes in (("noise", NOISE), ("oscillation", OSCILLATION), ("saturation", SATURATED)):
    query(f"relabel_{_kind}", "SELECT * FROM renamed", _ctes)(lambda s, d, k=_kind: _relabel(s, d, k))


@query("write_relabel_rows", "SELECT * FROM renamed", SATURATED)
def write_relabel_rows(s, d):
    path = shared_folder(s, "relabel")
    tables.write_table(_relabel(s, d, "saturation"), path, "run")
    return s.read.parquet(path).select(*tr.KEYS, "old_label", "new_label")


_METRICS = "SELECT source, 'strange:saturation' AS target, count(CASE WHEN new_label = 'strange:saturation' THEN 1 END) AS numerator, count(old_label) AS denominator, count(CASE WHEN new_label = 'strange:saturation' THEN 1 END) / nullif(count(old_label), 0) AS ratio FROM (VALUES ('strange:saturation'), ('normal:1')) t(source) LEFT JOIN renamed ON old_label = source GROUP BY source"


@query("relabel_metrics", _METRICS, SATURATED)
def relabel_metrics(s, d):
    return relabel.relabel_metrics("saturation", _relabel(s, d, "saturation"))


@query("relabel_confusions", f"SELECT 'old normal:1 -> new strange:oscillation' AS section, {KEYS} FROM renamed WHERE old_label = 'normal:1' AND new_label = 'strange:oscillation'", OSCILLATION)
def relabel_confusions(s, d):
    return relabel.relabel_confusions("oscillation", _relabel(s, d, "oscillation"))


HIT_PEAKS = _peaks_sql(height=40)
BUILT = f"""{GOOD}, {bind.cleaned_sql(20, 'good')}, {D2}, {RUNS}, {HIT_PEAKS}, {CENTROIDS.replace('SELECT *, -x', 'SELECT *, row_number() OVER (PARTITION BY cobo, asad, aget, channel ORDER BY pad DESC) = 1 AS last, -x')},
built AS (
  SELECT {KEYS}, CASE WHEN a.pad IS NULL THEN b.cx ELSE a.cx END AS x, CASE WHEN a.pad IS NULL THEN b.cy ELSE a.cy END AS y, coalesce(a.scale, b.scale) AS scale, (pos - 10.0) / 550.0 * 1000 AS z, height AS amplitude, (SELECT sum(c.x) FROM cleaned c WHERE c.run = p.run AND c.event_id = p.event_id AND c.trace_id = p.trace_id AND c.i BETWEEN floor(p.l) AND floor(p.r)) AS integral, coalesce(a.pad, b.pad) AS pad_id, pos,
         CAST(row_number() OVER (PARTITION BY run, event_id ORDER BY trace_id, pos) - 1 AS INT) AS hit_id
  FROM peaks p JOIN trace_keys k USING ({KEYS}) SEMI JOIN (SELECT {KEYS} FROM flip_count WHERE flips < 1) USING ({KEYS})
  LEFT JOIN centroids a ON a.cobo = _p // 1000 AND a.asad = _p // 100 % 10 AND a.aget = _p // 10 % 10 AND a.channel = _p % 10 AND a.last LEFT JOIN centroids b ON b.pad = k.vec_id % 100
  WHERE coalesce(a.pad, b.pad) IS NOT NULL)"""
_BUILT_SQL = f"SELECT {KEYS}, hit_id, round(x, 4) AS x, round(y, 4) + 0.0 AS y, scale, round(z, 4) AS z, round(amplitude, 4) AS amplitude, round(integral, 3) AS integral, pad_id, CAST(pos AS DOUBLE) AS time_bucket FROM built"


def _built(s, d) -> DataFrame:
    rows = _traces(s, d)
    return hits.build_hits(rows, pads.pad_centroid(bind.pads(s, d)), bind.bad_events(rows), FLIP)


def _built_view(rows: DataFrame) -> DataFrame:
    return rows.select(*tr.KEYS, "hit_id", "scale", (F.round("y", 4) + 0.0).alias("y"), *[F.round(c, n).alias(c) for c, n in (("x", 4), ("z", 4), ("amplitude", 4), ("integral", 3))], "pad_id", "time_bucket")


@query("build_hits", _BUILT_SQL, BUILT)
def build_hits(s, d):
    return _built_view(_built(s, d))


@query("write_hits", _BUILT_SQL, BUILT)
def write_hits(s, d):
    path = shared_folder(s, "clouds")
    events = _good(s, d).select("run", "event_id").distinct()
    tables.write_hits(_built(s, d), events, s.range(1).selectExpr("1 AS run", "'detector_length' AS key", "1000.0D AS value"), path)
    return _built_view(s.read.parquet(f"{path}/hits"))


@query("write_pads", "SELECT pad, x, y, scale, direction FROM pads")
def write_pads(s, d):
    path = shared_folder(s, "pads")
    tables.write_pads(bind.pads(s, d), path)
    return s.read.schema("pad INT, x DOUBLE, y DOUBLE, scale DOUBLE, direction INT").json(f"{path}/json")


_STAMP = "CAST(TIMESTAMP '2024-01-01 00:00:00' AS TIMESTAMP)"


@query("apply_label_changes", f"SELECT {KEYS}, CASE WHEN c THEN 'normal' ELSE family END AS family, CASE WHEN c THEN '9' ELSE label END AS label, CASE WHEN old THEN '2024-01-01' ELSE '2024-06-01' END AS created, CASE WHEN c THEN '2024-06-01' ELSE '2024-01-01' END AS updated FROM (SELECT {KEYS}, l.family, l.label, l.family IS NOT NULL AS old, f.trace_id IS NOT NULL AS c FROM trace_labels l FULL JOIN (SELECT DISTINCT {KEYS} FROM filter_rows) f USING ({KEYS}))")
def apply_label_changes(s, d):
    def stamped(df, at):
        return df.withColumn("created_at", F.lit(at).cast("timestamp")).withColumn("updated_at", F.lit(at).cast("timestamp"))

    changes = bind.filter_rows(s, d).select(*tr.KEYS, F.lit("normal").alias("family"), F.lit("9").alias("label"))
    out = labels.apply_changes(stamped(bind.trace_labels(s, d), "2024-01-01"), stamped(changes, "2024-06-01"), tr.KEYS)
    return out.select(*tr.KEYS, "family", "label", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("apply_event_label_changes", "SELECT run, event_id, CASE WHEN event_id % 5 = 0 THEN '0' ELSE label END AS label FROM cloud_events LEFT JOIN event_labels USING (run, event_id) WHERE event_id % 5 = 0 OR label IS NOT NULL")
def apply_event_label_changes(s, d):
    def stamped(df, at):
        return df.withColumn("created_at", F.lit(at).cast("timestamp")).withColumn("updated_at", F.lit(at).cast("timestamp"))

    changes = bind.cloud_events(s, d).where("event_id % 5 = 0").withColumn("label", F.lit("0"))
    return labels.apply_event_changes(stamped(bind.event_labels(s, d), "2024-01-01"), stamped(changes, "2024-06-01")).select("run", "event_id", "label")


_BATCH = "batch AS (SELECT vec_id AS pos, ' name' || (vec_id % 300) || ' ' AS name, 'k' || (vec_id % 450) AS shortcut_key FROM embeddings UNION ALL SELECT -1, 'TOXIC', 'q' UNION ALL SELECT -2, ' ', 'z' UNION ALL SELECT -3, 'fresh', 'u')"


@query("add_strange_labels", "SELECT pos, trim(name) AS name, shortcut_key, CASE WHEN trim(name) = '' THEN 'empty name' WHEN lower(trim(name)) IN (SELECT lower(name) FROM strange_labels) OR row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY pos) > 1 THEN 'duplicate name' WHEN shortcut_key IN (SELECT shortcut_key FROM strange_labels) OR row_number() OVER (PARTITION BY shortcut_key ORDER BY pos) > 1 THEN 'duplicate key' END AS reason FROM batch", _BATCH)
def add_strange_labels(s, d):
    batch = bind.table(s, d, "embeddings").selectExpr("vec_id AS pos", "concat(' name', vec_id % 300, ' ') AS name", "concat('k', vec_id % 450) AS shortcut_key")
    batch = batch.unionByName(s.sql("SELECT * FROM VALUES (-1L, 'TOXIC', 'q'), (-2L, ' ', 'z'), (-3L, 'fresh', 'u') AS b(pos, name, shortcut_key)"))
    return labels.add_strange_labels(bind.strange_labels(s, d), batch)


@query("remove_strange_labels", "SELECT name, count(label) AS used, count(label) = 0 AS removed FROM strange_labels LEFT JOIN trace_labels ON family = 'strange' AND label = name GROUP BY name")
def remove_strange_labels(s, d):
    known = bind.strange_labels(s, d)
    return labels.remove_strange_labels(known, bind.trace_labels(s, d), known.select("name"))


# --- other aggregates, order, names ----------------------------------------------------------------------------------


@query("normal_summary", "SELECT pos, label, CASE label WHEN '0' THEN '0 peak' WHEN '1' THEN '1 peak' WHEN '9' THEN '9+ peaks' ELSE label || ' peaks' END AS title, (SELECT count(*) FROM trace_labels t WHERE family = 'normal' AND t.label = b.label) AS traces FROM (SELECT CAST(i AS INT) AS pos, CAST(i AS VARCHAR) AS label FROM range(10) r(i)) b")
def normal_summary(s, d):
    return labels.normal_summary(bind.trace_labels(s, d))


@query("strange_summary", "SELECT name, shortcut_key, (SELECT count(*) FROM trace_labels t WHERE family = 'strange' AND t.label = name) AS traces FROM strange_labels")
def strange_summary(s, d):
    return labels.strange_summary(bind.trace_labels(s, d), bind.strange_labels(s, d))


@query("event_label_summary", "SELECT CAST(pos AS INT) AS pos, label, label || CASE WHEN label = '1' THEN ' line' ELSE ' lines' END AS title, (SELECT count(*) FROM event_labels e WHERE e.label = b.label) AS events FROM (VALUES (0, '0'), (1, '1'), (2, '2'), (3, '3'), (4, '4'), (5, '5'), (6, '6+')) b(pos, label)")
def event_label_summary(s, d):
    return labels.event_label_summary(bind.event_labels(s, d))


@query("label_breakdown", "SELECT pos, series_key, title, traces, coalesce(round(100.0::DOUBLE * traces / nullif(sum(traces) OVER (PARTITION BY split_part(series_key, ':', 1)), 0), 6), 0.0) AS percent FROM (SELECT d.*, (SELECT count(*) FROM grouped g WHERE g.series_key = d.series_key) AS traces FROM dimension d)", GROUPED)
def label_breakdown(s, d):
    return labels.label_breakdown(bind.trace_labels(s, d), bind.strange_labels(s, d)).withColumn("percent", F.round("percent", 6))


@query("label_counts", "SELECT run, series_key, (SELECT count(*) FROM grouped g WHERE g.run = r.run AND g.series_key = d.series_key) AS traces FROM (SELECT DISTINCT run FROM trace_labels) r, dimension d", GROUPED)
def label_counts(s, d):
    return labels.label_counts(bind.trace_labels(s, d), bind.strange_labels(s, d))


@query("pad_activity", "SELECT run, event_id, pad, pads.x, pads.y, max(amplitude) AS most, CAST(count(DISTINCT trace_id) AS INT) AS traces FROM hits JOIN pads ON pad = pad_id GROUP BY ALL")
def pad_activity(s, d):
    return clouds.pad_activity(bind.hits(s, d), bind.pads(s, d)).select("run", "event_id", "pad", "x", "y", "most", F.size("traces").alias("traces"))


@query("trace_neighbor", f"SELECT {KEYS}, coalesce(lead(trace_id) OVER w, trace_id) AS next_trace, coalesce(lag(trace_id) OVER w, trace_id) AS previous_trace FROM trace_keys WINDOW w AS (PARTITION BY run, event_id ORDER BY trace_id)")
def trace_neighbor(s, d):
    return tr.trace_neighbor(_traces(s, d))


@query("event_neighbor", "SELECT run, event_id, coalesce(lead(event_id) OVER w, event_id) AS next_event, coalesce(lag(event_id) OVER w, event_id) AS previous_event, coalesce(lead(n_traces) OVER w, n_traces) - 1 AS next_last_trace, coalesce(lag(n_traces) OVER w, n_traces) - 1 AS previous_last_trace FROM catalog WHERE n_traces > 0 WINDOW w AS (PARTITION BY run ORDER BY event_id)", CATALOG)
def event_neighbor(s, d):
    rows = _traces(s, d)
    return tr.event_neighbor(tr.event_catalog(rows, bind.bad_events(rows)))


@query("labeled_event_neighbor", "SELECT run, event_id, coalesce(lead(event_id) OVER w, event_id) AS next_event, coalesce(lag(event_id) OVER w, event_id) AS previous_event FROM event_labels WINDOW w AS (PARTITION BY run ORDER BY event_id)")
def labeled_event_neighbor(s, d):
    return labels.labeled_event_neighbor(bind.event_labels(s, d))


@query("sample_unlabeled_traces", f"SELECT {KEYS} FROM (SELECT *, row_number() OVER (PARTITION BY run, event_id ORDER BY md5(run || '/' || event_id || '/' || trace_id || '/0'), trace_id) AS r FROM trace_keys ANTI JOIN trace_labels USING ({KEYS})) WHERE r = 1 ORDER BY md5(run || '/' || event_id || '/1'), run, event_id LIMIT 20")
def sample_unlabeled_traces(s, d):
    return tr.sample_unlabeled_traces(_traces(s, d), bind.trace_labels(s, d), 20)


@query("sample_stored_traces", f"""
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS pos, {KEYS} FROM (
  SELECT min(k) AS k, {KEYS} FROM (
    SELECT k, run, event_id, trace_id FROM probed JOIN (SELECT run, event_id, trace_id, n FROM trace_keys JOIN counts USING (run, event_id) ANTI JOIN trace_labels USING ({KEYS})) USING (run, event_id)
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY step, CASE WHEN step = 0 THEN (trace_id - start % n + n) % n ELSE trace_id END) = 1)
  GROUP BY {KEYS} ORDER BY k LIMIT 20)""", f"""
span AS (SELECT run, min(event_id) AS low, max(event_id) - min(event_id) + 1 AS size FROM trace_keys WHERE run = 2 GROUP BY run),
counts AS (SELECT run, event_id, count(*) AS n FROM trace_keys ANTI JOIN bad_events USING (run, event_id) GROUP BY run, event_id),
drawn AS (SELECT run, k, low, size, CAST('0x' || substr(md5(run || '/5/' || k), 1, 8) AS BIGINT) % size AS place, CAST('0x' || substr(md5(run || '/5/' || k), 9, 8) AS BIGINT) AS start FROM span, range({probing.ATTEMPTS}) r(k)),
probed AS (SELECT run, k, step, low + (place + step) % size AS event_id, start FROM (SELECT *, unnest(range(least({probing.REACH}, size))) AS step FROM drawn))""")
def sample_stored_traces(s, d):
    return probing.sample_stored_traces(s, _stored(s, d), 2, bind.trace_labels(s, d), 20, 5, bad_events=bind.bad_events(_traces(s, d)))


@query("sample_unlabeled_event", "SELECT run, event_id FROM event_span ANTI JOIN event_labels USING (run, event_id) ORDER BY md5(run || '/' || event_id || '/0'), run, event_id LIMIT 20", EVENT_SPAN)
def sample_unlabeled_event(s, d):
    return labels.sample_unlabeled_events(bind.cloud_events(s, d), bind.event_labels(s, d), 20)


@query("order_keys", f"SELECT {KEYS} FROM trace_keys ORDER BY {KEYS}")
def order_keys(s, d):
    return _traces(s, d).select(*tr.KEYS).orderBy(*tr.KEYS)


@query("label_key", "SELECT DISTINCT family || ':' || label AS key FROM trace_labels")
def label_key(s, d):
    return bind.trace_labels(s, d).select(labels.label_key(F.col("family"), F.col("label")).alias("key")).distinct()


@query("sanitize_label_key", "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_name || ' '), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM part")
def sanitize_label_key(s, d):
    return bind.table(s, d, "part").select("p_partkey", labels.sanitize_label_key(F.concat("p_brand", F.lit(" / "), "p_name", F.lit(" "))).alias("key"))


@query("label_title", "SELECT DISTINCT family, label, CASE WHEN family = 'strange' THEN label WHEN label IN ('0', '1') THEN label || ' peak' WHEN label = '9' THEN '9+ peaks' ELSE label || ' peaks' END AS title FROM trace_labels")
def label_title(s, d):
    return bind.trace_labels(s, d).select("family", "label", labels.label_title(F.col("family"), F.col("label")).alias("title")).distinct()


@query("suggest_event_label", "SELECT s_suppkey, CASE WHEN s_nationkey % 9 - 1 <= 0 THEN '0' WHEN s_nationkey % 9 - 1 >= 6 THEN '6+' ELSE CAST(s_nationkey % 9 - 1 AS VARCHAR) END AS label FROM supplier")
def suggest_event_label(s, d):
    return bind.table(s, d, "supplier").select("s_suppkey", labels.suggest_event_label(F.col("s_nationkey") % 9 - 1).alias("label"))


@query("drift_z", "SELECT run, event_id, hit_id, round((time_bucket - 10) / 550 * 1000, 6) AS z FROM hits")
def drift_z(s, d):
    return bind.hits(s, d).select("run", "event_id", "hit_id", F.round(clouds.drift_z(F.col("time_bucket")), 6).alias("z"))


# --- point clouds ----------------------------------------------------------------------------------------------------

RATIOS = """
_m AS (SELECT run, event_id, count(*) AS n, covar_pop(x, x) AS a, covar_pop(y, y) AS b, covar_pop(z, z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM hits GROUP BY run, event_id),
_q AS (SELECT *, (a + b + c) / 3 AS q FROM _m),
_p2 AS (SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM _q),
_r AS (SELECT *, acos(greatest(least(((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p), 1.0), -1.0)) / 3 AS phi FROM _p2),
_ev AS (SELECT run, event_id, n, q + 2 * p * cos(phi) AS big, q + 2 * p * cos(phi + 2 * pi() / 3) AS small FROM _r),
ratios AS (SELECT run, event_id, coalesce(n, 0) AS n_hits, CASE WHEN n >= 3 AND big > 0 THEN CASE WHEN abs(small) < 1e-12 * big THEN 0 ELSE small / big END END AS ratio FROM cloud_events LEFT JOIN _ev USING (run, event_id))"""


def _ratios(s, d) -> DataFrame:
    return clouds.coplanar_ratio(bind.cloud_events(s, d), bind.hits(s, d))


@query("coplanar_ratio", "SELECT run, event_id, n_hits, round(ratio, 6) AS ratio FROM ratios", RATIOS)
def coplanar_ratio(s, d):
    return _ratios(s, d).withColumn("ratio", F.round("ratio", 6))


@query("coplanar_histogram", "SELECT run, CAST(least(floor(ratio / (CAST(0.05 AS DOUBLE) / 500)), 499) AS INT) AS bin, count(*) AS count FROM ratios WHERE ratio BETWEEN 0 AND 0.05 GROUP BY ALL", RATIOS)
def coplanar_histogram(s, d):
    return clouds.coplanar_histogram(_ratios(s, d))


@query("coplanar_counts", "SELECT run, count(*) AS processed, count(ratio) AS valid, count(CASE WHEN ratio BETWEEN 0 AND 0.05 THEN 1 END) AS accepted, count(*) - count(CASE WHEN ratio BETWEEN 0 AND 0.05 THEN 1 END) AS skipped FROM ratios GROUP BY run", RATIOS)
def coplanar_counts(s, d):
    return clouds.coplanar_counts(_ratios(s, d))


@query("coplanar_thresholds", "SELECT run, CAST(t AS DOUBLE) AS threshold, count(CASE WHEN ratio < t THEN 1 END) AS events, count(CASE WHEN ratio < t THEN 1 END) / count(*) AS share FROM ratios, (VALUES (0.001), (0.01), (0.02), (0.05)) v(t) WHERE ratio IS NOT NULL GROUP BY run, t", RATIOS)
def coplanar_thresholds(s, d):
    return clouds.coplanar_thresholds(_ratios(s, d))


def _axis(k: int, value: str) -> str:
    """SQL for the eigenvector of a symmetric matrix (a, b, c the diagonal, d = xy, e = xz, f = yz) to one eigenvalue: the longest cross product of two rows less the value."""
    rows = [(f"(a - {value})", "d", "e"), ("d", f"(b - {value})", "f"), ("e", "f", f"(c - {value})")]
    crosses = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        (p, q, r), (u, v, w) = rows[i], rows[j]
        crosses.append(f"[{q} * {w} - {r} * {v}, {r} * {u} - {p} * {w}, {p} * {v} - {q} * {u}]")
    longest = " UNION ALL ".join(f"SELECT {c} AS v" for c in crosses)
    return f"(SELECT list_transform(v, lambda x: x / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3])) FROM ({longest}) ORDER BY v[1] * v[1] + v[2] * v[2] + v[3] * v[3] DESC LIMIT 1) AS v{k}"


# from _m (run, event_id, n, a to f): the eigenvalues l1 > l2 > l3, and the axes v1 and v2
AXES = f"""
_q AS (SELECT *, (a + b + c) / 3 AS q FROM _m),
_p2 AS (SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM _q),
_r AS (SELECT *, acos(greatest(least(((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p), 1.0), -1.0)) / 3 AS phi FROM _p2),
_l AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi - 2 * pi() / 3) AS l2 FROM _r),
axes AS (SELECT *, {_axis(1, "l1")}, {_axis(2, "l2")} FROM _l)"""
_MOMENTS = "_m AS (SELECT run, event_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS a, covar_pop(y, y) AS b, covar_pop(z, z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM {0} GROUP BY run, event_id)"
_UP = "list_transform({0}, lambda x: x * CASE WHEN {0}[list_position(list_transform({0}, lambda y: abs(y)), list_max(list_transform({0}, lambda y: abs(y))))] < 0 THEN -1 ELSE 1 END)"
_PROJECTED = f"{AXES}, _signed AS (SELECT run, event_id, n, mx, my, mz, {_UP.format('v1')} AS g, {_UP.format('v2')} AS h FROM axes), projected AS (SELECT run, event_id, hit_id, z, round((x - mx) * g[1] + (y - my) * g[2] + (z - mz) * g[3], 1) + 0.0 AS u, round((x - mx) * h[1] + (y - my) * h[2] + (z - mz) * h[3], 1) + 0.0 AS v FROM rows_ JOIN _signed USING (run, event_id) WHERE n >= 3)"


@query("project_hits", "SELECT run, event_id, hit_id, u, v FROM projected", f"rows_ AS (SELECT * FROM hits), {_MOMENTS.format('rows_')}, {_PROJECTED}")
def project_hits(s, d):
    return clouds.project_hits(bind.hits(s, d)).select("run", "event_id", "hit_id", *[(F.round(c, 1) + 0.0).alias(c) for c in "uv"])


@query("event_hits", "SELECT run, event_id, hit_id, round(z, 6) AS z, u, v FROM projected", f"rows_ AS (SELECT * FROM hits WHERE z BETWEEN 0 AND 500), {_MOMENTS.format('rows_')}, {_PROJECTED}")
def event_hits(s, d):
    return clouds.event_hits(bind.hits(s, d), 500.0).select("run", "event_id", "hit_id", F.round("z", 6).alias("z"), *[(F.round(c, 1) + 0.0).alias(c) for c in "uv"])


_BY_RUN = f"params AS (SELECT run, CASE WHEN run = 1 THEN most / 2 ELSE 700.0 END::DOUBLE AS detector_length FROM (SELECT run, max(z) AS most FROM hits GROUP BY run)), rows_ AS (SELECT h.*, detector_length FROM hits h JOIN params USING (run) WHERE z BETWEEN 0 AND detector_length), {_MOMENTS.format('rows_')}, {_PROJECTED}"


@query("event_hits_by_run", "SELECT run, event_id, hit_id, round(p.z, 6) AS z, u, v, round(detector_length, 6) AS detector_length, 560.0::DOUBLE AS window_time_bucket FROM projected p JOIN params USING (run)", _BY_RUN)
def event_hits_by_run(s, d):
    """Run 1 has a stored length, the other one the default."""
    stored = bind.hits(s, d).where("run = 1").groupBy("run").agg(F.lit("detector_length").alias("key"), (F.max("z") / 2).alias("value"))
    known = tables.processing_params(bind.hits(s, d).select("run").distinct(), stored, {"detector_length": 700.0, "window_time_bucket": 560.0})
    found = clouds.event_hits(bind.hits(s, d), processing=known)
    return found.select("run", "event_id", "hit_id", F.round("z", 6).alias("z"), *[(F.round(c, 1) + 0.0).alias(c) for c in "uv"], F.round("processing.detector_length", 6).alias("detector_length"), "processing.window_time_bucket")


# Lines of the bound hits are noise, so the measures are taken on given lines: one to three per event, all through
# every third hit. Their directions turn in the plane of x and z, and their centres move along y, from event to event.
_TURN = "radians(event_id % 90 + 0.5::DOUBLE + k * (event_id % 5) * 1.1::DOUBLE)"
_GIVEN = f"given AS (SELECT run, event_id, CAST(k AS INT) AS line_id, cx, cy + k * (event_id % 7) * 4.3::DOUBLE AS cy, cz, cos({_TURN}) AS dx, 0.0::DOUBLE AS dy, sin({_TURN}) AS dz FROM (SELECT run, event_id, avg(x) + 0.0 AS cx, avg(y) AS cy, avg(z) AS cz FROM hits GROUP BY run, event_id), range(3) r(k) WHERE k <= event_id % 3), members AS (SELECT g.run, g.event_id, line_id, hit_id FROM given g JOIN hits h ON h.run = g.run AND h.event_id = g.event_id AND hit_id % 3 = line_id)"


def _given(s, d) -> DataFrame:
    rows = bind.hits(s, d).groupBy(*tr.EVENT).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"), F.sort_array(F.collect_list("hit_id")).alias("all"))
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))))
    turn = F.expr("radians(event_id % 90 + 0.5D + k * (event_id % 5) * 1.1D)")
    return each.select(*tr.EVENT, F.col("k").alias("line_id"), F.filter("all", lambda h: h % 3 == F.col("k")).alias("hit_ids"), "cx", F.expr("cy + k * (event_id % 7) * 4.3D").alias("cy"), "cz", F.cos(turn).alias("dx"), F.lit(0.0).alias("dy"), F.sin(turn).alias("dz"))


MEASURED = f"""{_GIVEN},
along AS (SELECT m.run, m.event_id, m.line_id, (h.x - cx) * dx + (h.y - cy) * dy + (h.z - cz) * dz AS p, greatest(amplitude, 0) AS q FROM members m JOIN hits h USING (run, event_id, hit_id) JOIN given g USING (run, event_id, line_id)),
_ends2 AS (SELECT *, min(p) OVER w AS lo, max(p) OVER w AS hi FROM along WINDOW w AS (PARTITION BY run, event_id, line_id)),
measured AS (SELECT run, event_id, line_id, max(p) - min(p) AS length, sum(q) AS charge, sum(CASE WHEN p > (lo + hi) / 2 THEN q ELSE 0 END) / nullif(sum(CASE WHEN p <= (lo + hi) / 2 THEN q ELSE 0 END), 0) AS half_ratio FROM _ends2 GROUP BY run, event_id, line_id)"""


def _measured(s, d) -> DataFrame:
    return clouds.measure_lines(bind.hits(s, d), _given(s, d))


def _hist_sql(metric: str, source: str, x: str, bins: int, high: float) -> str:
    return f"SELECT run, '{metric}' AS metric, CAST(least(floor(({x} - 0.0::DOUBLE) / {high / bins}), {bins - 1}) AS INT) AS bin_x, count(*) AS count FROM {source} WHERE {x} BETWEEN 0 AND {high} GROUP BY ALL"


@query("measure_lines", "SELECT run, event_id, line_id, round(length, 4) AS length, round(charge, 4) AS charge, round(half_ratio, 4) AS half_ratio FROM measured", MEASURED)
def measure_lines(s, d):
    return _measured(s, d).select(*tr.EVENT, "line_id", *[F.round(c, 4).alias(c) for c in ("length", "charge", "half_ratio")])


@query("longest_lines", "SELECT run, event_id, line_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run, event_id ORDER BY round(length, 6) DESC, line_id) AS INT) AS rank FROM measured) WHERE rank <= 3", MEASURED)
def longest_lines(s, d):
    return clouds.longest_lines(_measured(s, d).withColumn("length", F.round("length", 6))).select(*tr.EVENT, "line_id", "rank")


@query("line_length_histogram", _hist_sql("line_length", "measured", "length", 120, 1000.0), MEASURED)
def line_length_histogram(s, d):
    return clouds.line_length_histogram(_measured(s, d))


@query("line_charge_histogram", _hist_sql("line_charge", "measured", "charge", 200, 20000.0), MEASURED)
def line_charge_histogram(s, d):
    return clouds.line_charge_histogram(_measured(s, d))


@query("half_charge_ratio_histogram", _hist_sql("half_charge_ratio", "measured", "half_ratio", 100, 5.0), MEASURED)
def half_charge_ratio_histogram(s, d):
    return clouds.half_charge_ratio_histogram(_measured(s, d))


_FAR = "sqrt(power((h.y - cy) * dz - (h.z - cz) * dy, 2) + power((h.z - cz) * dx - (h.x - cx) * dz, 2) + power((h.x - cx) * dy - (h.y - cy) * dx, 2))"


@query("point_line_distance", f"SELECT h.run, h.event_id, hit_id, line_id, round({_FAR}, 4) AS distance FROM hits h JOIN given g USING (run, event_id)", _GIVEN)
def point_line_distance(s, d):
    far = clouds.point_line_distance([F.col(c) for c in "xyz"], [F.col(f"c{c}") for c in "xyz"], [F.col(f"d{c}") for c in "xyz"])
    return bind.hits(s, d).join(_given(s, d).drop("hit_ids"), tr.EVENT).select(*tr.EVENT, "hit_id", "line_id", F.round(far, 4).alias("distance"))


@query("projection_on_line", "SELECT h.run, h.event_id, hit_id, line_id, round((h.x - cx) * dx + (h.y - cy) * dy + (h.z - cz) * dz, 4) + 0.0 AS p FROM hits h JOIN given g USING (run, event_id)", _GIVEN)
def projection_on_line(s, d):
    along = clouds.projection_on_line([F.col(c) for c in "xyz"], [F.col(f"c{c}") for c in "xyz"], [F.col(f"d{c}") for c in "xyz"])
    return bind.hits(s, d).join(_given(s, d).drop("hit_ids"), tr.EVENT).select(*tr.EVENT, "hit_id", "line_id", (F.round(along, 4) + 0.0).alias("p"))


@query("line_point_at_z", "SELECT run, event_id, line_id, CASE WHEN dz <> 0 THEN round(cx + (100 - cz) / nullif(dz, 0) * dx, 4) END AS x, CASE WHEN dz <> 0 THEN round(cy + (100 - cz) / nullif(dz, 0) * dy, 4) + 0.0 END AS y FROM given", _GIVEN)
def line_point_at_z(s, d):
    x, y = clouds.line_point_at_z([F.col(f"c{c}") for c in "xyz"], [F.col(f"d{c}") for c in "xyz"], F.lit(100.0))
    return _given(s, d).select(*tr.EVENT, "line_id", F.round(x, 4).alias("x"), (F.round(y, 4) + 0.0).alias("y"))


@query("point_line_distance_histogram", f"SELECT run, 'point_line_distance' AS metric, lines, in_line, CAST(least(floor((far - 0.0::DOUBLE) / 2.5), 119) AS INT) AS bin_x, count(*) AS count FROM (SELECT h.run, unnest(['all', 'longest_' || rank]) AS lines, m.hit_id IS NOT NULL AS in_line, {_FAR} AS far FROM hits h JOIN given g USING (run, event_id) JOIN ranked k USING (run, event_id, line_id) LEFT JOIN members m USING (run, event_id, line_id, hit_id)) WHERE far BETWEEN 0 AND 300 GROUP BY ALL", f"{MEASURED}, ranked AS (SELECT run, event_id, line_id, row_number() OVER (PARTITION BY run, event_id ORDER BY length DESC, line_id) AS rank FROM measured)")
def point_line_distance_histogram(s, d):
    return clouds.point_line_distance_histogram(bind.hits(s, d), _given(s, d), _measured(s, d))


PAIRED = f"{_GIVEN}, line_pairs AS (SELECT a.run, a.event_id, a.line_id AS first, b.line_id AS second, sqrt(power((b.cy - a.cy) * a.dz - (b.cz - a.cz) * a.dy, 2) + power((b.cz - a.cz) * a.dx - (b.cx - a.cx) * a.dz, 2) + power((b.cx - a.cx) * a.dy - (b.cy - a.cy) * a.dx, 2)) AS distance, degrees(acos(greatest(least(a.dx * b.dx + a.dy * b.dy + a.dz * b.dz, 1.0), -1.0))) AS angle FROM given a JOIN given b ON a.run = b.run AND a.event_id = b.event_id AND a.line_id < b.line_id)"


def _pairs(s, d) -> DataFrame:
    return clouds.line_pairs(_given(s, d))


@query("line_pairs", "SELECT run, event_id, first, second, round(distance, 4) AS distance, round(angle, 4) AS angle FROM line_pairs", PAIRED)
def line_pairs(s, d):
    return _pairs(s, d).select(*tr.EVENT, "first", "second", F.round("distance", 4).alias("distance"), F.round("angle", 4).alias("angle"))


@query("pair_distance_histogram", _hist_sql("pair_distance", "line_pairs", "distance", 120, 600.0), PAIRED)
def pair_distance_histogram(s, d):
    return clouds.pair_distance_histogram(_pairs(s, d))


@query("pair_angle_histogram", _hist_sql("pair_angle", "line_pairs", "angle", 180, 180.0), PAIRED)
def pair_angle_histogram(s, d):
    return clouds.pair_angle_histogram(_pairs(s, d))


JOINT = f"{PAIRED}, joint AS (SELECT run, CAST(least(floor(distance / 5), 119) AS INT) AS bin_x, CAST(least(floor(angle), 179) AS INT) AS bin_y, count(*) AS count FROM line_pairs WHERE distance BETWEEN 0 AND 600 AND angle BETWEEN 0 AND 180 GROUP BY ALL)"


@query("pair_joint_histogram", "SELECT * FROM joint", JOINT)
def pair_joint_histogram(s, d):
    return clouds.pair_joint_histogram(_pairs(s, d))


@query("joint_slice", "SELECT run, 'x' AS axis, bin_x AS bin, CAST(sum(count) AS BIGINT) AS count FROM joint WHERE bin_y + 0.5 BETWEEN 1 AND 6 GROUP BY ALL UNION ALL SELECT run, 'y', bin_y, CAST(sum(count) AS BIGINT) FROM joint WHERE (bin_x + 0.5) * 5 BETWEEN 5 AND 30 GROUP BY ALL", JOINT)
def joint_slice(s, d):
    joint = clouds.pair_joint_histogram(_pairs(s, d))
    return clouds.joint_slice(joint, "x", 6.0, 1.0).withColumn("axis", F.lit("x")).unionByName(clouds.joint_slice(joint, "y", 5.0, 30.0).withColumn("axis", F.lit("y")))


@query("line_count_histogram", "SELECT run, 'line_count' AS metric, CAST(n AS INT) AS bin_x, count(*) AS count FROM (SELECT run, event_id, (SELECT count(*) FROM given g WHERE g.run = e.run AND g.event_id = e.event_id) AS n FROM cloud_events e) GROUP BY ALL", _GIVEN)
def line_count_histogram(s, d):
    return clouds.line_count_histogram(bind.cloud_events(s, d), _given(s, d))


@query("labeled_ratio_histogram", "SELECT run, 'labeled_ratio' AS metric, CAST(least(floor((k / n) / 0.01::DOUBLE), 99) AS INT) AS bin_x, count(*) AS count FROM (SELECT h.run, h.event_id, count(*) AS n, count(m.hit_id) AS k FROM hits h LEFT JOIN members m USING (run, event_id, hit_id) GROUP BY ALL) GROUP BY ALL", _GIVEN)
def labeled_ratio_histogram(s, d):
    return clouds.labeled_ratio_histogram(bind.hits(s, d), _given(s, d))


@query("histogram_plot_rows", f"SELECT run, 'pair_distance' AS metric, CAST(b AS INT) AS bin_x, (b + 0.5::DOUBLE) * 5 AS center, coalesce(count, 0) AS count FROM (SELECT DISTINCT run FROM joint) CROSS JOIN range(120) r(b) LEFT JOIN (SELECT run, bin_x AS b, CAST(sum(count) AS BIGINT) AS count FROM joint GROUP BY ALL) USING (run, b)", JOINT)
def histogram_plot_rows(s, d):
    return clouds.histogram_plot_rows(clouds.pair_distance_histogram(_pairs(s, d)), 120, 0.0, 600.0)


@query("line_totals", "SELECT run, count(DISTINCT event_id) AS events, CAST(sum(l) AS BIGINT) AS lines, CAST(sum(l * (l - 1) / 2) AS BIGINT) AS pairs, CAST(sum(p) AS BIGINT) AS points FROM (SELECT run, event_id, (SELECT count(*) FROM given g WHERE g.run = e.run AND g.event_id = e.event_id) AS l, (SELECT count(*) FROM members m WHERE m.run = e.run AND m.event_id = e.event_id) AS p FROM cloud_events e) GROUP BY run", _GIVEN)
def line_totals(s, d):
    return clouds.line_totals(bind.cloud_events(s, d), bind.hits(s, d), _given(s, d))


# Lines are sought among hits of which two of three lie on one of two tracks, by trials that md5 draws.
_FIND = FindParams(trials=60, tries=3)


def _tried_sql(k: int, p: FindParams = _FIND) -> str:
    """CTEs from free{k} (run, event_id, hit_id, x, y, z), the hits left before attempt k, to near{k}, those near its best trial."""
    line = "power((y - sy) * dz - (z - sz) * dy, 2) + power((z - sz) * dx - (x - sx) * dz, 2) + power((x - sx) * dy - (y - sy) * dx, 2)"
    return f"""
side{k} AS (SELECT *, CASE WHEN near BETWEEN 1 AND n - 1 THEN CAST(inside AS INT) ELSE 2 END AS side FROM (SELECT *, sum(CAST(inside AS INT)) OVER w AS near FROM (SELECT *, sqrt(x * x + y * y) < {p.start_radius} AS inside, count(*) OVER (PARTITION BY run, event_id) AS n FROM free{k}) WINDOW w AS (PARTITION BY run, event_id)) WHERE n >= 2),
pick{k} AS (SELECT *, row_number() OVER (PARTITION BY run, event_id, side ORDER BY hit_id) - 1 AS place, count(*) OVER (PARTITION BY run, event_id, side) AS of FROM side{k}),
drawn{k} AS (SELECT DISTINCT run, event_id, t, md5(run || '/' || event_id || '/{k}/' || t) AS d, min(side) OVER (PARTITION BY run, event_id) AS far_side, max(side) OVER (PARTITION BY run, event_id) AS near_side, n FROM side{k}, range({p.trials}) r(t)),
line{k} AS (SELECT * FROM (
  SELECT g.run, g.event_id, t, g.n, a.x AS sx, a.y AS sy, a.z AS sz, (b.x - a.x) / len AS dx, (b.y - a.y) / len AS dy, (b.z - a.z) / len AS dz
  FROM drawn{k} g JOIN pick{k} a ON a.run = g.run AND a.event_id = g.event_id AND a.side = near_side AND a.place = CAST('0x' || substr(d, 1, 8) AS BIGINT) % a.of
  JOIN pick{k} b ON b.run = g.run AND b.event_id = g.event_id AND b.side = far_side AND b.place = CAST('0x' || substr(d, 9, 8) AS BIGINT) % b.of, LATERAL (SELECT nullif(sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2)), 0) AS len)) WHERE dx IS NOT NULL),
trial{k} AS (SELECT run, event_id, t, any_value(n) AS n, count(*) AS hits, sum(off) AS error FROM (SELECT run, event_id, t, l.n, sqrt({line}) AS off FROM line{k} l JOIN free{k} f USING (run, event_id)) WHERE off <= {p.residual} GROUP BY run, event_id, t),
best{k} AS (SELECT * FROM (SELECT run, event_id, t FROM trial{k} QUALIFY row_number() OVER (PARTITION BY run, event_id ORDER BY CASE WHEN hits = n THEN t ELSE 1000000 END, hits DESC, error, t) = 1) JOIN line{k} USING (run, event_id, t)),
on{k} AS (SELECT f.*, sqrt({line}) <= {p.residual} AS own FROM free{k} f JOIN best{k} b USING (run, event_id)),
plane{k} AS (SELECT run, event_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM on{k} WHERE own GROUP BY run, event_id),
near{k} AS (SELECT run, event_id, hit_id, x, y, z FROM on{k} JOIN plane{k} USING (run, event_id) WHERE abs(z - mz - (xz * yy - yz * xy) / (xx * yy - xy * xy) * (x - mx) - (yz * xx - xz * xy) / (xx * yy - xy * xy) * (y - my)) <= {p.residual})"""


def _lines_sql(p: FindParams = _FIND) -> str:
    """CTEs that end in found(run, event_id, line_id, hit_id, x, y, z). An attempt whose hits are too few or too far from the axis is spent."""
    all_ = "all_hits AS (SELECT run, event_id, count(*) AS n FROM track_hits GROUP BY run, event_id), free0 AS (SELECT run, event_id, hit_id, x, y, z FROM track_hits SEMI JOIN (SELECT * FROM all_hits WHERE n >= {0}) USING (run, event_id))".format(p.min_hits)
    steps = [all_]
    for k in range(p.tries):
        own = f"own{k} AS (SELECT * FROM near{k} SEMI JOIN (SELECT run, event_id FROM near{k} GROUP BY run, event_id HAVING count(*) >= {p.min_hits} AND min(sqrt(x * x + y * y)) < {p.start_radius}) USING (run, event_id))"
        left = f"left{k} AS (SELECT * FROM free{k} ANTI JOIN own{k} USING (run, event_id, hit_id)), free{k + 1} AS (SELECT * FROM left{k} SEMI JOIN (SELECT run, event_id FROM left{k} JOIN all_hits USING (run, event_id) GROUP BY run, event_id, n HAVING count(*) >= {p.min_hits} AND n - count(*) < {p.target_share} * n) USING (run, event_id) SEMI JOIN near{k} USING (run, event_id))"
        steps += [_tried_sql(k, p), own, left]
    found = " UNION ALL ".join(f"SELECT {k} AS k, * FROM own{k}" for k in range(p.tries))
    return ", ".join([*steps, f"found AS (SELECT run, event_id, CAST(dense_rank() OVER (PARTITION BY run, event_id ORDER BY k) - 1 AS INT) AS line_id, hit_id, x, y, z FROM ({found}))"])


@query("extract_lines", "SELECT run, event_id, line_id, CAST(n AS INT) AS n_hits, round(mx, 4) + 0.0 AS cx, round(my, 4) + 0.0 AS cy, round(mz, 4) AS cz, " + ", ".join(f"round(v1[{k}] * CASE WHEN v1[3] < 0 THEN -1 ELSE 1 END, 4) + 0.0 AS d{n}" for k, n in ((1, "x"), (2, "y"), (3, "z"))) + " FROM axes", f"{_lines_sql()}, {_MOMENTS.format('found').replace('event_id, count', 'event_id, line_id, count').replace('GROUP BY run, event_id', 'GROUP BY run, event_id, line_id')}, {AXES}")
def extract_lines(s, d):
    found = clouds.extract_lines(bind.track_hits(s, d), _FIND, None, False, counted=True)
    return found.select(*tr.EVENT, "line_id", F.size("hit_ids").alias("n_hits"), *[(F.round(c, 4) + 0.0).alias(c) for c in ("cx", "cy", "cz", "dx", "dy", "dz")])


_NEAR_LINE = "sqrt(power((a.cy - b.cy) * b.dz - (a.cz - b.cz) * b.dy, 2) + power((a.cz - b.cz) * b.dx - (a.cx - b.cx) * b.dz, 2) + power((a.cx - b.cx) * b.dy - (a.cy - b.cy) * b.dx, 2)) < 30 AND degrees(acos(greatest(least(a.dx * b.dx + a.dy * b.dy + a.dz * b.dz, 1.0), -1.0))) < 3"
_MERGED = f"{_GIVEN}, first_near AS (SELECT b.run, b.event_id, b.line_id, coalesce(min(a.line_id), b.line_id) AS up FROM given b LEFT JOIN given a ON a.run = b.run AND a.event_id = b.event_id AND a.line_id < b.line_id AND {_NEAR_LINE} GROUP BY b.run, b.event_id, b.line_id), rooted AS (SELECT f.run, f.event_id, f.line_id, g.up AS root FROM first_near f JOIN first_near g ON g.run = f.run AND g.event_id = f.event_id AND g.line_id = f.up)"


@query("merge_lines", "SELECT run, event_id, CAST(dense_rank() OVER (PARTITION BY run, event_id ORDER BY root) - 1 AS INT) AS line_id, CAST(n_hits AS INT) AS n_hits, round(cy, 4) + 0.0 AS cy, round(dx, 6) AS dx, round(dz, 6) AS dz FROM (SELECT r.run, r.event_id, root, count(m.hit_id) AS n_hits FROM rooted r LEFT JOIN members m USING (run, event_id, line_id) GROUP BY ALL) JOIN given g USING (run, event_id) WHERE g.line_id = root", _MERGED)
def merge_lines(s, d):
    """Three lines at most, so two steps lead to the first of a group."""
    return clouds.merge_lines(_given(s, d)).select(*tr.EVENT, "line_id", F.size("hit_ids").alias("n_hits"), (F.round("cy", 4) + 0.0).alias("cy"), F.round("dx", 6).alias("dx"), F.round("dz", 6).alias("dz"))


@query("ransac_mask", "SELECT run, event_id, hit_id FROM near0", f"free0 AS (SELECT run, event_id, hit_id, x, y, z FROM track_hits), {_tried_sql(0)}")
def ransac_mask(s, d):
    return clouds.ransac_mask(bind.track_hits(s, d), _FIND)


@query("line_labels", "SELECT h.run, h.event_id, hit_id, coalesce(line_id, -1) AS line_id, n AS lines, CAST(n AS VARCHAR) AS suggested FROM hits h LEFT JOIN members m USING (run, event_id, hit_id) JOIN (SELECT run, event_id, count(*) AS n FROM given GROUP BY run, event_id) USING (run, event_id)", _GIVEN)
def line_labels(s, d):
    return clouds.line_labels(bind.hits(s, d), _given(s, d))


_FITTED = "SELECT run, event_id, round(mx, 4) + 0.0 AS cx, round(my, 4) + 0.0 AS cy, round(mz, 4) AS cz, " + ", ".join(f"round(v1[{k}] * CASE WHEN v1[3] < 0 THEN -1 ELSE 1 END, 6) + 0.0 AS d{n}" for k, n in ((1, "x"), (2, "y"), (3, "z"))) + " FROM axes"
_WEIGHED = "_c AS (SELECT run, event_id, sum(amplitude) AS w, sum(amplitude * x) / sum(amplitude) AS mx, sum(amplitude * y) / sum(amplitude) AS my, sum(amplitude * z) / sum(amplitude) AS mz FROM hits GROUP BY run, event_id), _m AS (SELECT run, event_id, mx, my, mz, " + ", ".join(f"sum(amplitude * ({p} - m{p}) * ({q} - m{q})) / w AS {n}" for n, p, q in (("a", "x", "x"), ("b", "y", "y"), ("c", "z", "z"), ("d", "x", "y"), ("e", "x", "z"), ("f", "y", "z"))) + " FROM hits JOIN _c USING (run, event_id) GROUP BY run, event_id, w, mx, my, mz)"


def _fitted(rows: DataFrame) -> DataFrame:
    return rows.select(*tr.EVENT, *[(F.round(c, 4) + 0.0).alias(c) for c in ("cx", "cy", "cz")], *[(F.round(c, 6) + 0.0).alias(c) for c in ("dx", "dy", "dz")])


@query("fit_line", _FITTED, f"{_MOMENTS.format('hits')}, {AXES}")
def fit_line(s, d):
    return _fitted(clouds.fit_line(bind.hits(s, d)))


@query("fit_line_weighted", _FITTED, f"{_WEIGHED}, {AXES}")
def fit_line_weighted(s, d):
    return _fitted(clouds.fit_line(bind.hits(s, d), "amplitude"))


@query("pad_directions", "SELECT pad, CAST((pad % 100 + pad // 100) % 2 AS INT) AS direction FROM pads")
def pad_directions(s, d):
    """The bound pads lie on a grid, so the colours are those of a chessboard."""
    near = pads.pad_neighbors(pads.pad_pairs(bind.pads(s, d), 4.5, False), 4)
    return pads.pad_directions(near, 0, 4.5)[0]
