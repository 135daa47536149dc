"""Golden values for the Spark operators on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline import queries
from driftline.operators import clouds, histograms, hits, labels, pads, predicates, relabel
from driftline.operators import traces as tr
from driftline.sources import tables

from .test_signals import _track, from_d2, gauss

TRACES = "run int, event_id long, trace_id int, samples array<double>"


def traces_of(spark, rows):
    return spark.createDataFrame([(r, e, t, [float(v) for v in x]) for r, e, t, x in rows], TRACES)


def sine(period, height=30):
    return height * np.sin(2 * np.pi * np.arange(256) / period)


def keys(df):
    return [(r.run, r.event_id, r.trace_id) for r in df.collect()]


def test_filter_by_amplitude(spark):
    rows = traces_of(spark, [(8, 1, 0, gauss(20)), (8, 1, 1, gauss(50)), (8, 1, 2, gauss(80)), (8, 2, 0, gauss(40))])
    chosen = predicates.Amplitude(20, 50, 20, 5, 40)
    assert keys(predicates.filter_traces(rows, [chosen])) == [(8, 1, 1), (8, 2, 0)]
    assert keys(predicates.filter_traces(rows, [chosen], limit=1)) == [(8, 1, 1)]
    bad = spark.createDataFrame([(8, 2)], "run int, event_id long")
    assert keys(predicates.filter_traces(rows, [chosen], bad)) == [(8, 1, 1)]
    with pytest.raises(ValueError):
        predicates.filter_traces(rows, [chosen], limit=-1)
    with pytest.raises(ValueError):
        predicates.filter_traces(rows, [])


def test_filters_are_joined_by_and(spark):
    rows = traces_of(spark, [(8, 1, 0, sine(4, 30)), (8, 1, 1, sine(64, 30)), (8, 1, 2, gauss(40)), (8, 1, 3, sine(4, 80))])
    assert keys(predicates.filter_traces(rows, [predicates.Oscillation()])) == [(8, 1, 0), (8, 1, 3)]
    both = [predicates.Oscillation(), predicates.Amplitude(20, 50, 1, 5, 40)]
    assert keys(predicates.filter_traces(rows, both)) == [(8, 1, 0)]
    assert predicates.filter_name(8, both) == "filter_run_0008_cdf_amp_20_50"


@pytest.mark.parametrize("make", [lambda: predicates.BitFlip(-1), lambda: predicates.BitFlip(1, 0), lambda: predicates.Saturation(min_plateau=1), lambda: predicates.Amplitude(5, 1)])
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_array_columns_keep_nulls_and_lengths(spark):
    rows = traces_of(spark, [(1, 1, 0, range(8)), (1, 1, 1, range(5)), (1, 1, 2, []), (1, 1, 3, [7])]).unionByName(spark.createDataFrame([(1, 1, 4, None)], TRACES))
    got = {r.trace_id: r for r in rows.select("trace_id", tr.clean("samples").alias("c"), tr.first_derivative(F.col("samples")).alias("d"), tr.second_derivative(F.col("samples"), True).alias("e"), tr.repair_edges(F.col("samples")).alias("r")).collect()}
    assert [len(got[i].c) for i in range(4)] == [8, 5, 0, 1] and got[4].c is None
    assert got[1].d == [0, 1, 1, 1, 1] and got[1].e == [0, 0, 0, 0, 0] and got[3].d == [0] and got[3].e == [0]
    assert got[1].r == [1, 1, 2, 3, 3] and got[3].r == [7]


def test_bitflip_bins(spark):
    d = [[0, 61, -121, 450, -512, 0, 0, 0], [0, 61, -121, 0, 0, -512, 574, 0], [0, 61, 121, -450, 0], [0, 200, -205, 0, 0]]
    rows = spark.createDataFrame([(1, i, [float(v) for v in from_d2(x)]) for i, x in enumerate(d)], "run int, trace_id int, x array<double>")
    found = rows.select("trace_id", tr.bitflip_segments("x", 1).alias("s")).select("trace_id", tr.bitflip_count(F.col("s")).alias("n"), F.size("s").alias("all")).orderBy("trace_id").collect()
    assert [(r.n, r.all) for r in found] == [(1, 1), (2, 2), (0, 0), (0, 1)]


def test_histograms_per_mode(spark):
    rows = traces_of(spark, [(1, 1, t, gauss(60 + t)) for t in range(4)])
    named = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 1, 1), (9, 9, 9)], "run int, event_id long, trace_id int")
    known = spark.createDataFrame([(1, 1, 0, "normal", "0"), (1, 1, 1, "normal", "7"), (1, 1, 2, "strange", "gone"), (1, 5, 5, "strange", "Burst")], "run int, event_id long, trace_id int, family string, label string")
    strange = spark.createDataFrame([(1, "Noise", "n"), (2, "Burst", "b")], "id long, name string, shortcut_key string")

    def total(mode, metric="baseline"):
        return {r.series_key: r.n for r in histograms.histogram(metric, rows, mode, known, strange, named).groupBy("series_key").agg(F.sum("count").alias("n")).collect()}

    assert total("all") == {"all": 1024} and total("filtered") == {"filtered": 768} and total("veto") == {"veto": 512}
    assert total("labeled") == {"normal:0": 256, "normal:4+": 256}
    assert total("all", "cdf") == {"all": 600}
    counts = {r.series_key: r.traces for r in labels.label_counts(known, strange).collect()}
    assert counts == {"normal:0": 1, "normal:1": 0, "normal:2": 0, "normal:3": 0, "normal:4+": 1, "strange:Burst": 1, "strange:Noise": 0}
    assert [r.title for r in labels.label_dimension(strange).orderBy("pos").collect()] == ["0 peak", "1 peak", "2 peaks", "3 peaks", "4+ peaks", "Burst", "Noise"]
    series = histograms.labeled_series(histograms.histogram("baseline", rows, "labeled", known, strange), known, strange)
    assert {(r.series_key, r.traces) for r in series.collect()} == {("normal:0", 1), ("normal:4+", 1)}


def test_relabel(spark):
    plateau = np.zeros(256)
    plateau[120:124], plateau[124] = 2105, 2098
    rows = traces_of(spark, [(1, 1, 0, plateau), (1, 1, 1, plateau), (1, 1, 2, gauss(300)), (1, 1, 3, gauss(20))])
    known = spark.createDataFrame([(1, 1, 0, "strange", "saturation"), (1, 1, 1, "normal", "1"), (1, 1, 2, "normal", "1"), (1, 1, 3, "normal", "0")], "run int, event_id long, trace_id int, family string, label string")
    found = relabel.relabel("saturation", rows, known, scale=20.0, threshold=1900.0)
    assert [r.new_label for r in found.orderBy("trace_id").collect()] == ["strange:saturation", "strange:saturation", "normal:1", "normal:0"]
    assert [(r.numerator, r.denominator) for r in relabel.relabel_metrics("saturation", found).collect()] == [(1, 1), (1, 2)]
    assert [tuple(r) for r in relabel.relabel_confusions("saturation", found).collect()] == [("old normal:1 -> new strange:saturation", 1, 1, 1)]
    noise = relabel.relabel("noise", rows, known)
    assert [r.new_label for r in noise.orderBy("trace_id").collect()][2:] == ["normal:1", "normal:0"]


def test_event_steps_skip_bad_and_missing_events(spark):
    rows = traces_of(spark, [(1, 1, 0, [0]), (1, 1, 1, [0]), (1, 2, 0, [0]), (1, 4, 0, [0])])
    bad = spark.createDataFrame([(1, 2)], "run int, event_id long")
    catalog = tr.event_catalog(rows, bad)
    assert [(r.event_id, r.n_traces) for r in catalog.orderBy("event_id").collect()] == [(1, 2), (2, 0), (3, 0), (4, 1)]
    assert [tuple(r) for r in tr.event_neighbor(catalog).orderBy("event_id").collect()] == [(1, 1, 4, 1, 0, 1), (1, 4, 4, 1, 0, 1)]


HITS = "run int, event_id long, hit_id int, x double, y double, z double, amplitude double, trace_id int, pad_id int"


def test_coplanar_counts(spark):
    flat = [(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5)]
    cube = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (1, 0, 1)]
    points = [(1, x, y, 2 * x - y) for x, y in flat] + [(2, *p) for p in cube] + [(3, 0, 0, 0), (3, 1, 1, 1)]
    rows = spark.createDataFrame([(1, e, i, float(x), float(y), float(z), 1.0, 0, 0) for i, (e, x, y, z) in enumerate(points)], HITS)
    events = spark.createDataFrame([(1, e) for e in (1, 2, 3, 4)], "run int, event_id long")
    ratios = clouds.coplanar_ratio(events, rows)
    assert tuple(clouds.coplanar_counts(ratios).first()) == (1, 4, 2, 1, 3)
    assert [r.events for r in clouds.coplanar_thresholds(ratios).orderBy("threshold").collect()] == [1, 1, 1, 1]
    assert [tuple(r) for r in clouds.coplanar_histogram(ratios).collect()] == [(1, 0, 1)]


def test_z_cut_drops_what_is_not_a_number(spark):
    values = [-1.0, 0.0, 50.0, 1000.0, 1500.0, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, z double")
    assert [r.i for r in clouds.filter_hits_z(rows).collect()] == [1, 2, 3]


def test_projection(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(50, 3)) * [10, 3, 0.1]
    rows = spark.createDataFrame([(1, 1, i, *map(float, p), 1.0, 0, 0) for i, p in enumerate(points)] + [(1, 1, 99, float("nan"), 0.0, 0.0, 1.0, 0, 0), (1, 2, 0, 1.0, 1.0, 1.0, 1.0, 0, 0)], HITS)
    found = clouds.project_hits(rows).collect()
    u = np.array([r.u for r in found if r.event_id == 1 and r.hit_id < 99])
    assert np.isclose(u.var(), np.linalg.eigvalsh(np.cov(points.T, bias=True))[-1])
    assert all(r.u is None for r in found if r.event_id == 2 or r.hit_id == 99)


def test_lines_in_spark(spark):
    points = np.concatenate([_track((1, -0.4, 0.1), noise=3.0), _track((0.3, 0.3, 1), noise=3.0, seed=1)])
    rows = spark.createDataFrame([(1, 1, i, *map(float, p), 5.0, 0, 0) for i, p in enumerate(points)] + [(1, 2, 0, 0.0, 0.0, 0.0, 1.0, 0, 0)], HITS)
    lines = clouds.extract_lines(rows).cache()
    assert lines.count() == 2 and {r.event_id for r in lines.collect()} == {1}
    other = clouds.extract_lines(rows.repartition(7))
    assert sorted(map(str, lines.collect())) == sorted(map(str, other.collect()))
    measures = clouds.measure_lines(rows, lines).collect()
    assert all(300 < r.length < 500 and r.charge > 200 for r in measures)
    pair = clouds.line_pairs(lines).collect()
    assert len(pair) == 1 and 0 <= pair[0].angle <= 180
    events = rows.select("run", "event_id").distinct()
    assert {(r.bin_x, r["count"]) for r in clouds.line_count_histogram(events, lines).collect()} == {(0, 1), (2, 1)}
    tags = clouds.line_labels(rows, lines)
    assert {r.suggested for r in tags.where("event_id = 1").collect()} == {"2"} and tags.where("event_id = 2").first().line_id == -1


def test_second_centre_to_first_line(spark):
    lines = spark.createDataFrame([(1, 1, 0, [0], 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 1, 1, [1], 3.0, 4.0, 5.0, 1.0, 0.0, 0.0)], clouds.LINE_SCHEMA)
    assert [(r.distance, round(r.angle, 6)) for r in clouds.line_pairs(lines).collect()] == [(5.0, 90.0)]


def test_last_bin_is_closed(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 9.0, 9.999, 10.0, 10.1, -0.1, None)], "v double")
    assert [r.b for r in rows.select(clouds.closed_bin(F.col("v"), 10, 0.0, 10.0).alias("b")).collect()] == [0, 9, 9, 9, None, None, None]


def test_trace_hits_in_the_order_asked_for(spark):
    rows = traces_of(spark, [(1, 1, 0, [11, 21, 31]), (1, 1, 2, [71, 81, 91])])
    cloud = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 0.0, 1.0, 2, 0)], HITS)
    wanted = spark.createDataFrame([(0, 1, 1, 2), (1, 1, 1, 0), (2, 1, 1, 2)], "pos int, run int, event_id long, trace_id int")
    assert [(r.samples[0], len(r.hits or [])) for r in clouds.trace_hits(wanted, rows, cloud).collect()] == [(71, 1), (11, 0)]


PADS = "pad int, x double, y double, scale double, direction int, cobo int, asad int, aget int, channel int"


def test_build_hits(spark):
    row = np.zeros(512)
    row[:] = gauss(0).sum()
    row[192:448] += gauss(100)
    hardware = "named_struct('cobo', 8, 'asad', 2, 'aget', 0, 'channel', 65, 'pad', 0) AS hardware"
    rows = traces_of(spark, [(70, 700, 3, row)]).selectExpr("*", hardware)
    known = spark.createDataFrame([(5, 1.0, 2.0, 0.5, 0, 8, 2, 0, 65), (0, 0.0, 0.0, 1.0, 1, 1, 1, 1, 1)], PADS)
    found = hits.build_hits(rows, pads.pad_centroid(known)).collect()
    assert len(found) == 1 and found[0].pad_id == 5 and (found[0].orig_run, found[0].orig_event) == (70, 700)
    assert np.isclose(found[0].z, (found[0].time_bucket - 10) / 550 * 1000)
    other = rows.withColumn("hardware", F.expr("named_struct('cobo', 0, 'asad', 0, 'aget', 0, 'channel', 0, 'pad', 0)"))
    assert hits.build_hits(other, pads.pad_centroid(known)).first().pad_id == 0
    nowhere = rows.withColumn("hardware", F.expr("named_struct('cobo', 0, 'asad', 0, 'aget', 0, 'channel', 0, 'pad', 77)"))
    assert hits.build_hits(nowhere, pads.pad_centroid(known)).count() == 0


def test_pad_directions_reports_conflicts(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (7, 8), (2, 0)]
    near = spark.createDataFrame([(a, b, 1.0, 1) for a, b in pairs + [(b, a) for a, b in pairs]], "pad int, pad2 int, distance double, rank int")
    done, wrong = pads.pad_directions(near, 3, 4.5)
    got = {r.pad: r.direction for r in done.collect()}
    assert set(got) == {0, 1, 2, 3} and got[3] == 0 and wrong.count() > 0  # the diagonal makes odd rings
    done, wrong = pads.pad_directions(near.where("not (pad in (0, 2) and pad2 in (0, 2))"), 3, 4.5)
    assert {r.pad: r.direction for r in done.collect()} == {3: 0, 0: 1, 2: 1, 1: 0} and wrong.count() == 0


def test_label_changes(spark):
    at = "run int, event_id long, label string, created_at timestamp, updated_at timestamp"

    def stamped(rows):
        return spark.createDataFrame(rows, "run int, event_id long, label string, at string").selectExpr("run", "event_id", "label", "timestamp(at) AS created_at", "timestamp(at) AS updated_at")

    old, new = stamped([(1, 1, "2", "2024-01-01"), (1, 2, "3", "2024-01-01")]), stamped([(1, 1, "6+", "2024-02-01"), (1, 3, "0", "2024-02-01")])
    got = labels.apply_event_changes(old, new)
    assert got.schema.simpleString() == spark.createDataFrame([], at).schema.simpleString()
    assert {(r.event_id, r.label, r.created_at.month, r.updated_at.month) for r in got.collect()} == {(1, "6+", 1, 2), (2, "3", 1, 1), (3, "0", 2, 2)}
    with pytest.raises(Exception, match="no such event label"):
        labels.apply_event_changes(old, stamped([(1, 1, "7", "2024-02-01")])).collect()


def test_strange_labels(spark):
    existing = spark.createDataFrame([(1, "Noise", "n"), (2, "Free", "f")], "id long, name string, shortcut_key string")
    batch = spark.createDataFrame([(0, " Burst ", "b"), (1, "NOISE", "x"), (2, "  ", "y"), (3, "burst", "z"), (4, "Other", "n")], "pos long, name string, shortcut_key string")
    assert [r.reason for r in labels.add_strange_labels(existing, batch).orderBy("pos").collect()] == [None, "duplicate name", "empty name", "duplicate name", "duplicate key"]
    used = spark.createDataFrame([(1, 1, 0, "strange", "Noise")], "run int, event_id long, trace_id int, family string, label string")
    assert {(r.name, r.used, r.removed) for r in labels.remove_strange_labels(existing, used, existing.select("name")).collect()} == {("Noise", 1, False), ("Free", 0, True)}


def test_run_files(spark):
    files = spark.createDataFrame([("/a/run_0008.h5",), ("/a/run_12.h5",), ("/a/notes.txt",)], "path string")
    assert {(r.run, r.name) for r in tables.run_catalog(files).collect()} == {(8, "run_0008"), (12, "run_0012")}
    with pytest.raises(Exception, match="two files for run 8"):
        tables.run_catalog(files.union(spark.createDataFrame([("/b/run_8.h5",)], "path string"))).collect()


def test_parameters_and_filter_sets(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run int")
    stored = spark.createDataFrame([(1, "length", 5.0)], "run int, key string, value double")
    assert [tuple(r) for r in tables.processing_params(runs, stored, {"length": 9.0}).orderBy("run").collect()] == [(1, 5.0), (2, 9.0)]
    with pytest.raises(Exception, match="no value for length"):
        tables.processing_params(runs, stored, {"length": None}).collect()
    rows = spark.createDataFrame([("a", 0, 3, 1, 1)], "filter_name string, pos long, run int, event_id long, trace_id int")
    with pytest.raises(Exception, match="unknown run 3"):
        tables.filter_rows_scan(rows, runs).collect()


def test_titles(spark):
    rows = spark.createDataFrame([("normal", "0"), ("normal", "4+"), ("normal", "9"), ("strange", "Odd Name!")], "f string, l string")
    assert [r.t for r in rows.select(labels.label_title(F.col("f"), F.col("l")).alias("t")).collect()] == ["0 peak", "4+ peaks", "9+ peaks", "Odd Name!"]
    assert [r.k for r in rows.select(labels.sanitize_label_key(labels.label_key(F.col("f"), F.col("l"))).alias("k")).collect()] == ["normal_0", "normal_4", "normal_9", "strange_odd_name"]


def test_review_and_neighbours(spark):
    known = spark.createDataFrame([(1, 1, 0, "normal", "4"), (1, 1, 1, "normal", "9"), (1, 1, 2, "normal", "2")], "run int, event_id long, trace_id int, family string, label string")
    assert keys(labels.filter_review(known, 1, "normal", "4+")) == [(1, 1, 0), (1, 1, 1)]
    assert len(keys(labels.filter_review(known, 1, "normal"))) == 3
    marks = spark.createDataFrame([(1, 3), (1, 7)], "run int, event_id long")
    wanted = spark.createDataFrame([(1, 1), (1, 3), (1, 5), (1, 9), (2, 1)], "run int, event_id long")
    assert {(r.run, r.event_id): r.labeled_event for r in labels.closest_labeled_event(wanted, marks).collect()} == {(1, 1): 3, (1, 3): 3, (1, 5): 7, (1, 9): 7, (2, 1): None}


def test_rows_are_numbered_by_many_tasks(spark):
    rows = spark.range(0, 5000, 1, 5).selectExpr("CAST(id % 2 AS INT) AS run", "id * 7919 % 5000 AS event_id", "CAST(id % 10 AS INT) AS trace_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        found = tables.numbered(rows, *tr.KEYS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(r) for r in found.orderBy("pos").collect()] == [(*k, i) for i, k in enumerate(sorted(map(tuple, rows.collect())))]
    assert found.groupBy(F.spark_partition_id()).count().count() > 1
    assert tables.numbered(rows.limit(0), *tr.KEYS).count() == 0


def test_written_filter_has_no_limit(spark, monkeypatch):
    limits, wanted = [], predicates.filter_traces
    monkeypatch.setattr(predicates, "filter_traces", lambda *a, **b: limits.append(b["limit"]) or wanted(*a, **b))
    rows = traces_of(spark, [(1, e, 0, gauss(50)) for e in range(3)])
    monkeypatch.setattr(queries.bind, "traces", lambda s, d: rows)
    assert queries.QUERIES["write_filter_rows"](spark, "").count() == 0
    assert limits == [0]


def test_neighbours_over_the_edges_of_buckets(spark):
    ids = [1, 5, 4095, 4096, 9000, 9001, 20000]
    events = spark.createDataFrame([(r, i, n + 1) for r in (1, 2) for n, i in enumerate(ids[r - 1 :])], "run int, event_id long, n_traces long")
    found = {(r.run, r.event_id): (r.previous_event, r.next_event, r.previous_last_trace, r.next_last_trace) for r in tr.event_neighbor(events).collect()}
    for run in (1, 2):
        own = ids[run - 1 :]
        for k, i in enumerate(own):
            a, b = max(k - 1, 0), min(k + 1, len(own) - 1)
            assert found[run, i] == (own[a], own[b], a, b)
    labelled = events.where("run = 1 and event_id in (5, 4096, 9001)").select("run", "event_id")
    closest = {(r.run, r.event_id): r.labeled_event for r in labels.closest_labeled_event(events.select("run", "event_id"), labelled).collect()}
    assert [closest[1, i] for i in ids] == [5, 5, 4096, 4096, 9001, 9001, 9001] and {closest[2, i] for i in ids[1:]} == {None}
    found = {r.event_id: (r.previous_event, r.next_event) for r in labels.labeled_event_neighbor(labelled).collect()}
    assert found == {5: (5, 4096), 4096: (5, 9001), 9001: (4096, 9001)}


def test_latest_change_wins_and_ties_have_one_winner(spark):
    schema = "run int, event_id long, trace_id int, label string, created_at int, updated_at int"
    old = spark.createDataFrame([(1, 1, 1, "old", 1, 5), (1, 1, 2, "old", 1, 1)], schema)
    new = spark.createDataFrame([(1, 1, 1, "a", 5, 5), (1, 1, 1, "b", 5, 5), (1, 1, 3, "c", 2, 2)], schema)
    out = {r.trace_id: (r.label, r.created_at) for r in labels.apply_changes(old, new, tr.KEYS).collect()}
    assert out == {1: ("b", 1), 2: ("old", 1), 3: ("c", 2)}


def test_an_empty_selection_keeps_its_metadata(spark):
    rows = spark.createDataFrame([(r, 1, t, [0.0] * 10 + [3000.0] * 3 + [0.0] * 10) for r in (1, 2) for t in range(3)], "run int, event_id long, trace_id int, samples array<double>")
    named = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 9, 9)], "run int, event_id long, trace_id int")
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run int")
    found = histograms.filtered_histogram("saturation", rows, runs, named, "mine", variant="length", threshold=100)
    about = {r.run: r for r in found.metadata.collect()}
    assert {n: (r.trace_count, r.series) for n, r in about.items()} == {1: (3, 1), 2: (0, 0), 3: (0, 0)}  # repeats and unknown traces count
    assert (about[2].title, about[2].bin_count, about[2].bin_label, about[2].variant, about[2].parameters) == ("Filtered traces · mine", 256, "Plateau length", "length", {"scale": 10.0, "threshold": 100.0})
    assert {(r.run, r["count"]) for r in found.rows.collect()} == {(1, 2)}
    others = histograms.filtered_histogram("saturation", rows, runs, named, "mine", True, threshold=100)
    assert {(r.run, r.variant, r.trace_count, r.title) for r in others.metadata.collect()} == {(n, v, c, "Vetoed traces · mine") for n, c in ((1, 2), (2, 3), (3, 0)) for v in ("drop", "length")}
    nothing = histograms.filtered_histogram("cdf", rows, runs, named.limit(0), "none")
    assert nothing.rows.count() == 0 and {(r.run, r.trace_count, r.bin_label) for r in nothing.metadata.collect()} == {(n, 0, None) for n in (1, 2, 3)}
    assert {m: set(v) for m, v in histograms.AXES.items()} == {"amplitude": {"peaks"}, "baseline": {"samples"}, "cdf": {"cdf"}, "bitflip": {"baseline", "value", "length", "count"}, "saturation": {"drop", "length"}}


def test_events_get_the_parameters_of_their_run(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(r, 1, i, float(x), float(y), float(z), 1.0, 0, 0) for r in (1, 2) for i, (x, y, z) in enumerate(rng.uniform(0, 100, (40, 3)))], HITS)
    runs, stored = spark.createDataFrame([(1,), (2,)], "run int"), spark.createDataFrame([(1, "detector_length", 30.0)], "run int, key string, value double")
    known = tables.processing_params(runs, stored, {"detector_length": 80.0, "fft_window_scale": 20.0})
    found = clouds.event_hits(rows, processing=known).collect()
    assert {(r.run, r.processing.detector_length, r.processing.fft_window_scale) for r in found} == {(1, 30.0, 20.0), (2, 80.0, 20.0)}
    assert len(found) == sum(r.z <= (30 if r.run == 1 else 80) for r in rows.collect()) and all(r.u is not None for r in found)
    alone = {(r.run, r.hit_id): r.u for r in clouds.event_hits(rows.where("run = 1"), 30.0).collect()}
    assert all(r.u == alone[r.run, r.hit_id] for r in found if r.run == 1)
    with pytest.raises(Exception, match="no value for detector_length"):  # before any hit is read
        clouds.event_hits(rows, processing=tables.processing_params(runs, stored, {"detector_length": None}))
    with pytest.raises(Exception, match="no parameters of run 2"):
        clouds.event_hits(rows, processing=known.where("run = 1")).count()


def test_any_number_of_rules(spark):
    rules = [(i, str(i % 7), "*" if i % 3 else str(i % 5), "*" if i % 2 else "1", str(i % 11) if i % 5 else "*", f"c{i}") for i in range(5, 900)]
    rules += [(900, "*", "*", "*", "*", "last"), (901, "*", "*", "*", "*", "never"), (3, "1", "2", "*", "*", "early"), (4, "1", "2", "*", "*", "late")]
    address = [(p, p % 7, p % 5, p % 3, p % 11) for p in range(60)] + [(7, 1, 2, 0, 0), (7, 1, 2, 0, 0), (99, None, 2, 1, 3)]
    own = spark.createDataFrame(address, "pad int, cobo int, asad int, aget int, channel int")

    def plain(fields, known):
        return next((r[5] for r in sorted(known) if all(x == "*" or x == str(v) for x, v in zip(r[1:5], fields, strict=True))), "gray")

    table = lambda known: spark.createDataFrame(known, "pos int, cobo string, asad string, aget string, channel string, color string")
    for known in (rules, rules[:400], rules[-2:]):
        found = sorted(map(tuple, pads.first_match_rules(own, table(known), "gray").collect()))
        assert found == sorted((a[0], plain(a[1:], known)) for a in address)
    assert {r.color for r in pads.first_match_rules(own, table(rules).limit(0), "gray").collect()} == {"gray"}
