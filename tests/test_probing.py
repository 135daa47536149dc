"""Samples and scans that read only what they need, against loops."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import probing
from driftline.operators import traces as tr
from driftline.sources import runs

KEYS = "run int, event_id long, trace_id int"


def frame(spark, rows):
    return spark.createDataFrame(rows, KEYS).withColumn("samples", F.expr("transform(sequence(0, 9), i -> CAST(sin(i * trace_id) * event_id AS DOUBLE))"))


def loop(rows, labelled, run, n, seed, bad=(), reach=probing.REACH, attempts=probing.ATTEMPTS):
    """The same draw, one trial after another."""
    ids = sorted(e for r, e, _ in rows if r == run)
    first, span = ids[0], ids[-1] - ids[0] + 1
    found = []
    for k in range(attempts):
        drawn = hashlib.md5(f"{run}/{seed}/{k}".encode()).hexdigest()
        at, start = int(drawn[:8], 16) % span, int(drawn[8:16], 16)
        for step in range(min(reach, span)):
            event = first + (at + step) % span
            traces = sorted(t for r, e, t in rows if (r, e) == (run, event)) if event not in bad else []
            order = traces[start % len(traces) :] + traces[: start % len(traces)] if traces and step == 0 else traces
            free = [t for t in order if (run, event, t) not in labelled]
            if free:
                if (run, event, free[0]) not in found:
                    found.append((run, event, free[0]))
                break
        if len(found) == n:
            break
    return found


@pytest.fixture(scope="module")
def events():
    """Two runs, with gaps, over several folders of event ids; the first run begins at 40."""
    return [(r, e, t) for r in (1, 2) for e in range(40 * r, 2300, 7) for t in range(e % 4 + 1)]


def test_sampling_equals_a_loop_and_reads_probed_folders_only(spark, events, tmp_path):
    where = str(tmp_path / "runs")
    runs.write_traces(frame(spark, events), where)
    labelled = [k for k in events if (k[1] + k[2]) % 3]
    labels = spark.createDataFrame([(*k, "normal", "1") for k in labelled], KEYS + ", family string, label string")
    bad = spark.createDataFrame([(2, e) for e in range(80, 2300, 35)], "run int, event_id long")
    draw = lambda n, seed, **p: [tuple(r)[1:] for r in probing.sample_stored_traces(spark, where, 2, labels, n, seed, **p).orderBy("pos").collect()]
    assert draw(5, 1) == loop(events, set(labelled), 2, 5, 1)
    assert draw(30, 2, bad_events=bad) == loop(events, set(labelled), 2, 30, 2, set(range(80, 2300, 35)))
    assert draw(9, 3, reach=2, attempts=12) == loop(events, set(labelled), 2, 9, 3, reach=2, attempts=12)
    shown = spark.createDataFrame(draw(5, 1), KEYS)
    assert not set(draw(5, 1, shown=shown)) & set(draw(5, 1))
    assert draw(0, 1) == [] and draw(3, 1, attempts=0) == []
    want = draw(2, 1)
    needed = {e // runs.EVENT_BUCKET for _, at, _ in probing.probes(2, 80, 2299 - (2299 - 80) % 7, 1, range(4)) for e in range(at, at + probing.REACH)} | {0, 2299 // runs.EVENT_BUCKET}
    gone = [p for p in (tmp_path / "runs" / "run_0002.parquet").iterdir() if p.is_dir() and int(p.name.split("=")[1]) not in needed]
    assert gone
    for p in gone:  # a file that is opened nevertheless is an error
        for f in p.glob("*.parquet"):
            f.write_bytes(b"broken")
        for f in p.glob(".*.crc"):
            f.unlink()
    assert draw(2, 1) == want


def handle(limit, seen=None):
    def run(event: pd.DataFrame):
        own = event[["run", "event_id", "trace_id"]]
        if event["event_id"].iloc[0] % 5 == 0:
            return None, True
        return own.assign(note=None if event["event_id"].iloc[0] % 2 else "even"), int(event["event_id"].iloc[0]) < limit

    return run


SCHEMA = KEYS + ", note string"


@pytest.mark.parametrize("limit, waves, events_read", [(131, 3, 15), (40, 1, 2), (10**6, 12, 641)])
def test_a_scan_ends_where_the_handler_says(spark, events, limit, waves, events_read):
    rows = frame(spark, events).repartition(5)
    scan = probing.scan_until(rows, handle(limit), SCHEMA, first_wave=8, growth=3)
    want = []
    for run, event in sorted({k[:2] for k in events}):
        own = pd.DataFrame([k for k in events if k[:2] == (run, event)], columns=["run", "event_id", "trace_id"])
        found, go = handle(limit)(own)
        want += [] if found is None else [tuple(r) for r in found.itertuples(index=False)]
        if not go:
            break
    assert sorted(map(tuple, scan.rows.collect()), key=str) == sorted(want, key=str)
    assert (scan.waves, scan.events) == (waves, events_read)


def test_later_waves_are_never_read(spark, events, tmp_path):
    runs.write_traces(frame(spark, events), str(tmp_path))
    counter = spark.sparkContext.accumulator(0)

    def counted(event):
        counter.add(1)
        return handle(100)(event)

    rows = runs.read_runs(spark, str(tmp_path)).where("run = 1")
    scan = probing.scan_until(rows, counted, SCHEMA, first_wave=64, growth=2)
    assert scan.waves == 1 and scan.events == counter.value == len({e for r, e, _ in events if r == 1 and e < 104})
    bad = spark.createDataFrame([(1, e) for _, e, _ in events if e < 104], "run int, event_id long").distinct()
    assert probing.scan_until(rows, handle(0), SCHEMA, bad, first_wave=64, growth=2).waves == 2


def test_nothing_to_scan(spark):
    scan = probing.scan_until(frame(spark, []), handle(1), SCHEMA)
    assert (scan.rows.count(), scan.events, scan.waves) == (0, 0, 0) and scan.rows.columns == [*tr.KEYS, "note"]
