"""Reads that end early: random unlabelled traces by probes into stored runs, and scans in waves that a handler ends."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import runs
from ..sources.shared import durable
from . import traces as tr

#: Random events tried at most, and events from one of them on that are looked at.
ATTEMPTS, REACH = 1024, 32


def probes(run: int, first: int, last: int, seed: int, trials: range) -> list[tuple[int, int, int]]:
    """(trial, event, number for the first trace) of each trial: from the md5 of run, seed and trial, so that anything can repeat the draw."""
    out = []
    for k in trials:
        drawn = hashlib.md5(f"{run}/{seed}/{k}".encode()).hexdigest()
        out.append((k, first + int(drawn[:8], 16) % (last - first + 1), int(drawn[8:16], 16)))
    return out


def _in_buckets(rows: DataFrame, buckets: list[int], column: str = "event_bucket") -> DataFrame:
    """Rows of some buckets of event ids; of stored traces no other folder is opened."""
    return rows.where((F.col(column) if column in rows.columns else F.floor(F.col("event_id") / runs.EVENT_BUCKET)).isin(buckets))


def sample_stored_traces(spark: SparkSession, path: str, run: int, labels: DataFrame, n: int, seed: int = 0, shown: DataFrame | None = None, bad_events: DataFrame | None = None, reach: int = REACH, attempts: int = ATTEMPTS) -> DataFrame:
    """(pos, run, event_id, trace_id): up to ``n`` random unlabelled traces of a run that ``runs.write_traces`` stored, without reading the run.

    Each trial draws an event id and takes the first trace that is neither labelled nor shown: of the event itself from
    a random trace on, round to it; else the first one of the next of ``reach`` events that has any (after the last
    event comes the first). A trace that an earlier trial took is passed over. Trials go on in growing rounds until n traces are found or
    ``attempts`` are spent; a round reads the event buckets of its trials, and labels in them. The driver gets one trace for each trial.
    """
    if n <= 0:
        return spark.createDataFrame([], "pos int, run int, event_id long, trace_id int")
    where = runs.find_run(spark, path, run, "parquet")
    stored = runs.read_runs(spark, where, run)
    first, last = _span(spark, where, stored)
    span, found, begin, end = last - first + 1, {}, 0, min(attempts, 2 * n)
    while begin < end and len(found) < n:
        tried = probes(run, first, last, seed, range(begin, end))
        events = [(k, j, first + (e - first + j) % span, start) for k, e, start in tried for j in range(min(reach, span))]
        buckets = sorted({e // runs.EVENT_BUCKET for _, _, e, _ in events})
        asked = F.broadcast(spark.createDataFrame(events, "trial int, step int, event_id long, start long"))  # attempts * reach rows at most
        near = _in_buckets(stored.select(*tr.KEYS, "event_bucket"), buckets)
        if bad_events is not None:
            near = near.join(bad_events, tr.EVENT, "left_anti")
        count = near.groupBy("event_id").agg(F.count("*").alias("_n"))
        free = near
        for taken in (labels, shown):
            if taken is not None:
                free = free.join(_in_buckets(taken.where(F.col("run") == run), buckets).select(*tr.KEYS), tr.KEYS, "left_anti")
        turn = F.when(F.col("step") == 0, F.pmod(F.col("trace_id") - F.pmod("start", "_n"), F.col("_n"))).otherwise(F.col("trace_id").cast("long"))
        best = free.join(asked, "event_id").join(count, "event_id").groupBy("trial").agg(F.min(F.struct("step", turn.alias("turn"), "event_id", "trace_id")).alias("b"))
        for r in sorted(best.collect(), key=lambda r: r.trial):
            found.setdefault((run, r.b.event_id, r.b.trace_id), r.trial)
        begin, end = end, min(attempts, 4 * end)
    return spark.createDataFrame([(i, *key) for i, key in enumerate(list(found)[:n])], "pos int, run int, event_id long, trace_id int")


def _span(spark: SparkSession, where: str, stored: DataFrame) -> tuple[int, int]:
    """The least and the greatest event id, from the names of the folders and the two folders at the ends."""
    system, root = runs.located(spark, where)
    buckets = [int(x.getPath().getName().removeprefix("event_bucket=")) for x in system.listStatus(root) if x.getPath().getName().startswith("event_bucket=")]
    ends = _in_buckets(stored, [min(buckets), max(buckets)])
    return tuple(ends.agg(F.min("event_id"), F.max("event_id")).first())


class Scan(NamedTuple):
    """The rows that a handler gave up to where it stopped; how many events it got, and in how many waves."""

    rows: DataFrame
    events: int
    waves: int


#: Event ids of a run's first wave, and how many times as many the next one has.
FIRST_WAVE, GROWTH = 64, 4


def scan_until(traces: DataFrame, handler: Callable[[pd.DataFrame], tuple[pd.DataFrame | None, bool]], schema: str, bad_events: DataFrame | None = None, run: int | None = None, scale: float = tr.SCALE, first_wave: int = FIRST_WAVE, growth: int = GROWTH) -> Scan:
    """A user's handler over the cleaned traces of one event after another, in order of run and event, until it says stop.

    The handler gets an event's frame and gives rows of ``schema`` (or None) and whether to go on. Events are
    handled in waves of event ids, in parallel within a wave; the next wave, ``growth`` times as wide, is read only
    if no event has said stop. Of the wave that has, rows of events after the first one that said it are dropped, so
    the result is that of a loop. Stored traces are read by their event buckets. An event is one group, bounded by the detector.
    """
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    marks = pa.schema([("_run", pa.int32()), ("_event", pa.int64()), ("_go", pa.bool_()), ("_real", pa.bool_())])

    def handled(key: tuple[pa.Scalar, ...], event: pa.Table) -> pa.Table:
        rows, go = handler(event.to_pandas())
        found = arrow.empty_table() if rows is None else pa.Table.from_pandas(rows, arrow, preserve_index=False)
        found = pa.concat_tables([found, pa.table([pa.nulls(1, f.type) for f in arrow], schema=arrow)])  # and a row that says how it went
        real = pa.array([True] * (len(found) - 1) + [False])
        own = [pa.repeat(x, len(found)) for x in (key[0], key[1], pa.scalar(bool(go)))]
        return pa.Table.from_arrays([*own, real, *found.columns], schema=pa.schema([*marks, *arrow]))

    if run is not None:
        traces = traces.where(F.col("run") == run)
    spans = traces.groupBy("run").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).orderBy("run").collect()
    waves = [(r.run, a, b) for r in spans for a, b in _widening(r.a, r.b, first_wave, growth)]
    parts, stop, events, n = [], None, 0, 0
    for n, (own, a, b) in enumerate(waves, 1):
        wave = traces.where((F.col("run") == own) & F.col("event_id").between(a, b))
        if "event_bucket" in traces.columns:
            wave = wave.where(F.col("event_bucket").between(a // runs.EVENT_BUCKET, b // runs.EVENT_BUCKET))
        done = durable(tr.trace_scan(wave, bad_events, scale=scale).groupBy(*tr.EVENT).applyInArrow(handled, f"_run int, _event long, _go boolean, _real boolean, {schema}"))
        told = done.where("NOT _real").agg(F.count("*").alias("n"), F.min(F.when(~F.col("_go"), F.col("_event"))).alias("stop")).first()
        events, stop = events + told.n, told.stop
        parts.append(done if stop is None else done.where(F.col("_event") <= stop))
        if stop is not None:
            break
    rows = traces.sparkSession.createDataFrame([], kind)
    for part in parts:
        rows = rows.unionByName(part.where("_real").select(*kind.names))
    return Scan(rows, events, n)


def _widening(first: int, last: int, width: int, growth: int) -> list[tuple[int, int]]:
    out = []
    while first <= last:
        out.append((first, min(last, first + width - 1)))
        first, width = first + width, width * growth
    return out
