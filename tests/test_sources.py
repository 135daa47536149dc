"""Run files, rows by their place in files, and lookups that miss nothing."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import pads
from driftline.operators import traces as tr
from driftline.sources import runs


def touch(folder, *names):
    for n in names:
        (folder / n).parent.mkdir(parents=True, exist_ok=True)
        (folder / n).write_bytes(b"abc")


def test_a_folder_of_run_files(spark, tmp_path):
    touch(tmp_path, "run_0008.h5", "run_12.h5", "notes.txt", "run_x.txt", "deep/run_0099.h5", "run_0030.h5/part-0", "run_0030.h5/part-1", "run_0030.h5/b=1/part-2")
    found = {r.run: r for r in runs.run_files(spark, str(tmp_path)).collect()}
    assert {n: (r.name, r.file, r.files, r.bytes) for n, r in found.items()} == {8: ("run_0008", "run_0008.h5", 1, 3), 12: ("run_0012", "run_12.h5", 1, 3), 30: ("run_0030", "run_0030.h5", 3, 9)}
    assert found[8].path == f"file:{tmp_path}/run_0008.h5" and found[8].modified is not None
    one = runs.run_files(spark, f"{tmp_path}/run_12.h5").collect()
    assert [(r.run, r.file) for r in one] == [(12, "run_12.h5")]
    assert [(r.run, r.files) for r in runs.run_files(spark, f"{tmp_path}/run_0030.h5").collect()] == [(30, 3)]


def test_bad_names_are_errors(spark, tmp_path):
    touch(tmp_path / "two", "run_0008.h5", "run_8.h5")
    touch(tmp_path / "odd", "run_8b.h5")
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="two files for run 8: run_0008.h5, run_8.h5"):
        runs.run_files(spark, str(tmp_path / "two")).collect()
    with pytest.raises(Exception, match="not a run file: run_8b.h5"):
        runs.run_files(spark, str(tmp_path / "odd")).collect()
    with pytest.raises(Exception, match="two files for run 8"):
        runs.run_files(spark, str(tmp_path / "two")).select("run").count()
    with pytest.raises(ValueError, match="not a run file"):
        runs.run_files(spark, str(tmp_path / "odd" / "run_8b.h5"))
    assert runs.run_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        runs.run_files(spark, str(tmp_path / "absent")).collect()


def test_a_requested_run(spark, tmp_path):
    touch(tmp_path, "run_0008.h5", "run_8.h5", "run_12.h5", "run_013.h5", "run_13.h5")
    where = str(tmp_path)
    assert runs.find_run(spark, where, 8).endswith("/run_0008.h5")  # the full name goes first
    assert runs.find_run(spark, where, 12).endswith("/run_12.h5")
    assert runs.find_run(spark, f"{where}/run_12.h5", 12).endswith("/run_12.h5")
    for path, run, message in ((where, 13, "two files for run 13"), (where, 14, "no file for run 14"), (f"{where}/run_12.h5", 8, "not a file of run 8"), (f"{where}/absent", 8, "no such path")):
        with pytest.raises(ValueError, match=message):
            runs.find_run(spark, path, run)


TRACES = "run int, event_id long, trace_id int, samples array<double>"


def traces(spark, n=2000):
    return spark.range(n).selectExpr("CAST(id % 2 + 1 AS INT) AS run", "id div 8 * 3 AS event_id", "CAST(id div 2 % 4 AS INT) AS trace_id", "array(CAST(id AS DOUBLE), 1D) AS samples")


def test_runs_are_written_and_read_back(spark, tmp_path):
    rows, where = traces(spark), str(tmp_path / "w")
    runs.write_traces(rows, where)
    runs.write_traces(rows.where("run = 2 AND event_id < 300"), where)  # replaces one run
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == ["run_0001.parquet", "run_0002.parquet"]
    want = rows.where("run = 1 OR event_id < 300")
    back = runs.read_runs(spark, where).select(*rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))
    assert runs.read_runs(spark, where, 2).select(*rows.columns).exceptAll(want.where("run = 2")).isEmpty()
    plan = runs.read_runs(spark, where, 1).where(f"event_bucket = {300 // runs.EVENT_BUCKET}")
    assert len(plan.inputFiles()) > 0 and plan.where("event_id >= 256 AND event_id < 512").count() == plan.count()
    with pytest.raises(ValueError, match="no run files"):
        runs.read_runs(spark, str(tmp_path))


def test_rows_have_their_place_in_many_files(spark, tmp_path):
    where = tmp_path / "parts"
    where.mkdir()
    lines = [f"{i},{i * 7 % 13}" for i in range(3000)]
    for k, (a, b) in enumerate(((0, 1000), (1000, 1001), (1001, 3000))):
        (where / f"part-{k:02d}.csv").write_text("\n".join(["a,b", *lines[a:b]]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several splits of a file
    try:
        rows = runs.positioned(spark.read.schema("a INT, b INT").csv(str(where), header=True))
        assert rows.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, rows.collect())) == [(i, i * 7 % 13, i) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    only = runs.positioned(spark.read.schema("a INT, b INT").csv(str(where), header=True), "b")
    assert only.columns == ["b", "position"] and only.agg(F.max("position")).first()[0] == 2999


def test_a_pad_map_of_uneven_parts(spark, tmp_path):
    for name, text in (("xy", "x,y\n0.5,1\n2,3\n4,5\n"), ("scale", "scale\n1\n0.5\n"), ("channels", "cobo,asad,aget,aget channel,det channel,det keyword\n1,2,3,4,1,pad\n9,9,9,9,0,FPN\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    where = str(tmp_path)
    found = pads.pad_map_from_files(spark, f"{where}/xy.csv", f"{where}/scale.csv", f"{where}/channels.csv").orderBy("pad").collect()
    assert [tuple(r[c] for c in ("pad", "x", "y", "scale", "direction", "cobo", "channel")) for r in found] == [(0, 0.5, 1.0, 1.0, None, None, None), (1, 2.0, 3.0, 0.5, None, 1, 4), (2, 4.0, 5.0, None, None, None, None)]
    (tmp_path / "direction.csv").write_text("direction\n1\n0\n1\n")
    found = pads.pad_map_from_files(spark, f"{where}/xy.csv", f"{where}/scale.csv", f"{where}/channels.csv", f"{where}/direction.csv")
    assert [r.direction for r in found.orderBy("pad").collect()] == [1, 0, 1]


def test_lookups_raise_for_what_is_missing(spark):
    rows = traces(spark, 80)
    names = lambda *r: spark.createDataFrame(r, "run int, event_id long, trace_id int, pos long")
    assert sorted((r.event_id, r.trace_id, r.pos) for r in tr.trace_lookup(rows, names((1, 3, 0, 5), (1, 3, 0, 6), (2, 0, 1, 7))).collect()) == [(0, 1, 7), (3, 0, 5), (3, 0, 6)]
    for missing in ((1, 3, 9, 0), (1, 4, 0, 0), (7, 3, 0, 0)):
        wanted = names((1, 3, 0, 5), missing)
        for used in (lambda f: f.collect(), lambda f: f.select("pos").collect(), lambda f: f.count()):
            with pytest.raises(Exception, match="no trace " + "/".join(map(str, missing[:3]))):
                used(tr.trace_lookup(rows, wanted))
    events = spark.createDataFrame([(1, 3), (2, 0)], "run int, event_id long")
    assert sorted(map(tuple, tr.trace_lookup(rows, events).groupBy("run", "event_id").count().collect())) == [(1, 3, 4), (2, 0, 4)]
    with pytest.raises(Exception, match="no trace 1/4"):
        tr.trace_lookup(rows, spark.createDataFrame([(1, 3), (1, 4)], "run int, event_id long")).count()
