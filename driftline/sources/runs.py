"""Run files: one file, or one folder of part files, named run_<digits>.<extension> for each run in a folder of runs."""

from __future__ import annotations

import posixpath
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import durable, remove
from .tables import demanded, run_name

#: Event ids of one folder of stored traces.
EVENT_BUCKET = 256


def located(spark: SparkSession, path: str):
    """The file system, and the path with its scheme as Spark's sources show it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


def _named(name: str, extension: str) -> int | None:
    found = re.fullmatch(rf"run_([0-9]+)\.{re.escape(extension)}", name)
    return int(found[1]) if found else None


def run_files(spark: SparkSession, path: str, extension: str = "h5") -> DataFrame:
    """(run, name, file, path, files, bytes, modified) of each run under ``path``: a folder of run files, or one run file.

    Spark lists the folder, in parallel where it is large, and reads no content. A run may be a file, or a folder of
    part files as Spark writes it. Names run_*.<extension> whose middle is not a number are an error, and so
    are two names of one run (run_8 and run_0008); other names are not runs. An empty folder has no row. A path that does not exist is an error.
    """
    system, root = located(spark, path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    folder = root.toString()
    if not system.getFileStatus(root).isDirectory() or _named(root.getName(), extension) is not None:
        folder = root.getParent().toString()  # one run; else what is in the folder
        if _named(root.getName(), extension) is None:
            raise ValueError(f"not a run file: {root.getName()}")
    own = F.substring_index(F.substring("path", len(folder.rstrip("/")) + 2, 1 << 30), "/", 1)
    rows = listed.select(own.alias("file"), "length", "modificationTime").where(F.col("file").like(f"run\\_%.{extension}"))
    each = rows.groupBy("file").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))
    number = F.regexp_extract("file", rf"^run_([0-9]+)\.{re.escape(extension)}$", 1)
    each = demanded(each, number != "", F.concat(F.lit("not a run file: "), "file")).withColumn("run", number.cast("int"))
    runs = each.groupBy("run").agg(F.count("*").alias("_n"), F.max_by(F.struct("file", "files", "bytes", "modified"), "file").alias("_f"), F.sort_array(F.collect_list("file")).alias("_all"))
    runs = demanded(runs, F.col("_n") == 1, F.concat(F.lit("two files for run "), F.col("run").cast("string"), F.lit(": "), F.concat_ws(", ", "_all")))
    return runs.select("run", run_name(F.col("run")).alias("name"), "_f.file", F.concat(F.lit(folder.rstrip("/") + "/"), "_f.file").alias("path"), "_f.files", "_f.bytes", "_f.modified")


def find_run(spark: SparkSession, path: str, run: int, extension: str = "h5") -> str:
    """The path of one run under ``path``; a single run file must be that run's. The name with four digits is preferred to others of the run.

    An absent run, another run's file and two other names of the run are errors. Only names of the folder itself are looked at.
    """
    system, root = located(spark, path)
    if not system.exists(root):
        raise ValueError(f"no such path: {path}")
    single = _named(root.getName(), extension)
    if single is not None or not system.getFileStatus(root).isDirectory():
        if single != run:
            raise ValueError(f"{root.getName()} is not a file of run {run}")
        return root.toString()
    preferred = f"run_{run:04d}.{extension}"
    entries = [x.getPath().getName() for x in system.listStatus(root)]
    found = sorted(n for n in entries if _named(n, extension) == run)
    if preferred not in found and len(found) != 1:
        raise ValueError(f"two files for run {run}: {', '.join(found)}" if found else f"no file for run {run}")
    return posixpath.join(root.toString(), preferred if preferred in found else found[0])


def write_runs(rows: DataFrame, path: str, *buckets: str) -> None:
    """``rows`` (with ``run``) as run files of Parquet under ``path``: one folder of part files for each run, whose rows any number of tasks write.

    ``buckets`` are columns that make folders within a run. Runs written before are replaced, others stay. A run's
    folder gets its name once all of it is written.
    """
    spark = rows.sparkSession
    system, root = located(spark, path)
    making = f"{root.toString()}/_making-{uuid.uuid4().hex}"
    rows.write.partitionBy("run", *buckets).parquet(making)
    to = spark._jvm.org.apache.hadoop.fs.Path
    for x in system.listStatus(to(making)):
        name = x.getPath().getName()
        if name.startswith("run="):
            final = to(root, f"run_{int(name.removeprefix('run=')):04d}.parquet")
            system.delete(final, True)
            system.rename(x.getPath(), final)
    remove(spark, making)


def read_runs(spark: SparkSession, path: str, run: int | None = None) -> DataFrame:
    """The rows of all run files of Parquet under ``path``, or of one run, with ``run`` from the file's name."""
    if run is not None:
        return spark.read.parquet(find_run(spark, path, run, "parquet")).withColumn("run", F.lit(run))
    files = [(r.run, r.path) for r in run_files(spark, path, "parquet").select("run", "path").collect()]
    if not files:
        raise ValueError(f"no run files in {path}")
    parts = [spark.read.parquet(p).withColumn("run", F.lit(n)) for n, p in sorted(files)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_traces(traces: DataFrame, path: str) -> None:
    """Traces as run files with a folder for each ``EVENT_BUCKET`` event ids, so that reads of some events open few files."""
    bucketed = traces.withColumn("event_bucket", F.floor(F.col("event_id") / EVENT_BUCKET))
    write_runs(bucketed.repartition("run", "event_bucket").sortWithinPartitions("run", "event_bucket", "event_id", "trace_id"), path, "event_bucket")


def positioned(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of files with ``position`` (long): their number from 0 in the order of the files' names and of the rows in each.

    Splits are numbered in parallel. A row's number is the count of the splits before its own and its place there;
    only the counts, one for each split, are added up in one task. ``rows`` reads files without filters.
    """
    kept = columns or tuple(rows.columns)
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = durable(rows.select(*kept, split.alias("_split"), F.monotonically_increasing_id().alias("_at")))
    counts = placed.groupBy("_split").agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))
    before = counts.selectExpr("_split", "_least", "sum(_n) OVER (ORDER BY _split) - _n AS _before")
    found = placed.join(F.broadcast(before), "_split")
    return found.select(*kept, (F.col("_before") + F.col("_at") - F.col("_least")).alias("position"))
