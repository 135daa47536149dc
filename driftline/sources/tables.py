"""Run catalogues, stored tables and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import durable


def demanded(rows: DataFrame, condition: Column, message: Column) -> DataFrame:
    """``rows``, of which one that does not meet the condition is an error, whatever is read of them afterwards."""
    # the partition's number keeps the optimizer from dropping, moving or simplifying the check
    met = F.when(condition, F.spark_partition_id() >= 0).otherwise(F.raise_error(message).cast("boolean"))
    return rows.where(met)


def run_of(path: Column) -> Column:
    """The run that a file name run_<digits>... names, else null."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)run_(\d+)[^/]*$", 1), F.lit("")).cast("int")


def run_name(run: Column) -> Column:
    return F.concat(F.lit("run_"), F.lpad(run.cast("string"), 4, "0"))


def run_catalog(files: DataFrame, path: str = "path") -> DataFrame:
    """(run, name, path) of files that name a run; two files of one run are an error."""
    rows = files.select(run_of(F.col(path)).alias("run"), F.col(path).alias("path")).where("run IS NOT NULL")
    once = rows.groupBy("run").agg(F.min("path").alias("path"), F.countDistinct("path").alias("n"))
    single = demanded(once, F.col("n") == 1, F.concat(F.lit("two files for run "), F.col("run").cast("string")))
    return single.select("run", run_name(F.col("run")).alias("name"), "path")


def processing_params(runs: DataFrame, stored: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """(run, one column per parameter): the stored value (run, key, value), else the default, else an error."""
    known = stored.groupBy("run").pivot("key", sorted(defaults)).agg(F.first("value"))

    def value(key: str) -> Column:
        default = defaults[key]
        rest = F.raise_error(f"no value for {key}").cast("double") if default is None else F.lit(float(default))
        return F.coalesce(F.col(key), rest).alias(key)

    return runs.join(known, "run", "left").select("run", *map(value, sorted(defaults)))


def filter_rows_scan(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Filter rows in their order; a run that does not exist is an error."""
    known = rows.join(runs.select("run", F.lit(True).alias("_known")), "run", "left")
    checked = demanded(known, F.coalesce("_known", F.lit(False)), F.concat(F.lit("unknown run "), F.col("run").cast("string")))
    return checked.select("filter_name", "pos", "run", "event_id", "trace_id").orderBy("filter_name", "pos")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with pos (long), their number from 0 in the order of ``order``.

    Tasks sort ranges of rows, written to the shared checkpoint folder, so that counts and rows are of the same
    ranges. A row's number is the count of the ranges before its own and its place there; only the counts,
    one for each range, are added up in one task.
    """
    # the upper bits are the range's number, the lower 33 the place in it
    placed = durable(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = ranges.selectExpr("_range", "sum(_n) OVER (ORDER BY _range) - _n AS _before")
    found = placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(before), "_range")
    return found.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("pos"))


def write_histogram(histograms: DataFrame, path: str) -> None:
    """Replaces what is stored of the same metric, mode and run and leaves the rest."""
    histograms.repartition("metric", "mode", "run").write.option("partitionOverwriteMode", "dynamic").partitionBy("metric", "mode", "run").mode("overwrite").parquet(path)


def histogram_scan(spark: SparkSession, path: str, metric: str | None = None, mode: str | None = None, run: int | None = None) -> DataFrame:
    """Stored histograms; the conditions select folders."""
    wanted = [F.col(k) == v for k, v in (("metric", metric), ("mode", mode), ("run", run)) if v is not None]
    rows = spark.read.parquet(path)
    return rows.where(reduce(lambda a, b: a & b, wanted)) if wanted else rows


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path) if partitions else df.write.mode("overwrite").parquet(path)


def write_hits(hits: DataFrame, events: DataFrame, processing: DataFrame, path: str) -> None:
    """Hits by run, with tables of events (those without hits too) and of processing parameters beside them."""
    write_table(hits, f"{path}/hits", "run")
    write_table(events, f"{path}/events")
    write_table(processing, f"{path}/processing")


def write_pads(pads: DataFrame, path: str) -> None:
    pads.write.mode("overwrite").csv(f"{path}/csv", header=True)
    pads.write.mode("overwrite").json(f"{path}/json")
