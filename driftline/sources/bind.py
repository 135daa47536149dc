"""The detector's logical tables, derived from general-purpose tables, for runs without detector data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keys(of: str) -> list[str]:
    return [f"CAST({of} % 2 + 1 AS INT) AS run", f"({of} div 2) div 10 AS event_id", f"CAST(({of} div 2) % 10 AS INT) AS trace_id"]


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, event_id, trace_id, hardware, samples): one waveform of whole counts per embedding."""
    vec = table(spark, sf_dir, "embeddings")
    p = "(vec_id * 7) % 2500"
    hardware = f"named_struct('cobo', CAST({p} div 1000 AS INT), 'asad', CAST({p} div 100 % 10 AS INT), 'aget', CAST({p} div 10 % 10 AS INT), 'channel', CAST({p} % 10 AS INT), 'pad', CAST(vec_id % 100 AS INT)) AS hardware"
    return vec.selectExpr(*_keys("vec_id"), hardware, "transform(embedding, e -> CAST(floor(CAST(e AS DOUBLE) * 800 + 0.5) AS DOUBLE)) AS samples")


def bad_events(traces_: DataFrame) -> DataFrame:
    return traces_.where("event_id % 11 = 10").select("run", "event_id").distinct()


def trace_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec, labels = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "labels")
    kind = "CASE WHEN toxic = 1 OR quality = 0 THEN 'strange' ELSE 'normal' END AS family"
    name = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'Low' ELSE CAST(label AS STRING) END AS label"
    return vec.where("vec_id % 3 <> 0").join(labels.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left").selectExpr(*_keys("vec_id"), kind, name)


def strange_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, shortcut_key): one per region; two have the names that the trace labels use."""
    name = "CASE r_regionkey WHEN 0 THEN 'toxic' WHEN 1 THEN 'Low' ELSE lower(r_name) END AS name"
    return table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) + 1 AS id", name, "CASE r_regionkey WHEN 0 THEN 't' WHEN 1 THEN 'l' ELSE chr(115 + r_regionkey) END AS shortcut_key")


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, event_id, label): two of three suppliers' events, labelled by their nation."""
    return table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").selectExpr("CAST(s_suppkey % 2 + 1 AS INT) AS run", "CAST(s_suppkey AS BIGINT) AS event_id", "CASE WHEN s_nationkey % 8 >= 6 THEN '6+' ELSE CAST(s_nationkey % 8 AS STRING) END AS label")


def filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filter_name, pos, run, event_id, trace_id): every seventh trace; every 21st is named twice."""
    vec = table(spark, sf_dir, "embeddings").where("vec_id % 7 = 3").select("vec_id", F.explode(F.expr("CASE WHEN vec_id % 3 = 0 THEN array(0, 1) ELSE array(0) END")).alias("again"))
    return vec.selectExpr("'sevenths' AS filter_name", "vec_id * 2 + again AS pos", *_keys("vec_id"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per supplier, its hits numbered in the order of the whole row; every fourth event is flat."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey % 2 + 1 AS INT) AS run", "l_suppkey AS event_id",
        "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS hit_id",
        "l_quantity * 8 - 200 AS x", "(l_discount - 0.05D) * CASE WHEN l_suppkey % 4 = 0 THEN 800 ELSE 4000 END AS y", "l_extendedprice / 105 AS z", "l_quantity AS amplitude", "l_quantity * (1 + l_tax) AS integral",
        "l_partkey AS pad_id", "l_extendedprice / 200 AS time_bucket", "1.0D AS scale", "l_linenumber AS trace_id",
    )


def track_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of each event with two of three moved to one of two tracks from the axis, a few units off; the third stays where it was."""
    lane, turn, tilt = "(hit_id % 3)", "radians(event_id * 37 % 360 + hit_id % 3 * 100)", "radians(30 + event_id % 5 * 10)"
    moved = {"x": f"z * sin({tilt}) * cos({turn}) + (amplitude % 5 - 2)", "y": f"z * sin({tilt}) * sin({turn}) + (pad_id % 7 - 3) * 0.8D", "z": f"z * cos({tilt}) + (trace_id - 4) * 0.5D"}
    return hits(spark, sf_dir).selectExpr("run", "event_id", "hit_id", *[f"CASE WHEN {lane} < 2 THEN {e} ELSE {c} END AS {c}" for c, e in moved.items()], "amplitude")


def cloud_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's event, with hits or without."""
    return table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey % 2 + 1 AS INT) AS run", "s_suppkey AS event_id")


def pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS INT) AS pad", "(p_partkey % 100) * 2.5D AS x", "(p_partkey div 100) * 4.25D AS y", "CASE WHEN p_size % 2 = 0 THEN 0.5D ELSE 1.0D END AS scale", "CAST(p_partkey % 2 AS INT) AS direction",
        "CAST(p_partkey div 1000 AS INT) AS cobo", "CAST((p_partkey div 100) % 10 AS INT) AS asad", "CAST((p_partkey div 10) % 10 AS INT) AS aget", "CAST(p_partkey % 10 AS INT) AS channel",
    )


#: The same tables in DuckDB's SQL, as the beginning of a query: WITH + BINDINGS + SELECT ...
BINDINGS = """
_s AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS e FROM embeddings),
samples AS (SELECT CAST(vec_id % 2 + 1 AS INT) AS run, (vec_id // 2) // 10 AS event_id, CAST((vec_id // 2) % 10 AS INT) AS trace_id, CAST(i AS INT) AS i, floor(CAST(e AS DOUBLE) * 800 + 0.5) AS v FROM _s),
trace_keys AS (SELECT vec_id, CAST(vec_id % 2 + 1 AS INT) AS run, (vec_id // 2) // 10 AS event_id, CAST((vec_id // 2) % 10 AS INT) AS trace_id, (vec_id * 7) % 2500 AS _p FROM embeddings),
bad_events AS (SELECT DISTINCT run, event_id FROM trace_keys WHERE event_id % 11 = 10),
trace_labels AS (
  SELECT CAST(vec_id % 2 + 1 AS INT) AS run, (vec_id // 2) // 10 AS event_id, CAST((vec_id // 2) % 10 AS INT) AS trace_id,
         CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 'strange' ELSE 'normal' END AS family,
         CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'Low' ELSE CAST(e.label AS VARCHAR) END AS label
  FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id WHERE vec_id % 3 <> 0),
strange_labels AS (
  SELECT CAST(r_regionkey AS BIGINT) + 1 AS id, CASE r_regionkey WHEN 0 THEN 'toxic' WHEN 1 THEN 'Low' ELSE lower(r_name) END AS name,
         CASE r_regionkey WHEN 0 THEN 't' WHEN 1 THEN 'l' ELSE chr(CAST(115 + r_regionkey AS INT)) END AS shortcut_key FROM region),
event_labels AS (
  SELECT CAST(s_suppkey % 2 + 1 AS INT) AS run, s_suppkey AS event_id, CASE WHEN s_nationkey % 8 >= 6 THEN '6+' ELSE CAST(s_nationkey % 8 AS VARCHAR) END AS label FROM supplier WHERE s_suppkey % 3 <> 0),
filter_rows AS (
  SELECT 'sevenths' AS filter_name, vec_id * 2 + again AS pos, CAST(vec_id % 2 + 1 AS INT) AS run, (vec_id // 2) // 10 AS event_id, CAST((vec_id // 2) % 10 AS INT) AS trace_id
  FROM (SELECT vec_id, unnest(CASE WHEN vec_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS again FROM embeddings WHERE vec_id % 7 = 3)),
hits AS (
  SELECT CAST(l_suppkey % 2 + 1 AS INT) AS run, l_suppkey AS event_id,
         CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS INT) AS hit_id,
         l_quantity * 8 - 200 AS x, (l_discount - CAST(0.05 AS DOUBLE)) * CASE WHEN l_suppkey % 4 = 0 THEN 800 ELSE 4000 END AS y, l_extendedprice / 105 AS z, l_quantity AS amplitude, l_quantity * (1 + l_tax) AS integral,
         l_partkey AS pad_id, l_extendedprice / 200 AS time_bucket, CAST(1.0 AS DOUBLE) AS scale, l_linenumber AS trace_id FROM lineitem),
track_hits AS (
  SELECT run, event_id, hit_id, CASE WHEN hit_id % 3 < 2 THEN z * sin(tilt) * cos(turn) + (amplitude % 5 - 2) ELSE x END AS x, CASE WHEN hit_id % 3 < 2 THEN z * sin(tilt) * sin(turn) + (pad_id % 7 - 3) * CAST(0.8 AS DOUBLE) ELSE y END AS y,
         CASE WHEN hit_id % 3 < 2 THEN z * cos(tilt) + (trace_id - 4) * CAST(0.5 AS DOUBLE) ELSE z END AS z, amplitude
  FROM (SELECT *, radians(event_id * 37 % 360 + hit_id % 3 * 100) AS turn, radians(30 + event_id % 5 * 10) AS tilt FROM hits)),
cloud_events AS (SELECT CAST(s_suppkey % 2 + 1 AS INT) AS run, s_suppkey AS event_id FROM supplier),
pads AS (
  SELECT CAST(p_partkey AS INT) AS pad, (p_partkey % 100) * CAST(2.5 AS DOUBLE) AS x, (p_partkey // 100) * CAST(4.25 AS DOUBLE) AS y, CAST(CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS scale,
         CAST(p_partkey % 2 AS INT) AS direction, CAST(p_partkey // 1000 AS INT) AS cobo, CAST((p_partkey // 100) % 10 AS INT) AS asad, CAST((p_partkey // 10) % 10 AS INT) AS aget, CAST(p_partkey % 10 AS INT) AS channel FROM part)
"""


def cleaned_sql(scale: float, source: str = "samples") -> str:
    """CTEs that end in cleaned(run, event_id, trace_id, i, n, x), by a circular convolution."""
    return f"""
_n AS (SELECT *, count(*) OVER (PARTITION BY run, event_id, trace_id) AS n FROM {source}),
_edge AS (SELECT run, event_id, trace_id, i, n, CASE WHEN i = 0 THEN lead(v) OVER w WHEN i = n - 1 THEN lag(v) OVER w ELSE v END AS v FROM _n WINDOW w AS (PARTITION BY run, event_id, trace_id ORDER BY i)),
_stat AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM _edge WINDOW w AS (PARTITION BY run, event_id, trace_id)),
_fill AS (SELECT *, coalesce(avg(CASE WHEN abs(v - m) <= 1.5 * sd THEN v END) OVER (PARTITION BY run, event_id, trace_id), m) AS f FROM _stat),
masked AS (SELECT run, event_id, trace_id, i, n, v, CASE WHEN abs(v - m) <= 1.5 * sd THEN v ELSE f END AS b FROM _fill),
_len AS (SELECT DISTINCT n FROM _n),
_kernel AS (
  SELECT n, j, sum(CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE sin(pi() * least(k, n - k) / {float(scale)}::DOUBLE) / (pi() * least(k, n - k) / {float(scale)}::DOUBLE) END * cos(2 * pi() * k * j / n)) / n AS h
  FROM (SELECT n, unnest(range(n)) AS j FROM _len) JOIN (SELECT n, unnest(range(n)) AS k FROM _len) USING (n) GROUP BY n, j),
_slow AS (
  SELECT a.run, a.event_id, a.trace_id, a.i, sum(m.b * h) AS s FROM masked a JOIN masked m USING (run, event_id, trace_id) JOIN _kernel q ON q.n = a.n AND q.j = (a.i - m.i + a.n) % a.n GROUP BY ALL),
cleaned AS (SELECT a.run, a.event_id, a.trace_id, a.i, a.n, a.v - s AS x FROM masked a JOIN _slow USING (run, event_id, trace_id, i))
"""
