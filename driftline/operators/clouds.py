"""Point clouds: cuts, projections, planarity, lines and their measures. A hits table has one row per hit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions.axes import forward, leading_axes, let, upright
from ..sources.shared import durable
from ..sources.tables import demanded
from .labels import suggest_event_label
from .traces import EVENT

#: Runs whose parameters may be broadcast.
MOST_RUNS = 100_000
COPLANAR_BINS, COPLANAR_MAX = 500, 0.05
COPLANAR_THRESHOLDS = (0.001, 0.01, 0.02, 0.05)
LINE_SCHEMA = "run int, event_id long, line_id int, hit_ids array<int>, cx double, cy double, cz double, dx double, dy double, dz double"


def filter_hits_z(hits: DataFrame, length: float = 1000.0) -> DataFrame:
    """Hits with a finite z from 0 to the detector's length, both included."""
    return hits.where(F.col("z").between(0.0, length))


def closed_bin(x: Column, bins: int, low: float, high: float) -> Column:
    """The bin of a value: equal half-open bins, the last one closed, null outside."""
    width = (high - low) / bins
    return F.when(x.between(low, high) & ~F.isnan(x), F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int"))


def _moments(hits: DataFrame, *extra: Column) -> DataFrame:
    """Count, means and population covariances of each event, from plain sums that combine before the shuffle."""
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    return hits.groupBy(*EVENT).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs], *extra)


def _eigenvalues() -> Column:
    """The least and the greatest eigenvalue (small, big) of an event's covariance, in closed form."""
    a, b, c, d, e, f = (F.col(x) for x in ("cxx", "cyy", "czz", "cxy", "cxz", "cyz"))

    def from_mean(q: Column) -> Column:
        p = F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6)
        det = (a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)
        angle = lambda p: F.acos(F.greatest(F.least(F.try_divide(det, 2 * p * p * p), F.lit(1.0)), F.lit(-1.0))) / 3
        return let(p, lambda p: let(angle(p), lambda phi: ends(q, p, phi)))

    def ends(q: Column, p: Column, phi: Column) -> Column:
        return F.struct(F.when(p > 0, q + 2 * p * F.cos(phi + 2 * math.pi / 3)).otherwise(q).alias("small"), F.when(p > 0, q + 2 * p * F.cos(phi)).otherwise(q).alias("big"))

    return let((a + b + c) / 3, from_mean)


def coplanar_ratio(events: DataFrame, hits: DataFrame) -> DataFrame:
    """(run, event_id, n_hits, ratio) of every event: least over greatest variance, null under 3 hits or without spread."""
    share = let(_eigenvalues(), lambda v: F.when(v["big"] > 0, F.when(F.abs(v["small"]) < 1e-12 * v["big"], 0.0).otherwise(v["small"] / v["big"])))
    stats, ratio = _moments(hits), F.when(F.col("n") >= 3, share)
    return events.join(stats.select(*EVENT, "n", ratio.alias("ratio")), EVENT, "left").select(*EVENT, F.coalesce("n", F.lit(0)).alias("n_hits"), "ratio")


def coplanar_histogram(ratios: DataFrame) -> DataFrame:
    rows = ratios.withColumn("bin", closed_bin(F.col("ratio"), COPLANAR_BINS, 0.0, COPLANAR_MAX)).where("bin IS NOT NULL")
    return rows.groupBy("run", "bin").agg(F.count("*").alias("count"))


def coplanar_counts(ratios: DataFrame) -> DataFrame:
    """Events processed, valid, accepted (in range) and skipped, of each run."""
    inside = F.col("ratio").between(0.0, COPLANAR_MAX)
    return ratios.groupBy("run").agg(F.count("*").alias("processed"), F.count("ratio").alias("valid"), F.count_if(inside).alias("accepted"), (F.count("*") - F.count_if(inside)).alias("skipped"))


def coplanar_thresholds(ratios: DataFrame) -> DataFrame:
    """(run, threshold, events strictly below it, share of the valid ones)."""
    limits = F.array(*map(F.lit, COPLANAR_THRESHOLDS))
    rows = ratios.where("ratio IS NOT NULL").select("run", "ratio", F.explode(limits).alias("threshold"))
    return rows.groupBy("run", "threshold").agg(F.count_if(F.col("ratio") < F.col("threshold")).alias("events"), (F.count_if(F.col("ratio") < F.col("threshold")) / F.count("*")).alias("share"))


def point_line_distance(point: list[Column], through: list[Column], direction: list[Column]) -> Column:
    a, b, c = (p - t for p, t in zip(point, through, strict=True))
    x, y, z = direction
    u, v, w = b * z - c * y, c * x - a * z, a * y - b * x
    return F.sqrt(u * u + v * v + w * w)


def projection_on_line(point: list[Column], through: list[Column], direction: list[Column]) -> Column:
    return sum(((p - t) * d for p, t, d in zip(point, through, direction, strict=True)), F.lit(0.0))


def line_point_at_z(through: list[Column], direction: list[Column], z: Column) -> list[Column]:
    """x and y of a line at a height; null for a level line."""
    step = F.try_divide(z - through[2], direction[2])
    return [through[0] + step * direction[0], through[1] + step * direction[1]]


def drift_z(time_bucket: Column, micromegas: Column | float = 10.0, window: Column | float = 560.0, length: Column | float = 1000.0) -> Column:
    m, w, n = (c if isinstance(c, Column) else F.lit(c) for c in (micromegas, window, length))
    return (time_bucket - m) / (w - m) * n


def project_hits(hits: DataFrame) -> DataFrame:
    """Hits with u and v, their coordinates on the event's two leading axes; null under 3 hits or for a hit that is not finite.

    The sign of each axis makes its largest component positive. The axes of an event are expressions of its moments, one row per event.
    """
    finite = sum((F.abs(F.col(c)) for c in "xyz"), F.lit(0.0)) < float("inf")
    axes = leading_axes(*[F.col(c) for c in ("cxx", "cyy", "czz", "cxy", "cxz", "cyz")])
    stats = _moments(hits.where(finite)).where("n >= 3").select(*EVENT, "mx", "my", "mz", let(axes, lambda v: F.struct(forward(v["first"]).alias("u"), forward(v["second"]).alias("v"))).alias("_axes"))
    centred = [F.when(finite, F.col(c) - F.col(f"m{c}")) for c in "xyz"]
    both = {n: sum((centred[i] * F.col(f"_axes.{n}")[i] for i in range(3)), F.lit(0.0)) for n in "uv"}
    return hits.join(stats, EVENT, "left").withColumns(both).select(*hits.columns, "u", "v")


def event_hits(hits: DataFrame, length: float = 1000.0, processing: DataFrame | None = None) -> DataFrame:
    """Hits within the detector, with their coordinates on the event's leading axes.

    ``processing`` has one row for each run, as ``processing_params`` gives it. All of it is checked before hits are read: a
    parameter without a value is an error at once. Each hit then gets the struct ``processing`` of its run, whose detector_length
    takes the place of ``length``. A run that it lacks is an error.
    """
    if processing is None:
        return project_hits(filter_hits_z(hits, length))
    known = durable(processing)
    own = known.select("run", F.struct(*[c for c in known.columns if c != "run"]).alias("processing"))
    rows = hits.join(F.broadcast(own) if own.limit(MOST_RUNS + 1).count() <= MOST_RUNS else own, "run", "left")
    rows = demanded(rows, F.col("processing").isNotNull(), F.concat(F.lit("no parameters of run "), F.col("run").cast("string")))
    return project_hits(rows.where(F.col("z").between(F.lit(0.0), F.col("processing.detector_length")))).select(*hits.columns, "u", "v", "processing")


def extract_lines(hits: DataFrame, find: ln.FindParams = ln.FindParams(), merge: ln.MergeParams | None = ln.MergeParams(), weighted: bool = True, counted: bool = False) -> DataFrame:
    """(run, event_id, line_id, hit_ids, centroid, direction): each event's lines, merged and refitted with the amplitudes as weights.

    ``counted``: trials are drawn by md5, as in ``ransac_mask``, instead of by numpy's generator. One event is one group: it holds thousands of hits at most, a bound of the detector.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hit_id")
        points, ids = pdf[["x", "y", "z"]].to_numpy(), pdf["hit_id"].to_numpy()
        key = int(pdf["run"].iloc[0]), int(pdf["event_id"].iloc[0])
        found = ln.find(points, find, ln.CountedDraw(*key) if counted else None)
        if merge is not None:
            found = ln.merge(found, merge)
        rows = []
        for i, line in enumerate(found):
            c, d = ln.fit(points[line.at], pdf["amplitude"].to_numpy()[line.at]) if weighted else (line.centroid, line.direction)
            rows.append((*key, i, ids[line.at].astype(np.int32).tolist(), *map(float, c), *map(float, d)))
        return pd.DataFrame(rows, columns=["run", "event_id", "line_id", "hit_ids", "cx", "cy", "cz", "dx", "dy", "dz"])

    return hits.select(*EVENT, "hit_id", "x", "y", "z", "amplitude").groupBy(*EVENT).applyInPandas(one, LINE_SCHEMA)


def line_trials(hits: DataFrame, find: ln.FindParams = ln.FindParams(), attempt: int = 0) -> DataFrame:
    """(run, event_id, trial, start, along, hits, every, error): each trial's line through two hits of its event, how many hits lie near it, whether all, and how far off.

    A trial joins a hit near the axis with one further out (any two if all are on one side), drawn by the md5 of run, event,
    attempt and trial from the hits in order of hit_id. Trials whose hits are one point have no line and are left out. Each
    trial meets the hits of its event only; what they add is summed before the shuffle.
    """
    event, place = [F.col(c) for c in EVENT], F.struct("x", "y", "z")
    inner = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) < find.start_radius
    whole = Window.partitionBy(*EVENT)
    rows = hits.select(*EVENT, "hit_id", "x", "y", "z", inner.alias("_inner")).withColumns({"_n": F.count("*").over(whole), "_near": F.count_if("_inner").over(whole)})
    mixed = (F.col("_near") > 0) & (F.col("_near") < F.col("_n"))
    rows = rows.withColumn("_side", F.when(mixed, F.col("_inner").cast("int")).otherwise(2)).where("_n >= 2")
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*EVENT, "_side").orderBy("hit_id")) - 1)
    events = rows.groupBy(*EVENT).agg(F.first("_n").alias("_n"), F.first("_near").alias("_near"), F.first("_side").alias("_any"))
    trials = events.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(find.trials - 1))))
    drawn = F.md5(F.concat_ws("/", *[c.cast("string") for c in event], F.lit(str(attempt)), F.col("trial").cast("string")))
    number = lambda at: F.conv(F.substring(drawn, at, 8), 16, 10).cast("long")
    sides = F.when(F.col("_any") == 2, F.struct(F.lit(2).alias("a"), F.col("_n").alias("na"), F.lit(2).alias("b"), F.col("_n").alias("nb"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("_near").alias("na"), F.lit(0).alias("b"), (F.col("_n") - F.col("_near")).alias("nb")))
    trials = trials.withColumn("_s", sides).select(*EVENT, "trial", "_n", F.col("_s.a").alias("_a"), (number(1) % F.col("_s.na")).cast("int").alias("_i"), F.col("_s.b").alias("_b"), (number(9) % F.col("_s.nb")).cast("int").alias("_j"))
    hit = lambda side, at, name: rows.select(*EVENT, F.col("_side").alias(side), F.col("_at").alias(at), place.alias(name))
    lines = trials.join(hit("_a", "_i", "start"), [*EVENT, "_a", "_i"]).join(hit("_b", "_j", "_to"), [*EVENT, "_b", "_j"])
    step = [F.col(f"_to.{c}") - F.col(f"start.{c}") for c in "xyz"]
    size = F.sqrt(sum((x * x for x in step), F.lit(0.0)))
    lines = lines.withColumn("_size", size).where("_size > 0").select(*EVENT, "trial", "_n", "start", F.struct(*[(x / F.col("_size")).alias(c) for x, c in zip(step, "xyz", strict=True)]).alias("along"))
    far = _off_trial()
    near = lines.join(rows.select(*EVENT, "x", "y", "z"), EVENT).groupBy(*EVENT, "trial", "_n", "start", "along").agg(F.count_if(far <= find.residual).alias("hits"), F.sum(F.when(far <= find.residual, far).otherwise(0.0)).alias("error"))
    return near.select(*EVENT, "trial", "start", "along", "hits", (F.col("hits") == F.col("_n")).alias("every"), "error")


def _off_trial() -> Column:
    return point_line_distance([F.col(c) for c in "xyz"], [F.col(f"start.{c}") for c in "xyz"], [F.col(f"along.{c}") for c in "xyz"])


def ransac_mask(hits: DataFrame, find: ln.FindParams = ln.FindParams(), attempt: int = 0) -> DataFrame:
    """(run, event_id, hit_id) of the hits near each event's best trial; see ``functions.lines.sampled``, whose counted draws these are.

    The best trial is the first that covers every hit, else that with the most hits, the least error and the least number. Where
    its hits span a plane z = ax + by + c, all hits within the residual of it in z are taken instead. Events whose trials have no hits have no row.
    """
    trials = line_trials(hits, find, attempt).where("hits > 0")
    rank = F.struct((~F.col("every")).alias("_part"), F.when(F.col("every"), F.col("trial")).alias("_first"), (-F.col("hits")).alias("_few"), "error", "trial")
    best = trials.groupBy(*EVENT).agg(F.min_by(F.struct("start", "along"), rank).alias("_b")).select(*EVENT, "_b.*")
    own = hits.select(*EVENT, "hit_id", "x", "y", "z").join(best, EVENT).withColumn("_on", _off_trial() <= find.residual)
    centre = own.where("_on").groupBy(*EVENT).agg(F.count("*").alias("_k"), *[F.avg(c).alias(f"_m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"_{a}{b}") for a, b in ("xx", "yy", "xy", "xz", "yz")])
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    flat = (F.col("_k") >= 3) & (det > 1e-12 * F.col("_xx") * F.col("_yy"))
    a, b = (F.col("_xz") * F.col("_yy") - F.col("_yz") * F.col("_xy")) / det, (F.col("_yz") * F.col("_xx") - F.col("_xz") * F.col("_xy")) / det
    planes = centre.select(*EVENT, F.when(flat, F.struct(a.alias("a"), b.alias("b"), F.col("_mx").alias("x"), F.col("_my").alias("y"), F.col("_mz").alias("z"))).alias("_p"))
    off = F.abs(F.col("z") - F.col("_p.z") - F.col("_p.a") * (F.col("x") - F.col("_p.x")) - F.col("_p.b") * (F.col("y") - F.col("_p.y")))
    return own.join(planes, EVENT).where(F.when(F.col("_p").isNotNull(), off <= find.residual).otherwise(F.col("_on"))).select(*EVENT, "hit_id")


def merge_lines(lines: DataFrame, merge: ln.MergeParams = ln.MergeParams()) -> DataFrame:
    """Lines of each event joined by ``functions.lines.merge`` in the order of line_id, and numbered anew. An event has few lines."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_id")
        found = [ln.Line(np.asarray(h, np.int64), c, d) for h, c, d in zip(pdf["hit_ids"], pdf[["cx", "cy", "cz"]].to_numpy(), pdf[["dx", "dy", "dz"]].to_numpy(), strict=True)]
        rows = [(int(pdf["run"].iloc[0]), int(pdf["event_id"].iloc[0]), i, x.at.astype(np.int32).tolist(), *map(float, (*x.centroid, *x.direction))) for i, x in enumerate(ln.merge(found, merge))]
        return pd.DataFrame(rows, columns=["run", "event_id", "line_id", "hit_ids", "cx", "cy", "cz", "dx", "dy", "dz"])

    return lines.groupBy(*EVENT).applyInPandas(one, LINE_SCHEMA)


def fit_line(hits: DataFrame, weight: str | None = None) -> DataFrame:
    """(run, event_id, centroid, direction) of one line through all hits of each event, from weighted sums; see ``functions.lines.fit``.

    Where no weight is positive all hits count alike. Hits without any spread have the direction x.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.col(weight), F.lit(0.0))
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    rows = hits.withColumn("_w", w)
    sums = rows.groupBy(*EVENT).agg(F.sum("_w").alias("_n"), F.count("*").alias("_all"), *[F.sum(F.col("_w") * F.col(c)).alias(f"_w{c}") for c in "xyz"], *[F.avg(c).alias(f"_m{c}") for c in "xyz"])
    some = F.col("_n") > 0
    centre = sums.select(*EVENT, some.alias("_some"), F.when(some, F.col("_n")).otherwise(F.col("_all")).alias("_n"), *[F.when(some, F.try_divide(f"_w{c}", "_n")).otherwise(F.col(f"_m{c}")).alias(f"c{c}") for c in "xyz"])
    # centred before squaring: the sums of squares of large coordinates would lose digits
    own = F.when(F.col("_some"), F.col("_w")).otherwise(1.0)
    around = rows.join(centre, EVENT).groupBy(*EVENT, "cx", "cy", "cz").agg(*[(F.sum(own * (F.col(a) - F.col(f"c{a}")) * (F.col(b) - F.col(f"c{b}"))) / F.first("_n")).alias(a + b) for a, b in pairs])
    axis = let(leading_axes(*[F.col(a + b) for a, b in pairs])["first"], upright).alias("_d")
    return around.select(*EVENT, "cx", "cy", "cz", axis).select(*EVENT, "cx", "cy", "cz", *[F.col("_d")[i].alias(f"d{c}") for i, c in enumerate("xyz")])


def line_points(lines: DataFrame) -> DataFrame:
    return lines.select(*EVENT, "line_id", F.explode("hit_ids").alias("hit_id"))


def line_labels(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """(run, event_id, hit_id, line_id or -1, lines of the event, suggested label)."""
    counts = lines.groupBy(*EVENT).agg(F.count("*").alias("lines"))
    rows = hits.select(*EVENT, "hit_id").join(line_points(lines), [*EVENT, "hit_id"], "left").join(counts, EVENT, "left")
    n = F.coalesce("lines", F.lit(0))
    return rows.select(*EVENT, "hit_id", F.coalesce("line_id", F.lit(-1)).alias("line_id"), n.alias("lines"), suggest_event_label(n).alias("suggested"))


def _vec(prefix: str, kind: str) -> list[Column]:
    return [F.col(f"{prefix}{kind}{c}") for c in "xyz"]


def line_pairs(lines: DataFrame) -> DataFrame:
    """(run, event_id, first, second, distance of the second centre to the first line, angle in degrees) of an event's lines."""
    a = lines.select(*EVENT, F.col("line_id").alias("first"), *[F.col(c).alias(f"a_{c}") for c in ("cx", "cy", "cz", "dx", "dy", "dz")])
    b = lines.select(*EVENT, F.col("line_id").alias("second"), *[F.col(c).alias(f"b_{c}") for c in ("cx", "cy", "cz", "dx", "dy", "dz")])
    dot = sum((x * y for x, y in zip(_vec("a_", "d"), _vec("b_", "d"), strict=True)), F.lit(0.0))
    angle = F.degrees(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))))
    pairs = a.join(b, EVENT).where("first < second")
    return pairs.select(*EVENT, "first", "second", point_line_distance(_vec("b_", "c"), _vec("a_", "c"), _vec("a_", "d")).alias("distance"), angle.alias("angle"))


def _hist(rows: DataFrame, metric: str, x: Column, bins: int, low: float, high: float, *keys: str) -> DataFrame:
    binned = rows.withColumn("bin_x", closed_bin(x, bins, low, high)).where("bin_x IS NOT NULL")
    return binned.groupBy("run", *keys, "bin_x").agg(F.count("*").alias("count")).select("run", F.lit(metric).alias("metric"), *keys, "bin_x", "count")


def line_count_histogram(events: DataFrame, lines: DataFrame) -> DataFrame:
    counts = events.join(lines.groupBy(*EVENT).agg(F.count("*").alias("lines")), EVENT, "left")
    return _hist(counts, "line_count", F.coalesce("lines", F.lit(0)).cast("double"), 10, 0.0, 10.0)


def labeled_ratio_histogram(hits: DataFrame, lines: DataFrame) -> DataFrame:
    total = hits.groupBy(*EVENT).agg(F.count("*").alias("n"))
    own = lines.groupBy(*EVENT).agg(F.sum(F.size("hit_ids")).alias("k"))
    return _hist(total.join(own, EVENT, "left"), "labeled_ratio", F.coalesce("k", F.lit(0)) / F.col("n"), 100, 0.0, 1.0)


def pair_distance_histogram(pairs: DataFrame) -> DataFrame:
    return _hist(pairs, "pair_distance", F.col("distance"), 120, 0.0, 600.0)


def pair_angle_histogram(pairs: DataFrame) -> DataFrame:
    return _hist(pairs, "pair_angle", F.col("angle"), 180, 0.0, 180.0)


def pair_joint_histogram(pairs: DataFrame) -> DataFrame:
    rows = pairs.withColumn("bin_x", closed_bin(F.col("distance"), 120, 0.0, 600.0)).withColumn("bin_y", closed_bin(F.col("angle"), 180, 0.0, 180.0))
    return rows.where("bin_x IS NOT NULL AND bin_y IS NOT NULL").groupBy("run", "bin_x", "bin_y").agg(F.count("*").alias("count"))


def joint_slice(joint: DataFrame, axis: str, low: float, high: float) -> DataFrame:
    """Counts along one axis ("x" or "y") where the other's bin centre lies within both bounds, in either order."""
    other, width = ("bin_y", 1.0) if axis == "x" else ("bin_x", 5.0)
    kept = joint.where(((F.col(other) + 0.5) * width).between(min(low, high), max(low, high)))
    return kept.groupBy("run", F.col(f"bin_{axis}").alias("bin")).agg(F.sum("count").alias("count"))


def measure_lines(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """(run, event_id, line_id, length, charge, half_ratio): spread along the line, charge, and that beyond the middle over the rest (null if none)."""
    along = projection_on_line([F.col(c) for c in "xyz"], [F.col(f"c{c}") for c in "xyz"], [F.col(f"d{c}") for c in "xyz"])
    points = lines.select(*EVENT, "line_id", *[f"{k}{c}" for k in "cd" for c in "xyz"], F.explode("hit_ids").alias("hit_id"))
    own = points.join(hits.select(*EVENT, "hit_id", "x", "y", "z", "amplitude"), [*EVENT, "hit_id"])
    rows = own.select(*EVENT, "line_id", along.alias("p"), F.greatest("amplitude", F.lit(0.0)).alias("q"))
    whole = Window.partitionBy(*EVENT, "line_id")  # a line's hits are bounded by the detector; the sums below need no other shuffle
    rows = rows.withColumns({"low": F.min("p").over(whole), "high": F.max("p").over(whole)})
    beyond = F.col("p") > (F.col("low") + F.col("high")) / 2
    far, near = F.sum(F.when(beyond, F.col("q")).otherwise(0.0)), F.sum(F.when(beyond, 0.0).otherwise(F.col("q")))
    sums = rows.groupBy(*EVENT, "line_id").agg((F.max("p") - F.min("p")).alias("length"), F.sum("q").alias("charge"), far.alias("far"), near.alias("near"))
    return sums.select(*EVENT, "line_id", "length", "charge", F.when(F.col("near") > 0, F.col("far") / F.col("near")).alias("half_ratio"))


def longest_lines(measures: DataFrame, n: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*EVENT).orderBy(F.desc("length"), "line_id"))
    return measures.withColumn("rank", rank).where(F.col("rank") <= n)


def line_length_histogram(measures: DataFrame) -> DataFrame:
    return _hist(measures, "line_length", F.col("length"), 120, 0.0, 1000.0)


def line_charge_histogram(measures: DataFrame) -> DataFrame:
    return _hist(measures, "line_charge", F.col("charge"), 200, 0.0, 20000.0)


def half_charge_ratio_histogram(measures: DataFrame) -> DataFrame:
    return _hist(measures, "half_charge_ratio", F.col("half_ratio"), 100, 0.0, 5.0)


def point_line_distance_histogram(hits: DataFrame, lines: DataFrame, measures: DataFrame) -> DataFrame:
    """Distances of all hits of an event to each of its lines, on the line or off it, for all lines and for the three longest."""
    ranks = longest_lines(measures).select(*EVENT, "line_id", "rank")
    groups = F.when(F.col("rank").isNull(), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.concat(F.lit("longest_"), F.col("rank").cast("string"))))
    # a hit's lines come to it before it meets all lines of its event
    owners = line_points(lines).groupBy(*EVENT, "hit_id").agg(F.collect_set("line_id").alias("_own"))
    placed = hits.select(*EVENT, "hit_id", "x", "y", "z").join(owners, [*EVENT, "hit_id"], "left")
    rows = placed.join(lines.drop("hit_ids").join(ranks, [*EVENT, "line_id"], "left"), EVENT)
    far = point_line_distance([F.col(c) for c in "xyz"], [F.col(f"c{c}") for c in "xyz"], [F.col(f"d{c}") for c in "xyz"])
    rows = rows.select("run", F.explode(groups).alias("lines"), F.coalesce(F.array_contains("_own", F.col("line_id")), F.lit(False)).alias("in_line"), far.alias("distance"))
    return _hist(rows, "point_line_distance", F.col("distance"), 120, 0.0, 300.0, "lines", "in_line")


def line_totals(events: DataFrame, hits: DataFrame, lines: DataFrame) -> DataFrame:
    """(run, events, lines, pairs, points on lines)."""
    per = lines.groupBy(*EVENT).agg(F.count("*").alias("lines"), F.sum(F.size("hit_ids")).alias("points"))
    n = F.coalesce("lines", F.lit(0))
    return events.join(per, EVENT, "left").groupBy("run").agg(F.count("*").alias("events"), F.sum(n).alias("lines"), F.sum(n * (n - 1) / 2).cast("long").alias("pairs"), F.sum(F.coalesce("points", F.lit(0))).alias("points"))


def histogram_plot_rows(counts: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """A histogram (run, metric, bin_x, count) with every bin of it, 0 where nothing is, and the bins' centres."""
    every = counts.select("run", "metric").distinct().withColumn("bin_x", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    rows = every.join(counts, ["run", "metric", "bin_x"], "left")
    return rows.select("run", "metric", "bin_x", (F.lit(low) + (F.col("bin_x") + 0.5) * ((high - low) / bins)).alias("center"), F.coalesce("count", F.lit(0)).alias("count"))


def trace_hits(wanted: DataFrame, traces: DataFrame, hits: DataFrame) -> DataFrame:
    """Traces of an event in the order first asked for (run, event_id, trace_id, pos), each with its hits."""
    keys = [*EVENT, "trace_id"]
    first = wanted.groupBy(*keys).agg(F.min("pos").alias("pos"))
    own = hits.join(first, keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("hit_id", "x", "y", "z", "amplitude"))).alias("hits"))
    return first.join(traces, keys).join(own, keys, "left").orderBy(*EVENT, "pos")


def pad_activity(hits: DataFrame, pads: DataFrame, metric: str = "amplitude") -> DataFrame:
    """(run, event_id, pad, cx or x, cy or y, most, traces) of every pad with hits that the map knows."""
    active = hits.groupBy(*EVENT, F.col("pad_id").cast("int").alias("pad")).agg(F.max(metric).alias("most"), F.sort_array(F.collect_set("trace_id")).alias("traces"))
    return active.join(pads.select("pad", "x", "y", "scale"), "pad")
