"""Pad maps: reading, joining, neighbours and two-colouring."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.runs import positioned
from ..sources.shared import durable

PAD_SCHEMA = "pad INT, x DOUBLE, y DOUBLE, scale DOUBLE, direction INT, cobo INT, asad INT, aget INT, channel INT, cy DOUBLE, cx DOUBLE"
ADDRESS = ["cobo", "asad", "aget", "channel"]
#: Rows of a pad map that may be broadcast (a detector has about ten thousand pads); larger maps are shuffled.
BROADCAST_PADS = 200_000
_OFFSET = 4.908235 * math.sqrt(3) / 6


def pad_scan(spark, path: str) -> DataFrame:
    return spark.read.schema(PAD_SCHEMA).csv(path, header=True)


def _last(pads: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows of one key the last."""
    return pads.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_PADS + 1).count() <= BROADCAST_PADS else df


def pad_lookup(rows: DataFrame, pads: DataFrame, order: str = "pad") -> DataFrame:
    """``rows`` (with cobo, asad, aget, channel and fallback_pad) with pad_id, x, y and scale: by address, else by pad number, else null. The place of a pad is (cx, cy)."""
    fields = ["pad", "cx", "cy", "scale"]
    by_address = _small(_last(pads, ADDRESS, order).select(*ADDRESS, F.struct(*fields).alias("_a")))
    by_pad = _small(_last(pads, ["pad"], order).select(F.col("pad").alias("fallback_pad"), F.struct(*fields).alias("_b")))
    found = rows.join(by_address, ADDRESS, "left").join(by_pad, "fallback_pad", "left").withColumn("_p", F.coalesce("_a", "_b"))
    return found.select(*rows.columns, F.col("_p.pad").alias("pad_id"), F.col("_p.cx").alias("x"), F.col("_p.cy").alias("y"), F.col("_p.scale").alias("scale"))


def pad_map_join(xy: DataFrame, scale: DataFrame, direction: DataFrame | None, channels: DataFrame) -> DataFrame:
    """The pad map from its parts, which all have ``pad``; of the channel map rows with keyword pad only. Without a direction file it is null."""
    out = xy.join(scale, "pad", "left")
    out = out.join(direction, "pad", "left") if direction is not None else out.withColumn("direction", F.lit(None).cast("int"))
    return out.join(channels.where("keyword = 'pad'").select("pad", *ADDRESS), "pad", "left")


def pad_map_from_files(spark, xy: str, scale: str, channels: str, direction: str | None = None) -> DataFrame:
    """The pad map from CSV files whose rows are the pads, in their order from 0: (x, y), (scale) and, if there is one, (direction).

    The channel map names its pads: cobo, asad, aget, "aget channel", "det channel" (the pad) and "det keyword". A
    part that is shorter than the first leaves nulls, what is longer is dropped.
    """
    def part(path: str, schema: str) -> DataFrame:
        rows = positioned(spark.read.schema(schema).csv(path, header=True))
        return rows.withColumn("pad", F.col("position").cast("int")).drop("position")

    names = {"cobo": "cobo", "asad": "asad", "aget": "aget", "aget channel": "channel", "det channel": "pad"}
    named = spark.read.csv(channels, header=True).select(F.col("`det keyword`").alias("keyword"), *[F.col(f"`{a}`").cast("int").alias(b) for a, b in names.items()])
    return pad_map_join(part(xy, "x DOUBLE, y DOUBLE"), part(scale, "scale DOUBLE"), None if direction is None else part(direction, "direction INT"), named)


def pad_centroid(pads: DataFrame) -> DataFrame:
    """With the centre (cx, cy) of each triangle."""
    off = F.lit(_OFFSET) * F.col("scale")
    return pads.withColumn("cy", -F.col("x")).withColumn("cx", F.when(F.col("direction") == 0, -F.col("y") + off).otherwise(-F.col("y") - off))


def pad_pairs(pads: DataFrame, within: float, same_scale: bool = True) -> DataFrame:
    """(pad, pad2, distance, scale_sum): ordered pairs nearer than ``within``, of one size class or of all.

    Pads are put into square cells of that side; a pad meets only those of its own and the eight
    neighbouring cells, by an equal join. Both sides are shuffled: Spark's estimate of a map's size leaves out that each
    pad is repeated for nine cells, so a large map would be broadcast by way of the driver.
    """
    cell = pads.select("pad", "x", "y", "scale", F.floor(F.col("x") / within).alias("i"), F.floor(F.col("y") / within).alias("j"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = cell.withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps)).select(F.col("pad").alias("pad2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("scale").alias("scale2"), (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    pairs = cell.join(near.hint("merge"), ["i", "j"]).where("pad <> pad2")
    if same_scale:
        pairs = pairs.where("scale = scale2")
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    out = pairs.select("pad", "pad2", F.sqrt(dx * dx + dy * dy).alias("distance"), (F.col("scale") + F.col("scale2")).alias("scale_sum"))
    return out.where(F.col("distance") < within)


def pad_neighbors(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each pad's pairs, ties by number."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("pad").orderBy("distance", "pad2"))).where(F.col("rank") <= k)


def pad_distance_classes(neighbors: DataFrame) -> DataFrame:
    """How many neighbour distances lie in each class of size sums: two small pads, one of each, two large."""
    return neighbors.where(F.col("scale_sum").isin(1.0, 1.5, 2.0)).groupBy("scale_sum").agg(F.count("*").alias("pairs"), F.min("distance").alias("least"), F.max("distance").alias("most"))


def pad_directions(neighbors: DataFrame, start: int, nearer_than: float, rank: int = 4) -> tuple[DataFrame, DataFrame]:
    """(pad, direction) of every pad that can be reached from ``start``, whose direction is 0, and the pairs of neighbours that got one direction.

    Neighbours get opposite directions. In a map with odd rings some pair must get one direction; which one
    depends on the way taken, so there only the fact is certain, not the pairs. Every pad hangs on its least neighbour, if that is less than itself,
    at an odd distance; pointers are then doubled, adding up distances, until they reach roots. Roots that
    still have edges between them are hung in the same way in the next round. So rounds grow with the logarithm
    of the map's width; each is written to the shared checkpoint folder.
    """
    spark = neighbors.sparkSession
    near = durable(neighbors.where((F.col("rank") <= rank) & (F.col("distance") < nearer_than)).select("pad", "pad2"))
    both = near.union(near.select("pad2", "pad")).distinct()
    first = spark.range(1).select(F.lit(start).cast("int").alias("pad"))
    roots = durable(both.select("pad").union(first).distinct().select("pad", F.col("pad").alias("root"), F.lit(0).alias("odd")))
    edges = durable(both.select(F.col("pad").alias("a"), F.col("pad2").alias("b"), F.lit(1).alias("odd")))
    while not edges.isEmpty():
        hung = durable(edges.where("b < a").groupBy("a").agg(F.min(F.struct("b", "odd")).alias("up")).select("a", "up.b", "up.odd"))
        while True:
            above = hung.select(F.col("a").alias("b"), F.col("b").alias("_b"), F.col("odd").alias("_odd"))
            longer = durable(hung.join(above, "b", "left").select("a", F.coalesce("_b", "b").alias("b"), ((F.col("odd") + F.coalesce("_odd", F.lit(0))) % 2).alias("odd"), F.col("_b").isNotNull().alias("moved")))
            hung = longer.drop("moved")
            if longer.where("moved").isEmpty():
                break
        up = hung.select(F.col("a").alias("root"), F.col("b").alias("_b"), F.col("odd").alias("_odd"))
        roots = durable(roots.join(up, "root", "left").select("pad", F.coalesce("_b", "root").alias("root"), ((F.col("odd") + F.coalesce("_odd", F.lit(0))) % 2).alias("odd")))
        for end in ("a", "b"):
            at = hung.select(F.col("a").alias(end), F.col("b").alias("_b"), F.col("odd").alias("_odd"))
            edges = edges.join(at, end, "left").withColumn(end, F.coalesce("_b", end)).withColumn("odd", (F.col("odd") + F.coalesce("_odd", F.lit(0))) % 2).drop("_b", "_odd")
        edges = durable(edges.where("a <> b").distinct())
    of_start = roots.where(F.col("pad") == start).select("root", F.col("odd").alias("_odd"))
    done = roots.join(F.broadcast(of_start), "root").select("pad", ((F.col("odd") + F.col("_odd")) % 2).alias("direction"))
    other = done.select(F.col("pad").alias("pad2"), F.col("direction").alias("direction2"))
    return done, near.join(done, "pad").join(other, "pad2").where("direction = direction2").select("pad", "pad2")


def _address(*fields: Column) -> Column:
    """One text of some fields, which may be null."""
    return F.concat_ws("/", *[F.coalesce(f.cast("string"), F.lit("\0")) for f in fields])


def first_match_rules(pads: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """(pad, color) by the first rule (pos, cobo, asad, aget, channel as text or '*', color) that fits, else the default.

    A pad has one text for each way to put stars into its address, 16 in all; a rule is one such text. So rules are found by
    an equal join, whatever their number, and the least position of those found counts. A null field fits stars only.
    """
    table = rules.groupBy(_address(*map(F.col, ADDRESS)).alias("_rule")).agg(F.min(F.struct("pos", "color")).alias("_r"))
    starred = [_address(*[F.lit("*") if star else F.col(a) for a, star in zip(ADDRESS, stars, strict=True)]) for stars in product((False, True), repeat=len(ADDRESS))]
    own = pads.withColumn("_own", _address(F.col("pad"), *map(F.col, ADDRESS)))
    asked = own.select("_own", F.explode(F.array(*starred)).alias("_rule")).distinct()
    colors = asked.join(table, "_rule").groupBy("_own").agg(F.min("_r").alias("_r"))
    return own.join(colors, "_own", "left").select("pad", F.coalesce("_r.color", F.lit(default)).alias("color"))
