"""Exact dedup: rows grouped by a 128-bit content hash, bytes compared inside groups, one row kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import attach, bounded, durable, staying, text_hash

#: Deleted before texts are compared: space and the control characters 9 to 13.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, n_text (code points of the original), text_hash.

    Texts are equal when they are identical without white space; a null text counts as empty. Of equal
    texts the row with the most code points stays, then the smallest id (null ids last), then any one of
    wholly equal rows. ``digest`` is the 128-bit content hash; texts that share it but differ in bytes
    are told apart by their sha256. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = durable(
        docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select("_id", F.char_length("_text").cast("long").alias("n_text"), normalised(F.col("_text")).alias("_norm"), text_hash("_text").alias("text_hash")).select("_id", "n_text", "text_hash", digest(F.col("_norm")).alias("_hash"), F.sha2("_norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_row"))
    )
    mixed = _collided(docs, keyed, text_col, digest)
    # only texts whose hash is shared by other bytes need more than the hash as their class
    keyed = keyed.withColumn("_class", F.lit("") if mixed is None else F.lit(None).cast("string"))
    if mixed is not None:
        keyed = durable(keyed.drop("_class").join(mixed.withColumn("_mixed", F.lit(True)), "_hash", "left").withColumn("_class", F.when(F.col("_mixed"), F.col("text_sha256")).otherwise(F.lit(""))).drop("_mixed"))
    best = F.min(F.struct((-F.col("n_text")).alias("n"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = keyed.groupBy("_hash", "_class").agg(best.alias("_best"), F.count("*").alias("group_size"))
    return attach(keyed, groups, ["_hash", "_class"], "_row").select(F.col("_id").alias(id_col), F.col("_best.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best.row")).alias("kept"), "text_sha256", "n_text", "text_hash")


def _collided(docs: DataFrame, keyed: DataFrame, text_col: str, digest: Callable[[Column], Column]) -> DataFrame | None:
    """The hashes that texts of different bytes share, None if there are none: least and greatest bytes of each repeated hash differ.

    The least and greatest text of a group are partial aggregates, so a group of copies of any size reaches
    one task as one row per map task.
    """
    repeated = durable(keyed.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"))
    texts = docs.select(normalised(F.col(text_col)).alias("_norm")).withColumn("_hash", digest(F.col("_norm")))
    spans = texts.join(bounded(repeated), "_hash", "left_semi").groupBy("_hash").agg(F.min("_norm").alias("low"), F.max("_norm").alias("high"))
    mixed = durable(spans.where("low <> high").select("_hash"))
    return None if mixed.isEmpty() else mixed


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of wholly equal rows one.

    A null text counts as empty, rows without an id take part like others and come last; an empty table stays empty.
    """
    return staying(docs, exact_groups(docs, id_col, text_col), id_col, text_col)
