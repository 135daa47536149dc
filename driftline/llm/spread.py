"""Helpers that the corpus operators share: durable intermediate tables and joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable, shared_folder

__all__ = ["SALTS", "attach", "bounded", "durable", "fresh", "salt", "shared_folder", "staying", "tasks", "text_hash"]

#: A hot key is dealt over this many sub-keys.
SALTS = 64


def tasks(df: DataFrame, size: int, each: int) -> int:
    """As many tasks as the session's setting says, or more, so that ``size`` of anything gives each about ``each``."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def salt(*cols: str | Column, salts: int = SALTS) -> Column:
    """A stable number below ``salts`` from the values of ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def attach(rows: DataFrame, table: DataFrame, keys: list[str], *spread_by: str) -> DataFrame:
    """Left join of ``rows`` to ``table``, which has one row for each key, without hot tasks.

    ``spread_by`` names columns of ``rows`` that tell rows of one key apart. The rows of a key are dealt
    over ``SALTS`` sub-keys. Each sub-key in use gets one copy of the table's row, so that a key with a
    third of all rows is joined by ``SALTS`` tasks. Null keys find no row.
    """
    rows = rows.withColumn("_salt", salt(*spread_by))
    used = rows.select(*keys, "_salt").distinct().join(table, keys)
    return rows.join(used, [*keys, "_salt"], "left").drop("_salt")


#: So many keys of rows (16 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def bounded(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``keys``, to be broadcast if they are few enough."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def text_hash(text_col: str) -> Column:
    """64 bits that tell the texts of one id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def staying(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, all columns, that ``decided`` (id, text_hash, kept: one row for each row of docs) keeps.

    Rows are told apart by id, null or not, and text; of equal rows one stays. Texts are not shuffled as long as the
    keys of the rows that go are few enough to be broadcast.
    """
    key_id, key_hash = fresh(docs, "_key_id", "_key_hash")
    keys = durable(decided.groupBy(F.col(id_col).alias(key_id), F.col("text_hash").alias(key_hash)).agg(F.bool_or("kept").alias("_kept"), F.count("*").alias("_n")).where("NOT _kept OR _n > 1"))
    same = F.col(id_col).eqNullSafe(F.col(key_id)) & (text_hash(text_col) == F.col(key_hash))
    once = docs.join(bounded(keys.drop("_kept", "_n")), same, "left_anti")
    repeated = keys.where("_kept").drop("_kept", "_n")
    if repeated.isEmpty():
        return once
    hashed = fresh(docs, "_own_hash")[0]
    repeats = docs.join(bounded(repeated), same, "left_semi").withColumn(hashed, text_hash(text_col))
    return once.unionByName(repeats.dropDuplicates([id_col, hashed]).drop(hashed))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
