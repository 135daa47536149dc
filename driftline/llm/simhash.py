"""SimHash near-dedup: 64-bit fingerprints of word shingles, compared exactly in tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .spread import attach, durable, staying, tasks, text_hash

#: Fingerprints of a bucket that one tile holds, on average, at most; a task compares two tiles.
TILE = 2048
#: Rows of the matrices within a task.
BLOCK = 256


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text in UTF-8, as an unsigned number. No word gives zero."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    if len(found) <= words:
        spans = [(0, len(joined))]
    else:
        spans = zip([0, *ends[:-words].tolist()], (ends[words - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], seed) for i, j in spans], np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, text_hash, fp): the fingerprint of each whole text as a signed long; a null text counts as empty."""
    schema = T.StructType([docs.schema[id_col], T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64))], names=schema.names)

    return docs.select(id_col, text_hash(text_col).alias("text_hash"), text_col).mapInArrow(run, schema)


def shared_bits(n: int, radius: int) -> list[int]:
    """Bit masks such that two numbers of 64 bits within ``radius`` agree on all bits of one mask at least.

    The bits are cut into more blocks than ``radius``; whatever bits differ, some blocks are untouched. More
    blocks give wider keys and so smaller buckets, at more copies of each number. Every choice is exact; ``n``
    only picks the cheapest one, that with about ``TILE`` numbers to a bucket or fewer.
    """
    for blocks in range(radius + 1, 2 * radius + 3):
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
        if n / 2 ** min(m.bit_count() for m in masks) <= TILE:
            break
    return masks


def near_links(prints: DataFrame, radius: int = 3, col: str = "fp", tile: int = TILE) -> DataFrame:
    """(a, b): links between the distinct longs of ``prints`` that connect all within ``radius`` bits, and only through such.

    Buckets of numbers that share the bits of a mask are cut into tiles. Each pair of tiles of a bucket is
    one group of bounded size and compared exactly; of dense groups only links to a root are returned, which
    join the same numbers.
    """
    n = prints.count()
    masks = shared_bits(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])
    dealt = prints.select(F.col(col).alias("fp")).select("fp", F.explode(keys).alias("x")).select("fp", "x.m", "x.k")
    tiles = dealt.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1").select("m", "k", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = attach(dealt, tiles, ["m", "k"], "fp").where("tiles is not null").withColumn("t", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("m", "k", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"), "t", "fp", F.bit_count("fp").alias("ones"))
    group = ["m", "k", "lo", "hi"]
    parts = tasks(prints, n * len(masks), 2_000_000)
    dealt = dealt.repartition(parts, *group).sortWithinPartitions(*group, "ones", "fp")
    return dealt.mapInArrow(lambda batches: _compare(batches, radius), "a long, b long").distinct()


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of groups that lie behind one another in sorted batches; the last group of a batch waits for the next."""
    rest = None
    for batch in batches:
        rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)])
        rows = rows if rest is None else np.concatenate([rest, rows])
        starts = _starts(rows)
        rest = rows[starts[-1] :]
        yield from _links(rows[: starts[-1]], radius)
    if rest is not None:
        yield from _links(rest, radius)


def _starts(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])) if len(rows) else np.zeros(1, np.int64)


def _links(rows: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    starts = _starts(rows)
    found = [_group_links(rows[i:j], radius) for i, j in zip(starts, [*starts[1:], len(rows)], strict=True)]
    links = np.concatenate([x for x in found if len(x)] or [np.zeros((0, 2), np.int64)])
    yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])


def _group_links(rows: np.ndarray, radius: int) -> np.ndarray:
    """Links within one group, whose rows are sorted by population count."""
    fp, ones, side = rows[:, 5].view(np.uint64) if rows[:, 5].flags.c_contiguous else np.ascontiguousarray(rows[:, 5]).view(np.uint64), rows[:, 6], rows[:, 4]
    across = rows[0, 2] != rows[0, 3]
    out = []
    for i in range(0, len(fp), BLOCK):
        for j in range(i, len(fp), BLOCK):
            x, y = slice(i, i + BLOCK), slice(j, j + BLOCK)
            if ones[y][0] - ones[x][-1] > radius:
                break  # tiles further on have still larger population counts
            near = np.bitwise_count(fp[x, None] ^ fp[None, y]) <= radius
            if across:
                near &= side[x, None] != side[None, y]
            elif i == j:
                np.fill_diagonal(near, False)
            p, q = np.nonzero(near)
            if len(p) > 2 * (near.shape[0] + near.shape[1]):
                p, q = _forest(near, i == j)
                nodes = np.concatenate([fp[x], fp[y]])
                out.append(np.column_stack([nodes[p], nodes[q]]))
            elif len(p):
                out.append(np.column_stack([fp[x][p], fp[y][q]]))
    return np.concatenate(out).view(np.int64) if out else np.zeros((0, 2), np.int64)


def _forest(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row (0 to n-1) and column (n on) of a dense matrix to the least one that it is connected with."""
    n, m = near.shape
    rows, cols = np.arange(n), np.arange(m) if same else np.arange(n, n + m)
    while True:
        new_rows = np.minimum(rows, np.where(near, cols[None, :], n + m).min(axis=1))
        new_cols = np.minimum(cols, np.where(near, new_rows[:, None], n + m).min(axis=0))
        if same:
            new_rows = new_cols = np.minimum(new_rows, new_cols)
        if (new_rows == rows).all() and (new_cols == cols).all():
            break
        rows, cols = new_rows, new_cols
    at, root = np.arange(n + m), np.concatenate([rows, cols])
    if same:
        at, root = at[:n], rows
    moved = at != root
    return at[moved], root[moved]


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fp (long), fingerprint (16 hex digits), component_id (least id of the component), kept (its first row), text_hash.

    Documents are linked when their fingerprints differ in ``radius`` bits or fewer; equal fingerprints,
    those of empty and null texts included, are linked. Repeated rows and ids stay repeated; rows without an
    id take part and get the least id of the others, or null. An empty table gives an empty result.
    """
    prints = durable(fingerprints(docs, id_col, text_col, words).withColumn("_row", F.monotonically_increasing_id()))
    first = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    distinct = durable(prints.groupBy("fp").agg(F.min(first).alias("_first")))
    roots = connected_components(near_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = durable(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    component = rooted.groupBy("root").agg(F.min("_first").alias("_first"))
    by_print = attach(rooted.drop("_first"), component, ["root"], "fp").select("fp", "_first")
    found = attach(prints, by_print, ["fp"], "_row")
    return found.select(id_col, "fp", hex16(F.col("fp")).alias("fingerprint"), F.col("_first.id").alias("component_id"), (F.col("_row") == F.col("_first.row")).alias("kept"), "text_hash")


def hex16(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, all columns: that of the least id, rows without an id last; of equal rows any one.

    Null and empty texts are near copies of each other. An empty table stays empty.
    """
    return staying(docs, simhash_groups(docs, id_col, text_col), id_col, text_col)
