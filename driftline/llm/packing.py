"""Best-fit packing of documents into sequences of bounded length, by bulk-synchronous rounds.

In every round the documents that wait and the gaps of the sequences are sorted by size into ranges, one for each
task. A sweep over a range, from small to large, holds the documents met so far; each gap takes the largest of them
that fits, of equal ones as many as fit. So a document goes to its successor, the least gap that holds it; where
several ask for one gap, the largest has the first rank and the others look further up. What a range leaves open is
matched over ranges by the same sweep over runs of equal sizes, whose counts are all that the driver gets. The gaps
are updated, and the next round begins. For documents that fit in no gap as many sequences are opened as they need
at least. No order of documents, and no list of them, is ever in one place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spread import durable, fresh, tasks
from .tokens import CACHED, TEXT_BYTES, slices, word_bpe_ids

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0
#: Documents and gaps that one task sweeps, at most about, and at least where there are more.
SWEPT, FEW = 500_000, 2_000
DOC, GAP, PLACED = 0, 1, 2


class Match(NamedTuple):
    """``gaps`` gaps of a run, from ``gap`` on, get ``per`` documents each, those of another run from ``doc`` on."""

    gap_run: int
    gap: int
    gaps: int
    doc_run: int
    doc: int
    per: int


def sweep(runs: Sequence[tuple[int, int, int]]) -> list[Match]:
    """Matches of runs (size, kind, count), which ascend by size and have documents before gaps of their size."""
    waiting: list[list[int]] = []  # run, first document, how many; the largest last
    out = []
    for g, (size, kind, count) in enumerate(runs):
        if kind == DOC:
            waiting.append([g, 0, count])
            continue
        at = 0
        while at < count and waiting:
            d, first, left = waiting[-1]
            per = size // runs[d][0]
            whole = min(count - at, left // per)
            if whole:
                out.append(Match(g, at, whole, d, first, per))
            at, first, left = at + whole, first + whole * per, left - whole * per
            if at < count and left:  # fewer than a gap holds
                out.append(Match(g, at, 1, d, first, left))
                at, left = at + 1, 0
            if left:
                waiting[-1] = [d, first, left]
            else:
                waiting.pop()
    return out


def needed(sizes: dict[int, int], capacity: int) -> int:
    """Sequences that documents (size: how many) need at least. Where some fill more than half a sequence, only these count: the others may fit beside them."""
    large = sum(n for size, n in sizes.items() if 2 * size > capacity)
    if large:
        return large
    by_length = -(-sum(size * n for size, n in sizes.items()) // capacity)
    by_number = (-(-sum(n for size, n in sizes.items() if (j + 1) * size > capacity) // j) for j in range(2, 9))
    return max(by_length, *by_number)


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, text_bytes: int = TEXT_BYTES, cached: int = CACHED) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and its end id, cut after every ``capacity`` ids.

    A Python worker takes ``text_bytes`` of text at once, or one text, and keeps the ids of ``cached`` words: less of either takes less memory and more time.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, text_bytes):
                ids, n = word_bpe_ids(part.column(1), path, cached)
                ends = np.cumsum(n)
                end = np.array([END], "<u4")
                row, start, length, crc = [], [], [], []
                for i, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
                    own = np.concatenate([ids[a:b].astype("<u4", copy=False), end])
                    for s in range(0, len(own), capacity):
                        row.append(i)
                        start.append(s)
                        length.append(min(capacity, len(own) - s))
                        crc.append(zlib.crc32(own[s : s + capacity]))
                start = np.array(start, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


_SWEPT = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())])


def _record(schema: T.StructType, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


def _swept(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """One range, which comes sorted by size and kind: documents with their places, gaps that took some with what is left of
    them, and the others with the range's number and their rank in the range among equals."""
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches]
    if not parts:
        return
    size, kind, ident = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
    starts = np.flatnonzero(np.concatenate([[True], (size[1:] != size[:-1]) | (kind[1:] != kind[:-1])])) if len(size) else np.zeros(0, np.int64)
    counts = np.diff(starts, append=len(size))
    used = np.zeros(len(size), bool)
    for m in sweep(list(zip(size[starts].tolist(), kind[starts].tolist(), counts.tolist(), strict=True))):
        gaps = starts[m.gap_run] + m.gap + np.arange(m.gaps)
        docs = starts[m.doc_run] + m.doc + np.arange(m.gaps * m.per)
        used[gaps] = used[docs] = True
        length, gap = int(size[docs[0]]), int(size[gaps[0]])
        none = np.full(len(docs), -1)
        yield _record(_SWEPT, np.full(len(docs), PLACED), ident[docs], size[docs], np.repeat(ident[gaps], m.per), capacity - gap + np.tile(np.arange(m.per), m.gaps) * length, none, none)
        none = np.full(len(gaps), -1)
        yield _record(_SWEPT, np.full(len(gaps), GAP), ident[gaps], np.full(len(gaps), gap - m.per * length), none, none, none, none)
    rest = np.flatnonzero(~used)
    run = np.searchsorted(starts, rest, side="right") - 1
    first = np.zeros(len(starts), np.int64)
    first[run[::-1]] = np.arange(len(rest))[::-1]
    none = np.full(len(rest), -1)
    yield _record(_SWEPT, kind[rest], ident[rest], size[rest], none, none, np.full(len(rest), TaskContext.get().partitionId()), np.arange(len(rest)) - first[run])


class _Across:
    """Finds the matches over ranges of what the ranges left open; of bounded size, as runs are no more than tasks and sizes."""

    def __init__(self, runs: list[tuple[int, int, int, int]], capacity: int):
        """``runs``: (part, size, kind, count), sorted."""
        self.capacity = capacity
        self.matches = sweep([r[1:] for r in runs])
        self.runs = self._run(*(np.array([r[i] for r in runs], np.int64) for i in range(3)))
        ends = {DOC: [(m.doc_run, m.doc, m.gaps * m.per, i, m.per, 0) for i, m in enumerate(self.matches)], GAP: [(m.gap_run, m.gap, m.gaps, i, 1, m.per * runs[m.doc_run][1]) for i, m in enumerate(self.matches)]}
        self.tables = {kind: np.array(sorted(x), np.int64).reshape(-1, 6) for kind, x in ends.items()}

    def _run(self, part: np.ndarray, size: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return (part * (self.capacity + 1) + size) * 2 + kind

    def find(self, batches: Iterator[pa.RecordBatch], schema: T.StructType) -> Iterator[pa.RecordBatch]:
        """Adds match (-1 without one), slot (the gap within the match), nth (the document within the gap); a matched gap's ``left`` is what is left of it."""
        for batch in batches:
            kind, ident, size, part, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            run = np.searchsorted(self.runs, self._run(part, size, kind))
            match, slot, nth, left = np.full(len(kind), -1), np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64), size.copy()
            for k, table in self.tables.items():
                at = np.flatnonzero(kind == k)
                if not len(at) or not len(table):
                    continue
                # runs are fewer than 2^23, ranks than 2^40
                row = np.searchsorted((table[:, 0] << 40) + table[:, 1], (run[at] << 40) + rank[at], side="right") - 1
                found = table[np.maximum(row, 0)]
                hit = (row >= 0) & (found[:, 0] == run[at]) & (rank[at] - found[:, 1] < found[:, 2])
                at, found = at[hit], found[hit]
                k_th = rank[at] - found[:, 1]
                match[at], slot[at], nth[at], left[at] = found[:, 3], k_th // found[:, 4], k_th % found[:, 4], size[at] - found[:, 5]
            yield _record(schema, kind, ident, size, match, slot, nth, left)


_FOUND = T.StructType([T.StructField("kind", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("id", "size", "match", "slot", "nth", "left")]])


class _Ranges:
    """Deals documents and gaps, in the order of size and kind, over tasks of about equal numbers, from their counts by size."""

    def __init__(self, waiting: Counter[int], gaps: Counter[int], capacity: int, parts: int):
        counts = np.zeros(2 * capacity + 2, np.int64)
        for kind, own in ((DOC, waiting), (GAP, gaps)):
            for size, n in own.items():
                counts[2 * size + kind] = n
        self.counts, self.before = counts, np.cumsum(counts) - counts
        self.each = -(-max(1, int(counts.sum())) // parts)

    def deal(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the task. Equals are dealt by a hash of their ids, as one size may have more rows than a task takes."""
        for batch in batches:
            kind, ident, size = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            share = (ident.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) / 2.0**31
            run = 2 * size + kind
            at = self.before[run] + np.floor(share * self.counts[run]).astype(np.int64)
            yield _record(_DEALT, kind, ident, size, at // self.each)


_DEALT = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("task", T.IntegerType())])


def place(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, sequence_id, offset) of documents (id, distinct, and size, from 1 to ``capacity``); sequences are numbered from 0.

    Each round is written to the shared folder. Rounds grow with the number of documents that a sequence holds, not
    with that of all documents.
    """
    spark = docs.sparkSession
    waiting = Counter({int(r[0]): r[1] for r in docs.groupBy("size").agg(F.count("*")).collect()})
    if any(not 1 <= size <= capacity for size in waiting):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    state = docs.select(F.lit(DOC).alias("kind"), F.col("id").cast("long").alias("id"), F.col("size").cast("long").alias("size"))
    gaps: Counter[int] = Counter()
    opened, rounds = 0, 0
    placed, docs_across, gaps_across = [], [], []
    while waiting:
        top = max(gaps, default=0)
        outside = {size: n for size, n in waiting.items() if size > top}
        if outside:
            more = needed(outside, capacity)
            state = state.unionByName(spark.range(opened, opened + more, numPartitions=1 + more // SWEPT).select(F.lit(GAP).alias("kind"), "id", F.lit(capacity).cast("long").alias("size")))
            gaps[capacity] += more
            opened += more
        total = waiting.total() + gaps.total()
        parts = min(tasks(docs, total, SWEPT), -(-total // FEW))
        ranges = _Ranges(waiting, gaps, capacity, parts)
        dealt = state.mapInArrow(ranges.deal, _DEALT).repartitionById(parts, F.col("task")).sortWithinPartitions("size", "kind", "id")
        swept = durable(dealt.select("size", "kind", "id").mapInArrow(lambda it: _swept(it, capacity), _SWEPT))
        stats = swept.where(F.col("kind") != PLACED).groupBy("part", "size", "kind").agg(F.count("*")).collect()
        runs = sorted(tuple(map(int, r)) for r in stats if r[0] >= 0)
        across = _Across(runs, capacity)
        rest = swept.where("part >= 0").select("kind", "id", "size", "part", "rank").mapInArrow(lambda it, a=across: a.find(it, _FOUND), _FOUND)
        placed.append(swept.where(F.col("kind") == PLACED).select("id", "sequence_id", "offset"))
        if across.matches:
            hit = rest.where("match >= 0").withColumn("round", F.lit(rounds))
            docs_across.append(hit.where(F.col("kind") == DOC).select("round", "match", "slot", "id", (F.col("nth") * F.col("size")).alias("after")))
            gaps_across.append(hit.where(F.col("kind") == GAP).select("round", "match", "slot", F.col("id").alias("sequence_id"), (capacity - F.col("size")).alias("begin")))
        rounds += 1
        # what the driver knows of the next round: counts by size
        waiting, gaps = Counter(), Counter({int(r[1]): r[3] for r in stats if r[0] < 0})
        for _, size, kind, n in runs:
            (waiting if kind == DOC else gaps)[size] += n
        for m in across.matches:
            size, length = runs[m.gap_run][1], runs[m.doc_run][1]
            waiting[length] -= m.gaps * m.per
            gaps[size] -= m.gaps
            gaps[size - m.per * length] += m.gaps
        waiting = +waiting
        least = max(1, min(waiting, default=1))
        gaps = Counter({size: n for size, n in gaps.items() if n and size >= least})
        kept = rest.where(f"NOT (kind = {DOC} AND match >= 0)").select("kind", "id", F.col("left").alias("size"))
        state = swept.where(f"kind = {GAP} AND part < 0").select("kind", "id", "size").unionByName(kept).where(f"size >= {least}")
    found = reduce(DataFrame.unionByName, placed, spark.createDataFrame([], "id long, sequence_id long, offset long"))
    if docs_across:
        both = reduce(DataFrame.unionByName, docs_across).join(reduce(DataFrame.unionByName, gaps_across), ["round", "match", "slot"])
        found = found.unionByName(both.select("id", "sequence_id", (F.col("begin") + F.col("after")).alias("offset")))
    return found


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (rows with a length of 1 to ``capacity``) with sequence_id and offset; equal rows keep their own places.

    An empty table gives an empty result. Other columns, null or not, are
    carried along; columns named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    (row,) = fresh(pieces, "_row")
    rows = durable(pieces.withColumn(row, F.monotonically_increasing_id()))
    placed = place(rows.select(F.col(row).alias("id"), F.col(length_col).alias("size")), capacity).withColumnRenamed("id", row)
    return rows.join(placed, row).select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, text_bytes: int = TEXT_BYTES, cached: int = CACHED) -> DataFrame:
    """Every piece of every document with its place; a null or empty text is one piece, its end id."""
    return pack(token_pieces(docs, path, id_col, text_col, capacity, text_bytes, cached), "length", capacity)
