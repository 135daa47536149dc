"""Token-ID output: whole documents as ids, in order of their ids, in files of range-coded blocks; and back.

A file is a Parquet file of blocks, written by one task with Spark's commit, so a lost task leaves nothing
behind. Files follow one another by ``part``, blocks by ``block``. A row has the coded block, the documents
that it holds parts of, and how many ids of each. Each block can be decoded by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spread import shared_folder, tasks
from .strand_coder import ABREAST, BLOCK, VOCABULARY, decode_blocks, encode_blocks
from .tokens import byte_bpe_ids, slices

#: The id that ends a document.
END = 0
#: Bytes of text that a writing task gets, about.
TASK_BYTES = 128 << 20


def write_tokens(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every document, by the tokenizer at ``path``, each with its end id, in ascending order of id.

    Null ids come first, equal ids in the order of a hash of their texts, equal rows as they are met; so rows of
    one id are dealt over tasks too. A null text counts as empty: its end id alone. An empty table gives no file. An id that
    the coder has no room for is an error.
    """
    of = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("docs", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(of)), T.StructField("code", T.BinaryType())])
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = tasks(docs, docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0], TASK_BYTES)
    order = ["id", "hash", "row"]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row")).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, doc = TaskContext.get().partitionId(), 0, 0, 0
        ids, of_doc, keys = np.zeros(0, np.uint16), np.zeros(0, np.int32), []
        first = 0  # the document that keys begins with

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block, before, ids, of_doc, keys, first
            n = -(-len(ids) // BLOCK) if last else len(ids) // BLOCK // ABREAST * ABREAST
            for at in range(0, n, ABREAST):
                some = [slice(i * BLOCK, (i + 1) * BLOCK) for i in range(at, min(n, at + ABREAST))]
                codes = encode_blocks([ids[s] for s in some])
                held = [_runs(of_doc[s]) for s in some]
                sizes = [len(ids[s]) for s in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(some), pa.int32()), pa.array(range(block, block + len(some)), pa.int32()), pa.array(before + np.cumsum(sizes) - sizes), pa.array(sizes, pa.int64()), pa.array([h[0].tolist() for h in held], pa.list_(pa.int64())), pa.array([h[1].tolist() for h in held], pa.list_(pa.int64())), pa.array([[keys[d - first] for d in h[0].tolist()] for h in held], pa.list_(kind)), pa.array(codes, pa.binary())],
                    names=schema.names,
                )
                block += len(some)
                before += sum(sizes)
            ids, of_doc = ids[n * BLOCK :], of_doc[n * BLOCK :]
            keep = int(of_doc[0]) if len(of_doc) else doc
            keys, first = keys[keep - first :], keep

        kind = None
        for batch in batches:
            for piece in slices(batch, 1):
                kind = piece.column(0).type
                own, n = byte_bpe_ids(piece.column(1), path)
                if own.max(initial=0) >= VOCABULARY:
                    raise ValueError(f"the coder takes ids below {VOCABULARY}, and the tokenizer gave {own.max()}")
                whole = np.full(len(own) + len(n), END, np.uint16)
                inner = np.ones(len(whole), bool)
                inner[np.cumsum(n + 1) - 1] = False
                whole[inner] = own
                ids, of_doc = np.concatenate([ids, whole]), np.concatenate([of_doc, np.repeat(np.arange(doc, doc + len(n), dtype=np.int32), n + 1)])
                keys += piece.column(0).to_pylist()
                doc += len(n)
                if len(ids) >= ABREAST * BLOCK:
                    yield from flush(False)
        if kind is not None:
            yield from flush(True)

    rows.mapInArrow(run, schema).write.parquet(folder)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of an ascending array, and how often each is there."""
    at = np.flatnonzero(np.diff(x, prepend=-1))
    return x[at], np.diff(at, append=len(x))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(part, doc, id, start, ids): the ids of each document, or of the part of it that one block holds, from its place in the part on."""
    rows = spark.read.parquet(folder)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("id", rows.schema["ids"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(lambda batches: _decoded(batches, schema.names, False), schema)


def _decoded(batches: Iterator[pa.RecordBatch], names: list[str], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ABREAST):
            some = batch.slice(at, ABREAST)
            col = {n: some.column(some.schema.get_field_index(n)) for n in some.schema.names}
            part, doc, start, out, length = [], [], [], [], []
            for ids, p, before, docs, sizes in zip(decode_blocks(col["code"].to_pylist()), col["part"].to_pylist(), col["before"].to_pylist(), col["docs"].to_pylist(), col["sizes"].to_pylist(), strict=True):
                raw, a = ids.astype("<u4").tobytes(), 0
                for d, n in zip(docs, sizes, strict=True):
                    own = raw[4 * a : 4 * (a + n)]
                    part.append(p)
                    doc.append(d)
                    start.append(before + a)
                    length.append(n)
                    out.append(zlib.crc32(own) if digest else own)
                    a += n
            rest = [pa.array(length, pa.int64()), pa.array(out, pa.int64())] if digest else [pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(doc, pa.int64()), col["ids"].flatten(), pa.array(start, pa.int64()), *rest], names=names)


def token_digests(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files; start counts the ids of all documents before it."""
    rows = spark.read.parquet(folder)
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per file
    before, seen = {}, 0
    for r in totals:
        before[r.part], seen = seen, seen + r.n
    of = rows.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("id", of), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())])
    pieces = rows.mapInArrow(lambda batches: _decoded(batches, schema.names, True), schema)
    whole = pieces.groupBy("part", "doc").agg(F.first("id").alias("id"), F.min("start").alias("start"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("pieces"))
    out = T.StructType([T.StructField(id_col, of), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, key, start, n, found = (batch.column(i) for i in range(5))
            crcs = []
            for pieces_ in found.to_pylist():
                crc = pieces_[0]["crc"]
                for p in pieces_[1:]:
                    crc = crc_of_both(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            starts = np.array([before[p] for p in part.to_pylist()], np.int64) + start.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([key, pa.array(starts), n, pa.array(crcs, pa.int64())], names=out.names)

    return whole.select("part", "id", "start", "n", "pieces").mapInArrow(join, out)


def crc_of_both(first: int, second: int, second_bytes: int) -> int:
    """The crc32 of two stretches behind one another, from the crc32 of each: the first is moved on by as many zero bytes."""
    moved, n, k = first, second_bytes, 0
    while n:
        if n & 1:
            moved = _times(moved, _zeros(k))
        n >>= 1
        k += 1
    return moved ^ second


@lru_cache(maxsize=64)
def _zeros(k: int) -> int:
    """What 2^k zero bytes do."""
    if k == 0:
        return _times(1 << 23, 1 << 31)  # x^8: one zero byte, in the checksum's reflected form
    return _times(_zeros(k - 1), _zeros(k - 1))


def _times(a: int, b: int) -> int:
    """The product of two polynomials over two elements, modulo the polynomial of crc32; the highest bit is the constant term."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def token_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` to a new shared folder and reads the digests back.

    A null or empty text is one id, its end. Repeated rows and ids are written and read as often as they come. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    write_tokens(docs, path, folder, id_col, text_col)
    return token_digests(spark, folder, id_col)
