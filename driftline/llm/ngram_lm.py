"""LM scoring by a weighted backoff automaton.

States are contexts of two words and of one; the root has none. A state has an arc for each word that followed its
context in training, weighted with its smoothed probability, and one failure arc to the state of the shorter
context, weighted with what is left for other words. p(w | h) = (c(hw) + M p(w | h')) / (c(h) + M), h' being h
without its first word: a word with an arc pays the arc, any other the failure arc M / (c(h) + M), then what the
next state asks, down to the root's p(w) = (c(w) + 1) / (N + V + 1), which leaves a share for unknown words. A text
begins in the state of the end token. Probabilities of all words after a context add up to one.

M is fitted for each order on training counts: with n1 n-grams used once and n2 used twice, M = n1 / (2 n2) leaves to
a word seen once after a context seen once what Good and Turing's estimate 2 n2 / n1 of its count leaves it.

The model is never in one place. Documents are counted and scored in blocks of bounded size; counts of words and
n-grams are added up in hash buckets, and each block gets back the part of the automaton that it uses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import packed, packed_ranks, unpacked, unpacked_ranks
from .spread import durable, tasks
from .tokens import slices

#: Bytes of text in a block, of which about four make an entry; entries that a bucket gets, about.
BLOCK, ENTRIES = 12 << 20, 2_000_000
#: Bits by which hashes of n-grams are longer than the number of tokens: one n-gram in 16,384 shares its count.
SPARE_BITS = 14
_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64 bits for a pair of words from 64 bits for each."""
    x = (first ^ (first >> np.uint64(32))) * _MULTIPLY + second
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLY
    return x ^ (x >> np.uint64(29))


def tokenise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts behind one another as places in a block's vocabulary, tokens of each text, hashes of the vocabulary.

    Texts are lower-cased in A-Z and cut at ASCII white space; each ends with the end token, place 0.
    """
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds = cut.offsets.to_numpy().astype(np.int64)
    flat = cut.values.slice(bounds[0], bounds[-1] - bounds[0])
    words = flat.dictionary_encode()
    place = words.indices.to_numpy().astype(np.int64) + 1
    distinct = words.dictionary.to_pylist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in ["", *distinct]), np.uint64, len(distinct) + 1)
    if "" in distinct:  # an edge of the white space, not a word
        place[place == distinct.index("") + 1] = -1
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    kept = place >= 0
    place, rows = place[kept], rows[kept]
    # the most frequent words get the smallest places, which pack well; the end token stays at 0
    by_use = np.concatenate([[0], 1 + np.argsort(-np.bincount(place, minlength=len(hashes))[1:], kind="stable")])
    new = np.empty(len(by_use), np.int64)
    new[by_use] = np.arange(len(by_use))
    place, hashes = new[place], hashes[by_use]
    sizes = np.bincount(rows, minlength=len(texts)) + 1
    tokens = np.zeros(len(place) + len(texts), np.int64)
    tokens[np.arange(len(place)) + rows] = place
    return tokens, sizes, hashes


def _packed_sorted(x: np.ndarray) -> bytes:
    """Ascending hashes as steps from one to the next."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def _unpacked_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x, np.uint64), dtype=np.uint64)


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per block of documents: ids, held_out, tokens per document, packed tokens and vocabulary hashes."""
    of = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(of)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("tokens", T.BinaryType()), T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 2, BLOCK):
                tokens, sizes, hashes = tokenise(part.column(2))
                one = [0, part.num_rows]
                lists = [pa.ListArray.from_arrays(pa.array(one, pa.int32()), x) for x in (part.column(0), part.column(1), pa.array(sizes))]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([packed_ranks(tokens)], pa.binary()), pa.array([packed(hashes)], pa.binary())], names=schema.names)
                number += 1

    return docs.select(id_col, is_held_out(id_col).alias("held"), text_col).mapInArrow(run, schema)


class Block:
    """A block's tokens with its words, pairs and triples of words, each in the order of their hashes.

    Hashes of pairs and triples have ``bits`` bits.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, words: np.ndarray, bits: int = 64):
        self.tokens, self.sizes = tokens, sizes
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        before = np.zeros(len(tokens), np.int64)  # the end token begins a text
        before[1:] = tokens[:-1]
        before[starts] = 0
        self.before = before
        self.later = np.ones(len(tokens), bool)  # tokens with two words before them, the end token counting as one
        self.later[starts] = False
        pairs, pair = np.unique(before * len(words) + tokens, return_inverse=True)
        pair_hashes = pair_hash(words[pairs // len(words)], words[pairs % len(words)])
        self.context = pair[:-1][self.later[1:]]  # the pair before each later token
        triples, triple = np.unique(self.context * len(words) + tokens[self.later], return_inverse=True)
        triple_hashes = pair_hash(pair_hashes[triples // len(words)], words[triples % len(words)])
        #: of each order the place of each token's n-gram, the order of the hashes, and the hashes in it
        self.grams = [(tokens, *_sorted(words)), (pair, *_sorted(pair_hashes >> np.uint64(64 - bits))), (triple, *_sorted(triple_hashes >> np.uint64(64 - bits)))]

    def counts(self, trained: np.ndarray) -> list[np.ndarray]:
        """How often each word, pair and triple is used in the documents that are trained on, in the order of the hashes."""
        use = np.repeat(trained, self.sizes)
        return [np.bincount(at[use if k < 2 else use[self.later]], minlength=len(order))[order] for k, (at, order, _) in enumerate(self.grams)]

    def scores(self, counts: list[np.ndarray], total: int, distinct: int, masses: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and model score of each document, by one traversal from token to token.

        ``counts`` are those of words, pairs and triples in the whole corpus, in the order of this block's hashes.
        """
        uses = []
        for (_, order, _), own in zip(self.grams, counts, strict=True):
            uses.append(np.zeros(len(order)))
            uses[-1][order] = own
        words, pairs, triples = uses
        token, pair, triple = (g[0] for g in self.grams)
        root = np.log10((words + 1) / (total + (distinct + 1)))[token]

        def state(arc: np.ndarray, context: np.ndarray, mass: float, shorter: np.ndarray) -> np.ndarray:
            """The arc where the word has one, else the failure arc and then what the shorter context asks; as logarithms."""
            out = np.log10(mass / (context + mass)) + shorter
            taken = np.flatnonzero(arc)
            out[taken] = np.log10((arc[taken] + mass * 10 ** shorter[taken]) / (context[taken] + mass))
            return out

        step = state(pairs[pair], words[self.before], masses[0], root)  # a context is used as often as its word
        step[self.later] = state(triples[triple], pairs[self.context], masses[1], step[self.later])
        starts = np.cumsum(self.sizes) - self.sizes
        return tuple(np.add.reduceat(x, starts) if len(starts) else x for x in ((words[token] > 0).astype(np.int64), root, step))


def _sorted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    return order, hashes[order]


def _block(batch: pa.RecordBatch, i: int, names: list[str], bits: int) -> tuple[Block, np.ndarray]:
    row = {n: batch.column(batch.schema.get_field_index(n))[i] for n in names}
    sizes = row["sizes"].values.to_numpy(zero_copy_only=False)
    block = Block(unpacked_ranks(row["tokens"].as_py()).astype(np.int64), sizes, unpacked(row["words"].as_py(), np.uint64), bits)
    return block, row["held"].values.to_numpy(zero_copy_only=False).astype(bool)


def _entries(batches: Iterator[pa.RecordBatch], buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, block, hashes, counts): what a block has for each bucket; kinds are 0 words, 1 pairs, 2 triples."""
    for batch in batches:
        for i in range(batch.num_rows):
            block, held = _block(batch, i, ["sizes", "tokens", "words", "held"], bits)
            rows = [[], [], [], []]
            for kind, counts in enumerate(block.counts(~held)):
                hashes = block.grams[kind][2]
                bucket = _bucket(hashes, buckets, bits if kind else 64)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for h, c, b in zip(np.split(hashes, cuts), np.split(counts, cuts), bucket[np.concatenate([[0], cuts])].tolist() if len(bucket) else [], strict=False):
                    for x, v in zip(rows, (kind, b, _packed_sorted(h), packed(c.astype(np.uint32))), strict=True):
                        x.append(v)
            number = pa.array([batch.column(0)[i].as_py()] * len(rows[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), number, pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=["kind", "bucket", "block", "hashes", "counts"])


def _bucket(hashes: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Ascending with the hash."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, block, counts, width, total, distinct, once, twice): counts over all blocks, for each block in its own order; buckets come sorted.

    The last four are those of the bucket, given once, on its first row: uses, and n-grams used at all, once and twice.
    """
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and held[0][:2] != row[:2]:
                yield _sum_bucket(held)
                held = []
            held.append(row)
    if held:
        yield _sum_bucket(held)


def _sum_bucket(rows: list[tuple]) -> pa.RecordBatch:
    hashes = [_unpacked_sorted(r[3]) for r in rows]
    counts = np.concatenate([unpacked(r[4], np.uint32) for r in rows])
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = np.bincount(at, weights=counts).astype(np.int64)
    back = np.split(sums[at], np.cumsum([len(h) for h in hashes])[:-1])
    first = np.arange(len(rows)) == 0
    wide = bool(sums.max() >> 32)
    totals = [int(x.sum()) for x in (sums, sums > 0, sums == 1, sums == 2)]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([packed(x.astype(np.uint64 if wide else np.uint32)) for x in back], pa.binary()), pa.array([8 if wide else 4] * len(rows), pa.int32()), *[pa.array(first * x) for x in totals]],
        names=["kind", "bucket", "block", "counts", "width", "total", "distinct", "once", "twice"],
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Rows whose crc32 of the id, modulo 7, is 2 are scored but not learned from; a row without an id is
    learned from. Null and empty texts have one token, their end. Repeated rows count and stay repeated. An
    empty table gives an empty result. Words are told apart by 64 bits of hash, n-grams by ``SPARE_BITS`` more than
    the number of tokens has, 44 at least.
    """
    held = durable(blocks(docs, id_col, text_col))
    n, tokens = held.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0))).first()
    bits = min(64, max(44, tokens.bit_length() + SPARE_BITS))
    parts = tasks(docs, n, 4)
    buckets = max(parts, n * BLOCK // (4 * ENTRIES))
    entries = held.mapInArrow(lambda it: _entries(it, buckets, bits), "kind int, bucket int, block long, hashes binary, counts binary")
    sums = durable(entries.repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket", "block").mapInArrow(_summed, "kind int, bucket int, block long, counts binary, width int, total long, distinct long, once long, twice long"))
    found = {r.kind: r for r in sums.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("total", "distinct", "once", "twice")]).collect()}
    total, distinct = (found[0].total, found[0].distinct) if found else (0, 0)
    masses = tuple(fitted_mass(found[k].once, found[k].twice) if k in found else 1.0 for k in (1, 2))
    both = held.withColumns({"kind": F.lit(-1), "bucket": F.lit(-1)}).unionByName(sums.drop("total", "distinct", "once", "twice"), allowMissingColumns=True)
    both = both.repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket")
    fields = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(*f) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def finish() -> pa.RecordBatch:
            block, out, ids, counts = now
            known, base, score = block.scores([np.concatenate(c or [np.zeros(0, np.uint32)]) for c in counts], total, distinct, masses)
            return pa.RecordBatch.from_arrays([ids, pa.array(out), pa.array(block.sizes), pa.array(known), pa.array(np.full(len(out), total, np.int64)), pa.array(base), pa.array(score)], names=schema.names)

        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("kind", "counts", "width", "ids")}
            kinds = batch.column(at["kind"]).to_pylist()
            for i, kind in enumerate(kinds):
                if kind < 0:
                    if now is not None:
                        yield finish()
                    now = None  # before the next block takes memory
                    block, out = _block(batch, i, ["sizes", "tokens", "words", "held"], bits)
                    now = block, out, pa.concat_arrays([batch.column(at["ids"])[i].values]), ([], [], [])
                else:
                    now[3][kind].append(unpacked(batch.column(at["counts"])[i].as_py(), np.uint64 if batch.column(at["width"])[i].as_py() == 8 else np.uint32))
        if now is not None:
            yield finish()

    return both.mapInArrow(run, schema)


def fitted_mass(once: int, twice: int) -> float:
    """M of an order, from how many of its n-grams are used once and twice."""
    return (once + 1) / (2 * twice + 1)
