"""Byte-level BPE by merge replay over the distinct words of the whole corpus.

Documents are cut into words; equal words meet in one bucket, whatever documents they come from. There every merge is
applied, in rank order, at all places that an inverted index from token pair to word positions gives for it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import packed, packed_ranks, packed_words, unpacked, unpacked_ranks, unpacked_words
from .spread import durable, tasks
from .tokens import encode_by_pieces, slices

#: Distinct words that are replayed together; bytes of text in a block of documents.
WORDS, BLOCK = 50_000, 32 << 20


class MergeReplay:
    """Encodes many words at once by the ranks of a vocabulary, which map byte strings to ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, as merging the leftmost adjacent pair of least rank again and again gives them.

        All bytes of all words stand in one row of symbols with links to their neighbours. The index holds,
        for each rank, the places of pairs that merge to it. Ranks are taken in ascending order; a merge
        takes its old neighbour pairs out (they no longer match) and enters the new ones.
        """
        raw = b"".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        symbols = np.frombuffer(raw, np.uint8).astype(np.int64)
        n = len(symbols)
        if not n:
            return [[] for _ in words]
        last = np.zeros(n, bool)
        last[ends[sizes > 0] - 1] = True
        after = np.where(last, -1, np.arange(1, n + 1)).tolist()
        first = np.zeros(n, bool)
        first[(ends - sizes)[sizes > 0]] = True
        before = np.where(first, -1, np.arange(-1, n - 1)).tolist()
        whole = self.single[symbols].tolist()
        pair = np.full(n, -1, np.int64)
        if n > 1:
            pair[:-1] = np.where(last[:-1], -1, self.first[symbols[:-1] * 256 + symbols[1:]])
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(pair[at]) > 0])) if len(at) else []
        index = {int(pair[x[0]]): x.tolist() for x in np.split(at, cuts[1:])} if len(at) else {}
        wanted = pair.tolist()  # the id that the pair at a place merges to
        self._replay(whole, before, after, wanted, index)
        out, alive = [], whole
        for start, size in zip((ends - sizes).tolist(), sizes.tolist(), strict=True):
            found, i = [], start if size else -1
            while i >= 0:
                found.append(alive[i])
                i = after[i]
            out.append(found)
        return out

    def _replay(self, whole: list[int], before: list[int], after: list[int], wanted: list[int], index: dict[int, list[int]]) -> None:
        ranks, text = self.ranks, self.bytes
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            places.sort()
            soon: list[tuple[int, int]] = []  # pairs that a merge made and that come before the next place
            for place in places:
                soon.append((rank, place))
                while soon:
                    now, i = heapq.heappop(soon)
                    if wanted[i] != now:
                        continue
                    j = after[i]
                    k = after[j]
                    whole[i], after[i], wanted[j] = now, k, -1
                    if k >= 0:
                        before[k] = i
                        new = ranks.get(text[now] + text[whole[k]], -1)
                        wanted[i] = new
                        if new > rank:
                            if new in index:
                                index[new].append(i)
                            else:
                                index[new] = [i]
                                heapq.heappush(heap, new)
                        elif new >= 0:
                            heapq.heappush(soon, (new, i))
                    else:
                        wanted[i] = -1
                    h = before[i]
                    if h >= 0:
                        new = ranks.get(text[whole[h]] + text[now], -1)
                        wanted[h] = new
                        if new > rank:
                            if new in index:
                                index[new].append(h)
                            else:
                                index[new] = [h]
                                heapq.heappush(heap, new)
                        elif new >= 0:
                            heapq.heappush(soon, (new, h))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def replay(path: str) -> MergeReplay:
    with open(path, "rb") as lines:
        return MergeReplay({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def cut_words(texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Places of all texts' words, behind one another, in the list of distinct words; the number of each text's words; that list.

    Words are the matches of ``pattern``. Texts are first cut before spaces, which no match reaches over, so that
    the pattern is run on distinct pieces only; a text with longer white space is one piece.
    """
    found: dict[str, int] = {}
    cut = regex.compile(pattern).findall

    def words_of(pieces: pa.Array, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [[found.setdefault(w, len(found)) for w in cut(p)] for p in pieces.to_pylist()]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        return np.fromiter(chain.from_iterable(own), np.uint32, int(sizes.sum())), sizes

    places, sizes = encode_by_pieces(texts, words_of, keep_spaces=True)
    return places, sizes, [w.encode() for w in found]


def _hash_order(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes in ascending order, and the places of the words in it."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    order = np.argsort(hashes, kind="stable")
    return hashes[order], order


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(block, ids, sizes, places, order, words): a bounded stretch of documents as places in the list of its distinct words.

    The most frequent words come first, which makes small numbers of most places; ``order`` are the words' places by hash.
    """
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, 1, BLOCK):
            places, sizes, words = cut_words(part.column(1), pattern)
            by_use = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")
            place = np.empty(len(by_use), np.uint32)
            place[by_use] = np.arange(len(by_use), dtype=np.uint32)
            words = [words[i] for i in by_use.tolist()]
            one = pa.array([0, part.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(one, x) for x in (part.column(0), pa.array(sizes))]
            texts = [packed_ranks(place[places]), packed(_hash_order(words)[1].astype(np.uint32)), packed_words(words)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *[pa.array([x], pa.binary()) for x in texts]], names=names)
            number += 1


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, block, words): a block's distinct words for each bucket; buckets are ascending ranges of the hash."""
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = unpacked_words(raw.as_py())
            hashes, order = _hash_order(words)
            words = [words[i] for i in order.tolist()]
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(words)] if words else []
            rows = [(int(bucket[i]), packed_words(words[i:j])) for i, j in pairwise(cuts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "block", "words"])


def _replayed(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(bucket, block, sizes, tokens): the ids of each block's words in their order; every word of a bucket, whatever blocks have it, is replayed once."""
    held: list[tuple[int, int, list[bytes]]] = []

    def finish() -> Iterator[pa.RecordBatch]:
        words = list(dict.fromkeys(w for _, _, own in held for w in own))
        ids: dict[bytes, np.ndarray] = {}
        for at in range(0, len(words), WORDS):
            some = words[at : at + WORDS]
            ids.update((w, np.array(x, np.uint32)) for w, x in zip(some, replay(path).encode(some), strict=True))
        for bucket, block, own in held:
            found = [ids[w] for w in own]
            sizes = np.fromiter(map(len, found), np.uint32, len(found))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([packed(sizes)], pa.binary()), pa.array([packed(np.concatenate(found))], pa.binary())], names=["bucket", "block", "sizes", "tokens"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and held[0][0] != row[0]:
                yield from finish()
                held = []
            held.append((row[0], row[1], unpacked_words(row[2])))
    if held:
        yield from finish()


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each whole text, one row for each row of ``docs``.

    Null and empty texts have no ids; repeated rows and ids stay repeated, rows without an id are encoded like
    others; an empty table gives an empty result; other columns are ignored.

    Distinct words of blocks of documents are dealt over buckets by their hashes. A bucket replays the merges of
    its words once for the whole corpus, and each block gets back the ids of its own words. Blocks are written to
    the shared folder first, so that a lost task finds the same words again.
    """
    of = docs.schema[id_col].dataType
    shape = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(of)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("places", T.BinaryType()), T.StructField("order", T.BinaryType()), T.StructField("words", T.BinaryType())])
    held = durable(docs.select(id_col, text_col).mapInArrow(lambda it: _blocks(it, pattern, shape.names), shape))
    parts = tasks(docs, held.count(), 4)
    words = held.select("block", "words").mapInArrow(lambda it: _dealt(it, parts), "bucket int, block long, words binary")
    found = words.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(lambda it: _replayed(it, path), "bucket int, block long, word_sizes binary, tokens binary")
    both = held.drop("words").withColumn("bucket", F.lit(-1)).unionByName(found, allowMissingColumns=True)
    both = both.repartition(parts, "block").sortWithinPartitions("block", "bucket").select("bucket", "ids", "sizes", "places", "word_sizes", "tokens", "order")
    schema = T.StructType([T.StructField(id_col, of), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = replay(path)
        decimal = {i: str(i) for i in model.bytes}
        now = None

        def finish() -> pa.RecordBatch:
            ids, sizes, places, order, word_sizes, tokens = now
            ends = np.zeros(len(order), np.int64)
            n = np.zeros(len(order), np.int64)
            n[order] = by_hash = np.concatenate(word_sizes or [np.zeros(0, np.uint32)])
            ends[order] = np.cumsum(by_hash, dtype=np.int64)
            flat = np.concatenate(tokens or [np.zeros(0, np.uint32)]).tolist()
            own = [flat[a:b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            texts = [",".join(map(decimal.__getitem__, x)).encode() for x in own]
            raw = list(map(model.decode, own))
            hashes, decoded, counts = [], [], []
            ends = np.cumsum(sizes)
            for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                at = places[a:b]
                counts.append(int(n[at].sum()))
                at = at.tolist()
                hashes.append(hashlib.sha256(b",".join(map(texts.__getitem__, at))).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(raw.__getitem__, at))).hexdigest())
            return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket < 0:
                    if now is not None:
                        yield finish()
                    now = pa.concat_arrays([batch.column(1)[i].values]), batch.column(2)[i].values.to_numpy(zero_copy_only=False), unpacked_ranks(batch.column(3)[i].as_py()), unpacked(batch.column(6)[i].as_py(), np.uint32), [], []
                else:
                    now[4].append(unpacked(batch.column(4)[i].as_py(), np.uint32))
                    now[5].append(unpacked(batch.column(5)[i].as_py(), np.uint32))
        if now is not None:
            yield finish()

    return both.mapInArrow(run, schema)
