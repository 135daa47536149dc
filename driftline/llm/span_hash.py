"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the sums of (code point + 1) x base^position, modulo a prime. The hash of
any span is a difference of two entries, moved to position 0 by a power of the base's inverse, so spans of
any texts compare in constant time and longest common extensions are found by binary search.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spread import tasks
from .tokens import slices

#: Two primes under 2^31 and a base for each; together 62 bits.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244353)
#: Code points of a window, one width for every text, and the smallest window hashes that a fingerprint keeps.
WINDOW, KEPT = 5, 160
#: Bytes of text that a task gets, about.
TASK_BYTES = 64 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a base, and of its inverse; kept by the worker and doubled as texts need it."""
    size = 1 << max(10, (n - 1).bit_length())
    if which not in _powers or len(_powers[which][0]) < n:
        p = np.uint64(PRIMES[which])
        made = []
        for base in (BASES[which], pow(BASES[which], -1, PRIMES[which])):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIMES[which])) % p])
            made.append(out)
        _powers[which] = (made[0], made[1])
    return _powers[which]


class Prefixes:
    """The two prefix arrays of a text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for which, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            terms = points % p * powers(which, self.n + 1)[0][: self.n] % p
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % p]))

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hash of the code points from ``i`` to before ``j``."""
        return tuple(int((int(s[j]) - int(s[i])) * int(powers(w, self.n + 1)[1][i]) % PRIMES[w]) for w, s in enumerate(self.sums))

    def windows(self, width: int = WINDOW) -> np.ndarray:
        """The mixed hash of every window of one width; of a shorter text that of the whole text, of an empty one none."""
        width = min(width, self.n)
        if not width:
            return np.zeros(0, np.uint64)
        p, s = np.uint64(PRIMES[0]), self.sums[0]
        return mixed((s[width:] + p - s[:-width]) % p * powers(0, self.n + 1)[1][: self.n - width + 1] % p)

    def whole(self) -> tuple[int, int]:
        return int(self.sums[0][-1]), int(self.sums[1][-1])


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Hashes whose order has nothing to do with the text."""
    x = (hashes + np.uint64(1)) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def same_span(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    """Whether ``length`` code points of ``a`` from ``i`` equal those of ``b`` from ``j`` (up to a chance of 2^-62)."""
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """The most code points that ``a`` from ``i`` and ``b`` from ``j`` have in common, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if same_span(a, i, b, j, middle) else (low, middle - 1)
    return low


def smallest(hashes: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The smallest distinct hashes, shortened to 32 bits, in order."""
    if len(hashes) > 64 * kept:
        some = hashes[hashes < np.uint64(int(8 * kept / len(hashes) * 2**64))]
        some = np.unique(some >> np.uint64(32))
        if len(some) > kept:
            return some[:kept]
    return np.unique(hashes >> np.uint64(32))[:kept]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """The share of windows that two texts have in common, estimated from their smallest hashes. Two empty texts are alike."""
    both = np.union1d(a, b)[:kept]
    return float(np.mean(np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True))) if len(both) else 1.0


def _text(whole: tuple[int, int], sketch: np.ndarray) -> str:
    return f"{whole[0]:08x}{whole[1]:08x}" + sketch.astype(">u4").tobytes().hex()


class Fingerprint:
    """What is kept of a document while it is compared with its neighbour."""

    def __init__(self, text: str):
        self.text, self.prefixes = text, Prefixes(text)
        self.windows = self.prefixes.windows()
        self.sketch = smallest(self.windows)

    def edited(self, after: Fingerprint) -> tuple[str, np.ndarray, tuple[int, int]]:
        """The text with its last half replaced by the beginning of another; its sketch and hash, from the prefix arrays of both."""
        n = self.prefixes.n
        half = n // 2
        stay, take = n - half, min(half, after.prefixes.n)
        text = self.text[:stay] + after.text[:take]
        if stay >= WINDOW and take >= WINDOW:
            joint = Prefixes(self.text[stay - WINDOW + 1 : stay] + after.text[: WINDOW - 1]).windows()
            windows = np.concatenate([self.windows[: stay - WINDOW + 1], joint, after.windows[: take - WINDOW + 1]])
        else:
            windows = Prefixes(text).windows()
        whole = tuple(int((int(self.prefixes.sums[w][stay]) + int(after.prefixes.sums[w][take]) * int(powers(w, stay + 1)[0][stay])) % PRIMES[w]) for w in (0, 1))
        return text, smallest(windows), whole


def in_turn(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, look, id, text) such that each part is a range of rows, in one task, in order, followed by the row that comes next.

    Rows go by id, null ids first, equal ids by a hash of their text; an id with more rows than a part holds is dealt
    over several by that hash. Every text moves once. The row that comes after a part is copied to it (``look``), and
    the first of all to the last part. Only bounds of the parts come to the driver.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    n, none, size = rows.agg(F.count("*"), F.count_if(F.col("id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    wanted = tasks(docs, size, TASK_BYTES)
    without = -(-none * wanted // n) if n else 0  # parts of rows without an id
    others = max(1, wanted - without)
    bounds = sorted(rows.select(F.col("id").cast("double").alias("id")).approxQuantile("id", [i / others for i in range(1, others)], 1 / (8 * others))) if others > 1 and n > none else []
    share = F.least(F.col("hash") / float(1 << 64) + 0.5, F.lit(1 - 1e-12))  # from 0 to below 1, in the order of the hash
    found = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("id"))) if bounds else F.lit(0)
    many = [x for b, k in Counter(bounds).items() if k > 1 for x in (F.lit(b), F.lit(k))]
    if many:
        k = F.try_element_at(F.create_map(*many), F.col("id").cast("double"))
        found = found - F.coalesce(k - 1 - F.floor(share * k), F.lit(0))
    part = F.when(F.col("id").isNull(), F.floor(share * max(1, without))).otherwise(found + without)
    rows = rows.withColumn("part", part.cast("int")).withColumn("key", F.xxhash64("id", "hash"))
    firsts = sorted((r.part, r.key) for r in rows.groupBy("part").agg(F.min_by("key", F.struct("id", "hash")).alias("key")).collect())
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}
    at = F.try_element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("key")) if before else F.lit(None).cast("int")
    places = F.array_compact(F.array(F.struct("part", F.lit(False).alias("look")), F.when(at.isNotNull(), F.struct(at.alias("part"), F.lit(True).alias("look")))))
    dealt = rows.withColumn("place", F.explode(places)).select("place.part", "place.look", "id", "hash", "text")
    return dealt.repartitionById(max(1, without + len(bounds) + 1), F.col("part")).sortWithinPartitions("part", "look", "id", "hash").select("part", "look", "id", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix_next):
    a fingerprint is the whole text's hash and the smallest window hashes, in hex. Rows go by id (null ids
    first), equal ids by a hash of their text; after the last comes the first. common_prefix_next is the longest common
    extension with the next text. Ids are numbers. A null text counts as empty.
    An empty table gives an empty result; other columns are ignored.
    """
    fields = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()), ("common_prefix_next", T.LongType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(*f) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a row that waits for the next one
        for batch in batches:
            for piece in slices(batch, 3, 8 << 20):
                out = []
                for part, look, key, text in zip(*(piece.column(i).to_pylist() for i in range(4)), strict=True):
                    if look and (held is None or held[0] != part):
                        continue
                    own = Fingerprint(text)
                    if held is not None and held[0] == part:
                        out.append(_row(held[1], held[2], own))
                    held = None if look else (part, key, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), [piece.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()], strict=True)], names=schema.names)

    return in_turn(docs, id_col, text_col).mapInArrow(run, schema)


def _row(key: object, own: Fingerprint, after: Fingerprint) -> tuple:
    text, sketch, whole = own.edited(after)
    sha = hashlib.sha256(text.encode("utf-8")).hexdigest()
    return key, own.prefixes.n, sha, _text(own.prefixes.whole(), own.sketch), _text(whole, sketch), likeness(own.sketch, sketch), likeness(own.sketch, after.sketch), common_extension(own.prefixes, 0, after.prefixes, 0)
