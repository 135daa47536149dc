"""Hard-negative mining: the best rows of an anchor's label, and of other labels the best in a window under each, by threshold joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import durable

#: Components are multiplied by this and cut down to whole numbers, so that scores are exact.
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: The window for negatives, in percent of the positive's score, both ends included.
WINDOW = (50, 95)
#: Rows of a block and anchors of a group, at most, and numbers in one; a task joins one block with one group.
ROWS, ANCHORS, NUMBERS = 16384, 1024, 1 << 21
#: Rows of a block from which more blocks are made if there are tasks to spare.
FEW_ROWS = 2048
#: Anchors that a task joins at once, and dimensions that it adds before it prunes.
TOGETHER, STEP = 128, 8
#: How far a threshold has come down from the top of a window to its bottom, round by round.
LOWERED = (0.2, 0.3, 0.4, 0.5, 1.0)
#: Share of pairs under which the pairs left are listed one by one.
SPARSE = 0.15


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones get zeros behind."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max(int(c.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for c in columns)


def _rest(x: np.ndarray) -> np.ndarray:
    """The norm of each row from each dimension on."""
    squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1))


@dataclass
class Block:
    """Rows to be searched, their dimensions in falling order of weight, and the norms of what is left from each dimension on."""

    x: np.ndarray
    rest: np.ndarray

    def index(self, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The inverted index: (first dimension, end, the rows that some of these dimensions list, their components)."""
        for j in range(0, self.x.shape[1], STEP):
            k = min(j + STEP, self.x.shape[1])
            own = np.flatnonzero(ends > j)
            yield j, k, own, np.where(np.arange(j, k) < ends[own, None], self.x[own, j:k], 0.0)

    def ends(self, threshold: float, longest: float) -> np.ndarray:
        """The number of indexed dimensions of each row: its last ones are left out as long as they alone cannot reach ``threshold`` with anchors up to ``longest``."""
        return (self.rest * longest >= threshold).sum(axis=1).clip(max=self.x.shape[1]) if threshold > 0 else np.full(len(self.x), self.x.shape[1])


def joined(block: Block, a: np.ndarray, a_rest: np.ndarray, threshold: np.ndarray, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all allowed pairs whose score is at least the anchor's threshold.

    Dimension by dimension the index adds to the partial scores of pairs; a pair goes once its partial score and the
    product of the norms of what is left stay under the threshold. Pairs that stay are scored in full. Scores are whole
    numbers, so half of one more than covers rounding.
    """
    least = threshold - 0.5
    low, longest = float(least.min()), float(a_rest[:, 0].max())
    ends = block.ends(low, longest)
    n, d = block.x.shape
    total, pairs, partial = np.zeros((len(a), n)), None, None
    for j, k, rows, values in block.index(ends):
        if pairs is None:
            if len(rows) == n:
                total += a[:, j:k] @ values.T
            else:
                total[:, rows] += a[:, j:k] @ values.T
            if 2 * k < d:
                continue
            last = np.minimum(k, ends)
            left = a_rest[:, k][:, None] * block.rest[:, k] if int(last.min(initial=d)) == k else a_rest[:, last] * block.rest[np.arange(n), last]
            alive = total + left >= least[:, None]
            if k < d and np.count_nonzero(alive) > SPARSE * alive.size:
                continue
            p, q = np.nonzero(alive)
            kept = allowed(p, q)
            pairs, partial = (p[kept], q[kept]), total[p[kept], q[kept]]
            place = np.zeros(n, np.int64)
        else:
            p, q = pairs
            place[:] = -1
            place[rows] = np.arange(len(rows))
            listed = np.flatnonzero(place[q] >= 0)
            partial[listed] += np.einsum("ij,ij->i", a[p[listed], j:k], values[place[q[listed]]])
            last = np.minimum(k, ends[q])
            kept = partial + a_rest[p, last] * block.rest[q, last] >= least[p]
            pairs, partial = (p[kept], q[kept]), partial[kept]
    if pairs is None:  # no dimension at all
        p, q = np.nonzero(np.broadcast_to((least <= 0)[:, None], (len(a), n)))
        kept = allowed(p, q)
        pairs = p[kept], q[kept]
    p, q = pairs
    score = np.einsum("ij,ij->i", a[p], block.x[q])
    kept = score >= threshold[p]
    return p[kept], q[kept], score[kept]


def fill_windows(block: Block, ids: np.ndarray, a: np.ndarray, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray], owner: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, row, score): the ``most`` best allowed rows of the block, smaller ids first among equals, whose score lies in each window.

    ``owner`` is the anchor of each window from ``low`` to ``high``. Thresholds begin near the top of the windows and
    come down for those that are not full yet; a window is done when it is full or its threshold is at its bottom.
    """
    a_rest = _rest(a)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    open_ = np.arange(len(owner))
    for share in LOWERED:
        if not len(open_):
            break
        now = low[open_] if share == 1 else np.maximum(low[open_], high[open_] - (high[open_] - low[open_]) * share)
        anchors, at = np.unique(owner[open_], return_inverse=True)
        threshold = np.full(len(anchors), np.inf)
        np.minimum.at(threshold, at, now)
        p, q, score = joined(block, a[anchors], a_rest[anchors], threshold, lambda i, j, anchors=anchors: allowed(anchors[i], j))
        order = np.lexsort((ids[q], -score, p))
        p, q, score = p[order], q[order], score[order]
        bounds = np.searchsorted(p, np.arange(len(anchors) + 1))
        left = []
        for w, own, bottom in zip(open_.tolist(), at.tolist(), now.tolist(), strict=True):
            begin, end = bounds[own], bounds[own + 1]
            falling = -score[begin:end]
            first, after = begin + np.searchsorted(falling, -high[w]), begin + np.searchsorted(falling, -bottom, side="right")
            if after - first < most and bottom > low[w]:
                left.append(w)
                continue
            own_rows = slice(first, min(after, first + most))
            out.append((np.full(len(q[own_rows]), w), q[own_rows], score[own_rows]))
        open_ = np.array(left, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_FOUND = pa.schema([("_a", pa.int64()), ("window", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _searched(same: bool, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The join of a group of anchors with a block of rows. An anchor's windows are those of ``scores``, or everything where it has none."""

    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _FOUND.empty_table()
        width = _width(anchors["v"], rows["v"])
        x, a = _matrix(rows["v"], width), _matrix(anchors["v"], width)
        ids, a_ids, key = rows["id"].to_numpy(), anchors["id"].to_numpy(), anchors["_a"].to_numpy()
        labels = pa.chunked_array([*rows["label"].chunks, *anchors["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        labels, a_labels = labels[: len(ids)], labels[len(ids) :]
        order = np.argsort(-(x * x).sum(axis=0), kind="stable")
        x, a = np.ascontiguousarray(x[:, order]), np.ascontiguousarray(a[:, order])
        rest, size = _rest(x), np.sqrt((a * a).sum(axis=1))
        most_possible = np.ceil(size * rest[:, 0].max()) + 1
        if most_possible.max() >= 2.0**53:
            raise ValueError("scores of 2^53 and more are not exact: use a smaller scale")
        out = [_FOUND.empty_table()]

        def search(some: np.ndarray, own: np.ndarray, allowed) -> None:
            for i in range(0, len(some), TOGETHER):
                part = some[i : i + TOGETHER]
                if same:
                    owner, low, high, name = np.arange(len(part)), -most_possible[part], most_possible[part], np.zeros(len(part), np.int64)
                else:
                    lists = anchors["windows"].take(pa.array(part)).combine_chunks()
                    owner = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                    low, high, name = (lists.flatten().field(f).to_numpy().astype(t) for f, t in (("low", float), ("high", float), ("score", np.int64)))
                    high = np.minimum(high, most_possible[part][owner])
                w, q, score = fill_windows(Block(x[own], rest[own]), ids[own], a[part], lambda p, q, part=part: allowed(part[p], own[q]), owner, low, high, most)
                out.append(pa.table([pa.array(key[part[owner[w]]]), pa.array(name[w]), pa.array(ids[own[q]]), pa.array(score.astype(np.int64))], schema=_FOUND))

        if same:
            for label in np.unique(a_labels):
                own = np.flatnonzero(labels == label)
                if len(own):
                    search(np.flatnonzero(a_labels == label), own, lambda p, q: a_ids[p] != ids[q])
        else:
            search(np.arange(len(a)), np.arange(len(x)), lambda p, q: (a_labels[p] != labels[q]) & (a_ids[p] != ids[q]))
        return pa.concat_tables(out)

    return cell


def _best(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("_a", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: float = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows for which ``is_anchor`` holds.

    A score is the inner product of vectors of whole numbers, floor(scale * x). An anchor's positives are its best
    ``positives`` other rows of its label; each has the best ``negatives`` rows of other labels whose score lies in
    ``window``, in percent of the positive's score. Higher scores come first, then smaller ids. Windows of positives with a score under 0
    are empty.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. A shorter vector counts as having zeros
    behind; an empty one scores 0 with all. Repeated rows count as often as they come, but a row is never a positive or negative of an
    anchor of its own id, and anchors that are alike in all three columns are one. Without anchors or rows there is no result. Other columns are
    not read. Scores have to stay under 2^53, beyond which there is an error.

    Every anchor meets every row, in tasks of one group of anchors and one block of rows, both of bounded size; a
    task gives back the best few of each window. Within a task the pairs are found by an inverted index with thresholds, see ``joined``.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    known = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    table = durable(known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("_is"), F.monotonically_increasing_id().alias("_n")))
    anchors = durable(table.where("_is").select("id", "label", "v").distinct().withColumn("_a", F.monotonically_increasing_id()))
    n, width = table.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    m, fits = anchors.count(), max(1, NUMBERS // max(1, width))
    spare = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, groups = max(1, -(-n // min(ROWS, fits)), min(spare, -(-n // FEW_ROWS))), max(1, -(-m // min(ANCHORS, fits)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    cell = ["_block", "_group"]
    # a partition's rows, then anchors, go to blocks and groups in turn
    searched = table.select(*[F.col(c).alias(c) for c in ("id", "label", "v")], F.pmod("_n", F.lit(blocks)).cast("int").alias("_block"), every(groups).alias("_group"))

    def search(asked: DataFrame, same: bool, most: int) -> DataFrame:
        asked = asked.select("*", F.pmod("_a", F.lit(groups)).cast("int").alias("_group"), every(blocks).alias("_block"))
        found = asked.groupBy(*cell).cogroup(searched.groupBy(*cell)).applyInArrow(_searched(same, most), "_a long, window long, id long, score long")
        return _best(found, most)

    positive = durable(search(anchors, True, positives).select("_a", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    low, high = F.call_function("div", F.col("positive_score") * window[0] + 99, F.lit(100)), F.call_function("div", F.col("positive_score") * window[1], F.lit(100))
    windows = positive.where("positive_score >= 0").select("_a", F.struct(F.col("positive_score").alias("score"), low.alias("low"), high.alias("high")).alias("w")).where("w.low <= w.high")
    asked = anchors.join(windows.groupBy("_a").agg(F.collect_set("w").alias("windows")), "_a")  # as many as positives at most
    negative = search(asked, False, negatives).select("_a", F.col("window").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select("_a", F.col("id").alias("anchor_id"))
    return positive.join(negative, ["_a", "positive_score"]).join(ids, "_a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
