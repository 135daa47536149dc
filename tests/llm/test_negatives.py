"""Hard negatives against scores of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import hard_negatives as mining

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id string, windows int"


def plain(rows, anchor, positives=5, negatives=3):
    """Rows (id, vector, label) of which none is to be left out."""
    whole = [np.floor(256 * np.array(v, np.float32).astype(float)) for _, v, _ in rows]
    out = []
    for i, (own, _, label) in enumerate(rows):
        if not anchor(own) or rows[i] in rows[:i]:
            continue
        scored = sorted((-int(whole[i][: len(x)] @ x[: len(whole[i])]), r[0], r[2]) for r, x in zip(rows, whole, strict=True) if r[0] != own)
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and -50 * p <= -100 * s[0] <= -95 * p]
            out += [(own, positive, k + 1, s[1], -p, -s[0]) for k, s in enumerate(inside[:negatives])]
    return sorted(out)


def mined(df, **p):
    return sorted(tuple(r) for r in mining.mine_hard_negatives(df, F.col("vec_id") % 5 == 0, **p).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "v", "i", 1) for r in rows], SCHEMA).repartition(3)


def vectors(n, d, labels, seed, copies=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (n, d)).astype(np.float32)
    same = rng.random(n) < copies
    x[same] = x[0]
    near = rng.random(n) < 0.2
    x[near] = x[rng.integers(n, size=near.sum())] + rng.normal(0, 0.02, (near.sum(), d)).astype(np.float32)
    return [(i, v.tolist(), int(rng.integers(labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize("n, d, labels, copies", [(300, 24, 4, 0.0), (300, 17, 3, 0.35), (200, 3, 2, 0.1), (120, 1, 2, 0.0), (90, 40, 60, 0.3)])
def test_all_pairs(spark, n, d, labels, copies):
    rows = vectors(n, d, labels, n + d, copies)
    assert mined(frame(spark, rows)) == plain(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("sizes", [{"ROWS": 40, "ANCHORS": 7, "FEW_ROWS": 10}, {"NUMBERS": 500}])
def test_many_blocks_and_groups(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(mining, name, value)
    rows = vectors(260, 16, 3, 3, 0.2)
    assert mined(frame(spark, rows)) == plain(rows, lambda i: i % 5 == 0)


def test_other_numbers_of_positives_and_negatives(spark):
    rows = vectors(120, 8, 2, 11)
    assert mined(frame(spark, rows), positives=2, negatives=7) == plain(rows, lambda i: i % 5 == 0, 2, 7)


def test_rows_that_take_no_part_and_repeated_ones(spark):
    rows = vectors(60, 6, 2, 9)
    left_out = [(100, None, 1), (105, [1.0, None, 1.0], 1), (110, [1.0, float("nan")], 0), (115, [float("-inf")] * 6, 0), (120, [1.0] * 6, None), (None, [1.0] * 6, 0)]
    odd = [(65, [], 0), (70, [0.5, 0.5], 1), (71, [0.0] * 6, 0)]
    assert mined(frame(spark, rows + odd + left_out)) == plain(rows + odd, lambda i: i % 5 == 0)
    repeated = rows + [rows[3]] * 4
    assert mined(frame(spark, repeated)) == plain(repeated, lambda i: i % 5 == 0)
    repeated = rows + [rows[5]] * 2
    assert mined(frame(spark, repeated)) == plain(repeated, lambda i: i % 5 == 0)


def test_nothing(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1, [1.0], 0), (2, [1.0], 1)])) == []


def test_scores_that_are_not_exact_are_an_error(spark):
    with pytest.raises(Exception, match="2\\^53"):
        mined(frame(spark, [(5, [1e15] * 4, 0), (6, [1e15] * 4, 0)]))


def test_a_threshold_join_leaves_nothing_out():
    rng = np.random.default_rng(4)
    x, a = np.floor(rng.normal(0, 60, (500, 30))), np.floor(rng.normal(0, 60, (20, 30)))
    block, score = mining.Block(x, mining._rest(x)), a @ x.T
    for threshold in (-1e9, 0.0, 1000.0, 40000.0, 90000.0):
        p, q, s = mining.joined(block, a, mining._rest(a), np.full(20, threshold), lambda p, q: np.ones(len(p), bool))
        assert sorted(zip(p.tolist(), q.tolist(), s.tolist(), strict=True)) == sorted((i, j, score[i, j]) for i, j in zip(*np.nonzero(score >= threshold), strict=True))
    ends = block.ends(60000.0, 500.0)
    assert ends.min() < 24  # some dimensions are in no list
    assert sum(len(rows) for *_, rows, _ in block.index(ends)) < 500 * 4
