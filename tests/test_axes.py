"""Axes as column expressions against numpy's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import axes
from driftline.functions.lines import fit
from driftline.operators import clouds

NAMES = "abcdef"


def leading(spark, matrices):
    rows = spark.createDataFrame([(i, *(float(m[p, q]) for p, q in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)))) for i, m in enumerate(matrices)], "i int, " + ", ".join(f"{n} double" for n in NAMES))
    found = rows.select("i", axes.leading_axes(*map(F.col, NAMES)).alias("v")).orderBy("i").collect()
    return np.array([[r.v.first, r.v.second] for r in found])


def with_values(values, seed):
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))[0]
    return turn @ np.diag(values) @ turn.T


def test_axes_equal_numpys(spark):
    rng = np.random.default_rng(0)
    matrices = [with_values(np.sort(rng.exponential(size=3) * 10.0 ** rng.integers(-6, 7))[::-1], i) for i in range(300)]
    matrices += [with_values(v, 7) for v in ((5, 4, 0), (1e8, 1, 0.5), (3, 2.999, 1), (3, 1.001, 1), (9, 0, 0))] + [np.diag(v) for v in ((1.0, 2, 3), (3.0, 1, 2), (2.0, 3, 1))]
    for m, found in zip(matrices, leading(spark, matrices), strict=True):
        values, vectors = np.linalg.eigh(m)
        for v, k in zip(found, (-1, -2), strict=True):
            assert np.isclose(np.linalg.norm(v), 1)
            assert np.abs(m @ v - values[k] * v).max() < 1e-7 * values[-1]
        assert abs(found[0] @ found[1]) < 1e-7


@pytest.mark.parametrize("values", [(2, 2, 1), (2, 1, 1), (4, 0, 0), (4, 4, 0)])
def test_equal_values_give_axes_of_their_plane(spark, values):
    m = with_values(values, 3)
    (found,) = leading(spark, [m])
    assert np.allclose(m @ found[0], values[0] * found[0]) and np.allclose(m @ found[1], values[1] * found[1])
    assert np.allclose(found @ found.T, np.eye(2)) and (found == leading(spark, [m])[0]).all()


def test_no_spread_gives_x_and_y(spark):
    assert leading(spark, [np.zeros((3, 3)), 5 * np.eye(3)]).tolist() == [[[1, 0, 0], [0, 1, 0]]] * 2


def test_signs(spark):
    rows = spark.createDataFrame([([0.1, -0.9, 0.2],), ([0.7, 0.1, -0.7],), ([-1.0, 0.0, 0.0],)], "v array<double>")
    assert [list(r.f) for r in rows.select(axes.forward(F.col("v")).alias("f")).collect()] == [[-0.1, 0.9, -0.2], [0.7, 0.1, -0.7], [1.0, -0.0, -0.0]]
    assert [list(r.f) for r in rows.select(axes.upright(F.col("v")).alias("f")).collect()] == [[0.1, -0.9, 0.2], [-0.7, -0.1, 0.7], [-1.0, 0.0, 0.0]]


def test_lines_equal_the_fit_of_each_event(spark):
    rng = np.random.default_rng(1)
    events = {e: (rng.normal(size=(e + 1, 3)) * rng.exponential(40, 3) + rng.normal(0, 5000, 3), rng.normal(0.3, 1, e + 1)) for e in range(1, 30)}
    events[30] = (np.array([[1.0, 2, 3], [1, 2, 8]]), np.array([-1.0, 0]))  # no weight counts
    rows = [(1, e, i, *map(float, p), float(w)) for e, (points, weights) in events.items() for i, (p, w) in enumerate(zip(points, weights, strict=True))]
    hits = spark.createDataFrame(rows, "run int, event_id long, hit_id int, x double, y double, z double, amplitude double").repartition(4)
    for weight in (None, "amplitude"):
        for r in clouds.fit_line(hits, weight).collect():
            points, weights = events[r.event_id]
            own = None if weight is None else weights
            centre, direction = fit(points, own)
            assert np.allclose([r.cx, r.cy, r.cz], centre)
            if own is None or (own > 0).sum() > 1 or not (own > 0).any():
                assert np.allclose([r.dx, r.dy, r.dz], direction, atol=1e-6)
    assert "MapInPandas" not in clouds.fit_line(hits, "amplitude")._jdf.queryExecution().toString()
    assert "Pandas" not in clouds.project_hits(hits)._jdf.queryExecution().toString()
