"""Golden values for the numpy functions of traces and lines."""

import numpy as np
import pytest

from driftline.functions import lines, signals


def from_d2(d):
    x = [0.0, 0.0]
    for v in d:
        x.append(v + 2 * x[-1] - x[-2])
    return np.array(x)


def gauss(height, centre=120, width=8):
    return height * np.exp(-((np.arange(256) - centre) ** 2) / (2 * width**2))


def test_cdf_points():
    assert np.allclose(signals.cdf_points(np.array([[0.0, 1, 3, 6]]), (0, 1, 2, 3, 4, 10)), [[0, 0, 0.1, 0.4, 1, 1]])
    assert (signals.cdf_points(np.zeros((1, 4)), (0, 2, 10)) == 0).all()


def test_clean_is_a_circular_convolution():
    for n in (7, 8, 128):
        x = np.random.default_rng(0).normal(size=(5, n))
        fixed = signals.repair_edges(x)
        masked = signals.mask_peaks(fixed)
        k = np.arange(n)
        response = np.sinc(np.minimum(k, n - k) / 20)
        slow = np.fft.ifft(np.fft.fft(masked, axis=1) * response, axis=1).real
        assert np.allclose(signals.clean(x, 20), fixed - slow, rtol=1e-9, atol=1e-9)
    assert signals.clean(np.zeros((2, 0)), 10).shape == (2, 0)
    assert np.allclose(signals.clean(np.full((1, 6), 4.0), 10), 0)


@pytest.mark.parametrize(("d", "want"), [
    ([0, 61, -121, 450, -512, 0, 0, 0], [(0, 5, 4, True)]),
    ([0, 61, -121, 0, 0, -512, 574, 0], [(0, 3, 2, True), (4, 7, 2, True)]),
    ([0, 61, 121, -450, 0], []),
    ([0, 200, -205, 0, 0], [(0, 3, 2, False)]),
    ([61, -121, 0, 0], []),
    ([0, 0, 61, -121], []),
])
def test_bitflip_segments(d, want):
    assert [(s["start"], s["end"], s["length"], s["qualified"]) for s in signals.bitflip_segments(from_d2(d), 1)] == want


def test_saturation():
    x = np.zeros(64)
    x[24:28], x[28] = 2105, 2098
    found = signals.saturation(x, 2000, 10, 16)
    assert found["plateau"] == 5 and min(found["drops"]) == 0 and len(found["drops"]) == 33
    assert signals.saturation(np.zeros(64), 2000, 10, 16) == {"plateau": 0, "drops": []}
    spike = np.zeros(64)
    spike[10], spike[11] = 2105, 2090
    assert signals.saturation(spike, 2000, 10, 16)["plateau"] == 1


def test_find_peaks():
    x = gauss(80) + gauss(50, 200)
    assert [p["pos"] for p in signals.find_peaks(x, 50, 20, 50)] == [120, 200]
    assert [p["pos"] for p in signals.find_peaks(x, 100, 20, 50)] == [120]
    assert signals.find_peaks(x, 50, 90, 50) == [] and signals.find_peaks(x, 50, 20, 5) == []
    assert [p["pos"] for p in signals.find_peaks(np.array([0, 2, 2, 2, 0, 0.0]), 1, 1, 9)] == [2]
    assert signals.find_peaks(np.array([5, 5, 0, 1.0]), 1, 0.5, 9) == []
    p = signals.find_peaks(np.array([0, 0, 10, 0, 0.0]), 1, 1, 9)[0]
    assert p["prominence"] == 10 and np.isclose(p["width"], 1.9)


def test_distance_goes_before_prominence():
    x = np.zeros(100)
    x[40], x[60] = 50, 49
    x[41:60] = 45  # the higher peak removes the lower one first
    assert [p["pos"] for p in signals.find_peaks(x, 30, 3, 90)] == [40]


def test_cleaned_heights():
    high = [max(signals.clean(gauss(h)[None], 10)[0]) for h in (20, 50, 80, 40)]
    assert np.allclose(high, [18.5, 46.25, 74, 37], atol=0.3)


def _track(direction, n=60, start=(0, 0, 0), noise=1.0, seed=0):
    t = np.linspace(0, 400, n)[:, None]
    return np.array(start) + t * np.array(direction) / np.linalg.norm(direction) + np.random.default_rng(seed).normal(0, noise, (n, 3))


def test_lines_are_found_apart():
    points = np.concatenate([_track((1, -0.4, 0.1), noise=3.0), _track((0.3, 0.3, 1), noise=3.0, seed=1), np.random.default_rng(2).uniform(-300, 300, (8, 3))])
    found = lines.find(points)
    assert len(found) >= 2 and all(len(x.at) >= 20 for x in found)
    used = np.concatenate([x.at for x in found])
    assert len(used) == len(set(used.tolist()))
    assert all(np.isclose(np.linalg.norm(x.direction), 1) and x.direction[2] >= 0 for x in found)
    again = lines.find(points)
    assert all((a.at == b.at).all() for a, b in zip(found, again, strict=True))
    assert lines.find(points[:5]) == []


def test_lines_that_continue_each_other_are_merged():
    z = np.array([0.0, 0.0, 1.0])
    a = lines.Line(np.arange(3), np.array([0.0, 0, 0]), z)
    b = lines.Line(np.arange(3, 6), np.array([10.0, 0, 200]), z)
    c = lines.Line(np.arange(6, 9), np.array([100.0, 0, 0]), z)
    merged = lines.merge([a, c, b])
    assert [sorted(x.at.tolist()) for x in merged] == [[0, 1, 2, 3, 4, 5], [6, 7, 8]] and (merged[0].centroid == a.centroid).all()


def test_weighted_fit():
    points = np.array([[0, 0, 0], [0, 0, 10], [50.0, 0, 0]])
    centre, direction = lines.fit(points, np.array([1, 1, -5.0]))
    assert np.allclose(centre, [0, 0, 5]) and np.allclose(direction, [0, 0, 1])
    assert np.allclose(lines.fit(points, np.zeros(3))[0], points.mean(axis=0))
    assert lines.distances(np.array([3.0, 4, 5]), np.zeros(3), np.array([0, 0, 1.0])) == 5


def _plain_peaks(x, separation, prominence, max_width, rel_height, height):
    """Peaks of one trace by loops over its samples."""
    n, found = len(x), []
    i = 0
    while i < n:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if i > 0 and j < n - 1 and x[i - 1] < x[i] > x[j + 1] and (height is None or x[i] >= height):
            found.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(found, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= separation for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        a = b = p
        while a > 0 and x[a - 1] <= x[p]:
            a -= 1
        while b < n - 1 and x[b + 1] <= x[p]:
            b += 1
        left, right = max(j for j in range(a, p + 1) if x[j] == min(x[a : p + 1])), min(j for j in range(p, b + 1) if x[j] == min(x[p : b + 1]))
        rise = x[p] - max(x[left], x[right])
        if rise < prominence:
            continue
        cut, i, j = x[p] - rel_height * rise, p, p
        while i > left and x[i] > cut:
            i -= 1
        while j < right and x[j] > cut:
            j += 1
        start = i + (cut - x[i]) / (x[i + 1] - x[i]) if x[i] < cut else i
        end = j - (cut - x[j]) / (x[j - 1] - x[j]) if x[j] < cut else j
        if 1 <= end - start <= max_width:
            out.append((p, x[p], rise, start, end))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_peaks_of_a_matrix_equal_plain_ones(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 4, 9, 40, 130):
        x = [rng.normal(0, 50, (30, n)), np.floor(rng.normal(0, 3, (30, n))), np.cumsum(rng.normal(0, 20, (30, n)), axis=1), 10.0 * np.cumsum(rng.integers(-1, 2, (30, n)), axis=1)][seed]
        for p in ((50, 20, 50, 0.95, None), (1, 1, 9, 0.5, None), (3.5, 0, 50, 1.0, 10.0), (0, 5, 20, 1.3, None)):
            found = signals.peaks(x, *p)
            rows = list(zip(*[found[k].tolist() for k in ("trace", "pos", "height", "prominence", "left", "right")], strict=True))
            want = [(t, *q) for t, row in enumerate(x) for q in _plain_peaks(row, *p)]
            assert [r[:2] for r in rows] == [w[:2] for w in want] and np.allclose(np.array(rows).reshape(-1, 6), np.array(want).reshape(-1, 6))


def test_many_traces_are_measured_in_parts():
    x = np.random.default_rng(0).normal(0, 50, (2 * signals._TOGETHER + 7, 24))
    found = signals.peaks(x, 4, 20, 50)
    assert found["trace"].max() > 2 * signals._TOGETHER and (np.diff(found["trace"]) >= 0).all()
    one = signals.peaks(x[-1:], 4, 20, 50)
    assert found["pos"][found["trace"] == len(x) - 1].tolist() == one["pos"].tolist()
