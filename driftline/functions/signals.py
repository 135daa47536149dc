"""Numpy functions of traces: baseline removal, spectra, peaks, bit flips and saturation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

# Step sizes that a flipped bit leaves in the second derivative, and how near to one a step must be.
BITFLIP_STEPS = (61, 121, 450, 512, 574, 902, 1024, 3584, 3646, 4096)
BITFLIP_TOLERANCE = 15.0


def repair_edges(x: np.ndarray) -> np.ndarray:
    """The first sample becomes the second, then the last the one before it."""
    x = np.array(x, np.float64)
    if x.shape[1] >= 2:
        x[:, 0] = x[:, 1]
        x[:, -1] = x[:, -2]
    return x


def mask_peaks(x: np.ndarray) -> np.ndarray:
    """Samples further than 1.5 population deviations from the mean become the mean of the others."""
    if not x.shape[1]:
        return x
    mean = x.mean(axis=1, keepdims=True)
    kept = np.abs(x - mean) <= 1.5 * x.std(axis=1, keepdims=True)
    n = kept.sum(axis=1, keepdims=True)
    fill = np.where(n > 0, (x * kept).sum(axis=1, keepdims=True) / np.maximum(n, 1), mean)
    return np.where(kept, x, fill)


def clean(x: np.ndarray, scale: float) -> np.ndarray:
    """Repaired traces less their slow part, which a sinc over the frequencies keeps."""
    x = repair_edges(x)
    n = x.shape[1]
    if not n:
        return x
    slow = np.fft.rfft(mask_peaks(x), axis=1) * np.sinc(np.arange(n // 2 + 1) / scale)
    return x - np.fft.irfft(slow, n=n, axis=1)


def spectrum(x: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(x, axis=1)) if x.shape[1] else x


def cdf_points(spectra: np.ndarray, thresholds: Sequence[int]) -> np.ndarray:
    """The share of each spectrum below each threshold bin; of a spectrum without weight 0 everywhere."""
    total = spectra.sum(axis=1, keepdims=True)
    sums = np.concatenate([np.zeros((len(spectra), 1)), np.cumsum(spectra, axis=1)], axis=1)
    at = np.clip(np.asarray(thresholds), 0, spectra.shape[1])
    share = np.divide(sums[:, at], total, out=np.zeros((len(spectra), len(at))), where=total > 0)
    share[:, at >= spectra.shape[1]] = np.where(total > 0, 1.0, 0.0)
    share[:, np.asarray(thresholds) <= 0] = 0.0
    return share


class Ranges:
    """Answers about stretches of the rows of a matrix, from the extremes of all stretches of 1, 2, 4, ... samples."""

    def __init__(self, x: np.ndarray, extreme: np.ufunc):
        self.tables, self.beyond = [x], np.less if extreme is np.maximum else np.greater
        while 2 ** len(self.tables) <= x.shape[1]:
            last, step = self.tables[-1], 2 ** (len(self.tables) - 1)
            self.tables.append(extreme(last[:, :-step], last[:, step:]))

    def before(self, row: np.ndarray, at: np.ndarray, limit: np.ndarray, tie: bool) -> np.ndarray:
        """The last place before ``at`` whose sample is beyond ``limit`` (or equals it, for ``tie``), else -1. Beyond is over for maxima, under for minima."""
        at = at.copy()
        for k in reversed(range(len(self.tables))):
            begin = at - 2**k
            some = np.flatnonzero(begin >= 0)
            value = self.tables[k][row[some], begin[some]]
            none = self.beyond(value, limit[some]) if tie else ~self.beyond(limit[some], value)
            at[some[none]] -= 2**k
        return at - 1

    def after(self, row: np.ndarray, at: np.ndarray, limit: np.ndarray, tie: bool) -> np.ndarray:
        """The first such place after ``at``, else the rows' length."""
        at, n = at + 1, self.tables[0].shape[1]
        for k in reversed(range(len(self.tables))):
            some = np.flatnonzero(at + 2**k <= n)
            value = self.tables[k][row[some], at[some]]
            none = self.beyond(value, limit[some]) if tie else ~self.beyond(limit[some], value)
            at[some[none]] += 2**k
        return at

    def extreme(self, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The extreme of the samples from ``first`` to ``last``, both included."""
        k = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(row))
        for level in np.unique(k):
            own = np.flatnonzero(k == level)
            a, b = (self.tables[level][row[own], at] for at in (first[own], last[own] + 1 - 2**level))
            out[own] = np.where(self.beyond(a, b), b, a)
        return out


def _tops(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trace, place) of the samples and the middles of level stretches that are higher than both neighbours, in order."""
    n = x.shape[1]
    starts = np.ones(x.shape, bool)
    starts[:, 1:] = x[:, 1:] != x[:, :-1]
    first = np.flatnonzero(starts)
    last = np.concatenate([first[1:], [x.size]]) - 1
    level, row = x.ravel()[first], first // n
    inner = np.flatnonzero((row[1:-1] == row[:-2]) & (row[1:-1] == row[2:]) & (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return row[inner], (first[inner] + last[inner]) // 2 - row[inner] * n


def _spread(marks: np.ndarray, reach: int) -> np.ndarray:
    """The maximum of each row within ``reach`` samples of each place."""
    reach = min(reach, marks.shape[1] - 1)
    out, done = np.pad(marks, ((0, 0), (reach, reach))), 1
    while done < 2 * reach + 1:  # out: the maximum of the next ``done`` samples
        step = min(done, 2 * reach + 1 - done)
        out = np.maximum(out[:, : out.shape[1] - step], out[:, step:])
        done += step
    return out


def _apart(x: np.ndarray, row: np.ndarray, at: np.ndarray, gap: int) -> np.ndarray:
    """Which places stay if, from high to low and from late to early among equals, those nearer than ``gap`` to one that stays go.

    In rounds over all traces: a place that goes first among those near it stays, and what is near to it goes.
    """
    if gap <= 1:
        return np.ones(len(row), bool)
    order = np.lexsort((at, x[row, at], row))
    turn = np.empty(len(row), np.int64)
    turn[order] = np.arange(1, len(row) + 1)
    left, stays = np.zeros(x.shape, np.int64), np.zeros(len(row), bool)
    left[row, at] = turn
    open_ = np.arange(len(row))
    while len(open_):
        first = _spread(left, gap - 1)[row[open_], at[open_]] == turn[open_]
        stays[open_[first]] = True
        taken = np.zeros(x.shape, np.int8)
        taken[row[open_[first]], at[open_[first]]] = 1
        gone = _spread(taken, gap - 1)[row[open_], at[open_]] > 0
        left[row[open_[gone]], at[open_[gone]]] = 0
        open_ = open_[~gone]
    return stays


#: Traces whose peaks are measured at once; a measure needs about 20 times their samples.
_TOGETHER = 1024


def peaks(x: np.ndarray, separation: float, prominence: float, max_width: float, rel_height: float = 0.95, height: float | None = None) -> dict[str, np.ndarray]:
    """Peaks of all traces: trace, pos, height, prominence, left and right end and width at ``rel_height`` of the prominence, in order.

    A peak is a sample, or a level stretch (its middle counts), higher than both neighbours. Of peaks closer
    than ``separation`` the higher stays (of equal ones the later); then those of enough prominence and of
    a width from 1 to ``max_width`` stay.
    """
    if len(x) > _TOGETHER:
        parts = [(i, peaks(x[i : i + _TOGETHER], separation, prominence, max_width, rel_height, height)) for i in range(0, len(x), _TOGETHER)]
        return {k: np.concatenate([p[k] + (i if k == "trace" else 0) for i, p in parts]) for k in parts[0][1]}
    row, at = _tops(x) if x.shape[1] >= 3 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if height is not None:
        row, at = (c[x[row, at] >= height] for c in (row, at))
    kept = _apart(x, row, at, math.ceil(separation))
    row, at = row[kept], at[kept]
    top, high, low = x[row, at], Ranges(x, np.maximum), Ranges(x, np.minimum)
    first, last = high.before(row, at, top, False) + 1, high.after(row, at, top, False) - 1  # up to higher samples
    left_least, right_least = low.extreme(row, first, at), low.extreme(row, at, last)
    rise = top - np.maximum(left_least, right_least)
    kept = rise >= prominence
    row, at, top, rise, left_least, right_least = (c[kept] for c in (row, at, top, rise, left_least, right_least))
    cut = top - rel_height * rise
    # the nearest sample at or under the cut, but not beyond the nearest lowest one
    a = np.maximum(low.before(row, at + 1, cut, True), low.before(row, at + 1, left_least, True))
    b = np.minimum(low.after(row, at - 1, cut, True), low.after(row, at - 1, right_least, True))

    def crossing(j: np.ndarray, step: int) -> np.ndarray:
        value, inner = x[row, j], x[row, np.clip(j + step, 0, x.shape[1] - 1)]
        part = np.divide(cut - value, inner - value, out=np.zeros(len(j)), where=value < cut)
        return j + step * part

    start, end = crossing(a, 1), crossing(b, -1)
    fits = (end - start >= 1.0) & (end - start <= max_width)
    found = {"trace": row, "pos": at, "height": top, "prominence": rise, "left": start, "right": end, "width": end - start}
    return {k: v[fits] for k, v in found.items()}


def find_peaks(x: np.ndarray, separation: float, prominence: float, max_width: float, rel_height: float = 0.95, height: float | None = None) -> list[dict]:
    """The peaks of one trace."""
    found = peaks(np.asarray(x, np.float64)[None], separation, prominence, max_width, rel_height, height)
    names = [k for k in found if k != "trace"]
    return [dict(zip(names, row, strict=True)) for row in zip(*[found[k].tolist() for k in names], strict=True)]


def second_derivative(x: np.ndarray) -> np.ndarray:
    return x[..., :-2] + x[..., 2:] - 2 * x[..., 1:-1] if x.shape[-1] >= 3 else x[..., :0]


def bitflip_runs(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of large steps in the traces' second derivatives that touch no end, have two points or more and change sign at each.

    (trace, begin, end, qualified, sizes): a run has the points from begin to before end; it is qualified if every
    step is near one that a flipped bit leaves. sizes are the steps of all runs behind one another.
    """
    d = second_derivative(x)
    n = d.shape[1]
    size = np.abs(d)
    large = np.zeros((len(d), n + 2), np.int8)
    large[:, 1:-1] = size > threshold
    trace, edge = np.nonzero(np.diff(large, axis=1))
    trace, begin, end = trace[::2], edge[::2], edge[1::2]
    inner = (begin > 0) & (end < n) & (end - begin >= 2)
    trace, begin, end = trace[inner], begin[inner], end[inner]

    def points(begin: np.ndarray, end: np.ndarray, trace: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All points of all runs, and where each run's begin."""
        width = end - begin
        first = np.cumsum(width) - width
        return np.repeat(trace * n + begin - first, width) + np.arange(width.sum()), first

    def every(ok: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.logical_and.reduceat(ok, first) if len(first) else np.zeros(0, bool)

    flat, sizes = d.ravel(), size.ravel()
    at, first = points(begin + 1, end, trace)
    turns = every((flat[at] > 0) != (flat[at - 1] > 0), first)
    trace, begin, end = trace[turns], begin[turns], end[turns]
    at, first = points(begin, end, trace)
    own = sizes[at]
    near = (np.abs(own[:, None] - np.array(BITFLIP_STEPS)) <= BITFLIP_TOLERANCE).any(axis=1)
    return trace, begin, end, every(near, first), own


def bitflip_segments(x: np.ndarray, threshold: float) -> list[dict]:
    """The runs of one trace; start and end are the points before and after a run, in the second derivative."""
    _, begin, end, qualified, sizes = bitflip_runs(np.asarray(x, np.float64)[None], threshold)
    cuts = np.cumsum(end - begin)[:-1]
    return [{"start": a - 1, "end": b, "length": b - a, "qualified": q, "steps": own.tolist()} for a, b, q, own in zip(begin.tolist(), end.tolist(), qualified.tolist(), np.split(sizes, cuts), strict=False)]


def saturations(x: np.ndarray, threshold: float, drop: float, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many samples around each trace's first maximum lie at most ``drop`` below it; how far those near it lie below, and how many these are.

    Nothing of traces under ``threshold``.
    """
    n = x.shape[1]
    if not n:
        return np.zeros(len(x), np.int64), np.zeros(0), np.zeros(len(x), np.int64)
    at, m = np.arange(n), x.argmax(axis=1)[:, None]
    top = np.take_along_axis(x, m, axis=1)
    below, high = top - x, top >= threshold
    far = below > drop
    left = np.where(far & (at < m), at, -1).max(axis=1)
    right = np.where(far & (at > m), at, n).min(axis=1)
    near = (np.abs(at - m) <= radius) & high
    return np.where(high[:, 0], right - left - 1, 0), below[near], near.sum(axis=1)


def saturation(x: np.ndarray, threshold: float, drop: float, radius: int) -> dict:
    """The same of one trace."""
    plateau, drops, _ = saturations(np.asarray(x, np.float64)[None], threshold, drop, radius)
    return {"plateau": int(plateau[0]), "drops": drops.tolist()}
