"""Eigenvalues and eigenvectors of symmetric 3 x 3 matrices as column expressions. A vector is an array of three doubles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative size under which what is left of a matrix counts as nothing, so that its eigenvalues are equal.
NOTHING = 1e-12


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: the optimizer does not copy it into each place of its use."""
    return F.transform(F.array(value), use)[0]


def dot(u: Column, v: Column) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u: Column, v: Column) -> Column:
    return F.array(u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])


def unit(v: Column) -> Column:
    return let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: x / n))


def upright(v: Column) -> Column:
    """v or its opposite, whose z is not negative."""
    return F.when(v[2] < 0, F.transform(v, lambda x: -x)).otherwise(v)


def forward(v: Column) -> Column:
    """v or its opposite, whose largest component, the first of equal ones, is positive."""
    sizes = F.transform(v, lambda x: F.abs(x))
    largest = F.element_at(v, F.array_position(sizes, F.array_max(sizes)).cast("int"))
    return F.when(largest < 0, F.transform(v, lambda x: -x)).otherwise(v)


def leading_axes(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """struct(first, second): unit vectors of the greatest and the middle eigenvalue of a matrix with diagonal a, b, c and d = xy, e = xz, f = yz.

    Eigenvalues in closed form. The one that lies apart from the other two has the longest cross product of two rows
    of the matrix less that value as its axis; the middle one's lies in the plane across, where a 2 x 2 matrix is left. Equal
    eigenvalues leave axes open. Then the middle axis is the one across that has no x or no y, and if all three are equal
    the axes are x and y. Signs are open too: see ``upright`` and ``forward``.
    """
    rows = F.array(F.array(a, d, e), F.array(d, b, f), F.array(e, f, c))
    return let(rows, lambda m: let(_values(m), lambda values: _axes(m, values)))


def _values(m: Column) -> Column:
    """struct(first, second, third, apart): the eigenvalues from great to small, and whether the first is the one apart; null if all are equal."""

    def ends(q: Column, p: Column, r: Column, phi: Column) -> Column:
        first, third = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
        return F.struct(first.alias("first"), (3 * q - first - third).alias("second"), third.alias("third"), (r >= 0).alias("apart"))

    def centred(q: Column, s: Column) -> Column:
        size = F.sqrt((dot(s[0], s[0]) + dot(s[1], s[1]) + dot(s[2], s[2])) / 6)
        cosine = lambda p: F.greatest(F.least(dot(s[0], cross(s[1], s[2])) / (2 * p * p * p), F.lit(1.0)), F.lit(-1.0))
        return let(size, lambda p: F.when(p > NOTHING * F.abs(q), let(cosine(p), lambda r: ends(q, p, r, F.acos(r) / 3))))

    return let((m[0][0] + m[1][1] + m[2][2]) / 3, lambda q: let(_less(m, q), lambda s: centred(q, s)))


def _less(m: Column, value: Column) -> Column:
    """The matrix less a multiple of the unit matrix."""
    return F.transform(m, lambda row, i: F.transform(row, lambda x, j: F.when(i == j, x - value).otherwise(x)))


def _axes(m: Column, values: Column) -> Column:
    def apart(value: Column) -> Column:
        def across(s: Column) -> Column:
            crosses = F.transform(F.array(*map(F.lit, range(3))), lambda i: let(s[i], lambda u: let(s[F.pmod(i + 1, F.lit(3))], lambda v: cross(u, v))))
            return F.array_max(F.transform(crosses, lambda w: F.struct(dot(w, w).alias("size"), w.alias("w"))))["w"]

        return unit(let(_less(m, value), across))

    def middle(w: Column) -> Column:
        zero = F.lit(0.0)
        u = unit(F.when(F.abs(w[0]) > F.abs(w[1]), F.array(-w[2], zero, w[0])).otherwise(F.array(zero, w[2], -w[1])))
        return let(u, lambda u: let(cross(w, u), lambda v: within(u, v)))

    def within(u: Column, v: Column) -> Column:
        times = lambda x: F.transform(m, lambda row: dot(row, x))
        value = values["second"]
        left = let(times(u), lambda mu: F.array(dot(u, mu) - value, dot(v, mu), dot(v, times(v)) - value))
        turned = lambda s: F.when(F.abs(s[0]) >= F.abs(s[2]), F.array(s[1], -s[0])).otherwise(F.array(s[2], -s[1]))
        small = NOTHING * (F.abs(values["first"]) + F.abs(values["third"]))
        return let(let(left, turned), lambda t: F.when(F.greatest(F.abs(t[0]), F.abs(t[1])) <= small, u).otherwise(unit(F.zip_with(u, v, lambda i, j: t[0] * i + t[1] * j))))

    both = lambda first, second: F.struct(first.alias("first"), second.alias("second"))
    axis = lambda *x: F.array(*map(F.lit, x))
    alone = apart(F.when(values["apart"], values["first"]).otherwise(values["third"]))
    found = let(alone, lambda w: let(middle(w), lambda v: F.when(values["apart"], both(w, v)).otherwise(both(cross(v, w), v))))
    return F.when(values.isNull(), both(axis(1.0, 0.0, 0.0), axis(0.0, 1.0, 0.0))).otherwise(found)
