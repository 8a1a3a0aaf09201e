"""Vector geometry as Column expressions: points are arrays of three doubles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(values: list[Column], body: Callable[..., Column]) -> Column:
    """body(*values) with each value written once: they are fields of the one element that a function runs over.

    Formulas name their points often; without this the plan of a formula of formulas grows by the product.
    """
    fields = F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)])
    return F.get(F.transform(F.array(fields), lambda x: body(*[x[f"v{k}"] for k in range(len(values))])), F.lit(0))


def point(x: Column, y: Column, z: Column) -> Column:
    return F.array(x.cast("double"), y.cast("double"), z.cast("double"))


def minus(a: Column, b: Column) -> Column:
    return F.array(*[a[i] - b[i] for i in range(3)])


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of arrays of any equal length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def vector_angle(a: Column, b: Column) -> Column:
    """Radians between two vectors; null where one of them is zero."""

    def of_vectors(a: Column, b: Column) -> Column:
        lengths = norm(a) * norm(b)
        return F.when(lengths > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / lengths))))

    return bound([a, b], of_vectors)


def torsion(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Dihedral angle in radians with the IUPAC sign; 0 where three points in a row are collinear."""

    def of_normals(first: Column, middle: Column, left: Column, right: Column) -> Column:
        angle = F.atan2(norm(middle) * dot(first, right), dot(left, right))
        return F.when((norm(left) > 0) & (norm(right) > 0), angle).otherwise(F.lit(0.0))

    def of_steps(first: Column, middle: Column, last: Column) -> Column:
        return bound([first, middle, cross(first, middle), cross(middle, last)], of_normals)

    return bound([p, q, r, s], lambda p, q, r, s: bound([minus(q, p), minus(r, q), minus(s, r)], of_steps))


def torsion_flipped(p: Column, q: Column, r: Column, s: Column) -> Column:
    """The same angle with the opposite sign; null where it is not defined."""

    def of_points(p: Column, q: Column, r: Column, s: Column) -> Column:
        first, middle, last = minus(q, p), minus(r, q), minus(s, r)
        defined = (norm(cross(first, middle)) > 0) & (norm(cross(middle, last)) > 0)
        return F.when(defined, -torsion(p, q, r, s))

    return bound([p, q, r, s], of_points)


def base_normal(n9_or_n1: Column, second: Column, third: Column) -> Column:
    """Unit normal of the base plane spanned from the glycosidic atom."""

    def of_points(a: Column, b: Column, c: Column) -> Column:
        return bound([cross(minus(b, a), minus(c, a))], lambda raw: bound([raw, norm(raw)], lambda v, length: F.transform(v, lambda x: x / length)))

    return bound([n9_or_n1, second, third], of_points)


def glycosidic_class(chi: Column) -> Column:
    """syn for chi between -30 and 120 degrees, else anti."""
    return F.when((chi > math.radians(-30)) & (chi < math.radians(120)), "syn").when(chi.isNotNull(), "anti")


def cis_trans(angle: Column) -> Column:
    return F.when((angle > -math.pi / 2) & (angle < math.pi / 2), "c").otherwise("t")


def plateau(x: Column, low: float, high: float, width: float) -> Column:
    """1 between low and high, falling as a Gaussian of the given width outside."""
    below = F.exp(-F.pow((x - low) / width, 2) / 2)
    above = F.exp(-F.pow((x - high) / width, 2) / 2)
    return F.when(x < low, below).when(x > high, above).otherwise(F.when(x.isNotNull(), 1.0))
