"""Triangle, segment and tetrahedron formulas as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import V, add, cross, div, dot, norm, norm2, scale, sub

# Direction of the containment ray, its merge tolerance and the
# ray-triangle tolerance.
RAY = (0.9428090415820634, 0.2705980500730985, 0.19611613513818402)
HIT_MERGE = 1e-8
RAY_EPS = 1e-10


def tri_area(a: V, b: V, c: V) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) * 0.5


def tri_flux(a: V, b: V, c: V) -> Column:
    """Signed volume of the tetrahedron spanned with the origin."""
    return dot(a, cross(b, c)) / 6.0


def equivalent_diameter(volume: Column) -> Column:
    return F.pow(volume * 6.0 / math.pi, F.lit(1.0 / 3.0))


def sphericity(volume: Column, area: Column) -> Column:
    return F.pow(F.lit(math.pi), F.lit(1.0 / 3.0)) * div(F.pow(volume * 6.0, F.lit(2.0 / 3.0)), area)


def sharpness(volume: Column, area: Column) -> Column:
    """A^3 / (36 pi V^2): one for a sphere, larger for anything else."""
    return div(area * area * area, volume * volume * (36.0 * math.pi))


def plane_distance(p: V, origin: V, normal: V) -> Column:
    return dot(sub(p, origin), normal)



def ray_hit(origin: V, direction: V, a: V, b: V, c: V) -> Column:
    """Ray parameter of a Moeller-Trumbore hit, NULL when there is none."""
    e1, e2 = sub(b, a), sub(c, a)
    p = cross(direction, e2)
    det = dot(e1, p)
    s = sub(origin, a)
    u = div(dot(s, p), det)
    q = cross(s, e1)
    w = div(dot(direction, q), det)
    t = div(dot(e2, q), det)
    ok = (F.abs(det) > RAY_EPS) & (u >= -RAY_EPS) & (w >= -RAY_EPS) & (u + w <= 1 + RAY_EPS) & (t > RAY_EPS)
    return F.when(ok, t)


def closest_on_segment(p: V, a: V, b: V) -> V:
    ab = sub(b, a)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), div(dot(sub(p, a), ab), norm2(ab)))), F.lit(0.0))
    return add(a, scale(ab, t))


def tet_volume(a: V, b: V, c: V, d: V) -> Column:
    """Signed volume."""
    return dot(sub(b, a), cross(sub(c, a), sub(d, a))) / 6.0


def tet_centroid(a: V, b: V, c: V, d: V) -> V:
    return scale(add(add(add(a, b), c), d), 0.25)


def tet_inverse(a: V, b: V, c: V, d: V) -> list[Column]:
    """Rows of the inverse edge matrix, nine values; NULL for a singular tetrahedron."""
    u, v, w = sub(b, a), sub(c, a), sub(d, a)
    det = dot(u, cross(v, w))
    return [div(x, det) for row in (cross(v, w), cross(w, u), cross(u, v)) for x in row]


def in_tet(p: V, a: V, inverse: list[Column], eps: float = 1e-12) -> Column:
    """Barycentric containment with tolerance from a precomputed inverse; singular holds nothing."""
    q = sub(p, a)
    l1, l2, l3 = (dot(q, V(*inverse[i:i + 3])) for i in (0, 3, 6))
    return F.coalesce((F.least(l1, l2, l3) >= -eps) & (l1 + l2 + l3 <= 1 + eps), F.lit(False))
