"""Axis-aligned boxes held as six columns: <p>x0 <p>y0 <p>z0 <p>x1 <p>y1 <p>z1."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import V


class Box(NamedTuple):
    lo: V
    hi: V


def box(prefix: str = "") -> Box:
    c = lambda n: F.col(prefix + n)
    return Box(V(c("x0"), c("y0"), c("z0")), V(c("x1"), c("y1"), c("z1")))


def lit_box(lo, hi) -> Box:
    return Box(V(*(F.lit(float(v)) for v in lo)), V(*(F.lit(float(v)) for v in hi)))


def columns(b: Box, prefix: str = "") -> list[Column]:
    names = ("x0", "y0", "z0", "x1", "y1", "z1")
    return [c.alias(prefix + n) for c, n in zip((*b.lo, *b.hi), names)]


def size(b: Box) -> V:
    return V(*(h - l for l, h in zip(b.lo, b.hi)))


def volume(b: Box) -> Column:
    """Product of extents, each clamped at zero."""
    return reduce(lambda p, q: p * q, (F.greatest(s, F.lit(0.0)) for s in size(b)))


def expand(b: Box, margin) -> Box:
    return Box(V(*(l - margin for l in b.lo)), V(*(h + margin for h in b.hi)))


def _all(conds) -> Column:
    return reduce(and_, conds)


def contains_point(b: Box, p: V) -> Column:
    """Closed containment."""
    return _all((c >= l) & (c <= h) for l, h, c in zip(b.lo, b.hi, p))


def contains_box(outer: Box, inner: Box) -> Column:
    return _all((il >= ol) & (ih <= oh) for ol, oh, il, ih in zip(outer.lo, outer.hi, inner.lo, inner.hi))


def meets(a: Box, b: Box) -> Column:
    """Closed intersection: touching boxes meet."""
    return _all((al <= bh) & (bl <= ah) for al, ah, bl, bh in zip(a.lo, a.hi, b.lo, b.hi))


def overlaps(a: Box, b: Box) -> Column:
    """Strict intersection: touching boxes do not overlap."""
    return _all((al < bh) & (bl < ah) for al, ah, bl, bh in zip(a.lo, a.hi, b.lo, b.hi))


def distance(a: Box, b: Box) -> Column:
    """Euclidean gap between two boxes, zero when they meet."""
    gaps = [F.greatest(bl - ah, al - bh, F.lit(0.0)) for al, ah, bl, bh in zip(a.lo, a.hi, b.lo, b.hi)]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])


def point_distance(p: V, b: Box) -> Column:
    gaps = [F.greatest(l - c, c - h, F.lit(0.0)) for c, l, h in zip(p, b.lo, b.hi)]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])


def aspect_ratio(b: Box) -> Column:
    """Longest over shortest extent; the shortest is floored at 1e-12."""
    s = size(b)
    return F.greatest(*s) / F.greatest(F.least(*s), F.lit(1e-12))


def boundary_ok(b: Box, domain: Box, mode: int, margin: float, depth: float) -> Column:
    """Boundary rule for a body in a domain.

    A body wholly inside keeps ``margin`` to every wall. In mode 1 nothing may
    straddle; in the other modes a straddling body must reach at least ``depth``
    to both sides of each wall it crosses and keep ``margin`` on the axes where
    it crosses none.
    """
    per_axis = []
    for l, h, dl, dh in zip(b.lo, b.hi, domain.lo, domain.hi):
        a, z, n = l - dl, h - dl, dh - dl
        inside = (a >= 0) & (z <= n)
        clear = (a >= margin) & (z <= n - margin)
        low_ok = (a >= 0) | ((F.abs(a) >= depth) & (z >= depth))
        high_ok = (z <= n) | ((n - a >= depth) & (z - n >= depth))
        per_axis.append((inside, clear, low_ok & high_ok))
    wholly = _all(p[0] for p in per_axis)
    all_clear = _all(p[1] for p in per_axis)
    if mode == 1:
        return wholly & all_clear
    straddle = _all(F.when(i, c).otherwise(d) for i, c, d in per_axis)
    return F.when(wholly, all_clear).otherwise(straddle)


def crossed_faces(b: Box, domain: Box) -> Column:
    """Names of the domain faces a box crosses, in xmin..zmax order."""
    names = ("xmin", "xmax", "ymin", "ymax", "zmin", "zmax")
    conds = []
    for l, h, dl, dh in zip(b.lo, b.hi, domain.lo, domain.hi):
        conds += [l < dl, h > dh]
    items = [F.when(c, F.lit(n)) for c, n in zip(conds, names)]
    return F.filter(F.array(*items), lambda s: s.isNotNull())


def retained_depth(b: Box, domain: Box) -> Column:
    """Smallest inward reach over the faces the box crosses (infinite if none)."""
    inf = F.lit(float("inf"))
    reach = []
    for l, h, dl, dh in zip(b.lo, b.hi, domain.lo, domain.hi):
        reach.append(F.when(l < dl, h - dl).otherwise(inf))
        reach.append(F.when(h > dh, dh - l).otherwise(inf))
    return F.least(*reach)


def snap(value: Column, eps: float = 1e-3) -> Column:
    """Pull a bound within ``eps`` of an integer onto it."""
    near = F.round(value)
    return F.when(F.abs(value - near) <= eps, near).otherwise(value)
