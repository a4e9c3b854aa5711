"""Three-component vector algebra over Columns (no UDFs, all inside codegen)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class V(NamedTuple):
    """Three DOUBLE columns treated as one vector."""

    x: Column
    y: Column
    z: Column


def vec(prefix: str) -> V:
    """The vector stored in columns ``<prefix>x, <prefix>y, <prefix>z``."""
    return V(F.col(prefix + "x"), F.col(prefix + "y"), F.col(prefix + "z"))


def lit3(x: float, y: float, z: float) -> V:
    return V(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))


def field(struct: Column) -> V:
    """The vector held in a STRUCT<x,y,z> column."""
    return V(struct["x"], struct["y"], struct["z"])


def struct(v: V) -> Column:
    return F.struct(v.x.alias("x"), v.y.alias("y"), v.z.alias("z"))


def columns(v: V, prefix: str) -> list[Column]:
    return [v.x.alias(prefix + "x"), v.y.alias(prefix + "y"), v.z.alias(prefix + "z")]


def div(a, b: Column) -> Column:
    """Quotient that is NULL, not an error, for a zero divisor under ANSI mode."""
    return a / F.nullif(b, F.lit(0.0))


def add(a: V, b: V) -> V:
    return V(a.x + b.x, a.y + b.y, a.z + b.z)


def sub(a: V, b: V) -> V:
    return V(a.x - b.x, a.y - b.y, a.z - b.z)


def scale(a: V, s) -> V:
    return V(a.x * s, a.y * s, a.z * s)


def dot(a: V, b: V) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: V, b: V) -> V:
    return V(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def norm2(a: V) -> Column:
    return dot(a, a)


def norm(a: V) -> Column:
    return F.sqrt(norm2(a))


def where(cond: Column, a: V, b: V) -> V:
    return V(*(F.when(cond, p).otherwise(q) for p, q in zip(a, b)))


def matvec(m, v: V) -> V:
    """Row-major 3x3 matrix (numbers or Columns) times a vector."""
    return V(*(row[0] * v.x + row[1] * v.y + row[2] * v.z for row in m))
