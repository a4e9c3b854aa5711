"""Queries on meshes cut by planes: hollow bodies of the orders, clipped and capped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import capped
from ..operators.clipping import FACES
from ..session import q6 as r6
from . import derive as D
from .derive import q6
from .registry import query

AXES = "xyz"
LO, HI = (10.0, 10.0, 0.0), (80.0, 90.0, 300.0)
CUT_X = 40.0


def hollow(spark, sf) -> DataFrame:
    """Every order's body as a box with a box-shaped hollow half its size, wound outwards."""
    b = D.box_bodies(spark, sf)
    outer = D.triangles(b)  # wound inwards, as a hollow has to be
    swapped = outer.select("part", *("a" + k for k in AXES), *(F.col("c" + k).alias("b" + k) for k in AXES), *(F.col("b" + k).alias("c" + k) for k in AXES))
    inner = D.triangles(b.withColumns({"h" + k: F.col("h" + k) / 2 for k in AXES}))
    return swapped.unionByName(inner.select(swapped.columns))


def volumes(tri: DataFrame) -> DataFrame:
    """Signed volume and cap area of each part."""
    e = {p + k: F.col(p + k) - F.col("a" + k) for p in "bc" for k in AXES}
    normal = [e["b" + AXES[(i + 1) % 3]] * e["c" + AXES[(i + 2) % 3]] - e["b" + AXES[(i + 2) % 3]] * e["c" + AXES[(i + 1) % 3]] for i in range(3)]
    volume = sum((F.col("a" + k) * n for k, n in zip(AXES, normal)), F.lit(0.0)) / 6
    area = F.lit(0.0)
    for i, face in enumerate(FACES):
        area = F.when(F.col("face") == face, normal[i // 2] * (0.5 if i % 2 else -0.5)).otherwise(area)
    return tri.groupBy("part").agg(F.sum(volume).alias("volume"), F.sum(area).alias("cap_area"))


def _side(k: str, lo: float, hi: float, half: str) -> str:
    return f"greatest(least({hi}, c{k} + {half}) - greatest({lo}, c{k} - {half}), 0)"


def _clipped(share: float) -> tuple[str, str]:
    """Volume of a centred box inside the domain, and the area of the domain faces it is cut by."""
    side = {k: _side(k, lo, hi, f"h{k} * {share}") for k, lo, hi in zip(AXES, LO, HI)}
    area = " + ".join(f"CASE WHEN c{k} - h{k} * {share} < {at} AND c{k} + h{k} * {share} > {at} THEN {' * '.join(side[o] for o in AXES if o != k)} ELSE 0 END"
                      for k, lo, hi in zip(AXES, LO, HI) for at in (lo, hi))
    return " * ".join(side.values()), area


(_OUT, _OUT_AREA), (_IN, _IN_AREA) = _clipped(1.0), _clipped(0.5)


@query("capped_clip", f"""WITH {D.BODIES_SQL} SELECT part, {q6(f'({_OUT}) - ({_IN})')} AS volume, {q6(f'({_OUT_AREA}) - ({_IN_AREA})')} AS cap_area FROM bodies WHERE {_OUT} > 0""")
def capped_clip(spark, sf):
    """Hollow bodies cut to a domain: solid volume and area of the caps, hollows left open."""
    got = volumes(capped.clip_box(hollow(spark, sf), LO, HI, ["part"]))
    return got.select("part", r6(F.col("volume")).alias("volume"), r6(F.col("cap_area")).alias("cap_area"))


_PAST = {s: f"least(greatest(cx + hx * {s} - {CUT_X}, 0), 2 * hx * {s}) * 4 * hy * hz * {s * s}" for s in (1.0, 0.5)}
_RIM = {s: f"CASE WHEN abs(cx - {CUT_X}) < hx * {s} THEN 4 * hy * hz * {s * s} ELSE 0 END" for s in (1.0, 0.5)}


@query("capped_clip_filled", f"""WITH {D.BODIES_SQL} SELECT part, {q6(f"({_PAST[1.0]}) - ({_PAST[0.5]}) - {2 * CUT_X / 3} * ({_RIM[0.5]})")} AS volume, {q6(f"({_RIM[1.0]}) + ({_RIM[0.5]})")} AS cap_area
FROM bodies WHERE cx + hx > {CUT_X}""")
def capped_clip_filled(spark, sf):
    """Hollow bodies cut at one plane, every loop filled: inner caps count with the outer ones, so the signed sum is not that of a solid."""
    got = volumes(capped.clip_plane(hollow(spark, sf), 0, CUT_X, "above", ["part"], "fill"))
    return got.select("part", r6(F.col("volume")).alias("volume"), r6(F.col("cap_area")).alias("cap_area"))
