"""Meshes cut by planes and closed again with caps.

A plane cuts each triangle on its own, by expressions; what a cut opens is a set of edges in
the plane. Edges that two kept triangles share cancel, the rest form loops. A cap is a fan, one
triangle per edge, so the longest loop spreads over all tasks and no list of points is built.
Cut points are computed from the inner to the outer end of a mesh edge; neighbours get the
same bits.

``holes`` says what becomes of a loop inside another:

* ``keep``: edges keep their direction, inner loops are wound the other way and their fans
  take away what the outer fan covers. Volumes are those of the solid. Where every point has as
  many edges in as out, one centre serves all loops of a mesh (triangles of hollows, and of
  concave or several loops, then overlap with opposite signs: right for sums and further cuts,
  not a picture). Meshes with gaps are capped loop by loop, about the mean of each.
* ``fill``: every fan triangle faces out of the kept side, so inner loops are filled as well
  and the result is not closed there. The choice of tools that wind all caps alike. Loops are
  components of their end points.

Loops that do not close (the mesh had a gap there) get no cap. A mesh that the plane only
touches stays as it is. Empty tables give empty tables; rows with a null coordinate are refused.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .clipping import CORNER_COLUMNS, EPS, FACES
from .components import connected_components
from .meshes import bbox

AXES = "xyz"
# Points closer than this become one end of an edge.
GRID = 1e6


def _corner(p: str) -> Column:
    return F.struct(*(F.col(p + k).alias(k) for k in AXES), F.col("d" + p).alias("d"))


def _crossing(i: Column, o: Column) -> Column:
    """Where the edge from a kept to a removed corner meets the plane; a corner in the plane is its own crossing."""
    t = i.d / (i.d - o.d)
    return F.struct(*(F.when(i.d == 0, i[k]).otherwise(i[k] + (o[k] - i[k]) * t).alias(k) for k in AXES), F.lit(0.0).alias("d"))


def _measured(tri: DataFrame, axis: int, sign: int, at: float) -> DataFrame:
    """Corner distances from the plane, positive on the kept side, exactly zero in it."""
    far = {p: (F.col(p + AXES[axis]) - at) * sign for p in "abc"}
    return tri.withColumns({"d" + p: F.when(F.abs(d) <= EPS, 0.0).otherwise(d) for p, d in far.items()}).withColumns(
        {"_low": F.least("da", "db", "dc"), "_high": F.greatest("da", "db", "dc")})


def _split(tri: DataFrame, carry: list[str]) -> DataFrame:
    """Straddling triangles as (carry, faces, edge): one or two kept triangles and the cap edge they leave."""
    a, b, c = map(_corner, "abc")
    kept = {p: F.col("d" + p) >= 0 for p in "abc"}
    # The corner on its own side comes first; the order of corners stays.
    turn = F.when(kept["b"] == kept["c"], F.array(a, b, c)).when(kept["a"] == kept["c"], F.array(b, c, a)).otherwise(F.array(c, a, b))
    t = tri.select(*carry, turn.alias("t")).select(*carry, *(F.col("t")[i].alias(n) for i, n in enumerate("uvw")))
    u, v, w = (F.col(n) for n in "uvw")
    single = u.d >= 0
    t = t.withColumn("p", F.when(single, _crossing(u, v)).otherwise(_crossing(v, u))).withColumn("q", F.when(single, _crossing(u, w)).otherwise(_crossing(w, u)))
    p, q = F.col("p"), F.col("q")
    face = lambda *x: F.struct(*(e.alias(n) for n, e in zip("abc", x)))
    return t.select(*carry, F.when(single, F.array(face(u, p, q))).otherwise(F.array(face(p, v, w), face(p, w, q))).alias("faces"),
                    F.when(single, face(q, p)).otherwise(face(p, q)).alias("edge"))


def _key(p: Column) -> Column:
    return F.struct(*(F.round(p[k] * GRID).cast("bigint").alias("q" + k) for k in AXES))


def _open_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, a, b) left after those run both ways have cancelled: keys, u, v, p, q, net."""
    ends = edges.select(*keys, F.array(*(F.struct(_key(F.col(n)).alias("node"), F.col(n).alias("at")) for n in "ab")).alias("e"))
    e = ends.select(*keys, F.sort_array("e").alias("o"), F.col("e")[0].node.alias("first"))
    e = e.select(*keys, *(F.col("o")[i].node.alias(n) for i, n in enumerate("uv")), *(F.col("o")[i].at.alias(n) for i, n in enumerate("pq")), "first").filter("u != v")
    e = e.withColumn("s", F.when(F.col("first") == F.col("u"), 1).otherwise(-1))
    return e.groupBy(*keys, "u", "v").agg(F.min("p").alias("p"), F.min("q").alias("q"), F.sum("s").alias("net")).filter("net != 0")


def _caps(edges: DataFrame, keys: list[str], axis: int, sign: int, holes: str) -> DataFrame:
    """Fans (keys, corners) that close the loops of the open edges."""
    net = cut(_open_edges(edges, keys))
    if net.isEmpty():
        return net.select(*keys, *(F.lit(0.0).alias(c) for c in CORNER_COLUMNS))
    ends = net.select(*keys, F.explode(F.array(*(F.struct(F.col(n).alias("node"), F.col(p).alias("at"), (F.col("net") * s).alias("out")) for n, p, s in (("u", "p", 1), ("v", "q", -1))))).alias("e")).select(*keys, "e.*")
    points = cut(ends.groupBy(*keys, "node").agg(F.min("at").alias("at"), F.sum("out").alias("balance"), F.count("*").alias("degree")))
    mean = [F.avg(F.col("at")[k]).alias("a" + k) for k in AXES]
    centred = None
    if holes == "keep":
        uneven = cut(points.filter("balance != 0").select(*keys).distinct())
        even = points.join(uneven, keys, "left_anti").groupBy(*keys).agg(*mean)
        centred = net.join(cut(even), keys)
        net, points = net.join(uneven, keys, "left_semi"), points.join(uneven, keys, "left_semi")
        net = None if uneven.isEmpty() else net
    if net is not None:  # loop by loop
        loops = connected_components(net.select(*keys, "u", "v"), keys=keys)
        whole = F.col("balance") == 0 if holes == "keep" else F.col("degree") % 2 == 0
        label = cut(points.join(loops, [*keys, "node"]))
        fans = label.groupBy(*keys, "component").agg(F.min(whole).alias("whole"), *mean)
        parts = net.join(label.select(*keys, F.col("node").alias("u"), "component"), [*keys, "u"]).join(cut(fans.filter("whole")), [*keys, "component"]).drop("component", "whole")
        centred = centred.unionByName(parts) if centred is not None else parts
    if holes == "keep":
        back, times = F.col("net") < 0, F.abs("net").cast("int")
    else:  # outwards means against the kept side
        s, t = AXES[(axis + 1) % 3], AXES[(axis + 2) % 3]
        rel = {n + k: F.col(n)[k] - F.col("a" + k) for n in "pq" for k in (s, t)}
        back, times = (rel["p" + s] * rel["q" + t] - rel["p" + t] * rel["q" + s]) * sign > 0, F.lit(1)
    corner = lambda p, q, name: [F.when(back, F.col(q)[k]).otherwise(F.col(p)[k]).alias(name + k) for k in AXES]
    flat = centred.select(*keys, *("a" + k for k in AXES), *corner("p", "q", "b"), *corner("q", "p", "c"), times.alias("_times"))
    return flat.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*keys, *CORNER_COLUMNS)


def _known() -> list[Column]:
    """Corner coordinates, refused where one is missing."""
    bad = F.raise_error(F.lit("triangle with a missing coordinate"))
    return [F.coalesce(F.col(c).cast("double"), bad).alias(c) for c in CORNER_COLUMNS]


def clip_plane(tri: DataFrame, axis: int, at: float, keep: str = "above", keys: Sequence[str] = ("mesh_id",), holes: str = "keep") -> DataFrame:
    """The part of every mesh above (or below) an axis plane, capped: keys, corners, ``face``.

    ``face`` names the plane whose cap a triangle belongs to (``xmin`` for a cut that keeps what lies
    above, and so on); it is null on the mesh's own surface. Other columns are not carried.
    """
    if holes not in ("keep", "fill") or keep not in ("above", "below") or axis not in (0, 1, 2):
        raise ValueError(f"unknown cut: axis {axis}, keep {keep}, holes {holes}")
    keys, sign = list(keys), 1 if keep == "above" else -1
    name = FACES[2 * axis + (keep == "below")]
    face = F.col("face") if "face" in tri.columns else F.lit(None).cast("string").alias("face")
    tri = _measured(tri.select(*keys, *_known(), face), axis, sign, float(at))
    beyond = cut(tri.filter("_low < 0").select(*keys).distinct())
    carry = [*keys, "face"]
    inside = tri.filter("_low >= 0 AND _high > 0")
    flush = tri.filter("_low = 0 AND _high = 0").join(beyond, keys, "left_anti")
    parts = cut(_split(tri.filter("_low < 0 AND _high > 0"), carry))  # read twice; its long expressions are not repeated
    split = parts.select(*carry, F.explode("faces").alias("f")).select(*carry, *(F.col(f"f.{p}.{k}").alias(p + k) for p in "abc" for k in AXES))
    # A kept triangle with an edge in the plane leaves that edge, run backwards.
    a, b, c = map(_corner, "abc")
    rim = inside.withColumn("edge", F.when((F.col("da") == 0) & (F.col("db") == 0), F.struct(b.alias("a"), a.alias("b")))
                            .when((F.col("db") == 0) & (F.col("dc") == 0), F.struct(c.alias("a"), b.alias("b")))
                            .when((F.col("dc") == 0) & (F.col("da") == 0), F.struct(a.alias("a"), c.alias("b")))).filter("edge IS NOT NULL")
    edges = cut(parts.select(*keys, "edge.*").unionByName(rim.join(beyond, keys, "left_semi").select(*keys, "edge.*")))
    caps = _caps(edges, keys, axis, sign, holes).withColumn("face", F.lit(name))
    cols = [*carry, *CORNER_COLUMNS]
    return inside.select(cols).unionByName(flush.select(cols)).unionByName(split.select(cols)).unionByName(caps.select(cols))


def _reaching(tri: DataFrame, lo: Sequence[float], hi: Sequence[float], keys: list[str]) -> DataFrame:
    """Triangles (keys, corners) of the meshes that no plane of the box leaves wholly outside."""
    tri = tri.select(*keys, *_known())
    ends = bbox(tri, keys)
    reach = F.lit(True)
    for i, k in enumerate(AXES):
        reach = reach & (F.col(k + "1") >= lo[i] - EPS) & (F.col(k + "0") <= hi[i] + EPS)
    if not keys:
        return tri
    near = cut(ends.filter(reach).select(*(F.col(k).alias("_near_" + k) for k in keys)))
    return tri.join(near, reduce(and_, (F.col(k).eqNullSafe(F.col("_near_" + k)) for k in keys)), "left_semi")


def clip_box(tri: DataFrame, lo: Sequence[float], hi: Sequence[float], keys: Sequence[str] = ("mesh_id",), holes: str = "keep") -> DataFrame:
    """Every mesh cut to an axis-aligned box, one plane after another, capped after each.

    Meshes that lie wholly beyond a plane leave nothing and go first, triangles clear of all planes are set aside; only
    what may still be cut is written between planes.
    """
    keys = list(keys)
    tri = _reaching(tri, lo, hi, keys)
    reach = {k: (F.least(*(p + k for p in "abc")), F.greatest(*(p + k for p in "abc"))) for k in AXES}
    clear = F.lit(True)
    for i, k in enumerate(AXES):
        clear = clear & (reach[k][0] > lo[i] + EPS) & (reach[k][1] < hi[i] - EPS)
    tri = cut(tri.withColumn("_clear", clear))
    settled = tri.filter("_clear").select(*keys, *CORNER_COLUMNS, F.lit(None).cast("string").alias("face"))
    left = tri.filter(~F.col("_clear")).select(*keys, *CORNER_COLUMNS, F.lit(None).cast("string").alias("face"))
    for axis in range(3):
        for at, keep in ((lo[axis], "above"), (hi[axis], "below")):
            low, high = left.agg(F.min(reach[AXES[axis]][0]), F.max(reach[AXES[axis]][1])).first()
            if low is None or (low >= at - EPS if keep == "above" else high <= at + EPS):
                continue  # nothing lies beyond this plane
            left = cut(clip_plane(left, axis, at, keep, keys, holes))
    return settled.unionByName(left)
