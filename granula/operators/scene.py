"""Scenes from unstructured grids: cell filters, boundary faces, edges, raycasting, compositing."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_
from typing import NamedTuple, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import solids as S
from ..functions.vec import V, add, cross, div, dot, lit3, norm, scale, sub, vec
from ..session import cut
from .ordered import chains, numbered, running

# Cell type codes and the local node positions of their faces.
LINE, TRIANGLE, TETRA, VOXEL, HEXAHEDRON = 4, 5, 10, 11, 12
TET_FACES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))
VOXEL_FACES = ((0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5))  # around each face
STOP_TRANSMITTANCE = 1.0 / 512.0
# Ranges that edges are first counted by, parts of a range that are counted next, and edges few enough to be sorted.
RANGES, FAN, SORTED = 4096, 64, 200_000
# View name -> (direction, up).
VIEWS = {
    "front": ((0, 1, 0), (0, 0, 1)), "back": ((0, -1, 0), (0, 0, 1)),
    "left": ((1, 0, 0), (0, 0, 1)), "right": ((-1, 0, 0), (0, 0, 1)),
    "top": ((0, 0, -1), (0, 1, 0)), "bottom": ((0, 0, 1), (0, 1, 0)),
    "iso_ne": ((-1, -1, -1), (0, 0, 1)), "iso_nw": ((1, -1, -1), (0, 0, 1)),
    "iso_se": ((-1, 1, -1), (0, 0, 1)), "iso_sw": ((1, 1, -1), (0, 0, 1)),
}


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    for n in names:
        if n not in df.columns:
            raise ValueError(f"array {n!r} is missing; the producer of this document must write it")


def decode_sets(keys: DataFrame, offsets: Column, components: Column) -> DataFrame:
    """Members of set-valued keys from end offsets and a flat component list: adds ``members``.

    A key outside the table has NULL members.
    """
    k = F.col("key").cast("int")
    start = F.when(k > 0, F.try_element_at(offsets, k)).otherwise(F.lit(0))
    end = F.try_element_at(offsets, k + 1)
    return keys.withColumn("members", F.when((k >= 0) & end.isNotNull(), F.slice(components, start.cast("int") + 1, (end - start).cast("int"))))


def filter_column(kind: str, **arg) -> Column:
    """Predicate for one scene filter; attribute filters pass cells they do not apply to (NULL)."""
    def attr(name, values):
        return F.col(name).isNull() | F.col(name).isin(list(values))

    if kind in ("cell_kind", "region_key", "partition", "regime"):
        return attr({"partition": "partition_id"}.get(kind, kind), arg["values"])
    if kind == "component":
        return F.col("members").isNull() | F.arrays_overlap(F.col("members"), F.array(*(F.lit(v) for v in arg["values"])))
    if kind in ("background_only", "background_exclude"):
        is_bg = F.coalesce((F.size("members") == 1) & (F.element_at("members", 1) == 0), F.lit(False))
        return is_bg if kind == "background_only" else ~is_bg
    if kind == "array_range":
        c = F.col(arg["array"])
        return c.isNull() | ((c >= arg["min"]) & (c <= arg["max"]))
    if kind == "bbox":
        return reduce(and_, ((F.col("c" + k) >= lo) & (F.col("c" + k) <= hi) for k, lo, hi in zip("xyz", arg["min"], arg["max"])))
    if kind == "clip_plane":
        return dot(sub(vec("c"), lit3(*arg["origin"])), lit3(*arg["normal"])) <= 0
    raise ValueError(f"unknown filter {kind!r}")


def select_cells(cells: DataFrame, filters: Sequence[tuple[str, dict]]) -> DataFrame:
    conds = [filter_column(k, **a) for k, a in filters]
    return cells.filter(reduce(and_, conds)) if conds else cells


def cell_faces(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per face of each tetrahedron or voxel: keys, cid, face (sorted nodes), cycle (nodes around it, in the cell's own order)."""
    def faces(table):
        return F.explode(F.array(*(F.array(*(F.col("nodes")[i] for i in f)) for f in table))).alias("cycle")

    tets = cells.filter(F.col("vtk_type") == TETRA).select(*keys, "cid", faces(TET_FACES))
    boxes = cells.filter(F.col("vtk_type") == VOXEL).select(*keys, "cid", faces(VOXEL_FACES))
    return tets.unionByName(boxes).withColumn("face", F.array_sort("cycle"))


def boundary_faces(cells: DataFrame, keys: Sequence[str] = (), cycle: bool = True) -> DataFrame:
    """Faces owned by exactly one of the given cells, with that cell and (if asked for) its cycle."""
    f = cell_faces(cells, keys)
    if cycle:
        f = f.groupBy(*keys, "face").agg(F.count("*").alias("n"), F.min("cid").alias("cid"), F.min_by("cycle", "cid").alias("cycle"))
        return f.filter("n = 1").drop("n")
    # Numbers of a fixed width, the steps from node to node: they add up in a hash table and pack well where they travel.
    steps = [F.get("face", F.lit(i)) - F.get("face", F.lit(i - 1)) if i else F.get("face", F.lit(0)) for i in range(4)]
    f = f.select(*keys, "cid", *(c.alias(f"_n{i}") for i, c in enumerate(steps)))
    f = f.groupBy(*keys, *(f"_n{i}" for i in range(4))).agg(F.count("*").alias("n"), F.min("cid").alias("cid")).filter("n = 1")
    upto = [sum((F.col(f"_n{j}") for j in range(1, i + 1)), F.col("_n0")) for i in range(4)]
    return f.select(*keys, F.when(F.col("_n3").isNull(), F.array(*upto[:3])).otherwise(F.array(*upto)).alias("face"), "cid")


def volume_only(cells: DataFrame) -> DataFrame:
    """The tetrahedra of a grid; surface, line and other cells are dropped, points keep their ids."""
    return cells.filter(F.col("vtk_type") == TETRA)


def wire_edges(faces: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct edges of triangular faces."""
    pairs = [F.struct(F.col("face")[i].alias("lo"), (F.col("face")[j] - F.col("face")[i]).alias("step")) for i, j in ((0, 1), (0, 2), (1, 2))]
    edges = faces.select(*keys, F.explode(F.array(*pairs)).alias("e")).select(*keys, "e.*").distinct()
    return edges.select(*keys, "lo", (F.col("lo") + F.col("step")).alias("hi"))


def thin_edges(edges: DataFrame, cap: int | None = None) -> DataFrame:
    """Every ceil(n / cap)-th edge in sorted order; all of them when they fit, or without a cap.

    Edges are counted by ranges of ``lo``; only ranges that hold an edge to be picked are counted again in finer steps,
    and at last sorted. ``edges`` is read a few times.
    """
    if cap is None:
        return edges
    e = edges.agg(F.count("*").alias("n"), F.count("lo").alias("known"), F.min("lo").alias("low"), F.max("lo").alias("high")).first()
    if e["n"] <= cap:
        return edges
    stride = math.ceil(e["n"] / cap)
    if e["known"] < e["n"] or dict(edges.dtypes)["lo"] not in ("int", "bigint") or e["high"] - e["low"] >= 1 << 62:
        return numbered(edges, [], ["lo", "hi"], "_rk").filter((F.col("_rk") - 1) % stride == 0).drop("_rk")

    def within(width):
        return F.expr(f"(lo - ({e['low']})) div {width}")

    width = 1 << (e["high"] - e["low"]).bit_length()  # powers of two: finer ranges never straddle wider ones
    ranges, rows, fan = edges.sparkSession.createDataFrame([(0, 0)], "_b long, _before long"), e["n"], RANGES
    while rows > SORTED and width > 1:
        finer = max(width // fan, 1)
        each = edges.withColumn("_b", within(width)).join(ranges, "_b").groupBy("_b", "_before", within(finer).alias("_c")).agg(F.count("*").alias("_n"))
        upto = F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        each = each.withColumn("_at", F.col("_before") + upto).filter(F.expr(f"(_at + _n + {stride - 1}) div {stride} > (_at + {stride - 1}) div {stride}"))
        ranges = cut(each.select(F.col("_c").alias("_b"), F.col("_at").alias("_before"), "_n"))
        rows, ranges = ranges.agg(F.sum("_n")).first()[0], ranges.drop("_n")
        width, fan = finer, FAN
    place = F.row_number().over(Window.partitionBy("_b").orderBy("lo", "hi")) + F.col("_before")
    return edges.withColumn("_b", within(width)).join(ranges, "_b").withColumn("_rk", place).filter((F.col("_rk") - 1) % stride == 0).select(*edges.columns)


def cell_value(cells: DataFrame, points: DataFrame, array: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of a point array over each cell's nodes, ignoring -1 and non-finite values."""
    node = cells.select(*keys, "cid", F.explode("nodes").alias("pid")).join(points.select(*keys, "pid", array), [*keys, "pid"])
    v = F.col(array).cast("double")
    ok = (v != -1) & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return node.groupBy(*keys, "cid").agg(F.avg(F.when(ok, v)).alias("value"))


class Camera(NamedTuple):
    """Orthographic or perspective camera; vectors are plain tuples."""

    position: tuple
    forward: tuple
    right: tuple
    up: tuple
    half_width: float
    half_height: float
    perspective: bool
    distance: float
    radius: float

    @property
    def depth_range(self) -> float:
        """Far minus near plane, the scale of the coincidence tolerance and the depth bias."""
        near = max(self.distance - 2 * self.radius, self.distance * 1e-4 if self.perspective else self.radius * 1e-3)
        return max(abs(self.distance + 2 * self.radius - near), 1e-9)

    def ray(self, px: Column, py: Column, width: int, height: int) -> tuple[V, V]:
        """Origin and direction through a pixel centre; y grows downwards."""
        sx = ((px + 0.5) / width * 2.0 - 1.0) * self.half_width
        sy = (1.0 - (py + 0.5) / height * 2.0) * self.half_height
        side = add(scale(lit3(*self.right), sx), scale(lit3(*self.up), sy))
        if not self.perspective:
            return add(lit3(*self.position), side), lit3(*self.forward)
        d = add(lit3(*self.forward), side)
        n = norm(d)
        return lit3(*self.position), V(*(c / n for c in d))

    def project(self, p: V, width: int, height: int) -> tuple[Column, Column, Column]:
        """Pixel coordinates (continuous) and depth of a point."""
        q = sub(p, lit3(*self.position))
        depth = dot(q, lit3(*self.forward))
        u, v = dot(q, lit3(*self.right)) / self.half_width, dot(q, lit3(*self.up)) / self.half_height
        if self.perspective:
            u, v = div(u, depth), div(v, depth)
        return (u + 1.0) * (width / 2.0) - 0.5, (1.0 - v) * (height / 2.0) - 0.5, depth


def camera(lo, hi, direction, up=None, width: int = 1024, height: int = 1024, projection: str = "orthographic",
           fov_degrees: float = 45.0, padding: float = 0.05, distance: float | None = None, focus=None) -> Camera:
    """Camera framing a box: orthographic fits its projection, perspective its bounding sphere."""
    lo, hi = np.asarray(lo, float), np.asarray(hi, float)
    centre = (lo + hi) / 2 if focus is None else np.asarray(focus, float)
    corners = np.array([[x, y, z] for x in (lo[0], hi[0]) for y in (lo[1], hi[1]) for z in (lo[2], hi[2])]) - centre
    radius = max(float(np.linalg.norm(corners, axis=1).max()), 1e-6)
    f = np.asarray(direction, float)
    if np.linalg.norm(f) < 1e-12:
        raise ValueError("view direction has no length")
    f = f / np.linalg.norm(f)
    wanted = [np.asarray(up if up is not None else (0.0, 0.0, 1.0), float), np.eye(3)[1], np.eye(3)[0]]
    right = next(r for r in (np.cross(f, g) for g in wanted) if np.linalg.norm(r) > 1e-9)
    right /= np.linalg.norm(right)
    top = np.cross(right, f)
    aspect = width / height
    if projection == "perspective":
        half_angle = math.radians(fov_degrees) / 2
        side_angle = math.atan(math.tan(half_angle) * aspect)
        away = distance or radius * (1 + padding) / math.sin(min(half_angle, side_angle))
        half = math.tan(half_angle)
        return Camera(tuple(centre - f * away), tuple(f), tuple(right), tuple(top), half * aspect, half, True, away, radius)
    need_w, need_h = np.abs(corners @ right).max(), np.abs(corners @ top).max()
    half_h = (max(need_h, need_w / aspect) if max(need_w, need_h) > 1e-12 else radius) * (1 + padding)
    away = distance or radius * 2
    return Camera(tuple(centre - f * away), tuple(f), tuple(right), tuple(top), half_h * aspect, half_h, False, away, radius)


def ray_hits(tri: DataFrame, cam: Camera, width: int, height: int, attrs: Sequence[str]) -> DataFrame:
    """Every (pixel, triangle) hit: px, py, t, fid, attrs and the two-sided shading cosine.

    A triangle makes the pixels that its screen rectangle covers; one that covers no pixel centre drops out
    before anything travels. ``tri`` is read once.
    """
    uv = [cam.project(vec(p), width, height) for p in "abc"]
    pad = 1e-6
    ends = [(c, size, F.least(*(w[i] for w in uv)) - pad, F.greatest(*(w[i] for w in uv)) + pad) for i, (c, size) in enumerate((("px", width), ("py", height)))]
    # Rectangles come out of a generator, so that the filter does not spell the projection out again.
    rect = tri.select("fid", *attrs, *(p + k for p in "abc" for k in "xyz"), F.explode(F.array(F.struct(
        *(F.greatest(F.ceil(lo), F.lit(0)).alias(c + "0") for c, _, lo, _ in ends), *(F.least(F.floor(hi), F.lit(size - 1)).alias(c + "1") for c, size, _, hi in ends)))).alias("_r"))
    rect = rect.filter((F.col("_r.px0") <= F.col("_r.px1")) & (F.col("_r.py0") <= F.col("_r.py1")))
    pairs = rect.withColumn("p_px", F.explode(F.sequence("_r.px0", "_r.px1"))).withColumn("p_py", F.explode(F.sequence("_r.py0", "_r.py1")))
    pairs = pairs.drop("_r").withColumnsRenamed({c: "b_" + c for c in ("fid", *attrs, *(p + k for p in "abc" for k in "xyz"))})
    origin, direction = cam.ray(F.col("p_px"), F.col("p_py"), width, height)
    a, b, c = vec("b_a"), vec("b_b"), vec("b_c")
    t = S.ray_hit(origin, direction, a, b, c)
    n = cross(sub(b, a), sub(c, a))
    cosine = F.abs(div(dot(n, direction), norm(n)))
    return pairs.select(F.col("p_px").alias("px"), F.col("p_py").alias("py"), t.alias("t"), F.col("b_fid").alias("fid"),
                        *(F.col("b_" + x).alias(x) for x in attrs), cosine.alias("cosine")).filter(F.col("t").isNotNull())


def nearest_hit(hits: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """The first hit of each pixel (lowest face id on equal depth)."""
    best = hits.groupBy("px", "py").agg(F.min(F.struct("t", "fid", *attrs, "cosine")).alias("m"))
    return best.select("px", "py", "m.*")


def merge_hits(hits: DataFrame, keys: Sequence[str], tol: float, rank: str, payload: Sequence[str]) -> DataFrame:
    """Merge hits closer than ``tol`` to the last kept hit; within a merge the highest rank wins.

    Hits are first grouped into chains (gaps within tol); only inside a chain, whose
    distinct depths all lie within tol steps of each other, is the moving anchor walked.
    """
    distinct = hits.groupBy(*keys, "t").agg(F.max(F.struct(rank, *payload)).alias("_p")).select(*keys, "t", "_p.*")
    chained = chains(distinct, list(keys), "t", tol, "_chain")
    item = F.struct("t", rank, *payload)
    lists = chained.groupBy(*keys, "_chain").agg(F.sort_array(F.collect_list(item)).alias("_h"))

    def step(kept, h):
        last = F.element_at(kept, -1)
        head = F.slice(kept, 1, F.size(kept) - 1)
        merged = F.when(h[rank] > last[rank], F.concat(head, F.array(h))).otherwise(kept)
        return F.when(h["t"] - last["t"] > tol, F.concat(kept, F.array(h))).otherwise(merged)

    kept = F.aggregate(F.slice("_h", 2, F.size("_h")), F.slice("_h", 1, 1), step)
    return lists.select(*keys, F.explode(kept).alias("_k")).select(*keys, "_k.*")


def composite(hits: DataFrame, keys: Sequence[str], alpha: str, channels: Sequence[str], order: Sequence[str], depth: str | None = None) -> DataFrame:
    """Front-to-back blending: sum of T * alpha * colour, stopping once T < 1/512.

    T before a hit is the product of (1 - alpha) of the hits in front, as a running sum
    of logarithms; an opaque hit hides everything behind it. ``depth`` adds a column: the
    first of ``order`` at the hit behind which nothing shows, NULL where light passes.
    """
    a = F.col(alpha)
    logs = hits.withColumn("_a", F.when(a < 1, F.ln(F.greatest(1 - a, F.lit(1e-300)))).otherwise(F.lit(-1e4)))
    work = running(logs, list(keys), list(order), {"_l": "_a"}, inclusive=False)
    seen = work.withColumn("_T", F.exp("_l")).filter(F.col("_T") >= STOP_TRANSMITTANCE)
    weight = F.col("_T") * a
    closed = [F.min(F.when(F.col("_T") * (1 - a) < STOP_TRANSMITTANCE, F.col(order[0]))).alias(depth)] if depth else []
    return seen.groupBy(*keys).agg(
        *(F.sum(weight * F.col(c)).alias(c) for c in channels), F.sum(weight).alias("alpha"), F.count("*").alias("layers"), *closed)


def overlay_lines(segments: DataFrame, cam: Camera, width: int, height: int, depths: DataFrame, order: str, attrs: Sequence[str]) -> DataFrame:
    """Pixels that line segments (ax..bz) paint: px, py, attrs of the segment that comes last by ``order``.

    A segment is stepped by at most a pixel in screen space; only the steps that can fall on the
    image become rows, so a line that runs far outside costs no more than one across it. A step
    shows where it lies in front of the opaque depth (``depths``: px, py, depth; NULL or missing
    is open) or behind it by less than the bias, a ten-thousandth of the depth range.
    """
    ends = {p: cam.project(vec(p), width, height) for p in "ab"}
    cols = [c.alias(f"_{p}{i}") for p in "ab" for i, c in enumerate(ends[p])]
    flat = cut(segments.select(F.col(order).alias("_order"), *attrs, *cols))  # else the projection is spelled out in every use
    if cam.perspective:
        near = max(cam.distance - 2 * cam.radius, cam.distance * 1e-4)
        flat = flat.filter((F.col("_a2") > near * 0.25) & (F.col("_b2") > near * 0.25))
    d = [F.col(f"_b{i}") - F.col(f"_a{i}") for i in range(3)]
    flat = flat.withColumn("_n", F.greatest(F.ceil(F.greatest(F.abs(d[0]), F.abs(d[1]))), F.lit(1)).cast("double"))
    flat = flat.withColumns({f"_r{i}": d[i] / F.col("_n") for i in range(2)})
    first, last = F.lit(0.0), F.col("_n")
    for i, size in ((0, width), (1, height)):  # steps s with -1 <= a + (b - a) s / n <= size
        here, rate = F.col(f"_a{i}"), F.col(f"_r{i}")
        one, two = div(-1.0 - here, rate), div(float(size) - here, rate)
        first = F.greatest(first, F.when(rate == 0, F.lit(0.0)).otherwise(F.least(one, two)))
        last = F.least(last, F.when(rate == 0, F.when((here < -1) | (here > size), F.lit(-1.0)).otherwise(F.col("_n"))).otherwise(F.greatest(one, two)))
    flat = flat.withColumn("_s0", F.floor(first)).withColumn("_s1", F.least(F.ceil(last), F.col("_n").cast("bigint"))).filter("_s0 <= _s1")
    steps = flat.withColumn("_s", F.explode(F.sequence("_s0", "_s1")))
    f = F.col("_s") / F.col("_n")
    at = [F.col(f"_a{i}") + d[i] * f for i in range(3)]
    dots = steps.select("_order", "_s", *attrs, F.round(at[0]).cast("bigint").alias("px"), F.round(at[1]).cast("bigint").alias("py"), at[2].alias("_z"))
    dots = dots.filter((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < width) & (F.col("py") < height))
    shown = dots.join(depths.select("px", "py", F.col("depth").alias("_depth")), ["px", "py"], "left").filter(F.col("_depth").isNull() | (F.col("_z") - cam.depth_range * 1e-4 <= F.col("_depth")))
    return shown.groupBy("px", "py").agg(F.max(F.struct("_order", "_s", *attrs)).alias("_m")).select("px", "py", *(F.col("_m")[a].alias(a) for a in attrs))


def overlay_markers(markers: DataFrame, cam: Camera, width: int, height: int, order: str, attrs: Sequence[str], arm: int = 3) -> DataFrame:
    """Pixels of upright crosses at points x, y, z (never hidden): px, py, attrs of the marker that comes last."""
    fx, fy, depth = cam.project(vec(""), width, height)
    at = markers.select(F.col(order).alias("_order"), *attrs, F.round(fx).cast("bigint").alias("cx"), F.round(fy).cast("bigint").alias("cy"), depth.alias("_z"))
    if cam.perspective:
        at = at.filter(F.col("_z") > 0)
    cross_ = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for k in range(-arm, arm + 1) for a, b in ((k, 0), (0, k))))
    dots = at.withColumn("_d", F.explode(cross_)).select("_order", *attrs, (F.col("cx") + F.col("_d.dx")).alias("px"), (F.col("cy") + F.col("_d.dy")).alias("py"))
    dots = dots.filter((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < width) & (F.col("py") < height))
    return dots.groupBy("px", "py").agg(F.max(F.struct("_order", *attrs)).alias("_m")).select("px", "py", *(F.col("_m")[a].alias(a) for a in attrs))


def shade(cosine: Column, ambient: float) -> Column:
    return cosine * (1.0 - ambient) + ambient


def image(pixels: DataFrame, width: int, height: int, channels: Sequence[str], background: Sequence[int], alpha: str | None = None) -> DataFrame:
    """One row of RGBA bytes per image line: py, line (BINARY, width * 4 bytes); ``alpha`` names the opacity of pixels (else the background's)."""
    grid = pixels.sparkSession.range(width * height).select((F.col("id") % width).alias("px"), F.floor(F.col("id") / width).alias("py"))
    full = grid.join(pixels, ["px", "py"], "left")
    comps = [F.coalesce(F.col(c).cast("int"), F.lit(int(b))) for c, b in zip(channels, background)] + [F.coalesce(F.col(alpha).cast("int") if alpha else F.lit(None), F.lit(int(background[3])))]
    hexed = F.concat(*(F.lpad(F.hex(F.greatest(F.least(c, F.lit(255)), F.lit(0))), 2, "0") for c in comps))
    lines = full.withColumn("_h", hexed).groupBy("py").agg(F.array_sort(F.collect_list(F.struct("px", "_h"))).alias("_l"))
    return lines.select("py", F.unhex(F.array_join(F.transform("_l", lambda s: s["_h"]), "")).alias("line"))
