"""Voxel lattices: correlation curves, background, PCA crop, resampling; voxelised bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng, solids as S
from ..operators import correlation as C
from ..operators import inside, meshes, volumes as V
from ..operators.gridjoin import contain_join
from ..session import cut, q6 as r6
from . import derive as D
from .derive import NX, NY, NZ, q6
from .registry import query, table

AXES = "xyz"
R_MAX = 4
SEED = 11


def _dims(spark, sf, vol="vol"):
    return _sized(D.voxels(spark, sf), vol)


def _sized(occ, vol="vol"):
    return occ.select(vol).distinct().select(vol, F.lit(NX).alias("nx"), F.lit(NY).alias("ny"), F.lit(NZ).alias("nz"))


_OFFSETS = f"""o AS (SELECT r, dx, dy, dz FROM (SELECT unnest(range(1, {R_MAX + 1})) AS r), (SELECT unnest(range(-{R_MAX}, {R_MAX + 1})) AS dx),
 (SELECT unnest(range(-{R_MAX}, {R_MAX + 1})) AS dy), (SELECT unnest(range(-{R_MAX}, {R_MAX + 1})) AS dz)
 WHERE dx * dx + dy * dy + dz * dz >= (r - 0.5) * (r - 0.5) AND dx * dx + dy * dy + dz * dz < (r + 0.5) * (r + 0.5))"""


def _s2_sql(occ: str, vol: str) -> str:
    return f"""h AS (SELECT {vol}, r, dx, dy, dz, count(*) AS hits FROM (SELECT a.{vol}, o.r, o.dx, o.dy, o.dz FROM {occ} a CROSS JOIN o
 JOIN {occ} b ON b.{vol} = a.{vol} AND b.x = a.x + o.dx AND b.y = a.y + o.dy AND b.z = a.z + o.dz) GROUP BY ALL),
 g AS (SELECT {vol}, r, dx, dy, dz FROM (SELECT DISTINCT {vol} FROM {occ}), o),
 s AS (SELECT {vol}, CAST(r AS INT) AS r, count(*) AS n_offsets, avg(coalesce(hits, 0) / (({NX} - abs(dx)) * ({NY} - abs(dy)) * ({NZ} - abs(dz)))) AS s2
  FROM g LEFT JOIN h USING ({vol}, r, dx, dy, dz) GROUP BY ALL
  UNION ALL SELECT {vol}, 0, 1, count(*) / {NX * NY * NZ} FROM {occ} GROUP BY {vol})"""


@query("s2_exact", f"WITH {D.VOXELS_SQL}, {_OFFSETS}, {_s2_sql('voxels', 'vol')} SELECT vol, r, n_offsets, {q6('s2')} AS s2 FROM s")
def s2_exact(spark, sf):
    """Exact two-point correlation of every supplier's lattice."""
    occ = cut(D.voxels(spark, sf).select("vol", *AXES))
    s = C.s2_exact(occ, _sized(occ), "vol", R_MAX)
    return s.select("vol", "r", "n_offsets", r6(F.col("s2")).alias("s2"))


_FLAG_VOX = """fv AS (SELECT DISTINCT l_suppkey || l_returnflag AS vol, CAST(l_quantity AS BIGINT) - 1 AS x, CAST(round(l_discount * 100) AS BIGINT) AS y,
 CAST(round(l_tax * 100) AS BIGINT) AS z FROM lineitem)"""


@query("s2_curve_l2", f"""WITH {_FLAG_VOX}, {_OFFSETS}, {_s2_sql('fv', 'vol')}, k AS (SELECT CAST(left(vol, length(vol) - 1) AS BIGINT) AS supplier, right(vol, 1) AS flag, r, s2 FROM s)
 SELECT a.supplier, {q6('sqrt(sum((a.s2 - b.s2) ** 2))')} AS l2 FROM k a JOIN k b ON a.supplier = b.supplier AND a.r = b.r AND a.flag = 'R' AND b.flag = 'A' GROUP BY a.supplier""")
def s2_curve_l2(spark, sf):
    """Distance of the curves of returned and accepted items, per supplier."""
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("R", "A"))
    occ = cut(li.select(F.struct(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f")).alias("vol"), (F.col("l_quantity").cast("bigint") - 1).alias("x"),
                    F.round(F.col("l_discount") * 100).cast("bigint").alias("y"), F.round(F.col("l_tax") * 100).cast("bigint").alias("z")).distinct())
    curves = cut(C.s2_exact(occ, _sized(occ), "vol", R_MAX))
    side = [curves.filter(F.col("vol.f") == f).select(F.col("vol.s").alias("supplier"), "r", "s2") for f in ("R", "A")]
    return C.l2(*side, ["supplier"]).select("supplier", r6(F.col("l2")).alias("l2"))


def _mc_pick() -> str:
    shells = C.shell_offsets(R_MAX)
    rows = [(r, i, *o) for r, offs in shells.items() for i, o in enumerate(offs)]
    sizes = "CASE r " + " ".join(f"WHEN {r} THEN {len(o)}" for r, o in shells.items()) + " END"
    u = {k: rng.u01_sql(SEED, k, "vol", "r", "i") for k in ("x", "y", "z", "offset")}
    idx = lambda k, n: f"greatest(least(CAST(floor({u[k]} * {n}) AS BIGINT), {n} - 1), 0)"
    return f"""sh(r, j, dx, dy, dz) AS (VALUES {', '.join(map(str, rows))}),
 dr AS (SELECT vol, r, i FROM (SELECT DISTINCT vol FROM voxels), (SELECT unnest(range(1, {R_MAX + 1})) AS r), (SELECT unnest(range(400)) AS i)),
 p AS (SELECT vol, r, {idx('x', NX)} AS x, {idx('y', NY)} AS y, {idx('z', NZ)} AS z, {idx('offset', sizes)} AS j FROM dr),
 q AS (SELECT vol, p.r, x, y, z, x + dx AS x2, y + dy AS y2, z + dz AS z2 FROM p JOIN sh ON sh.r = p.r AND sh.j = p.j),
 w AS (SELECT * FROM q WHERE x2 >= 0 AND y2 >= 0 AND z2 >= 0 AND x2 < {NX} AND y2 < {NY} AND z2 < {NZ})
 SELECT w.vol, CAST(w.r AS INT) AS r, CAST(sum(CAST(a.v IS NOT NULL AND b.v IS NOT NULL AS INT)) AS BIGINT) AS hits, count(*) AS valid
 FROM w LEFT JOIN voxels a ON a.vol = w.vol AND a.x = w.x AND a.y = w.y AND a.z = w.z
 LEFT JOIN voxels b ON b.vol = w.vol AND b.x = w.x2 AND b.y = w.y2 AND b.z = w.z2 GROUP BY w.vol, w.r"""


@query("s2_voxel_mc", f"WITH {D.VOXELS_SQL}, {_mc_pick()}")
def s2_voxel_mc(spark, sf):
    """Monte Carlo estimate of the same curves from counter-based draws."""
    occ = D.voxels(spark, sf).select("vol", *AXES)
    return C.s2_voxel_mc(occ, _dims(spark, sf), "vol", R_MAX, 400, SEED).select("vol", "r", "hits", "valid")


_SHELL = lambda t: " OR ".join(f"{k} < {t} OR {k} + {t} >= n{k}" for k in AXES)
_BG = f"""bgc AS (SELECT vol, v, count(*) AS n FROM dense WHERE {_SHELL(1)} GROUP BY ALL),
 bg AS (SELECT vol, v AS background FROM bgc QUALIFY row_number() OVER (PARTITION BY vol ORDER BY n DESC, v) = 1)"""


@query("background_mode", f"WITH {D.DENSE_SQL}, {_BG} SELECT vol, background FROM bg")
def background_mode(spark, sf):
    return V.background(D.dense_voxels(spark, sf))


def _with_background(spark, sf):
    d = D.dense_voxels(spark, sf)
    return d.join(V.background(d), "vol")


@query("edge_trim_auto", f"""WITH {D.DENSE_SQL}, {_BG}, r AS (SELECT vol, avg(CASE WHEN {_SHELL(1)} THEN CAST(v <> background AS INT) END) AS r1,
 avg(CASE WHEN {_SHELL(2)} THEN CAST(v <> background AS INT) END) AS r2 FROM dense JOIN bg USING (vol) GROUP BY vol)
 SELECT vol, {q6('r1')} AS r1, {q6('r2')} AS r2, CASE WHEN r1 > 0.08 AND r2 > 0.04 THEN 2 WHEN r1 > 0.03 THEN 1 ELSE 0 END AS trim FROM r""")
def edge_trim_auto(spark, sf):
    t = V.auto_trim(_with_background(spark, sf))
    return t.select("vol", r6(F.col("r1")).alias("r1"), r6(F.col("r2")).alias("r2"), "trim")


@query("trim_border", f"""WITH {D.DENSE_SQL} SELECT vol, max(x) AS mx, max(y) AS my, max(z) AS mz, CAST(sum(v) AS BIGINT) AS total FROM (
 SELECT vol, x - 2 AS x, y - 2 AS y, z, v FROM dense WHERE x >= 2 AND x < nx - 2 AND y >= 2 AND y < ny - 2) GROUP BY vol""")
def trim_border(spark, sf):
    d = V.trim_border(D.dense_voxels(spark, sf).withColumn("trim", F.lit(2)))
    return d.groupBy("vol").agg(*(F.max(k).alias("m" + k) for k in AXES), F.sum("v").alias("total"))


_COV = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]


@query("pca_moments", f"""WITH {D.DENSE_SQL}, {_BG} SELECT vol, count(*) AS n, {', '.join(f'{q6(f"avg({k})")} AS m{k}' for k in AXES)},
 {', '.join(f'{q6(f"covar_pop({a}, {b})")} AS c{a}{b}' for a, b in _COV)} FROM dense JOIN bg USING (vol) WHERE v <> background GROUP BY vol""")
def pca_moments(spark, sf):
    m = V.moments(_with_background(spark, sf))
    return m.select("vol", "n", *(r6(F.col("m" + k)).alias("m" + k) for k in AXES), *(r6(F.col(f"c{a}{b}")).alias(f"c{a}{b}") for a, b in _COV))


# A fixed rotation (rows of the frame matrix) so that SQL can follow the resampling.
_ROT = (0.8, -0.6, 0.0, 0.6, 0.8, 0.0, 0.0, 0.0, 1.0)


def _fixed_frames(spark, sf):
    mom = V.moments(_with_background(spark, sf))
    return mom.select("vol", "mx", "my", "mz", F.array(*(F.lit(c) for c in _ROT)).alias("frame"))


_DOUBLE = lambda c: f"CAST({c} AS DOUBLE)"
_MOM = f"{_BG}, mom AS (SELECT vol, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM dense JOIN bg USING (vol) WHERE v <> background GROUP BY vol)"
_R = [_DOUBLE(c) for c in _ROT]
_FRAMED = [f"({_R[i]} * (x - mx) + {_R[3 + i]} * (y - my) + {_R[6 + i]} * (z - mz))" for i in range(3)]
_SNAP = lambda e: f"CASE WHEN abs({e} - round({e})) <= 1e-3 THEN round({e}) ELSE {e} END"
_BOUNDS = f"""{_MOM}, pr AS (SELECT vol, {', '.join(f'min({e}) AS l{k}, max({e}) AS h{k}' for e, k in zip(_FRAMED, AXES))} FROM dense JOIN bg USING (vol) JOIN mom USING (vol)
 WHERE v <> background GROUP BY vol), bd AS (SELECT vol, {', '.join(f'CAST(floor({_SNAP("l" + k)}) AS BIGINT) AS {k}0, CAST(ceil({_SNAP("h" + k)}) AS BIGINT) AS {k}1' for k in AXES)} FROM pr)"""


@query("rotated_bounds", f"WITH {D.DENSE_SQL}, {_BOUNDS} SELECT * FROM bd")
def rotated_bounds(spark, sf):
    return V.rotated_bounds(_with_background(spark, sf), _fixed_frames(spark, sf))


def _resampled(spark, sf, interpolation):
    """Counts of values in the crop boxes sampled through the fixed frame."""
    d = cut(D.dense_voxels(spark, sf))
    d = d.join(cut(V.background(d)), "vol")
    frames = cut(V.moments(d).select("vol", "mx", "my", "mz", F.array(*(F.lit(c) for c in _ROT)).alias("frame")))
    return V.resample(d, cut(V.rotated_bounds(d, frames)), frames, interpolation).groupBy("vol", "v").agg(F.count("*").alias("n"))


_SRC = [f"({_R[3 * i]} * tx + {_R[3 * i + 1]} * ty + {_R[3 * i + 2]} * tz + m{k})" for i, k in enumerate(AXES)]
_GRID = f"""{_BOUNDS}, tg AS (SELECT vol, x0, y0, z0, mx, my, mz, tx, ty, unnest(range(z0, z1 + 1)) AS tz FROM (SELECT *, unnest(range(y0, y1 + 1)) AS ty FROM (
 SELECT *, unnest(range(x0, x1 + 1)) AS tx FROM bd JOIN mom USING (vol)))),
 sr AS (SELECT vol, tx - x0 AS x, ty - y0 AS y, tz - z0 AS z, {', '.join(f'{e} AS s{k}' for e, k in zip(_SRC, AXES))} FROM tg)"""


@query("resample_nearest", f"""WITH {D.DENSE_SQL}, {_GRID}, g AS (SELECT vol, x, y, z, {', '.join(f'CAST(round(s{k}) AS BIGINT) AS g{k}' for k in AXES)} FROM sr)
 SELECT vol, coalesce(d.v, background) AS v, count(*) AS n FROM g JOIN bg USING (vol) LEFT JOIN dense d ON d.vol = g.vol AND d.x = gx AND d.y = gy AND d.z = gz GROUP BY ALL""".replace("SELECT vol, coalesce", "SELECT g.vol, coalesce"))
def resample_nearest(spark, sf):
    return _resampled(spark, sf, "nearest")


@query("resample_trilinear", f"""WITH {D.DENSE_SQL}, {_GRID}, f AS (SELECT vol, x, y, z, {', '.join(f'CAST(floor(s{k}) AS BIGINT) AS f{k}, s{k} - floor(s{k}) AS w{k}' for k in AXES)} FROM sr),
 tp AS (SELECT vol, x, y, z, fx + a.b AS gx, fy + c.b AS gy, fz + e.b AS gz, (CASE a.b WHEN 1 THEN wx ELSE 1 - wx END) * (CASE c.b WHEN 1 THEN wy ELSE 1 - wy END) * (CASE e.b WHEN 1 THEN wz ELSE 1 - wz END) AS w
  FROM f, (VALUES (0), (1)) a(b), (VALUES (0), (1)) c(b), (VALUES (0), (1)) e(b)),
 vv AS (SELECT tp.vol, tp.x, tp.y, tp.z, CAST(round(round(sum(w * coalesce(d.v, background)), 9)) AS BIGINT) AS v FROM tp JOIN bg ON bg.vol = tp.vol
  LEFT JOIN dense d ON d.vol = tp.vol AND d.x = gx AND d.y = gy AND d.z = gz GROUP BY tp.vol, tp.x, tp.y, tp.z)
 SELECT vol, v, count(*) AS n FROM vv GROUP BY ALL""")
def resample_trilinear(spark, sf):
    return _resampled(spark, sf, "trilinear")


@query("crop_pca")
def crop_pca(spark, sf):
    """Whole crop: background, principal frame, rotated bounds, trilinear resample, automatic trim."""
    from .jobs import crop

    return crop(D.dense_voxels(spark, sf)).groupBy("vol").agg(*((F.max(k) + 1).alias("n" + k) for k in AXES), F.sum("v").alias("total"))


@query("volume_index", f"WITH {D.VOXELS_SQL} SELECT vol, CAST(sum(v * (z * {NX * NY} + y * {NX} + x)) AS BIGINT) AS zmajor, CAST(sum(v * (x * {NY * NZ} + y * {NZ} + z)) AS BIGINT) AS xmajor FROM voxels GROUP BY vol")
def volume_index(spark, sf):
    d = D.voxels(spark, sf).withColumns({"nx": F.lit(NX), "ny": F.lit(NY), "nz": F.lit(NZ)})
    return d.groupBy("vol").agg(F.sum(F.col("v") * V.flat_index()).alias("zmajor"), F.sum(F.col("v") * V.occupancy_index()).alias("xmajor"))


# ---------------------------------------------------------------- voxelised bodies
def _hits_sql(points: str, keys: str) -> str:
    """Brute-force ray parity of (keys, part, x, y, z) rows against every triangle of the part."""
    dx, dy, dz = (_DOUBLE(repr(c)) for c in S.RAY)
    return f"""e AS (SELECT part, ax, ay, az, bx - ax AS e1x, by - ay AS e1y, bz - az AS e1z, cx - ax AS e2x, cy - ay AS e2y, cz - az AS e2z FROM tri),
 pe AS (SELECT *, {dy} * e2z - {dz} * e2y AS px, {dz} * e2x - {dx} * e2z AS py, {dx} * e2y - {dy} * e2x AS pz FROM e),
 de AS (SELECT *, e1x * px + e1y * py + e1z * pz AS det FROM pe),
 s AS (SELECT {keys}, p.part, e1x, e1y, e1z, e2x, e2y, e2z, px, py, pz, det, p.x - ax AS sx, p.y - ay AS sy, p.z - az AS sz FROM {points} p JOIN de USING (part) WHERE abs(det) > 1e-10),
 qq AS (SELECT *, sy * e1z - sz * e1y AS qx, sz * e1x - sx * e1z AS qy, sx * e1y - sy * e1x AS qz FROM s),
 ht AS (SELECT {keys}, part, (e2x * qx + e2y * qy + e2z * qz) / det AS t FROM qq WHERE (sx * px + sy * py + sz * pz) / det >= -1e-10
  AND ({dx} * qx + {dy} * qy + {dz} * qz) / det >= -1e-10 AND (sx * px + sy * py + sz * pz) / det + ({dx} * qx + {dy} * qy + {dz} * qz) / det <= 1 + 1e-10),
 hd AS (SELECT {keys}, part, CASE WHEN t - lag(t) OVER (PARTITION BY {keys}, part ORDER BY t) <= 1e-8 THEN 0 ELSE 1 END AS k FROM ht WHERE t > 1e-10),
 ins AS (SELECT {keys}, part FROM hd GROUP BY ALL HAVING sum(k) % 2 = 1)"""


_PROBES = """pr AS (SELECT row(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS pid, l_extendedprice / 1000 AS x, (l_partkey % 100) + l_quantity / 64 AS y,
 l_orderkey / 100 + l_linenumber / 512 AS z FROM lineitem)"""
_BODYBOX = "bx AS (SELECT part, " + ", ".join(f"c{k} - h{k} AS {k}0, c{k} + h{k} AS {k}1" for k in AXES) + " FROM bodies)"


@query("points_in_solids", f"""WITH {D.TRI_SQL}, {_BODYBOX}, {_PROBES}, cd AS (SELECT DISTINCT pid, part, x, y, z FROM pr JOIN bx ON {' AND '.join(f'pr.{k} >= bx.{k}0 AND pr.{k} <= bx.{k}1' for k in AXES)}),
 {_hits_sql('cd', 'pid')} SELECT part, count(*) AS points FROM ins GROUP BY part""")
def points_in_solids(spark, sf):
    """How many line-item points lie inside each body."""
    pts = D.probe_points(spark, sf).distinct()
    return inside.points_inside(cut(pts), cut(D.triangles(D.bodies(spark, sf))), "pid", "part").groupBy("part").agg(F.count("*").alias("points"))


_RANGE = lambda k: f"unnest(range(CAST(greatest(floor({k}0), 0) AS BIGINT), CAST(ceil({k}1) AS BIGINT)))"
_VOX = f"""{_BODYBOX}, v1 AS (SELECT *, {_RANGE('x')} AS ix FROM bx), v2 AS (SELECT *, {_RANGE('y')} AS iy FROM v1), v3 AS (SELECT part, ix, iy, {_RANGE('z')} AS iz FROM v2),
 vp AS (SELECT part, ix, iy, iz, ix + 0.5::DOUBLE AS x, iy + 0.5::DOUBLE AS y, iz + 0.5::DOUBLE AS z FROM v3), {_hits_sql('vp', 'ix, iy, iz')}"""


def _coverage(spark, sf, *more):
    """Voxels inside each body, with the columns ``more`` of the bodies."""
    b = D.bodies(spark, sf)
    return inside.coverage(D.triangles(b), "part", (0, 0, 0), 1.0, more=b.select("part", *more) if more else None)


@query("voxel_occupancy", f"WITH {D.TRI_SQL}, {_VOX}, oc AS (SELECT ix, iy, iz, count(*) AS cover FROM ins GROUP BY ALL) SELECT iz, cover, count(*) AS voxels FROM oc GROUP BY ALL")
def voxel_occupancy(spark, sf):
    """Voxelised bodies: covered voxels per layer by how many bodies cover them."""
    occ = _coverage(spark, sf).groupBy("ix", "iy", "iz").agg(F.count("*").alias("cover"))
    return occ.groupBy("iz", "cover").agg(F.count("*").alias("voxels"))


@query("voxel_labels", f"""WITH {D.TRI_SQL}, {_VOX}, st AS (SELECT ins.*, status FROM ins JOIN bodies USING (part)),
 lb AS (SELECT ix, iy, iz, CASE WHEN max(CAST(status = 'P' AS INT)) = 1 THEN -1 ELSE min(part) + 1 END AS label FROM st GROUP BY ALL) SELECT label, count(*) AS voxels FROM lb GROUP BY label""")
def voxel_labels(spark, sf):
    """Voxel owners: bodies of pending orders are void and win, then the lowest body."""
    cover = cut(_coverage(spark, sf, "status"))
    lab = inside.labels(cover.filter("status <> 'P'"), "part", cover.filter("status = 'P'"))
    return lab.groupBy("label").agg(F.count("*").alias("voxels"))


@query("void_overlap", f"""WITH {D.TRI_SQL}, {_VOX}, st AS (SELECT ins.*, status FROM ins JOIN bodies USING (part)), vd AS (SELECT DISTINCT ix, iy, iz FROM st WHERE status = 'P')
 SELECT part, CAST(count(*) AS DOUBLE) AS overlap_volume FROM st JOIN vd USING (ix, iy, iz) WHERE status <> 'P' GROUP BY part""")
def void_overlap(spark, sf):
    """Volume of each solid body lost to the void, counted in voxels."""
    cover = cut(_coverage(spark, sf, "status"))
    return inside.overlap_volume(cover.filter("status <> 'P'"), cover.filter("status = 'P'"), ["part"], 1.0)


@query("s2_mesh_mc")
def s2_mesh_mc(spark, sf):
    """Monte Carlo S2 of the bodies themselves, per 10-unit layer of the domain: continuous point pairs."""
    from .jobs import mesh_mc_layers

    return mesh_mc_layers(cut(D.triangles(D.bodies(spark, sf))), "part", 10.0, 4, 400, SEED)


@query("coverage_by_body", f"WITH {D.TRI_SQL}, {_VOX} SELECT part, count(*) AS voxels FROM ins GROUP BY part")
def coverage_by_body(spark, sf):
    return _coverage(spark, sf).groupBy("part").agg(F.count("*").alias("voxels"))


@query("box_point_join", f"""WITH {D.BODIES_SQL}, {_BODYBOX}, {_PROBES} SELECT part, count(*) AS points FROM pr JOIN bx ON {' AND '.join(f'pr.{k} >= bx.{k}0 AND pr.{k} <= bx.{k}1' for k in AXES)} GROUP BY part""")
def box_point_join(spark, sf):
    """Line-item points per bounding box."""
    return contain_join(D.probe_points(spark, sf).select(*AXES), meshes.bbox(D.triangles(D.bodies(spark, sf)), ["part"]), like=True).groupBy(F.col("b_part").alias("part")).agg(F.count("*").alias("points"))
