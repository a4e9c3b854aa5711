"""Mesh measures, closedness, shells, transforms and clipping on bodies derived from orders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import quat as Q
from ..functions import rng, solids as S
from ..functions.vec import V, add, lit3, scale, vec
from ..operators import clipping, collision, meshes
from ..operators.components import connected_components
from ..operators.gridjoin import box_self_join, cell_size, grid_stats
from ..session import cut, q6 as r6
from . import derive as D
from .derive import q6
from .registry import query

AXES = "xyz"


@query("mesh_bbox", f"""WITH {D.TRI_SQL} SELECT mesh_id, {', '.join(f'min(least(a{k}, b{k}, c{k})) AS {k}0, max(greatest(a{k}, b{k}, c{k})) AS {k}1' for k in AXES)}
 FROM tri GROUP BY mesh_id""")
def mesh_bbox(spark, sf):
    return meshes.bbox(D.triangles(D.bodies(spark, sf)))


@query("vertex_centroid", f"""WITH {D.TRI_SQL}, v AS (SELECT DISTINCT mesh_id, vid, x, y, z FROM (
 {' UNION ALL '.join(f'SELECT mesh_id, i{p} AS vid, {p}x AS x, {p}y AS y, {p}z AS z FROM tri' for p in 'abc')}))
 SELECT mesh_id, {', '.join(f"{q6(f'avg({k})')} AS c{k}" for k in AXES)} FROM v GROUP BY mesh_id""")
def vertex_centroid(spark, sf):
    c = meshes.vertex_centroid(D.triangles(D.bodies(spark, sf)))
    return c.select("mesh_id", *(r6(F.col("c" + k)).alias("c" + k) for k in AXES))


_FLUX = "(ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)) / 6"
_AREA = ("sqrt(((by - ay) * (cz - az) - (bz - az) * (cy - ay)) ** 2 + ((bz - az) * (cx - ax) - (bx - ax) * (cz - az)) ** 2"
         " + ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) ** 2) / 2")


@query("mesh_measures", f"""WITH {D.TRI_SQL} SELECT mesh_id, count(*) AS faces, {q6(f'sum({_FLUX})')} AS signed_volume, {q6(f'abs(sum({_FLUX}))')} AS volume,
 {q6(f'sum({_AREA})')} AS area FROM tri GROUP BY mesh_id""")
def mesh_measures(spark, sf):
    m = meshes.measures(D.triangles(D.bodies(spark, sf)))
    return m.select("mesh_id", "faces", *(r6(F.col(c)).alias(c) for c in ("signed_volume", "volume", "area")))


@query("volume_centroid", f"""WITH {D.BODIES_SQL} SELECT part, {', '.join(f'{q6("c" + k)} AS g{k}' for k in AXES)} FROM bodies""")
def volume_centroid(spark, sf):
    m = meshes.measures(D.triangles(D.bodies(spark, sf)), ["part"])
    return m.select("part", *(r6(F.col("g" + k)).alias("g" + k) for k in AXES))


def _damaged(spark, sf):
    """Bodies with defects: a missing, flipped, repeated or degenerate first face, or no height."""
    b = D.bodies(spark, sf).withColumn("hz", F.when(F.col("part") % 50 == 17, F.lit(0.0)).otherwise(F.col("hz")))
    t = D.triangles(b)
    first, kind = F.col("fid") % 16 == 0, F.col("part") % 50
    t = t.filter(~(first & (kind == 3)))
    flip = first & (kind == 7)
    out = t.select("mesh_id", "part", "fid", "ia",
                   F.when(flip, F.col("ic")).when(first & (kind == 13), F.col("ia")).otherwise(F.col("ib")).alias("ib"),
                   F.when(flip, F.col("ib")).otherwise(F.col("ic")).alias("ic"),
                   *(F.col("a" + k) for k in AXES),
                   *(F.when(flip, F.col("c" + k)).otherwise(F.col("b" + k)).alias("b" + k) for k in AXES),
                   *(F.when(flip, F.col("b" + k)).otherwise(F.col("c" + k)).alias("c" + k) for k in AXES))
    return out.unionByName(out.filter((F.col("fid") % 16 == 0) & (F.col("part") % 50 == 11)).withColumn("fid", F.col("fid") + 15))


_DAMAGE_SQL = f"""{D.TRI_SQL.replace("CAST(0.4375 AS DOUBLE) + (o_orderkey % 11) / 16 AS hz", "CASE WHEN o_orderkey % 50 = 17 THEN 0 ELSE CAST(0.4375 AS DOUBLE) + (o_orderkey % 11) / 16 END AS hz")},
 d AS (SELECT part, fid, ia, CASE WHEN fid % 16 = 0 AND part % 50 = 7 THEN ic WHEN fid % 16 = 0 AND part % 50 = 13 THEN ia ELSE ib END AS ib,
  CASE WHEN fid % 16 = 0 AND part % 50 = 7 THEN ib ELSE ic END AS ic FROM tri WHERE NOT (fid % 16 = 0 AND part % 50 = 3)
  UNION ALL SELECT part, fid + 15, ia, ib, ic FROM tri WHERE fid % 16 = 0 AND part % 50 = 11),
 e AS (SELECT part, least(s, t) AS lo, greatest(s, t) AS hi, count(*) AS n, sum(CASE WHEN s < t THEN 1 ELSE -1 END) AS dir FROM (
  SELECT part, ia AS s, ib AS t FROM d UNION ALL SELECT part, ib, ic FROM d UNION ALL SELECT part, ic, ia FROM d) GROUP BY ALL),
 es AS (SELECT part, sum(CAST(n = 1 AS INT)) AS o, sum(CAST(n > 2 AS INT)) AS m, sum(CAST(n = 2 AND dir <> 0 AS INT)) AS w FROM e GROUP BY part),
 fs AS (SELECT part, max(CAST(ia = ib OR ib = ic OR ic = ia AS INT)) AS deg, count(*) - count(DISTINCT list_sort([ia, ib, ic])) AS rep FROM d GROUP BY part)"""
_REASON = """CASE WHEN deg = 1 THEN 'degenerate face' WHEN rep > 0 THEN 'repeated face' WHEN o > 0 THEN 'open: ' || CAST(o AS BIGINT) || ' edge(s)'
 WHEN m > 0 THEN 'non-manifold: ' || CAST(m AS BIGINT) || ' edge(s)' WHEN w > 0 THEN 'winding: ' || CAST(w AS BIGINT) || ' edge(s)'{extra} END"""


@query("mesh_closedness", f"""WITH {_DAMAGE_SQL} SELECT part, CAST(o AS BIGINT) AS open_edges, CAST(m AS BIGINT) AS nonmanifold_edges,
 CAST(w AS BIGINT) AS inconsistent_edges, {_REASON.format(extra=" WHEN part % 50 = 17 THEN 'zero-volume shell'")} AS reason FROM es JOIN fs USING (part)""")
def mesh_closedness(spark, sf):
    return meshes.closedness(_damaged(spark, sf), ["part"], shells=True)


@query("mesh_metrics", f"""WITH {_DAMAGE_SQL}, r AS (SELECT part, {_REASON.format(extra=" WHEN part % 50 = 17 THEN 'zero-volume shell'")} AS reason FROM es JOIN fs USING (part)),
 m AS (SELECT part, abs(sum({_FLUX})) AS v, sum({_AREA}) AS a FROM tri GROUP BY part)
 SELECT part, CASE WHEN reason IS NULL THEN {q6('v')} END AS volume, CASE WHEN reason IS NULL THEN {q6('a')} END AS area,
 CASE WHEN reason IS NULL THEN {q6('pow(6 * v / pi(), 1.0 / 3)')} END AS equivalent_diameter,
 CASE WHEN reason IS NULL THEN {q6('pow(pi(), 1.0 / 3) * pow(6 * v, 2.0 / 3) / a')} END AS sphericity, reason FROM r JOIN m USING (part)""")
def mesh_metrics(spark, sf):
    m = meshes.metrics(_damaged(spark, sf), ["part"])
    return m.select("part", *(r6(F.col(c)).alias(c) for c in ("volume", "area", "equivalent_diameter", "sphericity")), "reason")


@query("orient_components", f"""WITH {D.TRI_SQL}, p AS (SELECT mesh_id, part, count(*) AS n, sum({_FLUX}) AS v FROM tri GROUP BY ALL)
 SELECT mesh_id, CAST(sum(CAST(v < 0 AS INT)) AS BIGINT) AS flipped, count(*) AS parts, {q6('sum(abs(v))')} AS signed_volume FROM p GROUP BY mesh_id""")
def orient_components(spark, sf):
    o = meshes.orient(D.triangles(D.bodies(spark, sf)), ["mesh_id", "part"])
    per = o.groupBy("mesh_id", "part").agg(F.max(F.col("flipped").cast("int")).alias("f"), F.sum(S.tri_flux(vec("a"), vec("b"), vec("c"))).alias("v"))
    return per.groupBy("mesh_id").agg(F.sum("f").alias("flipped"), F.count("*").alias("parts"), r6(F.sum("v")).alias("signed_volume"))


def unrolled_components(nodes: str, links: str, rounds: int) -> str:
    """SQL CTEs for minimum-label propagation: nodes(node), links(u, v) both ways; last table lab{rounds}."""
    ctes = [f"lab0 AS MATERIALIZED (SELECT node, node AS label FROM {nodes})"]
    for i in range(1, rounds + 1):
        ctes.append(f"lab{i} AS MATERIALIZED (SELECT l.node, least(l.label, coalesce(min(m.label), l.label)) AS label FROM lab{i - 1} l "
                    f"LEFT JOIN {links} k ON k.u = l.node LEFT JOIN lab{i - 1} m ON m.node = k.v GROUP BY l.node, l.label)")
    return ", ".join(ctes)


_CUBE_ROUNDS = 24


@query("split_granules", f"""WITH {D.CUBES_SQL}, nodes AS (SELECT mesh_id || '/' || cube AS node, * FROM cubes),
 links AS (SELECT a.mesh_id || '/' || a.cube AS u, b.mesh_id || '/' || b.cube AS v FROM cubes a JOIN cubes b ON a.mesh_id = b.mesh_id
  AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 AND a.cube <> b.cube),
 {unrolled_components("nodes", "links", _CUBE_ROUNDS)}
 SELECT mesh_id, min(cube) * 12 AS shell, count(*) * 12 AS faces, CAST(count(*) AS DOUBLE) AS volume,
 CAST(min(x) AS DOUBLE) AS x0, CAST(max(x) + 1 AS DOUBLE) AS x1 FROM nodes JOIN lab{_CUBE_ROUNDS} USING (node) GROUP BY mesh_id, label""")
def split_granules(spark, sf):
    tri = D.cube_triangles(D.cubes(spark, sf))
    j = meshes.with_shells(tri, ["mesh_id"])
    m = meshes.measures(j, ["mesh_id", "shell"]).select("mesh_id", "shell", "faces", r6(F.col("volume")).alias("volume"))
    b = meshes.bbox(j, ["mesh_id", "shell"]).select("mesh_id", "shell", "x0", "x1")
    return m.join(b, ["mesh_id", "shell"])


@query("shell_signed_volumes", f"""WITH {D.TRI_SQL} SELECT mesh_id, min(fid) AS shell, {q6(f'sum({_FLUX})')} AS signed_volume FROM tri GROUP BY mesh_id, part""")
def shell_signed_volumes(spark, sf):
    tri = D.triangles(D.bodies(spark, sf))
    j = meshes.with_shells(tri, ["mesh_id"]).groupBy("mesh_id", "shell").agg(F.sum(S.tri_flux(vec("a"), vec("b"), vec("c"))).alias("v"))
    return j.select("mesh_id", "shell", r6(F.col("v")).alias("signed_volume"))




@query("weld_vertices", f"""WITH {D.CUBES_SQL}, box(tf, s1, s2, s3, t1, t2, t3, u1, u2, u3) AS (VALUES {', '.join(str((i, *((c + 1) // 2 for p in f for c in p))) for i, (_, f) in enumerate(D.BOX))}),
 c AS (SELECT mesh_id, (cube * 12 + tf) * 3 + j AS pos, CAST(CASE j WHEN 0 THEN x + s1 WHEN 1 THEN x + t1 ELSE x + u1 END AS DOUBLE) AS x,
  CAST(CASE j WHEN 0 THEN y + s2 WHEN 1 THEN y + t2 ELSE y + u2 END AS DOUBLE) AS y, CAST(CASE j WHEN 0 THEN z + s3 WHEN 1 THEN z + t3 ELSE z + u3 END AS DOUBLE) AS z
  FROM cubes CROSS JOIN box CROSS JOIN (VALUES (0), (1), (2)) AS t(j))
 SELECT mesh_id, CAST(round(x * 1e6) AS BIGINT) AS qx, CAST(round(y * 1e6) AS BIGINT) AS qy, CAST(round(z * 1e6) AS BIGINT) AS qz, min(pos) AS vid, count(*) AS uses
 FROM c GROUP BY ALL""")
def weld_vertices(spark, sf):
    tri = D.cube_triangles(D.cubes(spark, sf))
    items = [F.struct((F.col("fid") * 3 + j).alias("pos"), *(F.col(p + k).alias(k) for k in AXES)) for j, p in enumerate("abc")]
    pts = tri.select("mesh_id", F.explode(F.array(*items)).alias("p")).select("mesh_id", "p.*")
    return meshes.weld(pts, ["mesh_id"], "pos").select("mesh_id", "qx", "qy", "qz", "vid", "uses")


@query("merge_offsets", f"""WITH {D.BODIES_SQL}, n AS (SELECT mesh_id, part, CASE kind WHEN 0 THEN 8 ELSE 6 END AS n_vertices, CASE kind WHEN 0 THEN 12 ELSE 8 END AS n_faces FROM bodies)
 SELECT mesh_id, part, CAST(coalesce(sum(n_vertices) OVER w, 0) AS BIGINT) AS vertex_offset, CAST(coalesce(sum(n_faces) OVER w, 0) AS BIGINT) AS face_offset FROM n
 WINDOW w AS (PARTITION BY mesh_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def merge_offsets(spark, sf):
    b = D.bodies(spark, sf).select("mesh_id", "part", F.when(F.col("kind") == 0, 8).otherwise(6).alias("n_vertices"),
                                   F.when(F.col("kind") == 0, 12).otherwise(8).alias("n_faces"))
    return meshes.merge_offsets(b, ["mesh_id"], "part").select("mesh_id", "part", "vertex_offset", "face_offset")


@query("scale_to_diameter", f"""WITH {D.TRI_SQL}, v AS (SELECT part, abs(sum({_FLUX})) AS v FROM tri GROUP BY part)
 SELECT part, {q6('2 / pow(6 * v / pi(), 1.0 / 3)')} AS factor, {q6('v * pow(2 / pow(6 * v / pi(), 1.0 / 3), 3)')} AS volume FROM v""")
def scale_to_diameter(spark, sf):
    tri = D.triangles(D.bodies(spark, sf))
    m = meshes.shape_columns(meshes.measures(tri, ["part"])).select("part", (2.0 / F.col("equivalent_diameter")).alias("factor"))
    scaled = meshes.scale_tri(tri.join(m, "part"), F.col("factor"))
    out = scaled.groupBy("part").agg(F.first("factor").alias("factor"), F.abs(F.sum(S.tri_flux(vec("a"), vec("b"), vec("c")))).alias("volume"))
    return out.select("part", r6(F.col("factor")).alias("factor"), r6(F.col("volume")).alias("volume"))


_S3 = 1 / math.sqrt(3.0)


def _rodrigues_sql(x, y, z, angle):
    k, ca, sa = repr(_S3), f"cos({angle})", f"sin({angle})"
    dot = f"(({x}) + ({y}) + ({z})) * {k}"
    return [f"({a}) * {ca} + ({k}) * (({c}) - ({b})) * {sa} + {k} * ({dot}) * (1 - {ca})" for a, b, c in ((x, y, z), (y, z, x), (z, x, y))]


@query("rotate_about_centroid", f"""WITH {D.TRI_SQL}, r AS (SELECT part, t.* FROM tri t), cor AS (
 {' UNION ALL '.join(f'SELECT part, {p}x AS x, {p}y AS y, {p}z AS z FROM tri' for p in 'abc')}),
 rel AS (SELECT part, cx, cy, cz, x - cx AS x, y - cy AS y, z - cz AS z, (part % 16) / 8 AS w FROM cor JOIN bodies USING (part)),
 rot AS (SELECT part, {', '.join(f'c{k} + {e} AS r{k}' for k, e in zip(AXES, _rodrigues_sql('x', 'y', 'z', 'w')))} FROM rel)
 SELECT part, {', '.join(f"{q6(f'min(r{k})')} AS {k}0, {q6(f'max(r{k})')} AS {k}1" for k in AXES)} FROM rot GROUP BY part""")
def rotate_about_centroid(spark, sf):
    b = D.bodies(spark, sf)
    tri = D.triangles(b).join(b.select("part", "cx", "cy", "cz").withColumnsRenamed({"cx": "ox", "cy": "oy", "cz": "oz"}), "part")
    turned = meshes.map_corners(tri, lambda v: Q.rotate_about(v, vec("o"), lit3(1, 1, 1), (F.col("part") % 16) / 8))
    box = meshes.bbox(turned, ["part"])
    return box.select("part", *(r6(F.col(k + e)).alias(k + e) for k in AXES for e in "01"))


_QUAT_SQL = f"""u AS (SELECT part, cx, cy, cz, {', '.join(f"{rng.u01_sql(7, f'rotation{i}', 'part')} AS u{i}" for i in range(3))} FROM bodies),
 q0 AS (SELECT part, cx, cy, cz, sqrt(1 - u0) * sin(2 * pi() * u1) AS x, sqrt(1 - u0) * cos(2 * pi() * u1) AS y,
  sqrt(u0) * sin(2 * pi() * u2) AS z, sqrt(u0) * cos(2 * pi() * u2) AS w FROM u),
 q AS (SELECT part, cx, cy, cz, CASE WHEN w < 0 THEN -w ELSE w END AS w, CASE WHEN w < 0 THEN -x ELSE x END AS x,
  CASE WHEN w < 0 THEN -y ELSE y END AS y, CASE WHEN w < 0 THEN -z ELSE z END AS z FROM q0)"""


@query("placement_transform", f"""WITH {D.BODIES_SQL}, {_QUAT_SQL}
 SELECT part, {q6('w')} AS qw, {q6('cx + 2 * ((1 - 2 * (y * y + z * z)) * 1 + 2 * (x * y - w * z) * 2 + 2 * (x * z + w * y) * 3)')} AS px,
 {q6('cy + 2 * (2 * (x * y + w * z) * 1 + (1 - 2 * (x * x + z * z)) * 2 + 2 * (y * z - w * x) * 3)')} AS py,
 {q6('cz + 2 * (2 * (x * z - w * y) * 1 + 2 * (y * z + w * x) * 2 + (1 - 2 * (x * x + y * y)) * 3)')} AS pz FROM q""")
def placement_transform(spark, sf):
    b = D.bodies(spark, sf).withColumn("q", rng.quaternion(*(rng.u01(7, f"rotation{i}", F.col("part")) for i in range(3))))
    p = Q.place(F.col("q"), F.lit(2.0), vec("c"), lit3(1, 2, 3))
    return b.select("part", r6(F.col("q.w")).alias("qw"), *(r6(c).alias("p" + k) for c, k in zip(p, AXES)))


@query("compose_rotations", f"""WITH {D.BODIES_SQL}, {_QUAT_SQL} SELECT part, {q6('abs(w * w - x * x - y * y - z * z)')} AS qw FROM q""")
def compose_rotations(spark, sf):
    b = D.bodies(spark, sf).withColumn("q", rng.quaternion(*(rng.u01(7, f"rotation{i}", F.col("part")) for i in range(3))))
    return b.select("part", r6(Q.compose(F.col("q"), F.col("q"))["w"]).alias("qw"))


@query("wrap_centroids", f"""WITH {D.BODIES_SQL} SELECT part, {', '.join(f"{q6(f'c{k} - 10 - floor((c{k} - 10) / 30) * 30 + 10')} AS w{k}" for k in AXES)} FROM bodies""")
def wrap_centroids(spark, sf):
    return D.bodies(spark, sf).select("part", *(r6(F.pmod(F.col("c" + k) - 10.0, F.lit(30.0)) + 10.0).alias("w" + k) for k in AXES))


def forge_map(v: V, centre: V, compression: float, bulge: float) -> V:
    """Press along z by the compression ratio while the lateral axes bulge to keep (part of) the volume."""
    axial = min(max(1.0 - compression, 0.01), 1.0)
    lateral = (1.0 / math.sqrt(axial)) ** min(max(bulge, 0.0), 1.0)
    f = (lateral, lateral, axial)
    return V(*(c + (p - c) * s for p, c, s in zip(v, centre, f)))



_LAT = (1 / math.sqrt(0.8)) ** 0.5
_FORGE = {"x": _LAT, "y": _LAT, "z": 0.8}


@query("forge_ffd", f"""WITH {D.TRI_SQL}, f AS (SELECT part, {', '.join(f'50 + ({p}{k} - 50) * {_FORGE[k]!r} AS {p}{k}' for p in 'abc' for k in AXES)} FROM tri)
 SELECT part, {q6(f'abs(sum({_FLUX}))')} AS volume, {q6('min(least(az, bz, cz))')} AS z0, {q6('max(greatest(az, bz, cz))')} AS z1 FROM f GROUP BY part""")
def forge_ffd(spark, sf):
    tri = meshes.map_corners(D.triangles(D.bodies(spark, sf)), lambda v: forge_map(v, lit3(50, 50, 50), 0.2, 0.5))
    m = meshes.measures(tri, ["part"]).join(meshes.bbox(tri, ["part"]), "part")
    return m.select("part", *(r6(F.col(c)).alias(c) for c in ("volume", "z0", "z1")))


@query("boundary_rules", f"""WITH {D.BOXES_SQL}, t AS (SELECT part, {', '.join(f'{k}0 >= 20 AND {k}1 <= 80 AS in{k}, {k}0 - 20 >= 0.5 AND {k}1 - 20 <= 59.5 AS ok{k}, (({k}0 >= 20) OR (20 - {k}0 >= 0.25 AND {k}1 - 20 >= 0.25)) AND (({k}1 <= 80) OR (80 - {k}0 >= 0.25 AND {k}1 - 80 >= 0.25)) AS deep{k}' for k in AXES)},
  {', '.join(f"CASE WHEN {k}0 < 20 THEN '{k}min,' ELSE '' END || CASE WHEN {k}1 > 80 THEN '{k}max,' ELSE '' END AS s{k}" for k in AXES)},
  least({', '.join(f"CASE WHEN {k}0 < 20 THEN {k}1 - 20 ELSE 1e300 END, CASE WHEN {k}1 > 80 THEN 80 - {k}0 ELSE 1e300 END" for k in AXES)}) AS depth FROM boxes)
 SELECT part, inx AND iny AND inz AND okx AND oky AND okz AS strict_ok, CASE WHEN inx AND iny AND inz THEN okx AND oky AND okz
  ELSE {' AND '.join(f'(CASE WHEN in{k} THEN ok{k} ELSE deep{k} END)' for k in AXES)} END AS periodic_ok, rtrim(sx || sy || sz, ',') AS crossed,
  CASE WHEN depth < 1e299 THEN {q6('depth')} END AS depth FROM t""")
def boundary_rules(spark, sf):
    b = D.body_boxes(D.bodies(spark, sf))
    box, dom = B.box(), B.lit_box((20, 20, 20), (80, 80, 80))
    depth = B.retained_depth(box, dom)
    return b.select("part", B.boundary_ok(box, dom, 1, 0.5, 0.25).alias("strict_ok"), B.boundary_ok(box, dom, 3, 0.5, 0.25).alias("periodic_ok"),
                    F.array_join(B.crossed_faces(box, dom), ",").alias("crossed"), F.when(depth < 1e299, r6(depth)).alias("depth"))


@query("periodic_images", f"""WITH {D.BOXES_SQL}, s AS (SELECT a.v AS sx, b.v AS sy, c.v AS sz FROM (SELECT unnest(range(-1, 2)) AS v) a, (SELECT unnest(range(-1, 2)) AS v) b, (SELECT unnest(range(-1, 2)) AS v) c
 WHERE NOT (a.v = 0 AND b.v = 0 AND c.v = 0)) SELECT part, CAST(sx AS INT) AS sx, CAST(sy AS INT) AS sy, CAST(sz AS INT) AS sz FROM boxes, s
 WHERE {' AND '.join(f'{k}0 + s{k} * 60 < 80 AND 20 < {k}1 + s{k} * 60' for k in AXES)}""")
def periodic_images(spark, sf):
    return collision.periodic_images(D.body_boxes(D.bodies(spark, sf)), (20, 20, 20), (80, 80, 80), ["part"]).select("part", "sx", "sy", "sz")


_MEET = " AND ".join(f"a.{k}0 <= b.{k}1 AND b.{k}0 <= a.{k}1" for k in AXES)
_STRICT = " AND ".join(f"a.{k}0 < b.{k}1 AND b.{k}0 < a.{k}1" for k in AXES)


@query("box_overlap_join", f"WITH {D.BOXES_SQL} SELECT a.part AS a, b.part AS b FROM boxes a JOIN boxes b ON a.part < b.part AND {_STRICT}")
def box_overlap_join(spark, sf):
    p = box_self_join(D.body_boxes(D.bodies(spark, sf)), "part").filter(B.overlaps(B.box("a_"), B.box("b_")))
    return p.select(F.col("a_part").alias("a"), F.col("b_part").alias("b"))


_GAPS = [f"greatest(b.{k}0 - a.{k}1, a.{k}0 - b.{k}1, 0)" for k in AXES]


@query("box_distance_join", f"""WITH {D.BOXES_SQL}, p AS (SELECT a.part AS a, b.part AS b, sqrt({' + '.join(f'{g} * {g}' for g in _GAPS)}) AS d FROM boxes a JOIN boxes b
 ON a.part < b.part AND {' AND '.join(f'a.{k}0 - 1 <= b.{k}1 AND b.{k}0 <= a.{k}1 + 1' for k in AXES)}) SELECT a, b, {q6('d')} AS distance FROM p WHERE d < 1""")
def box_distance_join(spark, sf):
    b = D.body_boxes(D.bodies(spark, sf))
    wide = b.select("part", *((F.col(k + "0") - 0.5).alias(k + "0") for k in AXES), *((F.col(k + "1") + 0.5).alias(k + "1") for k in AXES))
    pairs = box_self_join(wide, "part")
    d = B.distance(B.expand(B.box("a_"), -0.5), B.expand(B.box("b_"), -0.5))
    out = pairs.select(F.col("a_part").alias("a"), F.col("b_part").alias("b"), d.alias("distance")).filter("distance < 1")
    return out.select("a", "b", r6(F.col("distance")).alias("distance"))


@query("grid_statistics", f"""WITH {D.BOXES_SQL}, c AS (SELECT part, unnest(range(CAST(floor(x0 / 2) AS BIGINT), CAST(floor(x1 / 2) AS BIGINT) + 1)) AS i, y0, y1, z0, z1 FROM boxes),
 d AS (SELECT i, unnest(range(CAST(floor(y0 / 2) AS BIGINT), CAST(floor(y1 / 2) AS BIGINT) + 1)) AS j, z0, z1 FROM c),
 e AS (SELECT i, j, unnest(range(CAST(floor(z0 / 2) AS BIGINT), CAST(floor(z1 / 2) AS BIGINT) + 1)) AS k FROM d),
 n AS (SELECT count(*) AS n FROM e GROUP BY i, j, k)
 SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS entries, max(n) AS max_per_cell, (SELECT greatest(max(greatest(x1 - x0, y1 - y0, z1 - z0)), 1) FROM boxes) AS cell FROM n""")
def grid_statistics(spark, sf):
    b = D.body_boxes(D.bodies(spark, sf))
    size = cell_size(b).first()["cell"]
    return grid_stats(b, 2.0).withColumn("cell", F.lit(size))


@query("contact_clusters", f"""WITH {D.BOXES_SQL}, nodes AS (SELECT part AS node FROM boxes), half AS MATERIALIZED (SELECT a.part AS u, b.part AS v FROM boxes a JOIN boxes b ON a.part < b.part AND {_MEET}),
 links AS MATERIALIZED (SELECT u, v FROM half UNION ALL SELECT v, u FROM half), {unrolled_components("nodes", "links", 30)}
 SELECT label AS cluster, count(*) AS bodies, max(node) AS last_body FROM lab30 GROUP BY label""")
def contact_clusters(spark, sf):
    b = D.body_boxes(D.bodies(spark, sf))
    pairs = box_self_join(b, "part").select(F.col("a_part").alias("u"), F.col("b_part").alias("v"))
    cc = connected_components(pairs, b.select(F.col("part").alias("node")))
    return cc.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("bodies"), F.max("node").alias("last_body"))


_CLIP = " * ".join(f"greatest(least({k}1, {h}) - greatest({k}0, {l}), 0)" for k, l, h in zip(AXES, (10, 20, 5), (90, 80, 120)))
_INSIDE = " AND ".join(f"{k}0 < {h} AND {k}1 > {l}" for k, l, h in zip(AXES, (10, 20, 5), (90, 80, 120)))


@query("clip_volume_exact", f"""WITH {D.BOXES_SQL} SELECT part, {q6(_CLIP)} AS volume, CASE WHEN {_INSIDE} THEN rtrim({' || '.join(f"CASE WHEN {k}0 < {l} THEN '{k}min,' ELSE '' END || CASE WHEN {k}1 > {h} THEN '{k}max,' ELSE '' END" for k, l, h in zip(AXES, (10, 20, 5), (90, 80, 120)))}, ',') ELSE '' END AS faces FROM boxes""")
def clip_volume_exact(spark, sf):
    v = clipping.volume_in_box(D.triangles(D.box_bodies(spark, sf)), (10, 20, 5), (90, 80, 120), ["part"])
    return v.select("part", r6(F.abs("volume")).alias("volume"), F.array_join("faces", ",").alias("faces"))


@query("volume_fraction", f"""WITH {D.BOXES_SQL}, p AS (SELECT status, {_CLIP} AS v FROM boxes) SELECT status, {q6('least(sum(v) / (80 * 60 * 115), 1)')} AS volume_fraction FROM p GROUP BY status""")
def volume_fraction(spark, sf):
    b = D.box_bodies(spark, sf)
    tri = D.triangles(b).join(b.select("part", "status"), "part")
    vf = clipping.volume_fraction(tri, (10, 20, 5), (90, 80, 120), ["part"], ["status"])
    return vf.select("status", r6(F.col("volume_fraction")).alias("volume_fraction"))


@query("collisions_exact")
def collisions_exact(spark, sf):
    """Exact solid contacts (surfaces crossing, or one body inside another)."""
    return collision.collisions(D.triangles(D.bodies(spark, sf)), "part")


@query("gap_exact", f"""WITH {D.BOXES_SQL}, p AS (SELECT a.part AS a, b.part AS b, sqrt({' + '.join(f'{g} * {g}' for g in _GAPS)}) AS d FROM boxes a JOIN boxes b
 ON a.part < b.part AND {' AND '.join(f'a.{k}0 - 1 <= b.{k}1 AND b.{k}0 <= a.{k}1 + 1' for k in AXES)}) SELECT a, b, {q6('d')} AS distance FROM p WHERE d < 0.5""")
def gap_exact(spark, sf):
    """Exact mesh distances below 0.5 between the bodies taken as boxes."""
    g = collision.closer_than(D.triangles(D.box_bodies(spark, sf)), "part", 0.5)
    return g.select("a", "b", r6(F.col("distance")).alias("distance"))


_TURNS = ", ".join("[" + ", ".join(f"CAST(round({p}{k} * 1e6) AS BIGINT)" for p in turn for k in AXES) + "]" for turn in ("abc", "bca", "cab"))


@query("shell_digests", f"""WITH {D.TRI_SQL}, h AS (SELECT part, sha256(array_to_string(list_min([{_TURNS}]), ',')) AS h FROM tri),
 k AS (SELECT part, h, row_number() OVER (PARTITION BY part ORDER BY h) AS n FROM h),
 b AS (SELECT part, (n - 1) // 5 AS b, sha256(string_agg(h, '' ORDER BY n)) AS h, count(*) AS faces FROM k GROUP BY ALL)
SELECT part, CAST(sum(faces) AS BIGINT) AS faces, sha256(string_agg(h, '' ORDER BY b)) AS digest FROM b GROUP BY part""")
def shell_digests(spark, sf):
    """Geometry digest of every body, as a tree of blocks of five faces."""
    return meshes.digest(D.triangles(D.bodies(spark, sf)), ["part"], block=5)


_RGAP = 0.25
_CUBE = " AND ".join(f"abs(a.c{k} - b.c{k}) <= a.reach + b.reach + {_RGAP}" for k in AXES)
_BOXGAP = "sqrt(" + " + ".join(f"greatest(abs(c{k}a - c{k}b) - h{k}a - h{k}b, 0) ** 2" for k in AXES) + ")"


@query("domain_sieve", f"""WITH {D.BODIES_SQL}, q AS (SELECT part, cx, cy + part % 3 / 300 AS cy, cz + part % 3 / 300 AS cz, hx, hy, hz FROM bodies), r AS (SELECT *, sqrt(hx * hx + hy * hy + hz * hz) AS reach FROM q),
 p AS (SELECT a.part AS a, b.part AS b, {', '.join(f'{s}.{v}{k} AS {v}{k}{s}' for s in 'ab' for v in 'ch' for k in AXES)}, a.reach + b.reach AS reaches FROM r a JOIN r b ON a.part < b.part AND {_CUBE}),
 t AS (SELECT {' + '.join(f'(c{k}a - c{k}b) ** 2' for k in AXES)} <= (reaches + {_RGAP}) ** 2 AS sphere, {_BOXGAP} < {_RGAP} AS box,
  CASE WHEN {_BOXGAP} > 0 THEN {_BOXGAP} ELSE 0 END < {_RGAP} AS exact FROM p),
 c AS (SELECT count(*) AS seen, count(*) FILTER (WHERE sphere) AS s, count(*) FILTER (WHERE sphere AND box) AS b, count(*) FILTER (WHERE sphere AND box AND exact) AS e FROM t)
SELECT stage, seen, passed FROM (SELECT 'sphere' AS stage, seen, s AS passed FROM c UNION ALL SELECT 'box', s, b FROM c UNION ALL SELECT 'exact', b, e FROM c)""")
def domain_sieve(spark, sf):
    """How many pairs of boxes each test of the sieve sees and passes, for a gap of a quarter.

    Bodies are moved a little so that no faces lie in one plane; boxes are exact here, so the last test keeps all.
    """
    b = D.box_bodies(spark, sf).withColumns({"cy": F.col("cy") + F.col("part") % 3 / 300, "cz": F.col("cz") + F.col("part") % 3 / 300})
    return collision.sieve(D.triangles(b), "part", _RGAP)[0]
