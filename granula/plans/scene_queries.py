"""Scene extraction, rendering, tetrahedral quality and packing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions.rng import u01, u01_sql
from ..functions.vec import vec
from ..operators import placement, scene, tets
from ..session import cut, fan_out, q6 as r6
from . import derive as D
from .derive import q6
from .mesh_queries import unrolled_components
from .registry import query, table

AXES = "xyz"


def _cells(spark, sf):
    """Tetrahedra of the cube specimens with the attributes scene filters look at."""
    t = D.kuhn_tets(D.cubes(spark, sf))
    return t.select(
        "*", F.lit(0).alias("cell_kind"), (F.col("cube") % 5).cast("int").alias("region_key"), (F.col("cid") % 4).cast("int").alias("partition_id"),
        F.when(F.col("cube") % 3 > 0, F.col("cube") % 3).cast("int").alias("regime"),
        *((F.col("a" + k) + F.col("b" + k) + F.col("c" + k) + F.col("d" + k)).alias("s" + k) for k in AXES)).withColumns(
        {"c" + k: F.col("s" + k) / 4 for k in AXES})


# Set-valued region keys: key -> components, as end offsets and a flat list (5 keys).
_OFFSETS, _COMPONENTS = [1, 3, 4, 6, 7], [0, 1, 2, 0, 2, 3, 3]


def _with_members(cells):
    keyed = cells.withColumn("key", F.col("region_key"))
    return scene.decode_sets(keyed, F.array(*(F.lit(c) for c in _OFFSETS)), F.array(*(F.lit(c) for c in _COMPONENTS)))


_MEMBERS = "[[0], [1, 2], [0], [2, 3], [3]][CAST(cube % 5 AS INT) + 1]"
_FACES = "f AS (SELECT mesh_id, cid, list_sort(n) AS face FROM (" + " UNION ALL ".join(
    f"SELECT mesh_id, cid, [n{a}, n{b}, n{c}] AS n FROM tets" for a, b, c in ("abc", "abd", "acd", "bcd")) + "))"


@query("boundary_faces", f"WITH {D.KUHN_SQL}, {_FACES}, b AS (SELECT mesh_id, face, min(cid) AS cid FROM f GROUP BY mesh_id, face HAVING count(*) = 1) SELECT mesh_id, face[1] AS n0, face[2] AS n1, face[3] AS n2, cid FROM b")
def boundary_faces(spark, sf):
    f = scene.boundary_faces(D.kuhn_tets(D.cubes(spark, sf)), ["mesh_id"])
    return f.select("mesh_id", *(F.col("face")[i].alias(f"n{i}") for i in range(3)), "cid")


@query("wireframe_thinned", f"""WITH {D.KUHN_SQL}, {_FACES}, b AS (SELECT mesh_id, face FROM f GROUP BY mesh_id, face HAVING count(*) = 1),
 e AS (SELECT DISTINCT lo, hi FROM (SELECT face[1] AS lo, face[2] AS hi FROM b UNION ALL SELECT face[1], face[3] FROM b UNION ALL SELECT face[2], face[3] FROM b)),
 r AS (SELECT *, row_number() OVER (ORDER BY lo, hi) - 1 AS k, count(*) OVER () AS n FROM e) SELECT lo, hi FROM r WHERE k % CAST(greatest(ceil(n / 5000), 1) AS BIGINT) = 0""")
def wireframe_thinned(spark, sf):
    """Distinct boundary edges, every n-th of them when there are more than 5,000."""
    f = scene.boundary_faces(D.kuhn_tets(D.cubes(spark, sf)), ["mesh_id"], cycle=False)
    return scene.thin_edges(cut(scene.wire_edges(f)), 5000)


_CENTRE = ", ".join(f"(a{k} + b{k} + c{k} + d{k}) / 4 AS g{k}" for k in AXES)


@query("scene_filters", f"""WITH {D.KUHN_SQL}, s AS (SELECT *, {_MEMBERS} AS members, {_CENTRE} FROM tets)
 SELECT mesh_id, cid FROM s WHERE list_has_any(members, [2, 3]) AND cid % 4 IN (0, 2) AND (cube % 3 = 0 OR cube % 3 IN (1)) AND cube % 5 IN (1, 3)
 AND gx >= 5 AND gx <= 45 AND gy >= 2 AND gy <= 28 AND gz >= 0 AND gz <= 1e6 AND (gx - 25) * 1 + (gy - 15) * 0.5::DOUBLE + (gz - 0) * 0 <= 0""")
def scene_filters(spark, sf):
    """All filters that apply to a cell must pass; filters on absent attributes do not apply."""
    cells = _with_members(_cells(spark, sf))
    return scene.select_cells(cells, [
        ("component", {"values": [2, 3]}), ("partition", {"values": [0, 2]}), ("regime", {"values": [1]}), ("region_key", {"values": [1, 3]}),
        ("bbox", {"min": (5, 2, 0), "max": (45, 28, 1e6)}), ("clip_plane", {"origin": (25, 15, 0), "normal": (1, 0.5, 0)})]).select("mesh_id", "cid")


@query("background_cells", f"WITH {D.KUHN_SQL} SELECT mesh_id, CAST(sum(CAST(cube % 5 IN (0, 2) AS INT)) AS BIGINT) AS background, CAST(sum(CAST(cube % 5 NOT IN (0, 2) AS INT)) AS BIGINT) AS solid FROM tets GROUP BY mesh_id")
def background_cells(spark, sf):
    c = _with_members(_cells(spark, sf))
    n = lambda k: F.sum(scene.filter_column(k).cast("bigint"))
    return c.groupBy("mesh_id").agg(n("background_only").alias("background"), n("background_exclude").alias("solid"))


@query("cell_values", f"""WITH {D.KUHN_SQL}, n AS (SELECT mesh_id, cid, unnest([na, nb, nc, nd]) AS p FROM tets), v AS (SELECT mesh_id, cid, CASE WHEN p % 7 = 0 THEN NULL ELSE p % 100 END AS v FROM n)
 SELECT mesh_id, cid, {q6('avg(v)')} AS value FROM v GROUP BY mesh_id, cid""")
def cell_values(spark, sf):
    """Point values averaged onto cells; -1 marks a point without a value."""
    t = D.kuhn_tets(D.cubes(spark, sf))
    pts = t.select("mesh_id", F.explode("nodes").alias("pid")).distinct().withColumn("load", F.when(F.col("pid") % 7 == 0, F.lit(-1)).otherwise(F.col("pid") % 100))
    return scene.cell_value(t, pts, "load", ["mesh_id"]).select("mesh_id", "cid", r6(F.col("value")).alias("value"))


_PAL = "[" + ", ".join(f"[{r}, {g}, {b}]" for r, g, b in stats.PALETTE) + "]"
_RAMP = "[" + ", ".join(f"[{r}, {g}, {b}]" for r, g, b in stats.RAMP) + "]"


@query("color_maps", f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN -1 ELSE p_size END AS k, greatest(0, least(1, (p_retailprice - 900) / 100)) * 4 AS x FROM part),
 i AS (SELECT *, least(CAST(floor(x) AS INT), 3) AS i, CASE WHEN k < 0 THEN [128, 128, 128] ELSE ({_PAL})[CAST(k % 12 AS INT) + 1] END AS c FROM p)
 SELECT p_partkey, c[1] AS cr, c[2] AS cg, c[3] AS cb, {', '.join(f"CAST(round(({_RAMP})[i + 1][{j}] + (({_RAMP})[i + 2][{j}] - ({_RAMP})[i + 1][{j}]) * (x - i)) AS INT) AS {n}" for j, n in ((1, 'sr'), (2, 'sg'), (3, 'sb')))} FROM i""")
def color_maps(spark, sf):
    p = table(spark, sf, "part")
    k = F.when(F.col("p_size") % 9 == 0, F.lit(-1)).otherwise(F.col("p_size"))
    c, s = stats.categorical_color(k), stats.scalar_color(F.col("p_retailprice"), F.lit(900.0), F.lit(1000.0))
    return p.select("p_partkey", *(c[i].alias(n) for i, n in enumerate(("cr", "cg", "cb"))), *(s[i].alias(n) for i, n in enumerate(("sr", "sg", "sb"))))


def _layers(spark, sf):
    """Events of a user as hits along one ray: t, rank, alpha and a grey level."""
    e = table(spark, sf, "events")
    return e.select("user_id", (F.floor(F.col("value") * 4) / 4).alias("t"), (F.col("event_id") % 2).cast("int").alias("rank"), "event_id",
                    (F.lit(0.125) + (F.col("event_id") % 5) / 8).alias("a"), (F.col("event_id") % 256).cast("double").alias("c"))


_LAYERS = """h AS (SELECT user_id, floor(value * 4) / 4 AS t, CAST(event_id % 2 AS INT) AS rank, event_id, 0.125::DOUBLE + (event_id % 5) / 8 AS a, CAST(event_id % 256 AS DOUBLE) AS c FROM events),
 u AS (SELECT user_id, t, rank, event_id, a, c FROM h QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY rank DESC, event_id DESC) = 1),
 n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM u)"""


def _merged_sql(tol: str) -> str:
    return f"""w AS (WITH RECURSIVE z AS (SELECT user_id, k, t AS t0, rank AS ar, event_id AS ae, 0 AS g FROM n WHERE k = 1
 UNION ALL SELECT n.user_id, n.k, CASE WHEN n.t - z.t0 > {tol} OR n.rank > z.ar THEN n.t ELSE z.t0 END, CASE WHEN n.t - z.t0 > {tol} OR n.rank > z.ar THEN n.rank ELSE z.ar END,
 CASE WHEN n.t - z.t0 > {tol} OR n.rank > z.ar THEN n.event_id ELSE z.ae END, CASE WHEN n.t - z.t0 > {tol} THEN z.g + 1 ELSE z.g END FROM z JOIN n ON n.user_id = z.user_id AND n.k = z.k + 1) SELECT * FROM z),
 mg AS (SELECT user_id, g, t0 AS t, ar AS rank, ae AS event_id FROM w QUALIFY row_number() OVER (PARTITION BY user_id, g ORDER BY k DESC) = 1)"""


@query("merge_hits", f"WITH {_LAYERS}, {_merged_sql('0.5')} SELECT user_id, t, rank, event_id FROM mg")
def merge_hits(spark, sf):
    """Hits merged within 0.5 of the last kept one; a face outranks a volume and moves the anchor."""
    return scene.merge_hits(_layers(spark, sf), ["user_id"], 0.5, "rank", ["event_id"]).select("user_id", "t", "rank", "event_id")


@query("composite_layers", f"""WITH {_LAYERS}, b AS (SELECT user_id, t, a, c, coalesce(sum(ln(1 - a)) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM u),
 s AS (SELECT *, exp(l) AS tr FROM b WHERE exp(l) >= 1 / 512) SELECT user_id, {q6('sum(tr * a * c)')} AS c, {q6('sum(tr * a)')} AS alpha, count(*) AS layers FROM s GROUP BY user_id""")
def composite_layers(spark, sf):
    hits = scene.merge_hits(_layers(spark, sf), ["user_id"], 0.0, "rank", ["event_id", "a", "c"])
    out = scene.composite(hits, ["user_id"], "a", ["c"], ["t"])
    return out.select("user_id", r6(F.col("c")).alias("c"), r6(F.col("alpha")).alias("alpha"), "layers")


def _rendered(spark, sf, width=96, height=96):
    b = D.bodies(spark, sf)
    tri = D.triangles(b)  # made again where it is read, not written
    box = tri.agg(*(F.min(F.least(*(F.col(p + k) for p in "abc"))).alias(k + "0") for k in AXES), *(F.max(F.greatest(*(F.col(p + k) for p in "abc"))).alias(k + "1") for k in AXES)).first()
    direction, up = scene.VIEWS["iso_ne"]
    cam = scene.camera([box[k + "0"] for k in AXES], [box[k + "1"] for k in AXES], direction, up, width, height)
    return tri, cam


@query("render_pixels")
def render_pixels(spark, sf):
    """Opaque view of all bodies: nearest hit per pixel, shaded and coloured by body."""
    tri, cam = _rendered(spark, sf)
    near = scene.nearest_hit(scene.ray_hits(tri, cam, 96, 96, ["part"]), ["part"])
    light = scene.shade(F.col("cosine"), 0.25)
    rgb = stats.categorical_color(F.col("part"))
    px = near.select("px", "py", *(F.round(rgb[i] * light).cast("int").alias(c) for i, c in enumerate("rgb")))
    return scene.image(px, 96, 96, ["r", "g", "b"], (255, 255, 255, 255)).select("py", F.sha2("line", 256).alias("digest"), F.length("line").alias("bytes"))


@query("render_coverage")
def render_coverage(spark, sf):
    """Transparent view: layers and opacity per image row."""
    tri, cam = _rendered(spark, sf)
    hits = scene.ray_hits(tri, cam, 96, 96, ["part"]).withColumns({"rank": F.lit(0), "a": F.lit(0.25), "c": scene.shade(F.col("cosine"), 0.25) * 255.0})
    merged = scene.merge_hits(hits, ["px", "py"], cam.depth_range * 1e-9, "rank", ["fid", "a", "c"])
    out = scene.composite(merged, ["px", "py"], "a", ["c"], ["t"])
    return out.groupBy("py").agg(F.sum("layers").alias("layers"), F.round(F.avg("alpha"), 6).alias("alpha"))


_SIDE, _FRAME = 64, ((0.0313, 0.0313, 0.0), (128.0313, 128.0313, 640.0))
_TOP = scene.camera(*_FRAME, *scene.VIEWS["top"], _SIDE, _SIDE, padding=0.0)
_EYE, _HALF = [float(v) for v in _TOP.position], [float(_TOP.half_width), float(_TOP.half_height)]
_AT = {p: {"x": f"(({p}x - {_EYE[0]}) / {_HALF[0]} + 1.0) * {_SIDE / 2} - 0.5", "y": f"(1.0 - ({p}y - {_EYE[1]}) / {_HALF[1]}) * {_SIDE / 2} - 0.5"} for p in "ab"}


@query("scene_overlay", f"""WITH {D.BODIES_SQL}, {D.PRIMS_SQL}, px AS (SELECT x.i AS px, y.i AS py, {_EYE[0]} + ((x.i + 0.5) / {_SIDE} * 2.0 - 1.0) * {_HALF[0]} AS x,
  {_EYE[1]} + (1.0 - (y.i + 0.5) / {_SIDE} * 2.0) * {_HALF[1]} AS y FROM unnest(range({_SIDE})) x(i), unnest(range({_SIDE})) y(i)),
 dp AS (SELECT px, py, min({_EYE[2]} - (cz + hz)) AS depth FROM px JOIN bodies ON status = 'P' AND abs(px.x - cx) < hx AND abs(px.y - cy) < hy AND cz + hz < {_EYE[2]} GROUP BY px, py),
 e AS (SELECT pid, {', '.join(f"{_AT[p][k]} AS {p}u{k}" for p in 'ab' for k in 'xy')}, {_EYE[2]} - az AS d FROM prims),
 n AS (SELECT *, greatest(ceil(greatest(abs(bux - aux), abs(buy - auy))), 1) AS n FROM e),
 s AS (SELECT pid, s, round(aux + (bux - aux) * (s / n)) AS px, round(auy + (buy - auy) * (s / n)) AS py, d FROM n, unnest(range(CAST(n AS BIGINT) + 1)) r(s)),
 v AS (SELECT pid, CAST(s.px AS BIGINT) AS px, CAST(s.py AS BIGINT) AS py FROM s LEFT JOIN dp ON s.px = dp.px AND s.py = dp.py WHERE s.px BETWEEN 0 AND {_SIDE - 1} AND s.py BETWEEN 0 AND {_SIDE - 1} AND (depth IS NULL OR d - {float(_TOP.depth_range)} * 1e-4 <= depth))
SELECT px, py, max(pid) AS pid FROM v GROUP BY px, py""")
def scene_overlay(spark, sf):
    """Lines of all parts over the opaque boxes of pending orders, seen from above: the last visible line of each pixel."""
    boxes = cut(D.triangles(D.box_bodies(spark, sf).filter("status = 'P'"))).withColumns({"alpha": F.lit(1.0), "c": F.lit(0.0)})
    hits = scene.ray_hits(boxes, _TOP, _SIDE, _SIDE, ["alpha", "c"])
    depths = scene.composite(hits, ["px", "py"], "alpha", ["c"], ["t", "fid"], depth="depth")
    return scene.overlay_lines(D.part_simplices(spark, sf), _TOP, _SIDE, _SIDE, cut(depths), "pid", ["pid"])


# ---------------------------------------------------------------- tetrahedra
def _skewed_tets(spark, sf):
    """Part tetrahedra, some flattened or turned inside out."""
    t = D.part_simplices(spark, sf).withColumnRenamed("pid", "tid")
    k = F.col("tid") % 40
    return t.withColumns({f"d{a}": F.when(k == 3, F.col("c" + a)).when(k.isin(5, 6), F.col("a" + a) * 2 - F.col("d" + a)).otherwise(F.col("d" + a)) for a in AXES})


_SKEW = f"""{D.PRIMS_SQL}, sk AS (SELECT pid AS tid, {', '.join(p + k for p in 'abc' for k in AXES)}, {', '.join(f'CASE WHEN pid % 40 = 3 THEN c{k} WHEN pid % 40 IN (5, 6) THEN a{k} * 2 - d{k} ELSE d{k} END AS d{k}' for k in AXES)} FROM prims),
 uv AS (SELECT tid, {', '.join(f'{q}{k} - a{k} AS {n}{k}' for q, n in (('b', 'u'), ('c', 'v'), ('d', 'w')) for k in AXES)} FROM sk),
 cr AS (SELECT *, {', '.join(f'{a}{"xyz"[i]} * {b}{"xyz"[j]} - {a}{"xyz"[j]} * {b}{"xyz"[i]} AS {n}{k}' for a, b, n in (('v', 'w', 'p'), ('w', 'u', 'q'), ('u', 'v', 'r')) for k, (i, j) in zip(AXES, ((1, 2), (2, 0), (0, 1))))},
  {', '.join(f'(v{"xyz"[i]} - u{"xyz"[i]}) * (w{"xyz"[j]} - u{"xyz"[j]}) - (v{"xyz"[j]} - u{"xyz"[j]}) * (w{"xyz"[i]} - u{"xyz"[i]}) AS s{k}' for k, (i, j) in zip(AXES, ((1, 2), (2, 0), (0, 1))))} FROM uv),
 ql AS (SELECT tid, (ux * px + uy * py + uz * pz) / 6 AS volume, (sqrt(px * px + py * py + pz * pz) + sqrt(qx * qx + qy * qy + qz * qz) + sqrt(rx * rx + ry * ry + rz * rz) + sqrt(sx * sx + sy * sy + sz * sz)) / 2 AS area,
  sqrt({' + '.join(f'(p{k} * (ux * ux + uy * uy + uz * uz) + q{k} * (vx * vx + vy * vy + vz * vz) + r{k} * (wx * wx + wy * wy + wz * wz)) ** 2' for k in AXES)}) AS ce FROM cr),
 qr AS (SELECT tid, volume, CASE WHEN abs(volume) > 1e-30 THEN ce / (12 * abs(volume)) * area / (9 * abs(volume)) END AS ratio FROM ql)"""


@query("tet_quality", f"WITH {_SKEW} SELECT tid, {q6('volume')} AS volume, CASE WHEN ratio IS NOT NULL THEN {q6('ratio')} END AS ratio FROM qr")
def tet_quality(spark, sf):
    q = tets.quality(_skewed_tets(spark, sf))
    return q.select("tid", r6(F.col("volume")).alias("volume"), F.when(F.col("ratio") < float("inf"), r6(F.col("ratio"))).alias("ratio"))


@query("tet_quality_summary", f"WITH {_SKEW} SELECT count(*) AS cells, CAST(sum(CAST(volume <= 1e-30 AS INT)) AS BIGINT) AS inverted, CAST(sum(CAST(coalesce(ratio, 1e300) > 1.8 AS INT)) AS BIGINT) AS over_limit, {q6('max(ratio)')} AS max_ratio FROM qr")
def tet_quality_summary(spark, sf):
    s = tets.quality_summary(tets.quality(_skewed_tets(spark, sf)), 1.8)
    return s.withColumn("max_ratio", r6(F.col("max_ratio")))


@query("tet_repair_groups", f"""WITH {D.KUHN_SQL}, bad AS (SELECT mesh_id || '/' || cid AS node, cid, mesh_id, na, nb, nc, nd FROM tets WHERE cube % 4 = 1 AND cid % 6 < 2), nd AS (SELECT node, unnest([na, nb, nc, nd]) AS p FROM bad),
 nodes AS (SELECT DISTINCT node FROM bad), fl AS (SELECT p, min(node) AS f FROM nd GROUP BY p), links AS MATERIALIZED (SELECT node AS u, f AS v FROM nd JOIN fl USING (p) WHERE node <> f UNION SELECT f, node FROM nd JOIN fl USING (p) WHERE node <> f),
 {unrolled_components("nodes", "links", 24)} SELECT label AS grp, count(*) AS cells FROM lab24 GROUP BY label""")
def tet_repair_groups(spark, sf):
    """Groups of cells marked inverted that share nodes and must be repaired together."""
    t = D.kuhn_tets(D.cubes(spark, sf))
    marked = t.select(F.concat_ws("/", "mesh_id", "cid").alias("tid"), *(F.col("nodes")[i].alias(f"n{i}") for i in range(4)),
                      F.when((F.col("cube") % 4 == 1) & (F.col("cid") % 6 < 2), F.lit(-1.0)).otherwise(F.lit(1.0)).alias("volume"))
    g = tets.repair_groups(marked, "tid", ["n0", "n1", "n2", "n3"])
    return g.groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("cells"))


@query("tet_interface_faces",
       f"WITH {D.KUHN_SQL}, f AS (SELECT den, list_sort(n) AS face FROM ({' UNION ALL '.join(f'SELECT cube % 3 AS den, [n{a}, n{b}, n{c}] AS n FROM tets' for a, b, c in ('abc', 'abd', 'acd', 'bcd'))})), g AS (SELECT face, count(*) AS n, min(den) AS low, max(den) AS high FROM f GROUP BY face) SELECT low, high, count(*) AS faces FROM g WHERE n = 2 AND low <> high GROUP BY low, high")
def tet_interface_faces(spark, sf):
    t = D.kuhn_tets(D.cubes(spark, sf)).select("cid", (F.col("cube") % 3).alias("density"), *(F.col("nodes")[i].alias(f"n{i}") for i in range(4)))
    return tets.interface_faces(t, "cid", ["n0", "n1", "n2", "n3"], "density").groupBy("low", "high").agg(F.count("*").alias("faces"))


# ---------------------------------------------------------------- packing
_ATTEMPTS = 4


def _proposals(spark, sf):
    """Four poses per order in a domain whose height grows with the table."""
    o = table(spark, sf, "orders")
    sizes = fan_out(o).select(F.col("o_orderkey").alias("particle"), (F.lit(0.75) + (F.col("o_orderkey") % 9) / 8).alias("rad"))
    top = float(o.count()) / 20.0
    return placement.proposals(sizes, "particle", _ATTEMPTS, (2, 2, 2), (28, 28, 2 + top), 17)


_PROPOSALS = f"""po AS (SELECT o_orderkey AS particle, k AS attempt, o_orderkey * {_ATTEMPTS} + k AS ord, 0.75::DOUBLE + (o_orderkey % 9) / 8 AS rad, 2 + 26 * {u01_sql(17, 'positionx', 'o_orderkey', 'k')} AS x,
 2 + 26 * {u01_sql(17, 'positiony', 'o_orderkey', 'k')} AS y, 2 + ((SELECT count(*) FROM orders) / 20) * {u01_sql(17, 'positionz', 'o_orderkey', 'k')} AS z FROM orders, (SELECT unnest(range({_ATTEMPTS})) AS k)),
 pr AS MATERIALIZED (SELECT * FROM po WHERE {' AND '.join(f'{k} - rad >= {lo} AND {k} + rad <= {hi}' for k, lo, hi in zip(AXES, (0, 0, 0), (30, 30, '(SELECT count(*) FROM orders) / 20 + 4')))}),
 cf AS MATERIALIZED (SELECT a.ord AS u, b.ord AS v FROM pr a JOIN pr b ON a.ord < b.ord AND b.z BETWEEN a.z - 4 AND a.z + 4 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < (a.rad + b.rad + 0.125) ** 2
  UNION SELECT a.ord, b.ord FROM pr a JOIN pr b ON a.particle = b.particle AND a.ord < b.ord)"""


def _greedy_rounds(rounds: int) -> str:
    """Unrolled rounds of the sequential rule: accept nodes with no live earlier neighbour, reject theirs."""
    ctes = ["st0 AS MATERIALIZED (SELECT ord, 0 AS s FROM pr)"]
    for i in range(1, rounds + 1):
        p = f"st{i - 1}"
        ctes.append(f"""fr{i} AS MATERIALIZED (SELECT ord FROM {p} WHERE s = 0 AND ord NOT IN (SELECT v FROM cf JOIN {p} a ON a.ord = u AND a.s = 0 JOIN {p} b ON b.ord = v AND b.s = 0)),
 st{i} AS MATERIALIZED (SELECT p.ord, CASE WHEN p.s <> 0 THEN p.s WHEN p.ord IN (SELECT ord FROM fr{i}) THEN 1 WHEN p.ord IN (SELECT v FROM cf JOIN fr{i} ON ord = u) THEN 2 ELSE 0 END AS s FROM {p} p)""")
    return ", ".join(ctes)


def _accepted(spark, sf):
    p = _proposals(spark, sf)
    top = float(table(spark, sf, "orders").count()) / 20.0 + 4.0
    ok = F.lit(True)
    for k, hi in zip(AXES, (30.0, 30.0, top)):
        ok = ok & (F.col(k) - F.col("rad") >= 0) & (F.col(k) + F.col("rad") <= hi)
    nodes = cut(p.filter(ok))
    return placement.greedy_select(nodes, placement.sphere_conflicts(nodes, F.col("rad"), 0.125, "particle"))


_ROUNDS = 24


@query("random_packing", f"WITH {_PROPOSALS}, {_greedy_rounds(_ROUNDS)} SELECT particle, attempt, {q6('x')} AS x, {q6('z')} AS z FROM pr JOIN st{_ROUNDS} USING (ord) WHERE s = 1")
def random_packing(spark, sf):
    """Random sequential packing of balls: up to four positions per particle, first fit wins."""
    return _accepted(spark, sf).select("particle", "attempt", r6(F.col("x")).alias("x"), r6(F.col("z")).alias("z"))


def _balls(spark, sf):
    return D.bodies(spark, sf).select("part", F.col("cx").alias("x"), F.col("cy").cast("double").alias("y"), F.col("cz").alias("z"), (F.col("hx") + 0.5).alias("rad"))


_BALLS = D.BODIES_SQL + ", ba AS (SELECT part, cx AS x, cy AS y, cz AS z, hx + 0.5::DOUBLE AS rad FROM bodies)"
_RES = f"""re AS (SELECT a.part AS a, b.part AS b, a.rad + b.rad - sqrt({' + '.join(f'(b.{k} - a.{k}) ** 2' for k in AXES)}) AS depth, {', '.join(f'(b.{k} - a.{k}) / sqrt({" + ".join(f"(b.{m} - a.{m}) ** 2" for m in AXES)}) AS n{k}' for k in AXES)}
 FROM ba a JOIN ba b ON a.part < b.part AND b.z BETWEEN a.z - 4 AND a.z + 4 AND sqrt({' + '.join(f'(b.{k} - a.{k}) ** 2' for k in AXES)}) < a.rad + b.rad)"""


@query("overlap_residual", f"WITH {_BALLS}, {_RES} SELECT a, b, {q6('depth')} AS depth FROM re")
def overlap_residual(spark, sf):
    return placement.overlap_residual(_balls(spark, sf), "part").select("a", "b", r6(F.col("depth")).alias("depth"))


@query("relaxation_step", f"""WITH {_BALLS}, {_RES}, pu AS (SELECT a AS part, {', '.join(f'-n{k} * depth * 0.5::DOUBLE AS p{k}' for k in AXES)} FROM re UNION ALL SELECT b, {', '.join(f'n{k} * depth * 0.5::DOUBLE' for k in AXES)} FROM re),
 tt AS (SELECT part, {', '.join(f'sum(p{k}) AS p{k}' for k in AXES)} FROM pu GROUP BY part) SELECT part, {', '.join(f"{q6(f'{k} + coalesce(p{k}, 0) * 0.8::DOUBLE')} AS {k}" for k in AXES)} FROM ba LEFT JOIN tt USING (part)""")
def relaxation_step(spark, sf):
    """One sweep pushing overlapping balls apart by half the penetration each."""
    m = placement.relax_step(_balls(spark, sf), "part", 0.8)
    return m.select("part", *(r6(F.col(k)).alias(k) for k in AXES))


@query("surface_samples", f"""WITH {D.TRI_SQL}, ar AS (SELECT part, fid, ax, ay, az, bx, by, bz, cx, cy, cz, sqrt(((by - ay) * (cz - az) - (bz - az) * (cy - ay)) ** 2 + ((bz - az) * (cx - ax) - (bx - ax) * (cz - az)) ** 2 + ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) ** 2) / 2 AS a FROM tri),
 ca AS (SELECT *, sum(a) OVER (PARTITION BY part ORDER BY fid) AS upto, sum(a) OVER (PARTITION BY part) AS total FROM ar), dr AS (SELECT part, {u01_sql(9, 'pick', 'part')} AS p, {u01_sql(9, 's', 'part')} AS s0, {u01_sql(9, 't', 'part')} AS t0 FROM bodies),
 fo AS (SELECT part, p, CASE WHEN s0 + t0 > 1 THEN 1 - s0 ELSE s0 END AS s, CASE WHEN s0 + t0 > 1 THEN 1 - t0 ELSE t0 END AS t FROM dr)
 SELECT part, {', '.join(f"{q6(f'a{k} + s * (b{k} - a{k}) + t * (c{k} - a{k})')} AS {k}" for k in AXES)} FROM ca JOIN fo USING (part) WHERE upto > p * total AND upto - a <= p * total""")
def surface_samples(spark, sf):
    """One area-weighted point on the surface of every body."""
    from ..functions import solids as S
    from ..operators.ordered import running_within

    tri = D.triangles(D.bodies(spark, sf)).withColumn("area", S.tri_area(vec("a"), vec("b"), vec("c")))
    upto = running_within(tri, ["part"], ["fid"], {"upto": "area"})
    total = tri.groupBy("part").agg(F.sum("area").alias("total"))
    who = F.col("part")
    s0, t0 = u01(9, "s", who), u01(9, "t", who)
    fold = s0 + t0 > 1
    j = upto.join(total, "part").withColumn("goal", u01(9, "pick", who) * F.col("total")).filter((F.col("upto") > F.col("goal")) & (F.col("upto") - F.col("area") <= F.col("goal")))
    j = j.withColumn("s", F.when(fold, 1 - s0).otherwise(s0)).withColumn("t", F.when(fold, 1 - t0).otherwise(t0))
    return j.select("part", *(r6(F.col("a" + k) + F.col("s") * (F.col("b" + k) - F.col("a" + k)) + F.col("t") * (F.col("c" + k) - F.col("a" + k))).alias(k) for k in AXES))


@query("mesh_packing")
def mesh_packing(spark, sf):
    """Random packing of real meshes: shapes from suppliers, one particle per order, exact contact tests."""
    from .jobs import pack, shape_library

    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    b = s.select(k.alias("part"), k.alias("mesh_id"), (k % 2).cast("int").alias("kind"), *(F.lit(0.0).alias("c" + a) for a in AXES),
                 (1 + (k % 3) / 4).alias("hx"), (1 + (k % 4) / 8).alias("hy"), (1 + (k % 5) / 8).alias("hz"))
    t = D.triangles(b)
    flip = F.col("fid") % 16 < 12
    solid = t.join(b.select("part", "kind"), "part")
    # Boxes are wound inward; the library wants outward shells.
    swap = flip & (F.col("kind") == 0)
    cols = {"b": "c", "c": "b"}
    solid = solid.select("mesh_id", "part", "fid", "ia", *(F.when(swap, F.col("i" + cols[p])).otherwise(F.col("i" + p)).alias("i" + p) for p in "bc"), *(F.col("a" + x) for x in AXES),
                         *(F.when(swap, F.col(cols[p] + x)).otherwise(F.col(p + x)).alias(p + x) for p in "bc" for x in AXES))
    shapes, tri = shape_library(solid)
    o = fan_out(table(spark, sf, "orders"))
    sizes = o.select(F.col("o_orderkey").alias("particle"), (F.lit(1.5) + (F.col("o_orderkey") % 9) / 8).alias("diameter"))
    top = float(o.count()) / 20.0
    return pack(shapes, tri, sizes, (0, 0, 0), (30, 30, top + 4), 29, attempts=2).select("entity_id", "particle", "attempt", "shape", r6(F.col("volume")).alias("volume"))
