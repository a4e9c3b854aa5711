"""Geometry derived from the relational tables, as DataFrames and as the matching SQL.

``orders`` become bodies (boxes and octahedra) spread along z, so the domain grows with
the table and the density stays put. ``lineitem`` becomes one voxel lattice per
supplier. ``part`` becomes tetrahedra and segments. Sizes are dyadic fractions, so
both engines compute identical coordinates.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fan_out
from .registry import table


def q6(expr: str) -> str:
    """SQL twin of ``session.q6``."""
    return f"(floor(({expr}) * 1e6 + 0.4370016) / 1e6 + 0.0)"


# ---------------------------------------------------------------- mesh templates
def _box_template():
    """Twelve inward-wound faces of the cube [-1, 1]^3; vertex number = its three sign bits."""
    faces = []
    for axis, side in itertools.product(range(3), (-1, 1)):
        others = [a for a in range(3) if a != axis]
        ring = []
        for s, t in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
            p = [0, 0, 0]
            p[axis], p[others[0]], p[others[1]] = side, s, t
            ring.append(tuple(p))
        outward = side * (1 if axis != 1 else -1) > 0
        if outward:
            ring.reverse()
        faces += [(ring[0], ring[1], ring[2]), (ring[0], ring[2], ring[3])]
    number = lambda p: sum((c > 0) << i for i, c in enumerate(p))
    return [(tuple(number(p) for p in f), f) for f in faces]


def _octahedron_template():
    """Eight outward-wound faces on the six axis points."""
    faces = []
    for sx, sy, sz in itertools.product((1, -1), repeat=3):
        tri = [(sx, 0, 0), (0, sy, 0), (0, 0, sz)]
        if sx * sy * sz < 0:
            tri[1], tri[2] = tri[2], tri[1]
        faces.append(tuple(tri))
    number = lambda p: next(2 * i + (c < 0) for i, c in enumerate(p) if c)
    return [(tuple(number(p) for p in f), f) for f in faces]


BOX, OCTA = _box_template(), _octahedron_template()
# (kind, fid, ia, ib, ic, nine corner signs)
TEMPLATE = [(kind, i, *ids, *(c for p in f for c in p)) for kind, faces in ((0, BOX), (1, OCTA)) for i, (ids, f) in enumerate(faces)]
TEMPLATE_NAMES = ("kind", "tf", "ta", "tb", "tc", *(f"s{p}{k}" for p in "abc" for k in "xyz"))
TEMPLATE_SQL = (f"template({', '.join(TEMPLATE_NAMES)}) AS (VALUES "
                + ", ".join(str(r) for r in TEMPLATE) + ")")


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """One body per order: part, mesh_id (customer), kind, centre cx.., half sizes hx.., status."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return fan_out(o).select(
        k.alias("part"), F.col("o_custkey").alias("mesh_id"), (k % 2).cast("int").alias("kind"),
        (F.col("o_totalprice") / 5000).alias("cx"),
        ((F.col("o_custkey") % 100) + (k % 8) / 8).alias("cy"), (k / 100).alias("cz"),
        (F.lit(0.4375) + (k % 7) / 8).alias("hx"), (F.lit(0.4375) + (F.col("o_custkey") % 5) / 8).alias("hy"),
        (F.lit(0.4375) + (k % 11) / 16).alias("hz"), F.col("o_orderstatus").alias("status"))


BODIES_SQL = """bodies AS (SELECT o_orderkey AS part, o_custkey AS mesh_id, CAST(o_orderkey % 2 AS INT) AS kind,
 o_totalprice / 5000 AS cx, (o_custkey % 100) + (o_orderkey % 8) / 8 AS cy, o_orderkey / 100 AS cz,
 CAST(0.4375 AS DOUBLE) + (o_orderkey % 7) / 8 AS hx, CAST(0.4375 AS DOUBLE) + (o_custkey % 5) / 8 AS hy,
 CAST(0.4375 AS DOUBLE) + (o_orderkey % 11) / 16 AS hz, o_orderstatus AS status FROM orders)"""


def _template_column():
    rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(TEMPLATE_NAMES[1:], r[1:]))) for r in TEMPLATE]
    by_kind = [F.array(*(s for r, s in zip(TEMPLATE, rows) if r[0] == kd)) for kd in (0, 1)]
    return F.when(F.col("kind") == 0, by_kind[0]).otherwise(by_kind[1])


def triangles(b: DataFrame) -> DataFrame:
    """The ``tri`` table of bodies."""
    t = b.withColumn("t", F.explode(_template_column()))
    return t.select(
        "mesh_id", "part", (F.col("part") * 16 + F.col("t.tf")).alias("fid"),
        *((F.col("part") * 8 + F.col(f"t.t{p}")).alias("i" + p) for p in "abc"),
        *((F.col("c" + k) + F.col(f"t.s{p}{k}") * F.col("h" + k)).alias(p + k) for p in "abc" for k in "xyz"))


def _tri_select(source: str) -> str:
    corners = ", ".join(f"c{k} + s{p}{k} * h{k} AS {p}{k}" for p in "abc" for k in "xyz")
    return (f"SELECT mesh_id, part, part * 16 + tf AS fid, part * 8 + ta AS ia, part * 8 + tb AS ib, part * 8 + tc AS ic, "
            f"{corners} FROM {source} JOIN template USING (kind)")


TRI_SQL = f"{BODIES_SQL}, {TEMPLATE_SQL}, tri AS ({_tri_select('bodies')})"


def box_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The same bodies, all as boxes."""
    return bodies(spark, sf).withColumn("kind", F.lit(0))


def body_boxes(b: DataFrame, keys=("part",)) -> DataFrame:
    """Bounding boxes x0..z1 of bodies."""
    return b.select(*keys, *((F.col("c" + k) - F.col("h" + k)).alias(k + "0") for k in "xyz"),
                    *((F.col("c" + k) + F.col("h" + k)).alias(k + "1") for k in "xyz"))


BOXES_SQL = BODIES_SQL + ", boxes AS (SELECT part, mesh_id, kind, status, " + ", ".join(
    f"c{k} - h{k} AS {k}0, c{k} + h{k} AS {k}1" for k in "xyz") + " FROM bodies)"


# ---------------------------------------------------------------- cube lattice
def cubes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct unit cubes per specimen (order priority): mesh_id, x, y, z, cube."""
    o = table(spark, sf, "orders")
    c = o.select(F.col("o_orderpriority").alias("mesh_id"), F.floor(F.col("o_totalprice") / 10000).alias("x"),
                 (F.col("o_custkey") % 30).alias("y"), F.floor(F.col("o_orderkey") / 100).alias("z")).distinct()
    return c.withColumn("cube", lattice_id(F.col("x"), F.col("y"), F.col("z")))


def lattice_id(x, y, z):
    return (x * 64 + y) * (1 << 24) + z


CUBES_SQL = """cubes AS (SELECT DISTINCT o_orderpriority AS mesh_id, CAST(floor(o_totalprice / 10000) AS BIGINT) AS x,
 o_custkey % 30 AS y, CAST(floor(o_orderkey / 100) AS BIGINT) AS z,
 (CAST(floor(o_totalprice / 10000) AS BIGINT) * 64 + o_custkey % 30) * 16777216 + CAST(floor(o_orderkey / 100) AS BIGINT) AS cube FROM orders)"""


def cube_triangles(c: DataFrame) -> DataFrame:
    """Triangles of the cubes; vertices are lattice points, so touching cubes share them."""
    rows = [F.struct(F.lit(i).alias("tf"), *(F.lit((s + 1) // 2).alias(f"s{p}{k}") for p, pt in zip("abc", f) for k, s in zip("xyz", pt)))
            for i, (_, f) in enumerate(BOX)]
    t = c.withColumn("t", F.explode(F.array(*rows)))
    pos = {p: [F.col(k) + F.col(f"t.s{p}{k}") for k in "xyz"] for p in "abc"}
    return t.select("mesh_id", (F.col("cube") * 12 + F.col("t.tf")).alias("fid"),
                    *(lattice_id(*pos[p]).alias("i" + p) for p in "abc"),
                    *(v.cast("double").alias(p + k) for p in "abc" for k, v in zip("xyz", pos[p])))


def kuhn_tets(c: DataFrame) -> DataFrame:
    """Six tetrahedra per cube, one per order of the axes: mesh_id, cid, vtk_type, nodes, corners."""
    rows = []
    for i, perm in enumerate(itertools.permutations(range(3))):
        path = [(0, 0, 0)]
        for axis in perm:
            path.append(tuple(v + (a == axis) for a, v in enumerate(path[-1])))
        rows.append(F.struct(F.lit(i).alias("tf"), *(F.lit(v).alias(f"s{p}{k}") for p, pt in zip("abcd", path) for k, v in zip("xyz", pt))))
    t = c.withColumn("t", F.explode(F.array(*rows)))
    pos = {p: [F.col(k) + F.col(f"t.s{p}{k}") for k in "xyz"] for p in "abcd"}
    return t.select("mesh_id", "cube", (F.col("cube") * 6 + F.col("t.tf")).alias("cid"), F.lit(10).alias("vtk_type"),
                    F.array(*(lattice_id(*pos[p]) for p in "abcd")).alias("nodes"),
                    *(v.cast("double").alias(p + k) for p in "abcd" for k, v in zip("xyz", pos[p])))


def _kuhn_sql() -> str:
    rows = []
    for i, perm in enumerate(itertools.permutations(range(3))):
        path = [(0, 0, 0)]
        for axis in perm:
            path.append(tuple(v + (a == axis) for a, v in enumerate(path[-1])))
        rows.append((i, *(v for p in path for v in p)))
    names = ("tf", *(f"s{p}{k}" for p in "abcd" for k in "xyz"))
    node = lambda p: f"((x + s{p}x) * 64 + y + s{p}y) * 16777216 + z + s{p}z"
    return (f"kuhn({', '.join(names)}) AS (VALUES {', '.join(map(str, rows))}), "
            f"tets AS (SELECT mesh_id, cube, cube * 6 + tf AS cid, x, y, z, {', '.join(f'{node(p)} AS n{p}' for p in 'abcd')}, "
            + ", ".join(f"CAST({k} + s{p}{k} AS DOUBLE) AS {p}{k}" for p in "abcd" for k in "xyz")
            + " FROM cubes CROSS JOIN kuhn)")


KUHN_SQL = CUBES_SQL + ", " + _kuhn_sql()


# ---------------------------------------------------------------- voxel lattices
NX, NY, NZ = 50, 11, 9


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    """Non-zero voxels of one 50 x 11 x 9 lattice per supplier: vol, x, y, z, v (number of line items)."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").alias("vol"), (F.col("l_quantity").cast("bigint") - 1).alias("x"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("y"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("z")).agg(F.count("*").alias("v"))


VOXELS_SQL = """voxels AS (SELECT l_suppkey AS vol, CAST(l_quantity AS BIGINT) - 1 AS x, CAST(round(l_discount * 100) AS BIGINT) AS y,
 CAST(round(l_tax * 100) AS BIGINT) AS z, count(*) AS v FROM lineitem GROUP BY ALL)"""


def dense_voxels(spark: SparkSession, sf: str) -> DataFrame:
    """Every voxel of every lattice (0 where no line item falls), with nx, ny, nz.

    Each voxel that is not zero makes the zeros up to the next one of its lattice, so none of them travels.
    """
    at = (F.col("z") * NY + F.col("y")) * NX + F.col("x")
    held = F.col("vol").isNotNull()
    for k, n in zip("xyz", (NX, NY, NZ)):
        held = held & F.col(k).between(0, n - 1)
    found = voxels(spark, sf).filter(held).select("vol", at.alias("at"), "v")
    heads = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("vol")).distinct().select("vol", F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("v"))
    following = F.lead("at", 1, NX * NY * NZ).over(Window.partitionBy("vol").orderBy("at"))
    each = found.unionByName(heads).withColumn("n", following).select("vol", "v", "at", F.explode(F.sequence("at", F.col("n") - 1)).alias("p")).filter("p >= 0")
    return each.select(
        "vol", (F.col("p") % NX).alias("x"), F.expr(f"p div {NX} % {NY}").alias("y"), F.expr(f"p div {NX * NY}").alias("z"),
        F.when(F.col("p") == F.col("at"), F.col("v")).otherwise(F.lit(0)).cast("bigint").alias("v"),
        F.lit(NX).alias("nx"), F.lit(NY).alias("ny"), F.lit(NZ).alias("nz"))


DENSE_SQL = VOXELS_SQL + f""", grid AS (SELECT vol, x, y, z FROM (SELECT DISTINCT vol FROM voxels), (SELECT unnest(range({NX})) AS x),
 (SELECT unnest(range({NY})) AS y), (SELECT unnest(range({NZ})) AS z)),
dense AS (SELECT vol, x, y, z, coalesce(v, 0) AS v, {NX} AS nx, {NY} AS ny, {NZ} AS nz FROM grid LEFT JOIN voxels USING (vol, x, y, z))"""


# ---------------------------------------------------------------- points and primitives
def probe_points(spark: SparkSession, sf: str) -> DataFrame:
    """One point per line item in the bodies' domain: pid, x, y, z."""
    li = table(spark, sf, "lineitem")
    return fan_out(li).select(
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("pid"),
        (F.col("l_extendedprice") / 1000).alias("x"), ((F.col("l_partkey") % 100) + F.col("l_quantity") / 64).alias("y"),
        (F.col("l_orderkey") / 100 + F.col("l_linenumber") / 512).alias("z"))


def customer_points(spark: SparkSession, sf: str) -> DataFrame:
    """One point per customer: qid, x, y, z in [0, 100]^3."""
    c = fan_out(table(spark, sf, "customer"))
    return c.select(F.col("c_custkey").alias("qid"), (F.col("c_acctbal") / 100).alias("x"),
                    ((F.col("c_custkey") * 7 % 97) + F.col("c_nationkey") / 32).alias("y"),
                    ((F.col("c_custkey") * 13 % 101) + F.col("c_nationkey") / 64).alias("z"))


CUSTOMERS_SQL = """pts AS (SELECT c_custkey AS qid, c_acctbal / 100 AS x, (c_custkey * 7 % 97) + c_nationkey / 32 AS y,
 (c_custkey * 13 % 101) + c_nationkey / 64 AS z FROM customer)"""


def part_simplices(spark: SparkSession, sf: str) -> DataFrame:
    """A tetrahedron per part (corners ax..dz): its first three corners are a triangle, its first two a segment."""
    p = fan_out(table(spark, sf, "part"))
    k = F.col("p_partkey")
    base = [(F.col("p_retailprice") - 900), (k * 31 % 103) / 1 + (k % 4) / 8, (k * 17 % 99) / 1 + (k % 5) / 16]
    ext = [F.lit(2.0) + (F.col("p_size") % 9) / 2, F.lit(2.0) + (k % 7) / 2, F.lit(2.0) + (k % 6) / 2]
    cols = [k.alias("pid")]
    for i, p_ in enumerate("abcd"):
        for j, ax in enumerate("xyz"):
            cols.append((base[j] + (ext[j] if i == j + 1 else F.lit(0.0))).alias(p_ + ax))
    return p.select(*cols)


def _simplex_sql() -> str:
    base = ["(p_retailprice - 900)", "((p_partkey * 31 % 103) / 1 + (p_partkey % 4) / 8)", "((p_partkey * 17 % 99) / 1 + (p_partkey % 5) / 16)"]
    ext = ["(2 + (p_size % 9) / 2)", "(2 + (p_partkey % 7) / 2)", "(2 + (p_partkey % 6) / 2)"]
    cols = ["p_partkey AS pid"]
    for i, p_ in enumerate("abcd"):
        for j, ax in enumerate("xyz"):
            cols.append(f"{base[j]} + {ext[j] if i == j + 1 else '0'} AS {p_}{ax}")
    return f"prims AS (SELECT {', '.join(cols)} FROM part)"


PRIMS_SQL = _simplex_sql()
