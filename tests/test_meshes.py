import math

import numpy as np
import pytest
from shapes import box, frame, icosphere

from granula.operators import clipping, collision, inside, meshes


def test_metrics_of_sphere_and_box(spark):
    tri = spark.createDataFrame(frame({1: icosphere(3), 2: box((0, 0, 0), (1, 2, 3))}))
    m = {r["mesh_id"]: r for r in meshes.metrics(tri).collect()}
    assert m[1]["reason"] is None and m[2]["reason"] is None
    assert m[1]["volume"] == pytest.approx(4 / 3 * math.pi, rel=0.02) and m[1]["sphericity"] == pytest.approx(1, abs=0.01)
    assert m[2]["volume"] == pytest.approx(6) and m[2]["area"] == pytest.approx(22)


def test_open_mesh_has_no_metrics(spark):
    tri = spark.createDataFrame(frame({1: icosphere(1)[1:]}))
    row = meshes.metrics(tri).first()
    assert row["volume"] is None and row["reason"] == "open: 3 edge(s)"


def test_winding_is_fixed_per_part(spark):
    tri = spark.createDataFrame(frame({1: box((0, 0, 0), (1, 1, 1))[:, [0, 2, 1]], 2: box((2, 0, 0), (3, 1, 1))}))
    o = meshes.orient(tri, ["part"])
    assert {r["part"]: r["flipped"] for r in o.select("part", "flipped").distinct().collect()} == {1: True, 2: False}
    assert all(r["signed_volume"] == pytest.approx(1) for r in meshes.measures(o, ["part"]).collect())


@pytest.mark.parametrize("lo,hi,expected,faces", [
    ((-2, -2, -2), (2, 2, 2), 4 / 3 * math.pi, []),
    ((0, -2, -2), (2, 2, 2), 2 / 3 * math.pi, ["xmin"]),
    ((-2, -2, 0.5), (2, 2, 2), math.pi * 0.25 * 2.5 / 3, ["zmin"]),
    ((-2, -2, -2), (-0.5, 2, 2), math.pi * 0.25 * 2.5 / 3, ["xmax"]),
    ((0, 0, 0), (2, 2, 2), math.pi / 6, ["xmin", "ymin", "zmin"]),
    ((-0.3, -0.3, -0.3), (0.3, 0.3, 0.3), 0.216, []),
    ((2, 2, 2), (3, 3, 3), 0.0, []),
])
def test_clip_against_closed_forms(spark, lo, hi, expected, faces):
    tri = spark.createDataFrame(frame({1: icosphere(4)}))
    row = clipping.volume_in_box(tri, lo, hi).first()
    assert row["volume"] == pytest.approx(expected, rel=0.01, abs=1e-9) and row["faces"] == faces


def test_nested_shells_and_distance(spark):
    tri = spark.createDataFrame(frame({1: icosphere(2, radius=2.0), 2: icosphere(1, radius=0.5), 3: icosphere(2, (5, 0, 0), 1.0), 4: icosphere(1, (6.5, 0, 0), 1.0)}))
    assert [(r["outer"], r["inner"]) for r in collision.nested(tri, "part").collect()] == [(1, 2)]
    assert sorted((r["a"], r["b"]) for r in collision.collisions(tri, "part").collect()) == [(1, 2), (3, 4)]
    near = {(r["a"], r["b"]): r["distance"] for r in collision.closer_than(tri, "part", 3.0).collect()}
    assert near[1, 2] == 0 and near[3, 4] == 0 and near[1, 3] == pytest.approx(2.0, abs=0.02)


def test_voxels_of_a_sphere(spark):
    tri = spark.createDataFrame(frame({1: icosphere(3)}))
    n = inside.occupancy(tri, "part", (-1.2, -1.2, -1.2), 0.1, (24, 24, 24)).count()
    assert n * 1e-3 == pytest.approx(4 / 3 * math.pi, rel=0.02)


def test_hollow_solid_is_outside_in_its_cavity(spark):
    shell = np.concatenate([icosphere(2, radius=2.0), icosphere(2, radius=1.0)[:, [0, 2, 1]]])
    tri = spark.createDataFrame(frame({1: shell}))
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.5, 0.0, 0.0), (2, 3.0, 0.0, 0.0)], "pid long, x double, y double, z double")
    assert [r["pid"] for r in inside.points_inside(pts, tri, "pid", "part").collect()] == [1]


def test_granules_split_by_shared_vertices(spark):
    both = np.concatenate([box((0, 0, 0), (1, 1, 1)), box((1, 1, 1), (2, 2, 2)), box((5, 5, 5), (6, 6, 6))])
    lab = meshes.face_shells(spark.createDataFrame(frame({1: both})), ["mesh_id"])
    assert sorted((r["shell"], r["count"]) for r in lab.groupBy("shell").count().collect()) == [(0, 24), (24, 12)]
    edge = meshes.face_shells(spark.createDataFrame(frame({1: both})), ["mesh_id"], share="edge")
    assert edge.select("shell").distinct().count() == 3


def test_measure_job(spark):
    from granula.plans.jobs import measure

    tri = spark.createDataFrame(frame({1: np.concatenate([box((1, 1, 1), (3, 3, 3)), box((5, 5, 5), (9, 9, 9))])}))
    vf, s2 = measure(tri, (0, 0, 0), (10, 10, 10), 2, 1.0)
    assert vf.first()[0] == pytest.approx(72 / 1000)
    curve = {r["r"]: r["s2"] for r in s2.collect()}
    assert curve[0] == pytest.approx(0.072) and 0 < curve[2] < curve[1] < curve[0]


def test_forge_keeps_the_corner_and_presses(spark):
    from granula.plans.jobs import forge

    tri = spark.createDataFrame(frame({1: box((2, 2, 2), (4, 4, 4)), 2: box((6, 6, 6), (8, 8, 8))}))
    moved, before, after = forge(tri, 0.2, 1.0, (2, 2, 2), (8, 8, 8))
    assert before == pytest.approx(after)
    b = meshes.bbox(moved, []).first()
    assert b["z0"] == pytest.approx(2) and b["z1"] - b["z0"] == pytest.approx(6 * 0.8)


def test_split_filter_job(spark):
    from granula.plans.jobs import split_filter

    tri = spark.createDataFrame(frame({1: np.concatenate([box((0, 0, 0), (1, 1, 1)), box((5, 0, 0), (15, 1, 1)), box((20, 0, 0), (22, 2, 2))])}))
    kept, report = split_filter(tri, max_aspect=2.0, volume=(2.0, -1.0))
    assert [r["volume"] for r in kept.collect()] == [pytest.approx(8)]
    assert [(r["rule"], r["before"], r["after"]) for r in report.orderBy("step").collect()] == [("aspect", 3, 2), ("volume", 2, 1)]


def test_digest_depends_on_geometry_alone(spark):
    ball = icosphere(2)
    rng = np.random.default_rng(4)
    turned = np.stack([np.roll(t, k, axis=0) for t, k in zip(ball, rng.integers(0, 3, len(ball)))])[rng.permutation(len(ball))]
    flipped, moved = ball[:, ::-1], ball + [0, 0, 2e-6]
    tri = spark.createDataFrame(frame({0: ball, 1: turned, 2: flipped, 3: moved, 4: ball[:-1]}))
    for block in (4096, 7, 2):
        a, b = ({r.part: (r.faces, r.digest) for r in meshes.digest(t, ["part"], block=block).collect()} for t in (tri, tri.repartition(9, "fid")))
        assert a == b and a[0] == a[1] and a[0][0] == 320 and len({d for _, d in a.values()}) == 4
    assert meshes.digest(tri.limit(0), ["part"]).collect() == []


def test_sieve_passes_only_undecided_pairs_on(spark):
    bodies = {0: icosphere(2), 1: icosphere(2, (2.08, 0, 0)), 2: icosphere(2, (1.6, 1.6, 0.1)), 3: box((-9, -9, -9), (-8, 9, 9)), 4: box((-7.9, -9, -9), (-7, 9, 9)), 5: icosphere(1, (0.1, 0, 0), 0.2)}
    stages, close = collision.sieve(spark.createDataFrame(frame(bodies)), "part", 0.15)
    got = {r.stage: (r.seen, r.passed) for r in stages.collect()}
    assert got["box"][0] == got["sphere"][1] and got["exact"][0] == got["box"][1] and got["exact"][1] == close.count()
    assert {(r.a, r.b) for r in close.collect()} == {(0, 1), (0, 5), (1, 2), (3, 4)}
    assert got["sphere"][0] > got["sphere"][1] and got["box"][0] > got["box"][1]
