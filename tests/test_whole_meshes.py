"""Small meshes come together once: no rounds of joins, no tables of all faces."""

import pytest
from pyspark.sql import functions as F

from granula.operators import capped, meshes, ordered
from shapes import COLS, box, frame, icosphere


def refuse(*_, **__):
    raise AssertionError("not for small meshes")


def table(spark):
    two = frame({1: icosphere(1), 2: box((5, 0, 0), (6, 1, 1)), 3: icosphere(0, (9, 0, 0))})
    two["mesh_id"] = two["part"] % 2
    two["fid"] += 1000 * two["part"]
    return spark.createDataFrame(two)


def test_meshes_beyond_a_plane_go_before_the_cuts(spark):
    far = {i: box((0, 0, 50 * i), (1, 1, 50 * i + 1)) for i in range(1, 5)}
    tri = spark.createDataFrame(frame({0: box((-1, -1, -1), (1, 1, 1)), **far, 9: box((1, 0, 0), (2, 1, 1))})[["mesh_id", *COLS]])
    left = capped._reaching(tri, (0, 0, 0), (1, 1, 60), ["mesh_id"])
    assert {r.mesh_id for r in left.select("mesh_id").distinct().collect()} == {0, 1, 9}  # 9 touches


@pytest.mark.parametrize("share", ["vertex", "edge"])
def test_shells_of_small_meshes(spark, monkeypatch, share):
    tri = table(spark)
    tri = tri.unionByName(tri.limit(3)).unionByName(tri.limit(2).withColumn("mesh_id", F.lit(None).cast("bigint")))
    monkeypatch.setattr(meshes, "WHOLE", 0)
    want = meshes.with_shells(tri, ["mesh_id"], share).select("mesh_id", "fid", "ax", "shell")
    want = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(meshes, "WHOLE", 100)
    assert want == sorted(map(tuple, meshes.with_shells(tri, ["mesh_id"], share).select("mesh_id", "fid", "ax", "shell").collect()))
    assert {r[3] for r in want} == {1000, 2000, 3000}
    monkeypatch.setattr(meshes, "WHOLE", 4096)
    monkeypatch.setattr(meshes, "connected_components", refuse)
    assert {r["reason"] for r in meshes.closedness(table(spark), ["part"]).collect()} == {None}


def test_digest_of_small_meshes(spark, monkeypatch):
    tri = table(spark)
    monkeypatch.setattr(meshes, "WHOLE", 0)
    want = sorted(map(tuple, meshes.digest(tri, ["part"], block=5).collect()))
    monkeypatch.setattr(meshes, "WHOLE", 4096)
    monkeypatch.setattr(meshes, "numbered", refuse)
    assert sorted(map(tuple, meshes.digest(tri, ["part"], block=5).collect())) == want and len(want) == 3


def test_running_totals_of_small_groups(spark, monkeypatch):
    rows = spark.createDataFrame([(g, i, float(i)) for g in range(3) for i in range(5)] + [(None, 1, 1.0)], "g int, i int, v double")
    for inclusive in (True, False):
        want = ordered.running(rows, ["g"], ["i"], {"s": "v"}, inclusive).collect()
        with monkeypatch.context() as m:
            m.setattr(ordered, "_blocks", refuse)
            assert sorted((r.g, r.i, r.s) for r in want) == sorted((r.g, r.i, r.s) for r in ordered.running_within(rows, ["g"], ["i"], {"s": "v"}, inclusive).collect())


def test_weld_keeps_no_points_to_sort(spark):
    pts = spark.createDataFrame([(1, 7, 0.1, 0.2, 0.3), (1, 4, 0.1 + 1e-9, 0.2, 0.3), (1, 9, 5.0, 0.2, 0.3)], "mesh_id long, pos long, x double, y double, z double")
    got = meshes.weld(pts, ["mesh_id"], "pos")
    assert sorted((r.vid, r.x, r.uses) for r in got.collect()) == [(4, 0.1 + 1e-9, 2), (9, 5.0, 1)]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
