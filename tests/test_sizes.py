"""What only shows on large tables: how sides of joins travel, and how many rows do."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import shapes
from granula.operators import correlation, gridjoin, inside, meshes, nearest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bodies(spark, n):
    return spark.range(n).select("id", *((F.col("id") * 0.5 + i).alias(k + e) for k in "xyz" for i, e in enumerate("01")))


def test_grid_cells_are_not_broadcast(spark):
    b = bodies(spark, 20)
    points = b.select("id", *(F.col(k + "0").alias(k) for k in "xyz"))
    prims = points.select(F.col("id").alias("pid"), *(F.col(k).alias("a" + k) for k in "xyz"))
    for got in (gridjoin.box_self_join(b, "id"), gridjoin.box_join(b, b), gridjoin.contain_join(points, b), nearest.upper_bounds(points, prims, "id")):
        assert "Join" in plan(got) and "BroadcastExchange" not in plan(got)


def test_faces_are_not_broadcast(spark):
    tri = spark.createDataFrame(shapes.frame({1: shapes.box((0, 0, 0), (1, 1, 1)), 2: shapes.box((3, 0, 0), (4, 1, 1))}))
    got = meshes.with_shells(tri, ["mesh_id"])
    scans = plan(got).split("SortMergeJoin [mesh_id")
    assert len(scans) > 1 and "fid" in scans[1].split("]")[0]
    assert got.groupBy("mesh_id", "shell").count().count() == 2


def test_words_travel_to_tiles_and_not_once_per_offset(spark):
    occ = np.random.default_rng(4).random((40, 21, 35)) < 0.3
    rows = pd.DataFrame(np.argwhere(occ), columns=list("xyz")).assign(vol=1)
    hits = correlation.pair_hits(spark.createDataFrame(rows), "vol", 4)
    assert "Generate explode([[" not in plan(hits)  # no list of offsets
    got = {(r["dx"], r["dy"], r["dz"]): r["hits"] for r in hits.collect()}
    for d in [o for offs in correlation.shell_offsets(4).values() for o in offs if (o[2], o[1], o[0]) > (0, 0, 0)]:
        lo = tuple(slice(max(0, -c), n - max(0, c)) for c, n in zip(d, occ.shape))
        hi = tuple(slice(max(0, c), n - max(0, -c)) for c, n in zip(d, occ.shape))
        assert got.get(d, 0) == (occ[lo] & occ[hi]).sum()


def test_parts_of_few_faces_need_no_grid(spark, monkeypatch):
    ball = shapes.icosphere(2, (4.2, 4.1, 4.3), 2.7)
    tri = spark.createDataFrame(shapes.frame({1: shapes.box((0.2, 0.3, 0.1), (3.4, 2.2, 9.3)), 2: shapes.box((1, 1, 1), (2, 2, 2)), 3: ball}))
    joins = []
    monkeypatch.setattr(inside, "contain_join", lambda points, boxes, *a, **k: joins.append(boxes.select("part").distinct().count()) or gridjoin.contain_join(points, boxes, *a, **k))
    got = {(r["part"], r["ix"], r["iy"], r["iz"]) for r in inside.coverage(tri, "part", (0, 0, 0), 0.5).collect()}
    assert joins == [1]  # the ball only
    mid = (np.arange(24) + 0.5) / 2
    x, y, z = np.meshgrid(mid, mid, mid, indexing="ij")
    box = [(0.2 < x) & (x < 3.4) & (0.3 < y) & (y < 2.2) & (0.1 < z) & (z < 9.3), (1 < x) & (x < 2) & (1 < y) & (y < 2) & (1 < z) & (z < 2)]
    assert {g for g in got if g[0] < 3} == {(i + 1, *map(int, v)) for i, b in enumerate(box) for v in np.argwhere(b)}
    r = np.sqrt((x - 4.2) ** 2 + (y - 4.1) ** 2 + (z - 4.3) ** 2)
    held = {g[1:] for g in got if g[0] == 3}
    assert {tuple(map(int, v)) for v in np.argwhere(r < 2.5)} <= held <= {tuple(map(int, v)) for v in np.argwhere(r <= 2.7)}
