"""Shells of large meshes: batches of rows become single nodes before anything travels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import shapes
from granula.operators import meshes


def chains(spark):
    """Balls and boxes that share corners with their neighbours, in random order, with repeated fids and lost ids."""
    rng = np.random.default_rng(6)
    parts = {m: np.concatenate([shapes.box(p, p + 1) for p in rng.integers(0, 7, (60, 3))] + [shapes.icosphere(1, (20, 0, 0))]) for m in (1, 2)}
    rows = shapes.frame(parts)
    rows = pd.concat([rows, rows[rows.mesh_id == 2].iloc[:40:7].assign(ia=900_000, ib=900_001, ic=900_002), rows.assign(mesh_id=3, fid=rows.index)], ignore_index=True)
    tri = spark.createDataFrame(rows.sample(frac=1, random_state=1)).repartition(5)
    return tri.withColumn("ic", F.when((F.col("fid") % 50 != 3) | (F.col("mesh_id") != 1), F.col("ic"))).withColumn("fid", F.when(F.col("fid") != 11, F.col("fid")))


@pytest.mark.parametrize("share", ["vertex", "edge"])
def test_as_by_joins(spark, monkeypatch, share):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        tri = chains(spark).localCheckpoint()
        monkeypatch.setattr(meshes, "WHOLE", 100)
        got = sorted(map(tuple, meshes.with_shells(tri, ["mesh_id"], share).select("mesh_id", "fid", "ia", "ax", "shell").collect()))
        want = tri.join(meshes.face_shells(tri, ["mesh_id"], share), ["mesh_id", "fid"]).select("mesh_id", "fid", "ia", "ax", "shell")
        assert got == sorted(map(tuple, want.collect())) and 10 < len({(r[0], r[4]) for r in got})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_nodes_of_batches_are_linked(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(meshes, "WHOLE", 10)
    real = meshes.connected_components
    monkeypatch.setattr(meshes, "connected_components", lambda links, *a, **k: seen.append(links.count()) or real(links, *a, **k))
    tri = spark.createDataFrame(shapes.frame({1: np.concatenate([shapes.icosphere(2), shapes.icosphere(2, (5, 0, 0))])})).coalesce(1)
    got = meshes.with_shells(tri, ["mesh_id"]).groupBy("shell").count().collect()
    assert sorted(r["count"] for r in got) == [320, 320] and seen == [0]
