"""Meshes of few faces are judged where their faces come together, by the rules of the joins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import shapes
from granula.operators import meshes

COLS = ["mesh_id", "nonfinite", "degenerate", "repeated", "open_edges", "nonmanifold_edges", "inconsistent_edges", "flat"]


def damaged():
    rng = np.random.default_rng(8)
    rows = shapes.frame({i: shapes.box(np.zeros(3), rng.integers(0, 3, 3)) if i % 2 else np.concatenate([shapes.icosphere(0), shapes.icosphere(0, (5, 0, 0))]) for i in range(60)})
    out = []
    for i, g in rows.groupby("mesh_id"):
        g = g.copy()
        at = g.index[rng.integers(len(g))]
        if i % 7 == 1:
            g = g.drop(at)
        elif i % 7 == 2:
            g = pd.concat([g, g.loc[[at]].assign(fid=99 if i % 3 else g.loc[at, "fid"])])
        elif i % 7 == 3:
            g.loc[at, ["ia", "ib"]] = g.loc[at, ["ib", "ia"]].to_numpy()
        elif i % 7 == 4:
            g.loc[at, "ib"] = g.loc[at, "ia"]
        elif i % 7 == 5:
            g.loc[at, "cx"] = [np.inf, -np.inf, 1e300][i % 3]
        elif i % 7 == 6:
            g.loc[at, "az"] = np.nan
        out.append(g)
    return pd.concat(out, ignore_index=True)


def rows_of(df):
    return sorted(map(tuple, df.select(*COLS).collect()))


@pytest.mark.parametrize("shells", [True, False])
def test_as_by_joins(spark, shells):
    tri = spark.createDataFrame(damaged())
    got = rows_of(meshes._whole_defects(tri, ["mesh_id"], shells))
    assert got == rows_of(meshes._defects(tri, ["mesh_id"], shells)) and len({r[1:] for r in got}) > 5


def test_edges_of_whole_meshes_do_not_travel(spark):
    tri = spark.createDataFrame(damaged())
    steps = meshes.closedness(tri, ["mesh_id"])._jdf.queryExecution().executedPlan().toString()
    assert steps.count("Exchange hashpartitioning") == 1 and "Generate" not in steps


def test_large_and_incomplete_meshes_take_the_joins(spark, monkeypatch):
    tri = spark.createDataFrame(damaged())
    tri = tri.withColumn("ic", F.when((F.col("mesh_id") != 9) | (F.col("fid") != 2), F.col("ic"))).withColumn("mesh_id", F.when(F.col("mesh_id") != 21, F.col("mesh_id")))
    say = lambda: sorted(map(tuple, meshes.closedness(tri, ["mesh_id"]).select("mesh_id", "open_edges", "nonmanifold_edges", "inconsistent_edges", "reason").collect()))
    got = say()
    monkeypatch.setattr(meshes, "WHOLE", 12)
    assert got == say() and len(got) == 59
