import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granula.operators import volumes
from granula.plans import derive


@pytest.mark.parametrize("interpolation", ["nearest", "trilinear"])
def test_tiles_give_what_every_target_samples(spark, interpolation):
    rng = np.random.default_rng(3)
    shape, turn = (37, 22, 19), np.linalg.qr(rng.normal(size=(3, 3)))[0]
    v = np.where(rng.random(shape) < 0.3, rng.integers(-3, 9, shape), 2)
    d = pd.DataFrame(np.argwhere(v > -9), columns=list("xyz")).assign(v=v.ravel(), vol=1, background=2)
    fg = np.argwhere(v != 2)
    m = fg.mean(0)
    p = (fg - m) @ turn
    lo, hi = np.floor(p.min(0)).astype(int), np.ceil(p.max(0)).astype(int)
    bounds = spark.createDataFrame([(1, *lo.tolist(), *hi.tolist())], "vol long, x0 long, y0 long, z0 long, x1 long, y1 long, z1 long")
    frames = spark.createDataFrame([(1, *m.tolist(), turn.ravel().tolist())], "vol long, mx double, my double, mz double, frame array<double>")
    got = volumes.resample(spark.createDataFrame(d), bounds, frames, interpolation).toPandas()
    size = hi - lo + 1
    assert len(got) == size.prod() == len(got[["x", "y", "z"]].drop_duplicates()) and (got[["nx", "ny", "nz"]].to_numpy() == size).all()
    at = (got[["x", "y", "z"]].to_numpy() + lo) @ turn.T + m
    padded = np.pad(v, 60, constant_values=2)
    pick = lambda g: padded[tuple((g + 60).T)]
    if interpolation == "nearest":
        want = pick(np.rint(at).astype(int))
    else:
        f = np.floor(at).astype(int)
        w = at - f
        want = sum(pick(f + c) * np.prod(np.where(c, w, 1 - w), axis=1) for c in (np.array([(i >> a) & 1 for a in range(3)]) for i in range(8)))
        want = np.sign(want) * np.floor(np.abs(np.round(want, 9)) + 0.5)
    assert (got["v"].to_numpy() == want).all()


def test_dense_lattices_fill_their_gaps(spark, tmp_path):
    rows = [(1, 1.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (1, 50.0, 0.10, 0.08), (2, 7.0, 0.03, 0.01), (3, 99.0, 0.0, 0.0), (4, None, 0.0, 0.0), (None, 5.0, 0.0, 0.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    d = derive.dense_voxels(spark, str(tmp_path))
    whole = derive.NX * derive.NY * derive.NZ
    assert {r["vol"]: (r["n"], r["places"]) for r in d.groupBy("vol").agg(F.count("*").alias("n"), F.count_distinct("x", "y", "z").alias("places")).collect()} == {k: (whole, whole) for k in (1, 2, 3, 4, None)}
    assert {tuple(r) for r in d.filter("v <> 0").select("vol", "x", "y", "z", "v").collect()} == {(1, 0, 0, 0, 2), (1, 49, 10, 8, 1), (2, 6, 3, 1, 1)}
    assert "SortMergeJoin" not in (plan := d._jdf.queryExecution().executedPlan().toString()) and "HashJoin" not in plan
