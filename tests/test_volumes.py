import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granula.functions import quat, rng, stats
from granula.functions.vec import V
from granula.operators import correlation as C
from granula.operators import ordered, population, scene, volumes
from granula.plans.jobs import crop


def occ_frame(occ):
    d = pd.DataFrame(np.argwhere(occ), columns=list("xyz"))
    d["vol"] = 1
    return d


@pytest.mark.parametrize("shape", [(6, 5, 4), (4, 3, 70)])
def test_s2_equals_brute_force(spark, shape):
    occ = np.random.default_rng(1).random(shape) < 0.4
    dims = spark.createDataFrame([(1, *shape)], "vol long, nx int, ny int, nz int")
    got = {r["r"]: r["s2"] for r in C.s2_exact(spark.createDataFrame(occ_frame(occ)), dims, "vol", 3).collect()}
    assert got[0] == pytest.approx(occ.mean())
    for r, offs in C.shell_offsets(3).items():
        vals = []
        for d in offs:
            if any(abs(c) >= n for c, n in zip(d, shape)):
                continue
            lo = [slice(max(0, -c), n - max(0, c)) for c, n in zip(d, shape)]
            hi = [slice(max(0, c), n - max(0, -c)) for c, n in zip(d, shape)]
            vals.append((occ[tuple(lo)] & occ[tuple(hi)]).mean())
        assert got[r] == pytest.approx(np.mean(vals))


def test_curve_gaps():
    smooth = C.fill_curve(np.array([1.0, 0, 0, 0, 0.2]), np.array([1, 0, 0, 0, 1], bool))
    assert smooth[2] == pytest.approx(0.6) and smooth[1] > smooth[2] > smooth[3]
    spline = C.fill_curve(np.array([0.0, 0.1, 0, 0.3, 0.4]), np.array([1, 1, 0, 1, 1], bool))
    assert spline[2] == pytest.approx(0.2)


def test_pca_frame_rules():
    turns = [np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))[0] for seed in range(40)]
    for values in ([5.0, 2.0, 1.0], [4.0, 4.0, 1.0], [4.0, 1.0, 1.0], [2.0, 2.0, 2.0], [1.0, 0.0, 0.0]):
        covs = np.array([q @ np.diag(values) @ q.T for q in turns])
        for cov, f in zip(covs, volumes.frames(covs)):
            assert np.linalg.det(f) == pytest.approx(1) and np.allclose(f.T @ f, np.eye(3))
            assert np.allclose(np.diag(f.T @ cov @ f), values, atol=1e-9)
    assert np.allclose(volumes.frames(np.array([np.eye(3) * 7, np.zeros((3, 3))])), np.eye(3))


def test_pca_frame_signs():
    tilt = np.array([[np.cos(0.2), -np.sin(0.2), 0], [np.sin(0.2), np.cos(0.2), 0], [0, 0, 1.0]])
    upright = volumes.frames(np.array([tilt @ np.diag([5.0, 2.0, 1.0]) @ tilt.T]))[0]
    assert np.allclose(upright, tilt)  # stays upright whatever the solver's signs
    level = volumes.frames(np.array([np.diag([4.0, 4.0, 1.0]), np.diag([1.0, 4.0, 4.0])]))
    assert np.allclose(level[0], np.eye(3))
    assert np.allclose(level[1], [[0, 0, 1], [1, 0, 0], [0, 1, 0]])  # the plane of y and z first, then x


def test_crop_of_an_upright_block(spark):
    v = np.zeros((12, 9, 7), int)
    v[3:9, 3:6, 2:5] = 5
    idx = np.argwhere(v >= 0)
    d = pd.DataFrame(idx, columns=list("xyz"))
    d["v"], d["vol"] = v.ravel(), 1
    df = spark.createDataFrame(d).withColumns({"nx": F.lit(12), "ny": F.lit(9), "nz": F.lit(7)})
    out = crop(df, trim=0).toPandas()
    assert (out.x.max(), out.y.max(), out.z.max()) == (6, 2, 2) and len(out) == 63
    assert set(out.v) <= set(range(6))


def test_quantiles_and_cdfs(spark):
    df = spark.createDataFrame([(0.5,), (0.975,), (1e-9,), (0.0,), (1.0,)], "p double")
    x = [r[0] for r in df.select(stats.inverse_normal_cdf(F.col("p"))).collect()]
    assert x[0] == 0 and x[1] == pytest.approx(1.959963984540054, abs=1e-12) and x[2] == pytest.approx(-5.997807015008182, abs=1e-9)
    assert x[3] == float("-inf") and x[4] == float("inf")
    r = df.select(stats.normal_cdf_poly(F.lit(1.0)), stats.normal_cdf_cheb(F.lit(1.0))).first()
    assert r[0] == pytest.approx(0.8413447, abs=2e-7) and r[1] == pytest.approx(0.8413447, abs=2e-7)


def test_uniform_rotations(spark):
    df = spark.range(4000).select(rng.quaternion(*(rng.u01(1, f"q{i}", F.col("id")) for i in range(3))).alias("q"))
    turned = quat.rotate(F.col("q"), V(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    m = df.select(*(c.alias(k) for c, k in zip(turned, "xyz"))).agg(*(F.avg(k) for k in "xyz"), *(F.avg(F.col(k) * F.col(k)) for k in "xyz")).first()
    assert all(abs(m[i]) < 0.04 for i in range(3)) and all(abs(m[i] - 1 / 3) < 0.03 for i in range(3, 6))


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals_cross_blocks(spark, parts):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), F.lit(1).alias("one")).repartition(parts)
    r = ordered.running(df, ["g"], ["k"], {"n": "one"}).toPandas()
    assert (r.n == r.k // 3 + 1).all()
    assert ordered.upper_middle(df, ["g"], "k").filter("g = 0").first()["upper_middle"] == 501


def test_anchored_merge_moves_with_rank(spark):
    rows = [(1, 0.0, 0, 10), (1, 0.4, 0, 11), (1, 0.8, 1, 12), (1, 1.2, 0, 13), (1, 5.0, 0, 14)]
    hits = spark.createDataFrame(rows, "p long, t double, rank int, e long")
    got = sorted((r["t"], r["e"]) for r in scene.merge_hits(hits, ["p"], 0.5, "rank", ["e"]).collect())
    assert got == [(0.0, 10), (0.8, 12), (5.0, 14)]


def test_largest_remainder_adds_up(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double")
    assert sorted(r["quota"] for r in population.largest_remainder(df, "w", "k", 10).collect()) == [3, 3, 4]


def test_rendered_square(spark):
    tri = spark.createDataFrame([(0, 1, -1.0, 0.0, -1.0, 1.0, 0.0, -1.0, 1.0, 0.0, 1.0), (1, 1, -1.0, 0.0, -1.0, 1.0, 0.0, 1.0, -1.0, 0.0, 1.0)],
                                "fid long, part long, " + ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz"))
    cam = scene.camera((-1, 0, -1), (1, 0, 1), (0, 1, 0), (0, 0, 1), 20, 20, padding=0.0)
    near = scene.nearest_hit(scene.ray_hits(tri, cam, 20, 20, ["part"]), ["part"])
    assert near.count() == 400 and near.agg(F.min("cosine")).first()[0] == pytest.approx(1)


def test_pair_hits_beyond_a_word(spark, monkeypatch):
    offsets = [(1, 0, 0, 2), (1, 0, 0, 31), (1, 1, -1, 33), (1, 0, 1, 64)]
    monkeypatch.setattr(C, "_half_space", lambda r_max, pitch: offsets)
    occ = np.random.default_rng(2).random((4, 3, 90)) < 0.4
    got = {(r["dx"], r["dy"], r["dz"]): r["hits"] for r in C.pair_hits(spark.createDataFrame(occ_frame(occ)), "vol", 1).collect()}
    for _, *d in offsets:
        lo = tuple(slice(max(0, -c), n - max(0, c)) for c, n in zip(d, occ.shape))
        hi = tuple(slice(max(0, c), n - max(0, -c)) for c, n in zip(d, occ.shape))
        assert got[tuple(d)] == int((occ[lo] & occ[hi]).sum())
