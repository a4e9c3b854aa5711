"""Steps whose cost once grew faster than their input: rows made by each test, results against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shapes import box, frame

from granula.operators import gridjoin, locate, nearest, placement, scene
from granula.plans import jobs
from granula.session import checkpoint_dir
from granula.sources import stl


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_faces_without_a_pixel_centre_never_travel(spark):
    """rectangles make their pixels themselves, nothing is joined."""
    rows = [dict(fid=i, **dict(zip([p + k for p in "abc" for k in "xyz"], map(float, c)))) for i, c in enumerate([
        (0, 0, 0, 9, 0, 0, 0, 9, 0), (2.1, 2.1, 1, 2.2, 2.1, 1, 2.1, 2.2, 1), (5, 5, 2, 7, 5, 2, 5, 7, 2)])]
    cam = scene.camera((0, 0, 0), (10, 10, 4), *scene.VIEWS["top"], 10, 10, padding=0.0)
    hits = scene.ray_hits(spark.createDataFrame(pd.DataFrame(rows)), cam, 10, 10, [])
    assert "Join" not in plan(hits)
    got = {(r.fid, r.px, r.py) for r in hits.collect()}
    centre = lambda i, j: (i + 0.5, 10 - j - 0.5)
    inside = lambda x, y, x0, y0, s: x >= x0 and y >= y0 and x - x0 + y - y0 <= s
    want = {(f, i, j) for i in range(10) for j in range(10) for f, x0, y0, s in ((0, 0, 0, 9), (2, 5, 5, 2)) if inside(*centre(i, j), x0, y0, s)}
    assert got == want


def test_picked_edges_are_found_without_sorting_all(spark, monkeypatch):
    """counts by ranges lead to the picks."""
    rng = np.random.default_rng(3)
    e = pd.DataFrame({"lo": rng.integers(-50, 4000, 3000) ** 2, "hi": rng.integers(0, 99, 3000)}).drop_duplicates().sort_values(["lo", "hi"])
    for name, v in (("RANGES", 8), ("FAN", 4), ("SORTED", 40)):
        monkeypatch.setattr(scene, name, v)
    monkeypatch.setattr(scene, "numbered", lambda *a: pytest.fail("all edges sorted"))
    got = sorted(map(tuple, scene.thin_edges(spark.createDataFrame(e), 70).collect()))
    assert got == [tuple(map(int, r)) for r in e.to_numpy()[:: math.ceil(len(e) / 70)]]


def test_boundary_without_cycles_is_the_same(spark):
    cells = spark.createDataFrame([(0, 10, [7, 1, 5, 3]), (1, 10, [1, 5, 3, 9]), (2, 11, [20, 21, 22, 23, 24, 25, 26, 27]), (3, 10, [9, 1, 5, 30])], "cid long, vtk_type int, nodes array<long>")
    a = {(tuple(r.face), r.cid) for r in scene.boundary_faces(cells).collect()}
    thin = scene.boundary_faces(cells, cycle=False)
    assert {(tuple(r.face), r.cid) for r in thin.collect()} == a and len(a) == 14 and "min_by" not in plan(thin)


def test_like_balls_meet_in_tiles(spark, monkeypatch):
    """F16, F42: no box join for balls of like sizes; pairs once, smaller id first."""
    rng = np.random.default_rng(5)
    b = pd.DataFrame({"id": rng.permutation(600), **{k: rng.uniform(-20, 20, 600) for k in "xyz"}, "rad": rng.uniform(1, 2, 600)})
    b = pd.concat([b, b.iloc[:3]])  # repeated rows
    monkeypatch.setattr(gridjoin, "box_self_join", lambda *a: pytest.fail("boxes joined"))
    got = sorted(map(tuple, placement.overlap_residual(spark.createDataFrame(b), "id").select("a", "b").collect()))
    rows = b.sort_values("id").to_numpy()
    want = sorted((int(p[0]), int(q[0])) for p, q in itertools.combinations(rows, 2) if p[0] < q[0] and np.linalg.norm(p[1:4] - q[1:4]) < p[4] + q[4])
    assert got == want and len(want) > 100


def test_unlike_balls_still_meet(spark):
    b = pd.DataFrame({"id": range(40), "x": [float(i) for i in range(40)], "y": 0.0, "z": 0.0, "rad": [30.0] + [0.1] * 39})
    assert gridjoin.ball_pairs(spark.createDataFrame(b), "id").filter("a_id = 0").count() >= 30


def test_greedy_rounds_leave_only_the_rejected(spark):
    """F16: edges of finished rounds leave the disk."""
    import glob

    before = set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/granula-*"))
    nodes = spark.range(60).withColumnRenamed("id", "order")
    kept = placement.greedy_select(nodes, nodes.selectExpr("order AS u", "order + 1 AS v").filter("v < 60"))
    assert sorted(r[0] for r in kept.collect()) == list(range(0, 60, 2))
    made = set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/granula-*")) - before
    assert all(spark.read.parquet(p).columns == ["order"] for p in made)


def test_points_travel_once_to_boxes_of_like_sizes(spark):
    """one level for boxes of two."""
    rng = np.random.default_rng(7)
    pts = pd.DataFrame(rng.uniform(0, 12, (300, 3)), columns=list("xyz")).assign(pid=range(300))
    low, size = rng.uniform(0, 10, (60, 3)), rng.uniform(0.6, 3, (60, 3))
    box = pd.DataFrame({"part": range(60), **{k + "0": low[:, i] for i, k in enumerate("xyz")}, **{k + "1": (low + size)[:, i] for i, k in enumerate("xyz")}})
    met = gridjoin.contain_join(spark.createDataFrame(pts), spark.createDataFrame(box), like=True)
    assert plan(met).count("Generate explode") == 3  # cells of boxes only
    want = {(p, b) for p, v in enumerate(pts[list("xyz")].to_numpy()) for b in range(60) if (low[b] <= v).all() and (v <= (low + size)[b]).all()}
    got = [(r[0], r[1]) for r in met.select("p_pid", "b_part").collect()]
    assert len(got) == len(want) and set(got) == want


def test_cells_beyond_a_face_of_a_tetrahedron_drop_out(spark, monkeypatch):
    """points meet only cells that the tetrahedron reaches, and none is lost."""
    rng = np.random.default_rng(9)
    c = rng.uniform(0, 9, (40, 12))
    tets = pd.DataFrame(c, columns=[p + k for p in "abcd" for k in "xyz"]).assign(tid=range(40))
    pts = pd.DataFrame(rng.uniform(0, 9, (400, 3)), columns=list("xyz")).assign(qid=range(400))
    seen, join = [], gridjoin.contain_join
    monkeypatch.setattr(locate, "contain_join", lambda *a, **k: seen.append(k) or join(*a, **k))
    got = {r.qid: r.donor for r in locate.containing(spark.createDataFrame(pts), locate.tet_boxes(spark.createDataFrame(tets)), "qid", "tid").collect()}
    want = {}
    for q, p in enumerate(pts[list("xyz")].to_numpy()):
        for t, v in enumerate(c.reshape(40, 4, 3)):
            lam = np.linalg.solve((v[1:] - v[0]).T, p - v[0])
            if lam.min() >= -1e-12 and lam.sum() <= 1 + 1e-12:
                want.setdefault(q, []).append((((p - v.mean(0)) ** 2).sum(), t))
    assert got == {q: min(t)[1] for q, t in want.items()} and seen[0]["finer"] == 2
    one = spark.range(1).select(*(F.lit(0.0).alias("b_a" + k) for k in "xyz"), *(F.lit(float(i in (0, 4, 8))).alias(f"b_m{i}") for i in range(9)))
    reach = lambda *low: one.select(locate._reaches([F.lit(v) for v in low], F.lit(0.25), [F.col(f"b_m{i}") for i in range(9)])).first()[0]
    assert reach(0.0, 0.0, 0.0) and reach(0.25, 0.25, 0.25) and not reach(0.5, 0.5, 0.5) and not reach(-0.5, 0.0, 0.0)


def test_numbers_of_a_draw_are_drawn_once(spark, monkeypatch):
    """filters on points do not repeat the digests."""
    made, cut = [], jobs.cut
    monkeypatch.setattr(jobs, "cut", lambda df: made.append(plan(df)) or cut(df))
    tri = spark.createDataFrame(frame({1: box((0, 0, 0), (2, 2, 3))}))
    jobs.mesh_mc_layers(tri, "part", 1.0, 1, 200, 3)
    assert made[0].count("sha2(") <= 5


@pytest.mark.parametrize("kind", ["segment", "triangle"])
def test_long_primitives_meet_points_piece_by_piece(spark, kind):
    """boxes of pieces are small, the nearest primitive is the same."""
    rng = np.random.default_rng(11)
    corners = "ab" if kind == "segment" else "abc"
    a = rng.uniform(0, 10, (80, 3))
    flat = np.concatenate([a] + [a + rng.uniform(-9, 9, (80, 3)) for _ in corners[1:]], 1)
    prims = pd.DataFrame(flat, columns=[p + k for p in corners for k in "xyz"]).assign(pid=range(80))
    pts = pd.DataFrame(rng.uniform(-2, 12, (60, 3)), columns=list("xyz")).assign(qid=range(60))
    boxed = nearest.triangle_boxes(spark.createDataFrame(prims), corners)
    cut_up = nearest.pieces(boxed, corners, 2.0)
    widest = lambda d: d.agg(F.max(F.greatest(*(F.col(k + "1") - F.col(k + "0") for k in "xyz")))).first()[0]
    assert widest(cut_up) <= 2.0 + 1e-9 < widest(boxed)
    got = {r.qid: r for r in nearest.nearest(spark.createDataFrame(pts), spark.createDataFrame(prims), kind=kind).collect()}
    from granula.functions import kernels as K

    for q, p in enumerate(pts[list("xyz")].to_numpy()):
        at = np.broadcast_to(p, (80, 3))
        d = (K.point_segment if kind == "segment" else K.point_triangle)(at, *(flat[:, 3 * i:3 * i + 3] for i in range(len(corners))))
        assert got[q].primitive == int(np.argmin(d)) and abs(got[q].distance - d.min()) < 1e-9


def test_faces_are_written_in_one_sort_without_copies(spark, tmp_path):
    """one table of encoded faces, gone when the files are there; text takes the shortest exact numbers."""
    import glob

    rng = np.random.default_rng(13)
    pdf = pd.DataFrame(np.round(rng.uniform(0, 1, (500, 9)), 3), columns=stl.COLUMNS).assign(fid=rng.permutation(500))
    pdf["path"] = [f"{tmp_path}/{'a' if i % 3 else 'b'}.stl" for i in range(500)]
    before = set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/granula-*"))
    done = {r.path: r.bytes for r in stl.write_files(spark.createDataFrame(pdf), text=True).collect()}
    assert len(set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/granula-*")) - before) == 1
    assert sum(done.values()) < 500 * 160
    back = stl.load(spark, str(tmp_path)).toPandas().sort_values(["path", "fid"])
    want = pdf.sort_values(["path", "fid"])
    assert np.array_equal(back[stl.COLUMNS].to_numpy(), want[stl.COLUMNS].to_numpy())
