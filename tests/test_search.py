import numpy as np
import pandas as pd
import pytest

from granula.operators import components, gridjoin, locate, nearest, placement

RNG = np.random.default_rng(5)


def boxes(n, seed, hot=False):
    r = np.random.default_rng(seed)
    c, h = r.uniform(0, 20, (n, 3)), 10 ** r.uniform(-1.5, 0.4, (n, 3))
    if hot:
        c[: n // 3] = 7.0 + r.normal(0, 0.02, (n // 3, 3))
    d = {"id": np.arange(n)}
    for i, k in enumerate("xyz"):
        d[k + "0"], d[k + "1"] = c[:, i] - h[:, i], c[:, i] + h[:, i]
    return pd.DataFrame(d)


def meet(a, b):
    ok = np.ones((len(a), len(b)), bool)
    for k in "xyz":
        ok &= (a[k + "0"].to_numpy()[:, None] <= b[k + "1"].to_numpy()) & (b[k + "0"].to_numpy() <= a[k + "1"].to_numpy()[:, None])
    return ok


@pytest.mark.parametrize("hot", [False, True])
def test_box_join_is_exact_without_duplicates(spark, hot):
    a, b = boxes(150, 1, hot), boxes(120, 2, hot)
    got = [(r[0], r[1]) for r in gridjoin.box_join(spark.createDataFrame(a), spark.createDataFrame(b)).select("a_id", "b_id").collect()]
    assert sorted(got) == sorted(map(tuple, np.argwhere(meet(a, b)).tolist()))


def test_box_self_join_gives_each_pair_once(spark):
    a = boxes(200, 3, True)
    got = [(r[0], r[1]) for r in gridjoin.box_self_join(spark.createDataFrame(a), "id").select("a_id", "b_id").collect()]
    assert sorted(got) == sorted((i, j) for i, j in np.argwhere(meet(a, a)).tolist() if i < j)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100) if i % 17] + [(500, j) for j in range(600, 800)]
    cc = components.connected_components(spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame([(999,)], "node long"))
    rows = {r["node"]: r["component"] for r in cc.collect()}
    assert rows[799] == 500 and rows[999] == 999 and rows[16] == 1 and rows[18] == 18 and rows[33] == 18 and rows[34] == 18


def test_nearest_triangle_on_clustered_data(spark):
    tri = RNG.uniform(0, 10, (120, 1, 3)) + RNG.normal(0, 0.5, (120, 3, 3))
    tri[:40] = 3.0 + RNG.normal(0, 0.01, (40, 3, 3))
    pts = np.concatenate([RNG.uniform(-5, 15, (60, 3)), 3.0 + RNG.normal(0, 0.01, (30, 3))])
    p = pd.DataFrame(pts, columns=list("xyz"))
    p["qid"] = np.arange(len(p))
    t = pd.DataFrame(tri.reshape(-1, 9), columns=[c + k for c in "abc" for k in "xyz"])
    t["pid"] = np.arange(len(t))
    got = nearest.nearest(spark.createDataFrame(p), spark.createDataFrame(t)).toPandas().sort_values("qid")
    from granula.functions.kernels import point_triangle

    for row in got.itertuples():
        d = point_triangle(np.repeat(pts[row.qid][None], len(tri), 0), tri[:, 0], tri[:, 1], tri[:, 2])
        assert row.distance == pytest.approx(d.min()) and row.primitive == np.flatnonzero(d <= d.min() * (1 + 1e-12))[0]


def test_nearest_without_primitives(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "qid long, x double, y double, z double")
    empty = spark.createDataFrame([], "pid long, " + ", ".join(f"{c}{k} double" for c in "abc" for k in "xyz"))
    row = nearest.nearest(p, empty).first()
    assert row["primitive"] == -1 and np.isnan(row["distance"])


def test_locate_inside_near_and_far(spark):
    tet = dict(zip([c + k for c in "abcd" for k in "xyz"], [0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1]))
    tets = spark.createDataFrame(pd.DataFrame([{"tid": 4, **{k: float(v) for k, v in tet.items()}}, {"tid": 9, **{k: float(v) for k, v in tet.items()}}]))
    pts = spark.createDataFrame([(0, 0.1, 0.1, 0.1), (1, -0.5, 0.2, 0.2), (2, 5.0, 5.0, 5.0)], "qid long, x double, y double, z double")
    rows = {r["qid"]: r for r in locate.locate(pts, tets, bound=0.5).collect()}
    assert rows[0]["donor"] == 4 and rows[0]["distance"] == 0
    assert rows[1]["donor"] == 4 and rows[1]["distance"] == pytest.approx(0.5)
    assert rows[2]["donor"] == -1 and np.isnan(rows[2]["distance"])


@pytest.mark.parametrize("parts", [1, 5])
def test_packing_equals_the_sequential_scan(spark, parts):
    r = np.random.default_rng(8)
    n = 90
    df = pd.DataFrame({"particle": np.arange(n) // 3, "order": np.arange(n), "rad": r.uniform(0.5, 1.2, n)})
    df[["x", "y", "z"]] = r.uniform(0, 8, (n, 3))
    kept, done = [], set()
    for row in df.itertuples():
        if row.particle in done:
            continue
        if all((row.x - k.x) ** 2 + (row.y - k.y) ** 2 + (row.z - k.z) ** 2 >= (row.rad + k.rad) ** 2 for k in kept):
            kept.append(row)
            done.add(row.particle)
    nodes = spark.createDataFrame(df).repartition(parts)
    from pyspark.sql import functions as F

    got = placement.greedy_select(nodes, placement.sphere_conflicts(nodes, F.col("rad"), 0.0, "particle"))
    assert sorted(r["order"] for r in got.collect()) == [k.order for k in kept]


def test_relaxation_reduces_overlap(spark):
    r = np.random.default_rng(4)
    df = pd.DataFrame(r.uniform(0, 6, (40, 3)), columns=list("xyz"))
    df["id"], df["rad"] = np.arange(40), 0.7
    b = spark.createDataFrame(df)
    total = lambda s: placement.overlap_residual(s, "id").selectExpr("coalesce(sum(depth), 0)").first()[0]
    assert total(placement.relax(b, "id", 4, lo=(0, 0, 0), hi=(6, 6, 6))) < 0.7 * total(b)
