"""Capped clips against closed forms: hollows, rings, gaps, touching planes, odd input."""

import numpy as np
import pytest

from granula.operators import capped
from shapes import COLS, box, frame, icosphere


def table(spark, meshes):
    return spark.createDataFrame(frame(meshes)[["mesh_id", *COLS]])


def corners(df, **where):
    rows = df.toPandas()
    for k, v in where.items():
        rows = rows[rows[k] == v]
    return rows[COLS].to_numpy().reshape(-1, 3, 3)


def volume(tri):
    return float(np.einsum("ij,ij->i", tri[:, 0], np.cross(tri[:, 1], tri[:, 2])).sum() / 6)


def open_edges(tri):
    """Directed edges without their opposite."""
    pts = np.round(tri * 1e6).astype(int).tolist()
    count = {}
    for t in pts:
        for i in range(3):
            p, q = tuple(t[i]), tuple(t[(i + 1) % 3])
            if p != q:
                count[(p, q)] = count.get((p, q), 0) + 1
                count[(q, p)] = count.get((q, p), 0) - 1
    return [e for e, n in count.items() if n]


def ring():
    """A square ring around the x axis: a 4 x 4 frame with a 2 x 2 opening, 2 thick."""
    out, blocks = [], [(y, z) for y in range(4) for z in range(4) if not (1 <= y <= 2 and 1 <= z <= 2)]
    for y, z in blocks:
        for t in box((0, y, z), (2, y + 1, z + 1)):
            n = np.cross(t[1] - t[0], t[2] - t[0])
            axis = int(np.argmax(np.abs(n)))
            step = np.zeros(3)
            step[axis] = np.sign(n[axis])
            at = (np.array([1, y + .5, z + .5]) + step * (2 if axis == 0 else 1))
            if axis == 0 or (int(at[1] // 1), int(at[2] // 1)) not in blocks:
                out.append(t)
    return np.array(out)


def test_hollow_and_filled(spark):
    outer, inner = box((0, 0, 0), (4, 4, 4)), box((1, 1, 1), (3, 3, 3))[:, ::-1]
    tri = table(spark, {"h": np.concatenate([outer, inner])})
    kept = capped.clip_plane(tri, 2, 2.0)
    got = corners(kept)
    assert volume(got) == pytest.approx(4 * 4 * 2 - 2 * 2) and not open_edges(got)
    assert set(kept.toPandas()["face"].dropna()) == {"zmin"}
    filled = corners(capped.clip_plane(tri, 2, 2.0, holes="fill"))
    assert volume(filled) == pytest.approx(28 - 2 * 2 * 4 / 3)  # the inner cap of area 4 at height 2 faces down instead of up


def test_ring_across_its_opening(spark):
    tri = table(spark, {"r": ring()})
    got = corners(capped.clip_plane(tri, 0, 0.75, "below"))
    assert volume(got) == pytest.approx(12 * 0.75) and not open_edges(got)
    got = corners(capped.clip_plane(tri, 1, 1.5))  # two separate loops
    assert volume(got) == pytest.approx(2 * (16 - 4 - 5)) and not open_edges(got)


def test_sphere_in_box_is_closed(spark):
    from granula.operators.clipping import volume_in_box

    tri = table(spark, {"s": icosphere(3), "far": icosphere(1, (9, 9, 9)), "in": icosphere(1, (.5, .25, .25), .1)})
    lo, hi = (0.013, -2.0, -0.3), (2.0, 0.45, 2.0)
    out = capped.clip_box(tri, lo, hi)
    flux = {r.mesh_id: r.volume for r in volume_in_box(tri, lo, hi).collect()}
    got = corners(out, mesh_id="s")
    assert volume(got) == pytest.approx(flux["s"], abs=1e-9) and not open_edges(got)
    assert volume(corners(out, mesh_id="in")) == pytest.approx(flux["in"], abs=1e-12)
    assert len(corners(out, mesh_id="far")) == 0


def test_touching_and_coplanar(spark):
    cube = box((0, 0, 0), (1, 1, 1))
    tri = table(spark, {"c": cube})
    same = corners(capped.clip_plane(tri, 2, 0.0))
    assert sorted(map(str, same.tolist())) == sorted(map(str, cube.tolist()))
    assert capped.clip_plane(tri, 2, 1.0).count() == 0
    # a step whose middle face lies in the plane: two boxes as one shell
    low, high = box((0, 0, 0), (2, 1, 1)), box((0, 0, 1), (1, 1, 2))
    both = corners(capped.clip_plane(table(spark, {"s": np.concatenate([low, high])}), 2, 1.0))
    assert volume(both) == pytest.approx(1.0) and not open_edges(both)


def test_gap_gets_no_cap(spark):
    cube = box((0, 0, 0), (1, 1, 1))
    upright = np.array([abs(t[:, 0]).sum() == 0 for t in cube])  # the side x = 0
    tri = table(spark, {"g": np.concatenate([cube[~upright], box((3, 0, 0), (4, 1, 1))]), "c": box((5, 0, 0), (6, 1, 1))})
    out = capped.clip_plane(tri, 2, 0.5).toPandas()
    caps = out[out.face.notna()]
    assert upright.sum() == 2 and set(caps.mesh_id) == {"c", "g"}
    assert caps[caps.mesh_id == "g"].ax.min() > 3  # its whole loop is capped, the open one is not


def test_empty_and_missing(spark):
    tri = table(spark, {"c": box((0, 0, 0), (1, 1, 1))})
    assert capped.clip_box(tri.limit(0), (0, 0, 0), (1, 1, 1)).count() == 0
    odd = tri.selectExpr("mesh_id", *("CAST(NULL AS DOUBLE) AS ax" if c == "ax" else c for c in COLS))
    with pytest.raises(Exception, match="missing coordinate"):
        capped.clip_plane(odd, 0, 0.5).count()
    with pytest.raises(ValueError):
        capped.clip_plane(tri, 0, 0.5, holes="some")
