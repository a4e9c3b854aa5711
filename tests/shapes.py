"""Meshes for the tests: boxes and icospheres as pandas ``tri`` tables."""

import itertools

import numpy as np
import pandas as pd

COLS = [p + k for p in "abc" for k in "xyz"]


def icosphere(level=2, centre=(0, 0, 0), radius=1.0):
    g = (1 + 5 ** 0.5) / 2
    pts = np.array([np.roll(p, r) for r in range(3) for p in itertools.product((0.0,), (-1.0, 1.0), (-g, g))])
    faces = []
    for i, j, k in itertools.combinations(range(12), 3):
        t = pts[[i, j, k]]
        if all(abs(np.linalg.norm(t[a] - t[b]) - 2) < 1e-9 for a, b in ((0, 1), (1, 2), (0, 2))):
            faces.append(t if np.linalg.det(t) > 0 else t[[0, 2, 1]])
    tri = np.array(faces)
    for _ in range(level):
        a, b, c = tri[:, 0], tri[:, 1], tri[:, 2]
        m = [(a + b) / 2, (b + c) / 2, (c + a) / 2]
        tri = np.concatenate([np.stack(t, 1) for t in ((a, m[0], m[2]), (m[0], b, m[1]), (m[2], m[1], c), (m[0], m[1], m[2]))])
    tri /= np.linalg.norm(tri, axis=2, keepdims=True)
    return tri * radius + np.asarray(centre)


def box(lo, hi):
    from granula.plans.derive import BOX

    lo, hi = np.asarray(lo, float), np.asarray(hi, float)
    signs = np.array([f for _, f in BOX], float)[:, [0, 2, 1]]
    return (lo + hi) / 2 + signs * (hi - lo) / 2


def frame(meshes: dict):
    """One table for several meshes, vertices welded per mesh."""
    out, base = [], 0
    for name, tri in meshes.items():
        _, ids = np.unique(np.round(tri.reshape(-1, 3) * 1e6), axis=0, return_inverse=True)
        df = pd.DataFrame(tri.reshape(-1, 9), columns=COLS)
        ids = ids.reshape(-1, 3) + base
        for i, p in enumerate("abc"):
            df["i" + p] = ids[:, i]
        df["mesh_id"], df["part"], df["fid"] = name, name, np.arange(len(df))
        base = ids.max() + 1
        out.append(df)
    return pd.concat(out, ignore_index=True)
