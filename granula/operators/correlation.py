"""Two-point correlation S2(r) of voxel occupancies and of meshes.

The exact curve packs voxels along z into machine words, so one joined pair of rows
answers up to 31 voxels at once: shift, AND, count bits. Words meet in tiles of columns,
keyed by (volume, tile, word), so one very large volume is just many tiles.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import u01, uniform_index
from ..session import cut, shuffled, spread

WORD = 31
TILE = 16
MIN_SAMPLES = 200
BLOCK = 2048


@lru_cache(maxsize=32)
def shell_offsets(r_max: int, pitch: float = 1.0) -> dict[int, list[tuple[int, int, int]]]:
    """Integer offsets of each radius: max(0, r/h - 1/(2h))^2 <= d^2 < (r/h + 1/(2h))^2, origin excluded."""
    reach = int(math.ceil((r_max + 0.5) / pitch))
    span = np.arange(-reach, reach + 1)
    grid = np.stack(np.meshgrid(span, span, span, indexing="ij"), -1).reshape(-1, 3)
    d2 = (grid ** 2).sum(1)
    out = {}
    for r in range(1, r_max + 1):
        low = max(0.0, r / pitch - 0.5 / pitch)
        high = r / pitch + 0.5 / pitch
        sel = (d2 > 0) & (d2 >= low * low) & (d2 < high * high)
        out[r] = [tuple(int(c) for c in o) for o in grid[sel]]
    return out


def _half_space(r_max: int, pitch: float):
    """One of each +/- pair of offsets: both have the same hits and the same valid count."""
    rows = []
    for r, offs in shell_offsets(r_max, pitch).items():
        rows += [(r, *o) for o in offs if (o[2], o[1], o[0]) > (0, 0, 0)]
    return rows


def _rows(values, names) -> Column:
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in values))


def packed(occ: DataFrame, vol: str) -> DataFrame:
    """Rows (vol, x, y, w) with the word's own 31 bits and the following 31 as high bits."""
    one = F.lit(1).cast("bigint")
    b = (F.col("z") % WORD).cast("int")
    w = F.floor(F.col("z") / WORD)
    parts = F.array(
        F.struct(w.alias("w"), F.call_function("shiftleft", one, b).alias("bits")),
        F.struct((w - 1).alias("w"), F.call_function("shiftleft", one, b + WORD).alias("bits")))
    spread = occ.select(vol, "x", "y", F.explode(parts).alias("p")).select(vol, "x", "y", "p.*")
    # the first word has none before it
    return spread.filter("w >= 0").groupBy(vol, "x", "y", "w").agg(F.bit_or("bits").alias("bits"))


def pair_hits(occ: DataFrame, vol: str, r_max: int, pitch: float = 1.0) -> DataFrame:
    """Occupied pairs per offset: vol, dx, dy, dz, hits (half space of offsets, zero hits omitted)."""
    half = _half_space(r_max, pitch)
    depth = max(o[3] for o in half)
    columns = {(o[1], o[2]) for o in half}
    reach = max(abs(c) for o in columns for c in o)
    side, span = max(TILE, 2 * reach), 2 * reach + 1
    bits = cut(packed(occ, vol))
    own = F.col("bits").bitwiseAND(F.lit((1 << WORD) - 1))

    def tile(c):
        return F.floor(c / side).cast("int")

    # A word travels to the few tiles of columns within reach, not once per offset.
    left = bits.filter(own != 0).select(vol, "x", "y", "w", own.alias("own"))
    for c in "xy":
        left = left.withColumn("_t" + c, F.explode(F.sequence(tile(F.col(c) - reach), tile(F.col(c) + reach))))
    # dz = k words and a rest of fewer than WORD bits
    left = left.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(depth // WORD)))).withColumn("w", F.col("w") + F.col("k"))
    right = bits.select(vol, "w", F.col("x").alias("_x"), F.col("y").alias("_y"), "bits", *(tile(F.col(c)).alias("_t" + c) for c in "xy"))
    dx, dy = F.col("_x") - F.col("x"), F.col("_y") - F.col("y")
    near = (F.abs(dx) <= reach) & (F.abs(dy) <= reach) & (dx * span + dy).cast("int").isin([a * span + b for a, b in sorted(columns)])
    met = shuffled(left).join(shuffled(right), [vol, "_tx", "_ty", "w"]).filter(near).select(
        vol, dx.cast("int").alias("dx"), dy.cast("int").alias("dy"), "k", "own", "bits")
    sums = [F.sum(F.bit_count(F.col("own").bitwiseAND(F.shiftright(F.col("bits"), dz)))).alias(f"h{dz}")
            for dz in range(min(depth + 1, WORD))]
    per_column = met.groupBy(vol, "dx", "dy", "k").agg(*sums)
    long = per_column.select(vol, "dx", "dy", "k", F.posexplode(F.array(*(F.col(f"h{dz}") for dz in range(min(depth + 1, WORD))))).alias("rest", "hits"))
    return long.filter(F.col("hits") > 0).select(vol, "dx", "dy", (F.col("k") * WORD + F.col("rest")).alias("dz"), "hits")


def s2_exact(occ: DataFrame, dims: DataFrame, vol: str, r_max: int, pitch: float = 1.0) -> DataFrame:
    """Exact S2 per volume: vol, r, n_offsets, s2 for r = 0..r_max.

    ``occ`` holds the occupied voxels (vol, x, y, z); ``dims`` the grid sizes
    (vol, nx, ny, nz). S2(r) is the mean over in-domain offsets of hits / valid pairs;
    S2(0) is the occupied fraction; radii with no offset in the domain are interpolated.
    """
    half = _half_space(r_max, pitch)
    offs = dims.select(vol, "nx", "ny", "nz", F.explode(_rows(half, ("r", "dx", "dy", "dz"))).alias("o"))
    offs = offs.select(vol, "nx", "ny", "nz", "o.*").filter(
        (F.abs("dx") < F.col("nx")) & (F.abs("dy") < F.col("ny")) & (F.abs("dz") < F.col("nz")))
    hits = pair_hits(occ, vol, r_max, pitch)
    valid = (F.col("nx") - F.abs("dx")) * (F.col("ny") - F.abs("dy")) * (F.col("nz") - F.abs("dz"))
    ratio = F.coalesce("hits", F.lit(0)).cast("double") / valid
    rings = shuffled(offs).join(hits, [vol, "dx", "dy", "dz"], "left").groupBy(vol, "r").agg(
        (F.count("*") * 2).alias("n_offsets"), F.avg(ratio).alias("s2"))
    filled = occ.groupBy(vol).agg(F.count("*").alias("n"))
    zero = dims.join(filled, vol, "left").select(
        vol, F.lit(0).alias("r"), F.lit(1).cast("bigint").alias("n_offsets"),
        (F.coalesce("n", F.lit(0)).cast("double") / (F.col("nx") * F.col("ny") * F.col("nz"))).alias("s2"))
    return fill_gaps(zero.unionByName(rings), vol, r_max)


def fill_curve(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Fill unsupported radii between known ones, clamped to [0, 1].

    Two known radii blend by smoothstep; three or more by a natural cubic spline.
    """
    xs = np.flatnonzero(known)
    out = values.copy()
    if len(xs) < 2:
        return out
    ys = values[xs]
    gaps = [i for i in range(xs[0], xs[-1]) if not known[i]]
    if not gaps:
        return out
    x = np.array(gaps, dtype=float)
    if len(xs) == 2:
        t = (x - xs[0]) / (xs[1] - xs[0])
        y = ys[0] + (ys[1] - ys[0]) * t * t * (3 - 2 * t)
    else:
        h = np.diff(xs).astype(float)
        system = np.eye(len(xs))
        rhs = np.zeros(len(xs))
        for i in range(1, len(xs) - 1):
            system[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            rhs[i] = 6 * ((ys[i + 1] - ys[i]) / h[i] - (ys[i] - ys[i - 1]) / h[i - 1])
        bend = np.linalg.solve(system, rhs)
        k = np.searchsorted(xs, x, side="right") - 1
        p, q = (xs[k + 1] - x) / h[k], (x - xs[k]) / h[k]
        y = p * ys[k] + q * ys[k + 1] + ((p ** 3 - p) * bend[k] + (q ** 3 - q) * bend[k + 1]) * h[k] ** 2 / 6
    out[gaps] = np.clip(y, 0.0, 1.0)
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _filled(values: pd.Series) -> pd.Series:
    def one(v):
        v = np.array([np.nan if c is None else c for c in v], dtype=float)
        known = ~np.isnan(v)
        return fill_curve(np.where(known, v, 0.0), known)

    return values.map(one)


def fill_gaps(curve: DataFrame, vol: str, r_max: int) -> DataFrame:
    """Add the radii missing from each curve (r_max + 1 values per volume)."""
    wide = curve.groupBy(vol).agg(
        *(F.max(F.when(F.col("r") == r, F.col("s2"))).alias(f"s{r}") for r in range(r_max + 1)),
        *(F.max(F.when(F.col("r") == r, F.col("n_offsets"))).alias(f"n{r}") for r in range(r_max + 1)))
    s = F.array(*(F.col(f"s{r}") for r in range(r_max + 1)))
    n = F.array(*(F.coalesce(F.col(f"n{r}"), F.lit(0)) for r in range(r_max + 1)))
    gap = F.exists(s, lambda v: v.isNull())
    whole = wide.filter(~gap).select(vol, s.alias("s"), n.alias("n"))
    # Only curves with a gap visit Python.
    holed = wide.filter(gap).select(vol, _filled(s).alias("s"), n.alias("n"))
    both = whole.unionByName(holed).select(vol, F.posexplode(F.arrays_zip("s", "n")).alias("r", "v"))
    return both.select(vol, "r", F.col("v.n").alias("n_offsets"), F.col("v.s").alias("s2"))


def s2_voxel_mc(occ: DataFrame, dims: DataFrame, vol: str, r_max: int, samples: int, seed: int,
                pitch: float = 1.0) -> DataFrame:
    """Monte Carlo S2: uniform voxel, uniform shell offset, hits over in-grid pairs (pooled)."""
    samples = max(samples, MIN_SAMPLES)
    shells = shell_offsets(r_max, pitch)
    blocks = math.ceil(samples / BLOCK)
    draws = dims.select(vol, "nx", "ny", "nz", F.explode(F.sequence(F.lit(1), F.lit(r_max))).alias("r"))
    draws = spread(draws.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), vol, "r", "b")
    draws = draws.withColumn("i", F.explode(F.sequence(F.col("b") * BLOCK, F.least(F.col("b") * BLOCK + BLOCK, F.lit(samples)) - 1)))
    u = [u01(seed, s, F.col(vol), F.col("r"), F.col("i")) for s in ("x", "y", "z", "offset")]
    sizes = F.element_at(F.array(*(F.lit(len(shells[r])) for r in range(1, r_max + 1))), F.col("r"))
    table = dims.sparkSession.createDataFrame(
        [(r, j, *o) for r, offs in shells.items() for j, o in enumerate(offs)], "r int, j int, dx int, dy int, dz int")
    draws = draws.select(vol, "nx", "ny", "nz", "r", *(uniform_index(c, F.col(n)).cast("bigint").alias(k) for c, n, k in zip(u, ("nx", "ny", "nz"), "xyz")), uniform_index(u[3], sizes).alias("j"))
    draws = draws.join(table, ["r", "j"])
    pairs = draws.select(vol, "r", "x", "y", "z", *((F.col(k) + F.col(f"d{k}")).alias(f"{k}2") for k in "xyz"), "nx", "ny", "nz").filter(
        "x2 >= 0 AND y2 >= 0 AND z2 >= 0 AND x2 < nx AND y2 < ny AND z2 < nz")
    a = occ.select(vol, *(F.col(k).cast("bigint").alias(k) for k in "xyz"), F.lit(1).alias("first"))
    b = occ.select(vol, *(F.col(k).cast("bigint").alias(k + "2") for k in "xyz"), F.lit(1).alias("second"))
    seen = pairs.join(a, [vol, "x", "y", "z"], "left").join(b, [vol, "x2", "y2", "z2"], "left")
    return seen.groupBy(vol, "r").agg(
        F.sum((F.col("first").isNotNull() & F.col("second").isNotNull()).cast("bigint")).alias("hits"),
        F.count("*").alias("valid")).withColumn("s2", F.col("hits") / F.col("valid"))


def l2(a: DataFrame, b: DataFrame, keys: list[str], value: str = "s2") -> DataFrame:
    """Euclidean distance of two curves over their common radii."""
    j = a.select(*keys, "r", F.col(value).alias("va")).join(b.select(*keys, "r", F.col(value).alias("vb")), [*keys, "r"])
    d = F.col("va") - F.col("vb")
    return j.groupBy(*keys).agg(F.sqrt(F.sum(d * d)).alias("l2"))
