"""Spatial joins on a hierarchy of grids.

A box lives on the level whose cell side is the power of two just above its
longest extent, so it touches at most two cells per axis there, however large or
small it is. A pair of boxes is found on the level of the larger one: the larger
box sits in its "home" cells and the smaller one probes the cells it touches on
that level. The join is therefore a plain equi-join on (level, cell), which
shuffles, spills and skew-splits like any other, and a dense region made of small
boxes gets small cells by itself. A pair that shares several cells is kept only in
the cell holding the low corner of its intersection, so no de-duplication shuffle
is needed.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffled

AXES3 = (("x0", "x1"), ("y0", "y1"), ("z0", "z1"))
# Smallest cell side, 2^-40: boxes thinner than this (points included) share that level.
MIN_LEVEL = -40


def _level(axes, prefix: str = "") -> Column:
    extents = [F.col(prefix + hi) - F.col(prefix + lo) for lo, hi in axes]
    longest = F.greatest(*extents) if len(extents) > 1 else extents[0]
    return F.ceil(F.log2(F.greatest(longest, F.lit(2.0 ** MIN_LEVEL)))).cast("int")


def _cells(df: DataFrame, axes, level: Column) -> DataFrame:
    """One row per grid cell a box touches on ``level``."""
    out = df.withColumn("_s", F.pow(F.lit(2.0), level))
    for i, (lo, hi) in enumerate(axes):
        first, last = F.floor(F.col(lo) / F.col("_s")), F.floor(F.col(hi) / F.col("_s"))
        out = out.withColumn(f"_c{i}", F.explode(F.sequence(first, last)))
    return out


def used_levels(df: DataFrame, axes=AXES3) -> list[int]:
    """Distinct levels of a set of boxes: a handful of small integers (double exponents)."""
    return sorted(r[0] for r in df.select(_level(axes)).distinct().collect() if r[0] is not None)


def _side(df: DataFrame, tag: str, axes) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{tag}{c}") for c in df.columns))


def _tagged(axes, tag):
    return [(tag + lo, tag + hi) for lo, hi in axes]


def _home(df: DataFrame, axes) -> DataFrame:
    lv = _level(axes)
    return _cells(df.withColumn("_level", lv), axes, F.col("_level"))


def _probe(df: DataFrame, axes, levels: Sequence[int], strict: bool) -> DataFrame:
    """Cells touched on every listed level at or above (strictly above) the box's own."""
    own = _level(axes)
    wanted = F.filter(F.array(*(F.lit(v) for v in levels)), lambda v: (v > own) if strict else (v >= own))
    return _cells(df.withColumn("_level", F.explode(wanted)), axes, F.col("_level"))


def _match(home: DataFrame, probe: DataFrame, keys, haxes, paxes, hkeys, pkeys) -> DataFrame:
    n = len(haxes)
    h = home.select("*").withColumnRenamed("_level", "_hl").drop("_s")
    for i in range(n):
        h = h.withColumnRenamed(f"_c{i}", f"_h{i}")
    conds = [F.col("_hl") == F.col("_level"), *(F.col(f"_h{i}") == F.col(f"_c{i}") for i in range(n))]
    conds += [F.col(a) == F.col(b) for a, b in zip(hkeys, pkeys)]
    joined = shuffled(h).join(shuffled(probe), reduce(and_, conds), "inner")
    keep = []
    for i, ((hl, hh), (pl, ph)) in enumerate(zip(haxes, paxes)):
        keep.append((F.col(hl) <= F.col(ph)) & (F.col(pl) <= F.col(hh)))
        keep.append(F.floor(F.greatest(F.col(hl), F.col(pl)) / F.col("_s")) == F.col(f"_c{i}"))
    out = joined.filter(reduce(and_, keep))
    return out.drop("_hl", "_level", "_s", *(f"_h{i}" for i in range(n)), *(f"_c{i}" for i in range(n)))


def box_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), axes=AXES3,
             left_tag: str = "a_", right_tag: str = "b_") -> DataFrame:
    """All pairs of boxes that meet (closed), with columns prefixed ``a_`` and ``b_``.

    ``keys`` are extra columns both sides must agree on.
    """
    a, b = _side(left, left_tag, axes), _side(right, right_tag, axes)
    aa, ba = _tagged(axes, left_tag), _tagged(axes, right_tag)
    ak, bk = [left_tag + k for k in keys], [right_tag + k for k in keys]
    la, lb = used_levels(left, axes), used_levels(right, axes)
    big_left = _match(_home(a, aa), _probe(b, ba, la or [0], False), keys, aa, ba, ak, bk)
    if la and lb and min(la) >= max(lb):
        return big_left
    big_right = _match(_home(b, ba), _probe(a, aa, lb or [0], True), keys, ba, aa, bk, ak)
    return big_left.unionByName(big_right)


def box_self_join(boxes: DataFrame, id_col: str, keys: Sequence[str] = (), axes=AXES3) -> DataFrame:
    """Unordered pairs of distinct boxes that meet; ``a_<id> < b_<id>``."""
    a, b = _side(boxes, "a_", axes), _side(boxes, "b_", axes)
    aa, ba = _tagged(axes, "a_"), _tagged(axes, "b_")
    levels = used_levels(boxes, axes)
    pairs = _match(_home(a, aa), _probe(b, ba, levels or [0], False), keys, aa, ba,
                   ["a_" + k for k in keys], ["b_" + k for k in keys])
    ida, idb = F.col("a_" + id_col), F.col("b_" + id_col)
    la, lb = _level(aa), _level(ba)
    pairs = pairs.filter((la > lb) | ((la == lb) & (ida < idb))).filter(ida != idb)
    swap = ida > idb
    cols = []
    for c in boxes.columns:
        ca, cb = F.col("a_" + c), F.col("b_" + c)
        cols += [F.when(swap, cb).otherwise(ca).alias("a_" + c), F.when(swap, ca).otherwise(cb).alias("b_" + c)]
    return pairs.select(*cols)


def ball_pairs(balls: DataFrame, id_col: str, gap: float = 0.0) -> DataFrame:
    """Unordered pairs of balls (x, y, z, rad) that come within ``gap``, by a hair more at most; ``a_<id> < b_<id>``.

    Balls of like sizes meet in tiles of some 64 balls: each lies in the tile of its centre and travels, with its centre
    and radius only, to those tiles in reach that come after its own, so a pair is found once. Others take the box join.
    ``balls`` is read three times.
    """
    e = balls.agg(F.count("rad").alias("n"), F.max("rad").alias("most"), F.avg("rad").alias("mean"),
                  *(f(k).alias(k + n) for k in "xyz" for f, n in ((F.min, "0"), (F.max, "1")))).first()
    rows = balls.select(id_col, "x", "y", "z", "rad")
    sides = [e[k + "1"] - e[k + "0"] for k in "xyz"] if e["n"] and e["x0"] is not None and e["y0"] is not None and e["z0"] is not None else [math.inf]
    if not (all(math.isfinite(v) for v in sides) and 0 < e["most"] <= 4 * e["mean"] and 2 * e["most"] + gap > 0):
        half = F.col("rad") + gap / 2
        return box_self_join(rows.select("*", *((F.col(k) + s * half).alias(k + n) for k in "xyz" for s, n in ((-1, "0"), (1, "1")))), id_col)
    widest = 2 * e["most"] + gap
    room = math.prod(max(v, widest) for v in sides)
    tile = min(max((64 * room / e["n"]) ** (1 / 3), widest), 6 * widest)
    slack = 1e-9 * widest + 1e-12 * max(abs(e[k + n]) for k in "xyz" for n in "01")
    a = _side(rows, "a_", ()).withColumns({f"_t{k}": F.floor(F.col("a_" + k) / tile) for k in "xyz"})
    b = _side(rows, "b_", ())
    reach = F.col("b_rad") + (e["most"] + gap + slack)
    for k in "xyz":
        b = b.withColumn(f"_t{k}", F.explode(F.sequence(F.floor((F.col("b_" + k) - reach) / tile), F.floor((F.col("b_" + k) + reach) / tile))))
    own, at = (F.struct(*(c.alias(k) for k, c in zip("xyz", cs))) for cs in ([F.floor(F.col("b_" + k) / tile) for k in "xyz"], [F.col(f"_t{k}") for k in "xyz"]))
    b = b.filter(at >= own)
    ida, idb = F.col("a_" + id_col), F.col("b_" + id_col)
    near = F.lit(0.0)
    for k in "xyz":
        d = F.col("a_" + k) - F.col("b_" + k)
        near = near + d * d
    limit = F.col("a_rad") + F.col("b_rad") + (gap + slack)
    tiles = [F.col("a._t" + k) == F.col("b._t" + k) for k in "xyz"]
    alike = reduce(and_, (F.floor(F.col("b_" + k) / tile) == F.col("a._t" + k) for k in "xyz"))
    met = shuffled(a.alias("a")).join(shuffled(b.alias("b")), reduce(and_, [*tiles, ida != idb, near <= limit * limit, (ida < idb) | ~alike]))
    swap = ida > idb
    one, two = (F.struct(*(F.col(s + c).alias(c) for c in rows.columns)) for s in ("a_", "b_"))
    # Out of a generator: filters that follow do not spell the exchange out for every candidate.
    low = met.select(F.explode(F.array(F.struct(F.when(swap, two).otherwise(one).alias("l"), F.when(swap, one).otherwise(two).alias("h")))).alias("p"))
    return low.select(*(F.col(f"p.{s}.{c}").alias(t + c) for s, t in (("l", "a_"), ("h", "b_")) for c in rows.columns))


def contain_join(points: DataFrame, boxes: DataFrame, coords: Sequence[str] = ("x", "y", "z"),
                 keys: Sequence[str] = (), axes=AXES3, like: bool = False, finer: int = 0, meets=None) -> DataFrame:
    """Pairs (point, box) with the point in the closed box; box columns prefixed ``b_``, point columns ``p_``.

    ``like``: boxes of much the same size; where theirs are no more than two levels apart, all take the largest one, so
    points travel once. ``finer`` lowers the levels, for boxes that are mostly empty: of their cells only those stay that
    ``meets(low corner, side)`` holds for.
    """
    p = points.select(*(F.col(c).alias("p_" + c) for c in points.columns))
    b = _side(boxes, "b_", axes)
    ba = _tagged(axes, "b_")
    levels = used_levels(boxes, axes) or [0]
    one = like and levels[-1] - levels[0] <= 2
    levels = [levels[-1] - finer] if one else [v - finer for v in levels]
    p = p.withColumn("_level", F.lit(levels[0]) if one else F.explode(F.array(*(F.lit(v) for v in levels))))
    side = F.pow(F.lit(2.0), F.col("_level"))
    p = p.select("*", *(F.floor(F.col("p_" + c) / side).alias(f"_c{i}") for i, c in enumerate(coords)))
    level = F.lit(levels[0]) if one else _level(ba) - finer
    h = _cells(b.withColumn("_level", F.when(F.col(ba[0][0]).isNotNull(), level)), ba, F.col("_level"))
    if meets is not None:
        h = h.filter(meets([F.col(f"_c{i}") * F.col("_s") for i in range(len(axes))], F.col("_s")))
    h = h.withColumnRenamed("_level", "_hl").drop("_s")
    for i in range(len(axes)):
        h = h.withColumnRenamed(f"_c{i}", f"_h{i}")
    # Cells first: rows are sorted by these, and levels or parts are much the same.
    conds = [*(F.col(f"_h{i}") == F.col(f"_c{i}") for i in reversed(range(len(axes)))), F.col("_hl") == F.col("_level")]
    conds += [F.col("b_" + k) == F.col("p_" + k) for k in keys]
    keep = [(F.col(lo) <= F.col("p_" + c)) & (F.col("p_" + c) <= F.col(hi)) for (lo, hi), c in zip(ba, coords)]
    out = shuffled(h).join(shuffled(p), reduce(and_, conds), "inner").filter(reduce(and_, keep))
    return out.drop("_hl", "_level", *(f"_h{i}" for i in range(len(axes))), *(f"_c{i}" for i in range(len(axes))))


def grid_stats(boxes: DataFrame, cell: float, axes=AXES3) -> DataFrame:
    """Occupancy of a uniform grid: cells in use, entries, and the fullest cell."""
    spread = boxes
    for i, (lo, hi) in enumerate(axes):
        spread = spread.withColumn(f"_c{i}", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
    per_cell = spread.groupBy(*(f"_c{i}" for i in range(len(axes)))).agg(F.count("*").alias("n"))
    return per_cell.agg(F.count("*").alias("cells"), F.sum("n").alias("entries"), F.max("n").alias("max_per_cell"))


def cell_size(boxes: DataFrame, axes=AXES3) -> DataFrame:
    """Grid pitch for a set of boxes: the longest extent, at least one."""
    extents = [F.col(hi) - F.col(lo) for lo, hi in axes]
    return boxes.agg(F.greatest(F.max(F.greatest(*extents)), F.lit(1.0)).alias("cell"))
