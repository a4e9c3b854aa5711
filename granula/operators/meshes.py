"""Triangle meshes as a flat ``tri`` table.

One row per triangle: mesh_id, part_id, fid, ia, ib, ic (vertex ids) and the corner
coordinates ax..cz. All measures are grouped sums or extrema, so they combine
map-side and a mesh holding most of the triangles spreads over every task.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import solids as S
from ..functions.vec import div, norm2, scale, sub, vec
from ..session import cut, shuffled
from .components import connected_components
from .ordered import numbered, running

CORNERS = ("a", "b", "c")
# A shell whose signed sum vanishes to this share of its absolute sum encloses nothing; an
# exact zero would depend on the order of the additions.
ZERO_VOLUME = 1e-12
# Meshes of so many faces at most are labelled where their faces have come together, larger ones by joins.
WHOLE = 4096


def corners(tri: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per triangle corner: keys, vid, x, y, z."""
    items = [F.struct(F.col("i" + p).alias("vid"), *(F.col(p + k).alias(k) for k in "xyz")) for p in CORNERS]
    return tri.select(*keys, F.explode(F.array(*items)).alias("v")).select(*keys, "v.*")


def vertices(tri: DataFrame, keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """The distinct vertices of each mesh."""
    return corners(tri, keys).groupBy(*keys, "vid").agg(*(F.first(k).alias(k) for k in "xyz"))


def bbox(tri: DataFrame, keys: Sequence[str] = ("mesh_id",), *more: Column) -> DataFrame:
    """Bounding boxes x0..z1; ``more`` are further aggregates."""
    def ext(fn, pick, k):
        return fn(pick(*(F.col(p + k) for p in CORNERS)))

    return tri.groupBy(*keys).agg(
        *(ext(F.min, F.least, k).alias(k + "0") for k in "xyz"),
        *(ext(F.max, F.greatest, k).alias(k + "1") for k in "xyz"), *more)


def vertex_centroid(tri: DataFrame, keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Mean of the distinct vertices."""
    return vertices(tri, keys).groupBy(*keys).agg(*(F.avg(k).alias("c" + k) for k in "xyz"))


def measures(tri: DataFrame, keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Faces, signed and absolute volume, surface area and volume centroid."""
    a, b, c = vec("a"), vec("b"), vec("c")
    flux = S.tri_flux(a, b, c)
    work = tri.withColumn("_v", flux)
    sums = work.groupBy(*keys).agg(
        F.count("*").alias("faces"),
        F.sum("_v").alias("signed_volume"),
        F.sum(S.tri_area(a, b, c)).alias("area"),
        *(F.sum(F.col("_v") * (F.col("a" + k) + F.col("b" + k) + F.col("c" + k)) / 4.0).alias("_m" + k) for k in "xyz"))
    return sums.select(
        *keys, "faces", "signed_volume", F.abs("signed_volume").alias("volume"), "area",
        *(div(F.col("_m" + k), F.col("signed_volume")).alias("g" + k) for k in "xyz"))


def shape_columns(df: DataFrame) -> DataFrame:
    """Equivalent diameter and sphericity from volume and area."""
    return (df.withColumn("equivalent_diameter", S.equivalent_diameter(F.col("volume")))
              .withColumn("sphericity", S.sphericity(F.col("volume"), F.col("area"))))


def edges(tri: DataFrame, keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Undirected edges with their face count and summed direction."""
    items = [F.struct(F.col("i" + p).alias("s"), F.col("i" + q).alias("e")) for p, q in ("ab", "bc", "ca")]
    each = tri.select(*keys, F.explode(F.array(*items)).alias("d"))
    return each.groupBy(*keys, F.least("d.s", "d.e").alias("lo"), F.greatest("d.s", "d.e").alias("hi")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d.s") < F.col("d.e"), 1).otherwise(-1)).alias("direction"))


def face_shells(tri: DataFrame, keys: Sequence[str] = ("mesh_id",), share: str = "vertex") -> DataFrame:
    """Label faces with their shell: faces sharing a vertex (or, for ``edge``, an edge).

    Returns keys, fid, shell, where shell is the smallest fid of the shell.
    """
    if share == "vertex":
        incid = corners(tri, [*keys, "fid"]).select(*keys, F.col("vid").alias("lo"), F.col("vid").alias("hi"), "fid")
    else:
        items = [F.struct(F.least("i" + p, "i" + q).alias("lo"), F.greatest("i" + p, "i" + q).alias("hi"))
                 for p, q in ("ab", "bc", "ca")]
        incid = tri.select(*keys, F.explode(F.array(*items)).alias("hinge"), "fid").select(*keys, "hinge.*", "fid")
    # Chain the faces around a hinge through its first face: a hinge of n faces gives n-1 links, not n^2.
    first = incid.groupBy(*keys, "lo", "hi").agg(F.min("fid").alias("u"))
    links = shuffled(incid).join(first, [*keys, "lo", "hi"]).filter(F.col("fid") != F.col("u"))
    links = links.select(*keys, "u", F.col("fid").alias("v"))
    cc = connected_components(links, tri.select(*keys, F.col("fid").alias("node")), keys)
    return cc.select(*keys, F.col("node").alias("fid"), F.col("component").alias("shell"))


def _smallest_linked(n: np.ndarray, ok: np.ndarray, hinges: np.ndarray, fid: np.ndarray) -> np.ndarray:
    """Smallest fid of the faces of one list that hinges chain together: ``n`` faces a list, ``hinges`` (faces, per face, 2), ``ok`` marks those that count."""
    row = np.repeat(np.arange(len(n)), n)
    face, which = np.nonzero(ok)
    # a face links to its hinges and to rows of its own number
    own = np.zeros(len(fid), "i8")
    parts = [(row[face], *hinges[face, which].T, np.zeros(len(face), "i8")), (row, fid, own, own + 1)]
    columns = [np.concatenate(c) for c in zip(*parts)]
    face = np.concatenate([face, np.arange(len(fid))])
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), bool)
    for c in columns:
        fresh[1:] |= np.diff(c[order]) != 0
    face, hinge = face[order], np.cumsum(fresh)
    starts = np.flatnonzero(np.diff(hinge, prepend=-1))
    by_face = np.argsort(face, kind="stable")
    firsts = np.flatnonzero(np.diff(face[by_face], prepend=-1))
    label = fid
    while len(fid):
        low = np.minimum.reduceat(label[face], starts)
        lower = np.minimum.reduceat(low[hinge[by_face]], firsts)
        if (lower == label).all():
            break
        label = lower
    return label


def _hinges(share: str) -> tuple[list[Column], list[Column]]:
    """The two ends of each of a face's three hinges, and whether the hinge counts."""
    if share == "vertex":
        ends = [(F.col("i" + p), F.lit(0).cast("bigint")) for p in CORNERS]
    else:
        ends = [(F.least("i" + p, "i" + q), F.greatest("i" + p, "i" + q)) for p, q in ("ab", "bc", "ca")]
    hinges = [F.coalesce(e.cast("bigint"), F.lit(0)) for pair in ends for e in pair]
    return hinges, [F.coalesce(lo.isNotNull() & hi.isNotNull(), F.lit(False)) for lo, hi in ends]


def _labelled(tri: DataFrame, keys: list[str], share: str) -> DataFrame:
    """``with_shells`` of meshes of ``WHOLE`` faces at most: the faces of a mesh come together once."""
    hinges, known = _hinges(share)
    rest = [c for c in tri.columns if c not in keys]
    rows = tri.dropna(subset=[*keys, "fid"]).groupBy(*keys).agg(F.collect_list(F.struct(*rest, F.array(*hinges).alias("_hinges"), F.array(*known).alias("_known"))).alias("_f"))

    @F.arrow_udf("array<bigint>")
    def label(fid: pa.Array, hinges: pa.Array, known: pa.Array) -> pa.Array:
        ids = fid.flatten().to_numpy()
        n = fid.value_lengths().to_numpy()
        found = _smallest_linked(n, known.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3), hinges.flatten().to_numpy().reshape(-1, 3, 2), ids)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(found))

    marked = rows.withColumn("_shell", label(F.col("_f.fid").cast("array<bigint>"), F.flatten("_f._hinges"), F.flatten("_f._known")))
    each = marked.select(*keys, F.explode(F.arrays_zip("_f", "_shell")).alias("_z"))
    return each.select(*keys, *(F.col(f"_z._f.{c}").alias(c) for c in rest), F.col("_z._shell").cast(tri.schema["fid"].dataType).alias("shell")).select(*_order(tri, keys), "shell")


def _codes(keys: list[pa.Array], n: int) -> np.ndarray:
    """Equal numbers for rows with equal keys."""
    code = np.zeros(n, np.int64)
    for k in keys:
        if pa.types.is_nested(k.type):
            listed, seen = k.to_pylist(), {}
            own = np.array([seen.setdefault(repr(v), len(seen)) for v in listed], np.int64)
        else:
            own = k.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1].ravel().astype(np.int64)
    return code


def _contracted(tri: DataFrame, keys: list[str], share: str) -> DataFrame:
    """``with_shells`` of large meshes: faces that a batch of rows already links become one node of the graph.

    Of a hinge only one row for each batch and node travels; a node is named by its smallest fid.
    """
    hinges, known = _hinges(share)
    ask = lambda df: df.select("*", F.array(*hinges).alias("_hinges"), F.array(*known).alias("_known"), F.col("fid").cast("bigint").alias("_fid"))
    schema = T.StructType([*tri.schema.fields, T.StructField("_node", T.LongType())])
    names = tri.columns

    def parts(batch):
        n = batch.num_rows
        code = _codes([batch.column(k) for k in keys], n)
        return n, code, batch.column("_known").flatten().to_numpy(zero_copy_only=False).reshape(n, 3), batch.column("_hinges").flatten().to_numpy().reshape(n, 3, 2), batch.column("_fid").to_numpy()

    def label(batches):
        for batch in batches:
            if batch.num_rows:
                n, code, ok, ends, fid = parts(batch)
                order = np.argsort(code, kind="stable")
                node = np.empty(n, np.int64)
                node[order] = _smallest_linked(np.bincount(code), ok[order], ends[order], fid[order])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(node)], [*names, "_node"])

    def met(batches):
        """Distinct (keys, hinge, node) of a batch; a fid is a hinge, too: rows of one fid are one face."""
        for batch in batches:
            if batch.num_rows:
                n, code, ok, ends, fid = parts(batch)
                node = batch.column("_node").to_numpy()
                face, which = np.nonzero(ok)
                none = np.zeros(n, np.int64)
                row = np.concatenate([face, np.arange(n)])
                columns = [np.concatenate(c) for c in ((np.zeros(len(face), np.int64), none + 1), (ends[face, which, 0], fid), (ends[face, which, 1], none), (node[face], node))]
                order, begin = _runs(code[row], *columns)
                pick = order[begin]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row[pick])) for k in keys), *(pa.array(c[pick]) for c in columns)], [*keys, "_kind", "_lo", "_hi", "v"])

    faces = cut(ask(tri.dropna(subset=[*keys, "fid"])).mapInArrow(label, schema))
    hinge = ["_kind", "_lo", "_hi", "v"]
    seen = ask(faces).select(*keys, "_hinges", "_known", "_fid", "_node").mapInArrow(met, T.StructType([*(tri.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in hinge)]))
    links = seen.withColumn("u", F.min("v").over(Window.partitionBy(*keys, *hinge[:3]))).filter("u <> v").select(*keys, "u", "v")
    found = connected_components(links, None, keys).withColumnRenamed("node", "_node")
    shell = F.coalesce("component", "_node").cast(tri.schema["fid"].dataType).alias("shell")
    return faces.join(found, [*keys, "_node"], "left").select(*_order(tri, keys), shell)


def _order(tri: DataFrame, keys: list[str]) -> list[str]:
    """Columns as a join on keys and fid leaves them."""
    return [*keys, "fid", *(c for c in tri.columns if c not in keys and c != "fid")]


def with_shells(tri: DataFrame, keys: Sequence[str] = ("mesh_id",), share: str = "vertex") -> DataFrame:
    """Add ``shell``, the label of ``face_shells``, to every face that has keys and a fid."""
    keys = list(keys)
    whole = all(t in ("int", "bigint") for c, t in tri.dtypes if c in ("fid", "ia", "ib", "ic"))
    large = cut(tri.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > (WHOLE if whole else 0)).select(*keys))
    if large.isEmpty():
        return _labelled(tri, keys, share)
    some = tri.join(large, keys, "left_semi")
    if not whole:
        return shuffled(some).join(face_shells(some, keys, share), [*keys, "fid"])
    few = tri.dropna(subset=keys).join(large, keys, "left_anti")
    return _labelled(few, keys, share).unionByName(_contracted(some, keys, share))


def _defects(tri: DataFrame, keys: list[str], shells: bool) -> DataFrame:
    """What ``closedness`` judges by, for meshes of any size: joins and grouped sums."""
    finite = [~(F.isnan(c) | (F.abs(c) == float("inf"))) for p in CORNERS for c in vec(p)]
    bad = finite[0]
    for f in finite[1:]:
        bad = bad & f
    per_face = tri.withColumn("_finite", bad).withColumn(
        "_deg", (F.col("ia") == F.col("ib")) | (F.col("ib") == F.col("ic")) | (F.col("ic") == F.col("ia"))).withColumn(
        "_key", F.array_sort(F.array("ia", "ib", "ic")))
    face_first = per_face.groupBy(*keys, "_key").agg(
        F.count("*").alias("copies"), F.min("fid").alias("fid0"),
        F.min(F.when(~F.col("_finite"), F.col("fid"))).alias("nf"),
        F.min(F.when(F.col("_deg"), F.col("fid"))).alias("deg"))
    faces = face_first.groupBy(*keys).agg(
        F.min("nf").alias("nonfinite_fid"), F.min("deg").alias("degenerate_fid"),
        F.sum(F.col("copies") - 1).alias("repeated"))
    e = edges(tri, keys).groupBy(*keys).agg(
        F.sum((F.col("n") == 1).cast("long")).alias("open_edges"),
        F.sum((F.col("n") > 2).cast("long")).alias("nonmanifold_edges"),
        F.sum(((F.col("n") == 2) & (F.col("direction") != 0)).cast("long")).alias("inconsistent_edges"))
    out = faces.join(e, list(keys)).withColumn("flat", F.lit(0))
    if shells:
        flux = S.tri_flux(vec("a"), vec("b"), vec("c"))
        vol = (with_shells(tri, keys, share="edge").groupBy(*keys, "shell")
               .agg(F.sum(flux).alias("v"), F.sum(F.abs(flux)).alias("w"))
               .groupBy(*keys).agg(F.max((F.isnan("v") | (F.abs("v") <= F.col("w") * ZERO_VOLUME)).cast("int")).alias("flat")))
        out = out.drop("flat").join(vol, list(keys))
    return out.select(*keys, F.col("nonfinite_fid").isNotNull().alias("nonfinite"), F.col("degenerate_fid").isNotNull().alias("degenerate"),
                      "repeated", "open_edges", "nonmanifold_edges", "inconsistent_edges", (F.col("flat") == 1).alias("flat"))


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows together, and where each run of them begins."""
    order = np.lexsort(columns[::-1])
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([np.diff(c[order]) != 0 for c in columns])
    return order, np.flatnonzero(fresh)


def _counted(n: np.ndarray, fid: np.ndarray, ids: np.ndarray, flux: np.ndarray, shells: bool) -> list[np.ndarray]:
    """Repeated faces, open, non-manifold and inconsistent edges, and whether a shell is flat, of meshes of ``n`` faces each."""
    row = np.repeat(np.arange(len(n)), n)
    per = lambda r: np.bincount(r, minlength=len(n))
    order, begin = _runs(row, *np.sort(ids, 1).T)
    repeated = n - per(row[order][begin])
    s, e = ids.ravel(), ids[:, [1, 2, 0]].ravel()
    lo, hi, each = np.minimum(s, e), np.maximum(s, e), np.repeat(row, 3)
    order, begin = _runs(each, lo, hi)
    faces = np.diff(begin, append=len(order))
    turn = np.add.reduceat(np.where(s < e, 1, -1)[order], begin) if len(begin) else begin
    owner = each[order][begin]
    out = [repeated, per(owner[faces == 1]), per(owner[faces > 2]), per(owner[(faces == 2) & (turn != 0)])]
    if not shells:
        return [*out, np.zeros(len(n), bool)]
    hinges = np.stack([lo, hi], 1).reshape(-1, 3, 2)
    order, begin = _runs(row, _smallest_linked(n, np.ones((len(fid), 3), bool), hinges, fid))
    with np.errstate(invalid="ignore"):
        v, w = (np.add.reduceat(x[order], begin) if len(begin) else x for x in (flux, np.abs(flux)))
        thin = np.isnan(v) | (np.abs(v) <= w * ZERO_VOLUME)
    return [*out, per(row[order][begin][thin]) > 0]


def _whole_defects(tri: DataFrame, keys: list[str], shells: bool) -> DataFrame:
    """``_defects`` of meshes of ``WHOLE`` faces at most, without nulls: faces come together once, without their corners."""
    a, b, c = vec("a"), vec("b"), vec("c")
    finite = F.lit(True)
    for x in (*a, *b, *c):
        finite = finite & ~(F.isnan(x) | (F.abs(x) == float("inf")))
    face = F.struct(*(F.col(i).cast("bigint").alias(i) for i in ("fid", "ia", "ib", "ic")), S.tri_flux(a, b, c).alias("flux"))
    rows = tri.groupBy(*keys).agg(F.collect_list(face).alias("_f"), (~F.min(finite)).alias("nonfinite"),
                                  F.max((F.col("ia") == F.col("ib")) | (F.col("ib") == F.col("ic")) | (F.col("ic") == F.col("ia"))).alias("degenerate"))
    names = ("repeated", "open_edges", "nonmanifold_edges", "inconsistent_edges")
    kind = f"struct<{', '.join(f'{n}: bigint' for n in names)}, flat: boolean>"

    @F.arrow_udf(kind)
    def judge(faces: pa.Array) -> pa.Array:
        f = faces.flatten()
        column = lambda i: f.field(i).to_numpy(zero_copy_only=False)
        found = _counted(faces.value_lengths().to_numpy(), column(0), np.stack([column(i) for i in (1, 2, 3)], 1), column(4), shells)
        return pa.StructArray.from_arrays([*(pa.array(x.astype("i8")) for x in found[:4]), pa.array(found[4])], [*names, "flat"])

    return rows.select(*keys, "nonfinite", "degenerate", judge("_f").alias("_j")).select(*keys, "nonfinite", "degenerate", "_j.*")


def closedness(tri: DataFrame, keys: Sequence[str] = ("mesh_id",), shells: bool = True) -> DataFrame:
    """NULL reason for a closed, consistently wound mesh; otherwise the first rule it breaks.

    Rules are tried in a fixed order: non-finite coordinate, degenerate face, repeated
    face, open edge, edge of three or more faces, inconsistent winding, and (when
    ``shells``) an edge-connected shell enclosing zero volume.
    """
    keys = list(keys)
    out = None
    if all(t in ("int", "bigint") for c, t in tri.dtypes if c in ("fid", "ia", "ib", "ic")):
        known = F.lit(True)
        for c in ("fid", "ia", "ib", "ic", *(p + k for p in CORNERS for k in "xyz")):
            known = known & F.col(c).isNotNull()
        others = cut(tri.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(known).alias("_known")).filter((F.col("_n") > WHOLE) | ~F.col("_known")).select(*keys).dropna())
        some = tri.dropna(subset=keys)
        if others.isEmpty():
            out = _whole_defects(some, keys, shells)
        else:
            out = _whole_defects(some.join(others, keys, "left_anti"), keys, shells).unionByName(_defects(tri.join(others, keys, "left_semi"), keys, shells))
    if out is None:
        out = _defects(tri, keys, shells)
    reason = (F.when(F.col("nonfinite"), F.lit("non-finite coordinate"))
              .when(F.col("degenerate"), F.lit("degenerate face"))
              .when(F.col("repeated") > 0, F.lit("repeated face"))
              .when(F.col("open_edges") > 0, F.format_string("open: %d edge(s)", "open_edges"))
              .when(F.col("nonmanifold_edges") > 0, F.format_string("non-manifold: %d edge(s)", "nonmanifold_edges"))
              .when(F.col("inconsistent_edges") > 0, F.format_string("winding: %d edge(s)", "inconsistent_edges"))
              .when(F.col("flat"), F.lit("zero-volume shell")))
    return out.select(*keys, "open_edges", "nonmanifold_edges", "inconsistent_edges", reason.alias("reason"))


def metrics(tri: DataFrame, keys: Sequence[str] = ("mesh_id",), shells: bool = True) -> DataFrame:
    """Volume, area, diameter and sphericity; NULL unless the mesh is closed."""
    m = shape_columns(measures(tri, keys)).join(closedness(tri, keys, shells), list(keys))
    ok = F.col("reason").isNull()
    names = ("volume", "area", "equivalent_diameter", "sphericity")
    return m.select(*keys, *(F.when(ok, F.col(n)).alias(n) for n in names), "reason")


def orient(tri: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flip the winding of every part whose signed volume is negative; adds ``flipped``."""
    signs = tri.groupBy(*keys).agg((F.sum(S.tri_flux(vec("a"), vec("b"), vec("c"))) < 0).alias("flipped"))
    j = tri.join(signs, list(keys))
    flip = F.col("flipped")
    swapped = {}
    for k in ("i{}", "{}x", "{}y", "{}z"):
        b, c = k.format("b"), k.format("c")
        swapped[b] = F.when(flip, F.col(c)).otherwise(F.col(b))
        swapped[c] = F.when(flip, F.col(b)).otherwise(F.col(c))
    return j.select(*(swapped.get(n, F.col(n)).alias(n) for n in tri.columns), "flipped")


def weld(points: DataFrame, keys: Sequence[str], order_col: str, quantum: float = 1e6) -> DataFrame:
    """Vertex ids for coordinates that agree after ``round(c * quantum)``; the first coordinates win.

    Returns keys, qx, qy, qz, vid (the order value of the first occurrence) and x, y, z.
    """
    quant = [F.round(F.col(k) * quantum).cast("bigint").alias("q" + k) for k in "xyz"]
    # plain minima are added up in a hash table and drop out where nobody reads them; a minimum of structs would sort all points first
    return points.groupBy(*keys, *quant).agg(
        F.min(order_col).alias("vid"), *(F.min_by(k, order_col).alias(k) for k in "xyz"), F.count("*").alias("uses"))


def merge_offsets(parts: DataFrame, group: Sequence[str], order_col: str) -> DataFrame:
    """Vertex and face offsets of each part inside its merged mesh.

    ``parts`` has n_vertices and n_faces; offsets are running totals in part order.
    """
    return running(parts, group, [order_col], {"vertex_offset": "n_vertices", "face_offset": "n_faces"}, inclusive=False)


def scale_tri(tri: DataFrame, factor) -> DataFrame:
    """Uniform scaling about the origin."""
    return tri.select(*(((F.col(c) * factor).alias(c)) if c in {p + k for p in CORNERS for k in "xyz"} else F.col(c)
                        for c in tri.columns))


def map_corners(tri: DataFrame, fn) -> DataFrame:
    """Apply a vector function to every corner."""
    new = {}
    for p in CORNERS:
        v = fn(vec(p))
        new.update({p + k: c for k, c in zip("xyz", v)})
    return tri.select(*(new[c].alias(c) if c in new else F.col(c) for c in tri.columns))


def digest(tri: DataFrame, keys: Sequence[str] = ("mesh_id",), quantum: float = 1e6, block: int = 4096) -> DataFrame:
    """SHA-256 of each mesh's geometry: keys, faces, digest.

    The same for the same set of oriented faces, however they are numbered, ordered or partitioned:
    a face is its three corners, rounded to 1 / ``quantum``, from the least corner on in its winding; faces
    are hashed, sorted by hash, and hashed again in blocks of ``block``, and so on up to one hash. No task
    holds more than one block of a mesh. Repeated faces count; coordinates must be finite.
    """
    corner = {p: [F.round(F.col(p + k) * quantum).cast("bigint") for k in "xyz"] for p in "abc"}
    turns = F.array_min(F.array(*(F.array(*(c for p in turn for c in corner[p])) for turn in ("abc", "bca", "cab"))))
    keys, joined = list(keys), lambda hashes: F.sha2(F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ""), 256)
    leaves = tri.select(*keys, F.unhex(F.sha2(F.array_join(turns, ","), 256)).alias("h"))
    count = tri.groupBy(*keys).agg(F.count("*").alias("faces"))
    most = count.agg(F.max("faces")).first()[0] or 0
    rounds = max(1, next(r for r in range(64) if block ** r >= most))
    if most <= WHOLE:  # every mesh comes together once; its blocks are slices of one sorted list
        some = leaves.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("faces"), F.array_sort(F.collect_list("h")).alias("level"))
        for _ in range(rounds):
            starts = F.sequence(F.lit(1), F.greatest(F.size("level"), F.lit(1)), F.lit(block))
            some = some.withColumn("level", F.transform(starts, lambda i: F.unhex(joined(F.slice(F.col("level"), i, F.lit(block))))))
        return some.select(*keys, "faces", F.lower(F.hex(F.col("level")[0])).alias("digest"))
    ranked = cut(numbered(leaves, keys, ["h"], "n").withColumn("b", F.floor((F.col("n") - 1) / block)))
    level = ranked.select(*keys, "b", "h", "n")
    for r in range(rounds):
        if r:
            level = cut(level.select(*keys, F.floor(F.col("b") / block).alias("b"), "h", F.col("b").alias("n")))
        items = F.array_sort(F.collect_list(F.struct("n", "h")))
        level = level.groupBy(*keys, "b").agg(F.unhex(joined(F.transform(items, lambda i: i["h"]))).alias("h"))
    return level.select(*keys, F.lower(F.hex("h")).alias("digest")).join(count, keys).select(*keys, "faces", "digest")
