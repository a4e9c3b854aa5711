"""Tetrahedral mesh quality: aspect ratios, inverted cells, groups to repair together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import solids as S
from ..functions.vec import vec
from .components import connected_components


def quality(tets: DataFrame) -> DataFrame:
    """Add signed ``volume`` and aspect ``ratio`` (infinite when flat) from corners ax..dz."""
    c = [vec(p) for p in "abcd"]
    return tets.withColumn("volume", S.tet_volume(*c)).withColumn("ratio", K.batched(K.tet_ratio, *c))


def quality_summary(q: DataFrame, limit: float, padding=None) -> DataFrame:
    """Cells, inverted or flat cells, cells over the limit, and the worst finite ratio."""
    watched = q if padding is None else q.filter(~padding)
    finite = F.col("ratio") < float("inf")
    return watched.agg(
        F.count("*").alias("cells"),
        F.sum((F.col("volume") <= 1e-30).cast("bigint")).alias("inverted"),
        F.sum((F.col("ratio") > limit).cast("bigint")).alias("over_limit"),
        F.max(F.when(finite, F.col("ratio"))).alias("max_ratio"))


def repair_groups(q: DataFrame, tet_id: str, nodes: list[str]) -> DataFrame:
    """Inverted cells that share nodes, transitively: tet_id, group (smallest cell of the group)."""
    bad = q.filter(F.col("volume") <= 1e-30)
    incid = bad.select(tet_id, F.explode(F.array(*(F.col(n) for n in nodes))).alias("node"))
    first = incid.groupBy("node").agg(F.min(tet_id).alias("first"))
    links = incid.join(first, "node").filter(F.col(tet_id) != F.col("first")).select(F.col("first").alias("u"), F.col(tet_id).alias("v"))
    cc = connected_components(links, bad.select(F.col(tet_id).alias("node")))
    return cc.select(F.col("node").alias(tet_id), F.col("component").alias("group"))


def interface_faces(tets: DataFrame, tet_id: str, nodes: list[str], density: str) -> DataFrame:
    """Faces shared by two cells of different density: face, low, high."""
    combos = [(i, j, k) for i in range(4) for j in range(i + 1, 4) for k in range(j + 1, 4)]
    faces = F.array(*(F.array_sort(F.array(*(F.col(nodes[i]) for i in c))) for c in combos))
    each = tets.select(density, F.explode(faces).alias("face"))
    f = each.groupBy("face").agg(F.count("*").alias("n"), F.min(density).alias("low"), F.max(density).alias("high"))
    return f.filter("n = 2 AND low <> high").drop("n")
