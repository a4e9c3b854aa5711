"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of partial scores over ``lists`` groups of dimensions. Phase one gathers
each list's k best partial scores per query and resolves those candidates exactly: their k-th
best total is a safe cutoff, for at least k rows reach it. Phase two sends every query its
cutoff c; a row whose total reaches c has at least one partial of c / lists or more, so only
such entries are collected. Phase three adds up the remaining lists of what was collected and
keeps the k best; ties go to the smaller id.

Queries and rows meet in blocks: both are packed into matrices of bounded size, and every
(query block, row block) cell is a task's worth of work of its own. Several query blocks travel
together where there are cells enough for all tasks, so a row block is copied once per group of
them. Cutoffs travel with the query blocks; both copied sides are shuffled, so nothing that grows
is broadcast, and a row that many copies share spreads over blocks like any other.

Defined cases: vectors that are null or hold null, infinite or NaN components take no part;
shorter vectors count as padded with zeros, an empty one scores 0 with all; of rows with
the same id each is a row of its own, except that a query never meets rows of its own id;
components are floored to 64-bit whole numbers, scores are exact between -2 ** 62 and 2 ** 62;
equal scores go to the smaller id; other columns are not read, whatever their names; no queries or no
rows give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.session import shuffled

from .base import keep, partitions, query, table

QUERIES_A_BLOCK, ROWS_A_BLOCK = 512, 4_096
# Numbers of query blocks that travel as one, at most; and so many cells should be left for a task.
GROUP, CELLS_A_TASK = 16, 4
LOW = -(1 << 62)
PACKED = "block long, ids binary, m binary, kind string, dim int, cutoff binary"


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id and components floor(scale * x); rows that cannot take part are dropped."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    return rows.filter(F.col(key).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"), F.lit(LOW).alias("cutoff"))


def blocks(rows: DataFrame, number: int) -> DataFrame:
    """Pack rows into ``number`` matrices by hash of their id; inside, rows stand in order of id, then components."""

    def pack(group: pa.Table) -> pa.Table:
        v = group["v"].combine_chunks()
        lengths = np.diff(v.offsets.to_numpy())
        dim = int(lengths.max(initial=0))
        m = np.zeros((group.num_rows, dim), np.int64)
        m[np.arange(dim) < lengths[:, None]] = v.flatten().to_numpy()
        ids, cutoff = group["id"].to_numpy(), group["cutoff"].to_numpy()
        order = np.lexsort([*m.T[::-1], ids])
        top = int(np.abs(m).max(initial=0))
        kind = "int16" if 0 <= top < 1 << 15 else "int32" if 0 <= top < 1 << 31 else "int64"
        return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int64()), "ids": [ids[order].tobytes()], "m": [m[order].astype(kind).tobytes()],
                         "kind": [kind], "dim": pa.array([dim], pa.int32()), "cutoff": [cutoff[order].tobytes()]})

    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(number))).groupBy("block").applyInArrow(pack, PACKED)


def matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["m"], row["kind"]).reshape(len(ids), row["dim"])


def partials(q: np.ndarray, c: np.ndarray, lists: int) -> list[np.ndarray]:
    """Partial scores by list of dimensions; floating point only where every sum is an exact whole number."""
    dim = min(q.shape[1], c.shape[1])
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(dim, 1)
    kind = np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64
    cuts = [dim * i // lists for i in range(lists + 1)]
    return [q[:, a:b].astype(kind) @ c[:, a:b].T.astype(kind) for a, b in zip(cuts, cuts[1:])]


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Mask of each row's k best scores, ties to the left."""
    if score.shape[1] <= k:
        return np.ones(score.shape, bool)
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1:k]
    above, level = score > least, score == least
    return above | (level & (np.cumsum(level, 1) <= k - above.sum(1, keepdims=True)))


def cell(q: dict, c: dict, k: int, lists: int, phase: int) -> pa.RecordBatch:
    """One query block against one row block: what its score lists yield, resolved exactly."""
    qid, qm = matrix(q)
    cid, cm = matrix(c)
    parts = partials(qm, cm, lists)
    other = qid[:, None] != cid[None, :]
    found = np.zeros(other.shape, bool)
    cutoff = np.frombuffer(q["cutoff"], np.int64)[:, None]
    for p in parts:
        if phase == 1:  # the k best of this list
            found |= best(np.where(other, p, p.dtype.type(-np.inf) if p.dtype.kind == "f" else LOW), k)
        else:  # at least an even share of the cutoff
            found |= p >= -(-cutoff // lists)
    row, col = np.nonzero(found & other)
    score = sum(p[row, col].astype(np.int64) for p in parts)
    keep_ = score >= cutoff[row, 0]
    row, col, score = row[keep_], col[keep_], score[keep_]
    order = np.lexsort((col, -score, row))  # rows of a block stand in order of id
    row, col, score = row[order], col[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, col, score = (x[rank < k] for x in (row, col, score))
    return pa.RecordBatch.from_arrays([pa.array(row + (q["block"] << 32), pa.int64()), pa.array(qid[row], pa.int64()), pa.array(cid[col], pa.int64()), pa.array(score, pa.int64())], ["q", "query_id", "vec_id", "score"])


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64, lists: int = 4) -> DataFrame:
    """Each query's k best rows of another id: query_id, rank, vec_id, score."""
    asked = keep(whole_vectors(queries, key, vector, scale))
    known = keep(whole_vectors(rows, key, vector, scale))
    nq, nc = max(1, -(-asked.count() // QUERIES_A_BLOCK)), max(1, -(-known.count() // ROWS_A_BLOCK))
    packed = keep(blocks(known, nc))
    row = F.struct("block", "ids", "m", "kind", "dim", "cutoff")
    group = max(1, min(GROUP, nq * nc // (CELLS_A_TASK * partitions(rows.sparkSession))))
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    right = packed.select(row.alias("c"), F.col("block").alias("cb"), copies(-(-nq // group)).alias("qb"))

    def hits(asked: DataFrame, phase: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    pair = batch.slice(i, 1).to_pylist()[0]
                    for q in pair["q"]:
                        yield cell(q, pair["c"], k, lists, phase)

        left = blocks(asked, nq).groupBy(F.expr(f"block div {group}").alias("qb")).agg(F.collect_list(row).alias("q")).select("q", "qb", copies(nc).alias("cb"))
        # Both sides hold many copies of their input, which Spark's estimates for a broadcast do not see.
        found = shuffled(left).join(shuffled(right), ["qb", "cb"]).select("q", "c").mapInArrow(run, "q long, query_id long, vec_id long, score long")
        w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    first = hits(asked, 1).groupBy("q", "query_id").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    # of repeated query ids, the lowest cutoff is safe for all
    cutoffs = first.groupBy(F.col("query_id").alias("id")).agg(F.min(F.when(F.col("n") == k, F.col("score")).otherwise(F.lit(LOW))).alias("least"))
    second = asked.join(cutoffs, "id", "left").select("id", "v", F.coalesce("least", F.lit(LOW)).alias("cutoff"))
    return hits(second, 2).select("query_id", "rank", "vec_id", "score")


SQL_OP3 = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op3_exact_top_k", SQL_OP3)
def op3(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.filter("vec_id % 20 = 0"))
