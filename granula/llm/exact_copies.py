"""Exact copies by progressive refinement: length, then a hash of the head, then a hash of the whole text.

Documents are packed into chunks that are written once and never move. Beside them lies one slim
row per document: chunk, row, id, length and head (64 bytes) of the text with white space folded.
Each step is a grouped count over what the step before left, and a join back:

1. lengths that occur twice or more;
2. of those rows, pairs of length and head hash that occur twice or more;
3. of those rows, the whole texts, fetched from their chunks, as SHA-256; equal hash, equal text.

Only slim rows are shuffled. Counts combine map-side and are written before the join back, so a
length or text that a third of all rows share is a row split by adaptive execution, not a task.
The decisions, a few numbers for rows that have a copy, meet their chunk again.

Defined cases: null texts count as empty, and all empty texts are copies of each other; of rows
with equal ids (or only null ids) in a group exactly one stays, the first of the lowest chunk;
null ids come last, ``keep_id`` is null where all are; very long texts need a few times their own
size in one task; an empty table gives an empty result; further columns pass through, and those
named like the results are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import cells
from .base import SPACE, keep, partitions, query, table

HEAD = 64
RESULTS = ["keep_id", "group_size", "kept"]
BODY, SLIM = -1, 0


def folded(text: bytes | None) -> bytes:
    """UTF-8 text with every run of white space as one blank."""
    if not text:
        return b""
    out = b" ".join(text.split())
    if not out:
        return b" "
    return b" " * text[:1].isspace() + out + b" " * text[-1:].isspace()


def contents(rows: pa.Table, text: str) -> list[bytes]:
    return [folded(t) for t in rows[text].cast(pa.binary()).to_pylist()]


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """``docs`` with ``keep_id`` (id of the copy that stays), ``group_size`` and ``kept``."""
    carry = [c for c in docs.columns if c.lower() not in RESULTS or c in (key, text)]
    docs = docs.select(carry)
    kind = docs.schema[key].dataType
    id_type = to_arrow_type(kind)
    stored_schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("id", kind), T.StructField("length", T.LongType()),
                                  T.StructField("head", T.BinaryType()), T.StructField("data", T.BinaryType()), T.StructField("kind", T.IntegerType())])

    def pack(batches):
        first = TaskContext.get().partitionId() << 32
        for number, rows in enumerate(cells.chunks(batches, cells.CHUNK_BYTES)):
            texts, n = contents(rows, text), rows.num_rows
            body = [[first + number], [None], pa.nulls(1, id_type), [None], [None], [cells.to_stream(rows)], [BODY]]
            slim = [[first + number] * n, range(n), rows[key].combine_chunks().cast(id_type), [len(t) for t in texts], [t[:head] for t in texts], [None] * n, [SLIM] * n]
            for part in (body, slim):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.int32(), id_type, pa.int64(), pa.binary(), pa.binary(), pa.int32()))],
                                                 names=stored_schema.fieldNames())

    stored = keep(docs.mapInArrow(pack, stored_schema), "kind", bucketed=("chunk", partitions(docs.sparkSession)))
    bodies = stored.filter(F.col("kind") == BODY).select("chunk", "data")
    slim = stored.filter(F.col("kind") == SLIM).select("chunk", "row", "id", "length", "head")

    def several(rows: DataFrame, *by: str) -> DataFrame:
        found = keep(rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
        return rows.join(found, list(by))

    same_length = keep(several(slim, "length").select("chunk", "row", "length", F.xxhash64("head").alias("prefix")))
    same_head = several(same_length, "length", "prefix").select(F.col("chunk").alias("home"), "row")

    def read(mine: pa.Table, asked: pa.Table) -> pa.Table:
        """Hashes of the whole texts asked for."""
        chosen = asked["row"].to_numpy()
        if not len(chosen):
            return pa.table([[]] * 4, schema=hash_schema)
        rows = cells.from_stream(mine["data"][0].as_buffer()).select(list(dict.fromkeys([key, text]))).take(pa.array(chosen))
        full = [hashlib.sha256(t).digest() for t in contents(rows, text)]
        return pa.Table.from_arrays([pa.array([mine["chunk"][0].as_py()] * len(chosen), pa.int64()), asked["row"].cast(pa.int32()), rows[key].cast(id_type), pa.array(full, pa.binary())], schema=hash_schema)

    hash_schema = pa.schema([("chunk", pa.int64()), ("row", pa.int32()), ("id", id_type), ("full", pa.binary())])
    hashed_schema = T.StructType([stored_schema["chunk"], stored_schema["row"], stored_schema["id"], T.StructField("full", T.BinaryType())])
    hashed = keep(bodies.groupBy("chunk").cogroup(same_head.groupBy("home")).applyInArrow(read, hashed_schema))
    first = F.min(F.struct(F.isnull("id").alias("unnamed"), "id", "chunk", "row"))
    groups = keep(hashed.groupBy("full").agg(first.alias("first"), F.count("*").alias("group_size")).filter("group_size > 1"))
    stays = (F.col("first.chunk") == F.col("chunk")) & (F.col("first.row") == F.col("row"))
    told = hashed.join(groups, "full").select(F.col("chunk").alias("home"), "row", F.col("first.id").alias("keep_id"), "group_size", stays.alias("kept"))

    out_schema = T.StructType([*docs.schema, T.StructField("keep_id", kind), T.StructField("group_size", T.LongType()), T.StructField("kept", T.BooleanType())])

    def finish(mine: pa.Table, decided: pa.Table) -> pa.Table:
        rows = cells.from_stream(mine["data"][0].as_buffer())
        n, at = rows.num_rows, decided["row"].to_numpy()
        size, kept, source = np.ones(n, np.int64), np.ones(n, bool), np.arange(n)
        size[at], kept[at], source[at] = decided["group_size"].to_numpy(), decided["kept"].to_numpy(), n + np.arange(len(at))
        ids = pa.chunked_array([*rows[key].cast(id_type).chunks, *decided["keep_id"].cast(id_type).chunks], id_type).take(pa.array(source))
        for name, values in (("keep_id", ids), ("group_size", pa.array(size)), ("kept", pa.array(kept))):
            rows = rows.append_column(name, values)
        return rows

    return bodies.groupBy("chunk").cogroup(told.groupBy("home")).applyInArrow(finish, out_schema)


SQL_OP12 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""


@query("op12_exact_dedup", SQL_OP12)
def op12(spark, sf_dir):
    out = exact_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    content = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE + "+", " ")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.sha2(content, 256).alias("text_sha256"))
