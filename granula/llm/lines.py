"""Line dedup: lines that many documents share are dropped everywhere.

The distinct line keys of the corpus are sharded by hash. Each shard is indexed once by a
minimal perfect hash, whose numbers address two compact arrays: a 32-bit fingerprint and the
number of documents with the line. Chunks of documents send their distinct line hashes to the
shards (a line that a third of all documents share goes once per chunk), probe the arrays, and
get one bit per hash back; no line is joined with another.

A line's key is the line without blanks and controls (tab to carriage return) at both ends, A-Z
in lower case, hashed to 128 bits. A probe is certain of its own line: it was indexed, and the
64 low and 64 high hash bits place it.

Defined cases: null counts as one empty line and stays null, empty stays empty; empty keys are
never dropped; a repeated row counts as one more document; columns named like the results are
replaced; a key found in just as many documents as the limit is dropped; a task holds one very long text
whole; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import cells
from .base import keep, partitions, query, table
from .mph import Mph, mix

PAIR = np.dtype([("high", "<u8"), ("low", "<u8")])
RESULTS = ["n_lines", "n_dropped", "kept_sha256"]


def keyed(texts: list) -> tuple[list[list[bytes]], list[np.ndarray], np.ndarray]:
    """Lines of every text, per text the numbers of its line keys (0: empty key), and the hashes by number."""
    index: dict[bytes, int] = {b"": 0}
    lines, numbers = [], []
    for t in texts:
        own = (t or "").encode().split(b"\n")
        lines.append(own)
        numbers.append(np.fromiter((index.setdefault(x.strip().lower(), len(index)) for x in own), np.int64, len(own)))
    digests = b"".join(map(xxhash.xxh3_128_digest, index))
    return lines, numbers, np.frombuffer(digests, PAIR)


def by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all non-empty keys, shard after shard, and where each shard ends."""
    shard = (mix(hashes["high"]) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard[1:], kind="stable") + 1
    return order, np.searchsorted(shard[order], np.arange(shards), side="right")


def build(group: pa.Table) -> pa.Table:
    """Index one shard: add up documents per hash, number the hashes, fill both arrays."""
    parts = [cells.unzip_bytes(d) for d in group["data"].to_pylist()]
    n = [len(p) // (PAIR.itemsize + 4) for p in parts]
    pairs = np.concatenate([np.frombuffer(p, PAIR, k) for p, k in zip(parts, n)])
    docs = np.concatenate([np.frombuffer(p, "<u4", k, k * PAIR.itemsize) for p, k in zip(parts, n)])
    order = np.lexsort((pairs["low"], pairs["high"]))
    pairs, docs = pairs[order], docs[order]
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    starts = np.flatnonzero(new)
    keys, count = pairs[starts], np.add.reduceat(docs.astype(np.int64), starts)
    hashed = Mph.build(keys["high"], keys["low"])
    at = hashed(keys["high"], keys["low"])
    prints, counts = np.empty(len(keys), "<u4"), np.empty(len(keys), "<i8")
    prints[at], counts[at] = keys["low"] >> np.uint64(32), count
    return pa.table({"bucket": group["bucket"][:1], "sizes": [hashed.sizes.tobytes()], "words": [hashed.words.tobytes()], "prints": [prints.tobytes()], "counts": [counts.astype("<u4").tobytes()]})


def line_index(asked: DataFrame) -> DataFrame:
    """One row per shard: the hash and its arrays."""
    return keep(asked.groupBy("bucket").applyInArrow(build, "bucket int, sizes binary, words binary, prints binary, counts binary"))


def probe(asked: DataFrame, index: DataFrame, min_docs: int) -> DataFrame:
    """Per chunk and shard, one bit per hash: is the line in ``min_docs`` documents or more?"""

    def run(group: pa.Table, shard: pa.Table) -> pa.Table:
        row = shard.slice(0, 1).to_pylist()[0]
        hashed = Mph(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["words"], "<u8"))
        prints, counts = np.frombuffer(row["prints"], "<u4"), np.frombuffer(row["counts"], "<u4")
        out = []
        for chunk, data in zip(group["chunk"].to_pylist(), group["data"].to_pylist()):
            data = cells.unzip_bytes(data)
            pairs = np.frombuffer(data, PAIR, len(data) // (PAIR.itemsize + 4))
            at = hashed(pairs["high"], pairs["low"])
            often = (at >= 0) & (prints[at] == pairs["low"] >> np.uint64(32)) & (counts[at] >= min_docs)
            out.append((chunk, row["bucket"], np.packbits(often).tobytes(), 1))
        return cells.cells(out)

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(run, cells.SCHEMA)


def drop_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, carry: list[str] | None = None, digest: bool = False) -> DataFrame:
    """``docs`` with shared lines dropped from ``text``, ``n_lines`` (before) and ``n_dropped``; or the kept text's SHA-256."""
    shards = partitions(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    docs = docs.select(*dict.fromkeys([*carry, text]))

    def ask(rows: pa.Table):
        _, numbers, hashes = keyed(rows[text].to_pylist())
        docs_of = np.bincount(np.concatenate([np.unique(n) for n in numbers]) if numbers else [], minlength=len(hashes))
        order, ends = by_shard(hashes, shards)
        return rows, [(s, cells.zip_bytes(hashes[order[a:e]].tobytes() + docs_of[order[a:e]].astype("<u4").tobytes())) for s, (a, e) in enumerate(zip([0, *ends], ends)) if e > a]

    def finish(rows: pa.Table, got: list[dict[int, bytes]], _chunk: int) -> pa.Table:
        lines, numbers, hashes = keyed(rows[text].to_pylist())
        order, ends = by_shard(hashes, shards)
        often = np.zeros(len(hashes), bool)
        for s, (a, e) in enumerate(zip([0, *ends], ends)):
            if e > a:
                often[order[a:e]] = np.unpackbits(np.frombuffer(got[0][s], np.uint8), count=e - a)
        gone = [often[n] for n in numbers]
        kept = [b"\n".join(x for x, g in zip(own, drop) if not g) if drop.any() else b"\n".join(own) for own, drop in zip(lines, gone)]
        out = rows.select(carry)
        if not digest:
            texts = pa.array([None if t is None else k.decode() for t, k in zip(rows[text].to_pylist(), kept)], pa.string())
            out = out.set_column(out.schema.get_field_index(text), text, texts)
        out = out.append_column("n_lines", pa.array([len(x) for x in lines], pa.int64())).append_column("n_dropped", pa.array([int(g.sum()) for g in gone], pa.int64()))
        return out.append_column("kept_sha256", pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())) if digest else out

    if not digest and text not in carry:
        raise ValueError("the text column must be carried where lines are dropped from it")
    stored, asked = cells.split(docs, ask)
    replies = probe(asked, line_index(asked), min_docs)
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), *([T.StructField("kept_sha256", T.StringType())] if digest else [])])
    return cells.meet(stored, [replies], finish, schema)


SQL_OP4 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (SELECT k.r, k.i, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key),
s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY r)
SELECT d.doc_id, s.n_lines, s.n_dropped, sha256(s.kept) AS kept_sha256 FROM d JOIN s ON d.r = s.r
"""


@query("op4_line_dedup", SQL_OP4)
def op4(spark, sf_dir):
    return drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"], digest=True)
