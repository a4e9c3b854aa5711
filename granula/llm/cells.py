"""Chunks ask buckets: exchange of many small keys between documents and hash buckets.

A task packs its documents into chunks of bounded size. Of each chunk it keeps the
documents themselves (an Arrow stream, zstd) and, for every hash bucket, one cell: the
chunk's *distinct* keys of that bucket. A bucket sees the cells of all chunks, answers each
with one value per key (a bit, an id list), and the answers meet their chunk again.

What travels is a few bytes per distinct key of a chunk instead of a row per occurrence. A
key that sits in a third of all documents comes once per chunk, so no bucket is hot. Chunks
are written to the shared folder once, as a table bucketed by chunk: replies are shuffled to
it, the documents themselves never move again, and a lost executor never changes which
document sits in which chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import keep, partitions

CHUNK_BYTES = 24_000_000
SCHEMA = "chunk long, bucket int, data binary, kind int"
PLAIN = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("kind", pa.int32())])
DOCS, ASKS = -1, 0


def zip_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unzip_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def to_stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def from_stream(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def ends_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket ends among sorted 64-bit hashes; buckets are equal ranges of hashes."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets, dtype=np.uint64), side="right")


def pack_hashes(hashes: np.ndarray, flags: np.ndarray) -> bytes:
    """Sorted hashes and a bit each: differences, their bytes of a kind together, compressed."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    return zip_bytes(len(hashes).to_bytes(8, "little") + np.packbits(flags).tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = unzip_bytes(data)
    n = int.from_bytes(data[:8], "little")
    at = 8 + -(-n // 8)
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=at).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.unpackbits(np.frombuffer(data, np.uint8, at - 8, 8), count=n).astype(bool)


def ask_hashes(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """Distinct hashes, sorted, and their cells; a bit says that the chunk has the hash more than once."""
    keys, count = np.unique(hashes, return_counts=True)
    ends = ends_of(keys, buckets)
    return keys, [(b, pack_hashes(keys[a:e], count[a:e] > 1)) for b, (a, e) in enumerate(zip([0, *ends], ends)) if e > a]


def repeated(asked: list[bytes]) -> list[bytes]:
    """One bit per hash: does it occur twice or more in all chunks together?"""
    each = [unpack_hashes(d) for d in asked]
    every = np.sort(np.concatenate([k for k, _ in each]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for keys, own in each:
        at = np.searchsorted(twice, keys)
        at[at == len(twice)] = 0
        out.append(np.packbits(own | (twice[at] == keys if len(twice) else False)).tobytes())
    return out


def read_bits(keys: np.ndarray, got: dict[int, bytes], buckets: int) -> np.ndarray:
    """The replies' bits for all ``keys`` (sorted, distinct)."""
    ends, out = ends_of(keys, buckets), np.zeros(len(keys), bool)
    for b, (a, e) in enumerate(zip([0, *ends], ends)):
        if e > a:
            out[a:e] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=e - a)
    return out


def cells(rows: Iterable[tuple[int, int, bytes, int]]) -> pa.Table:
    chunk, bucket, data, kind = zip(*rows) if (rows := list(rows)) else ((), (), (), ())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip((chunk, bucket, data, kind), PLAIN.types)], schema=PLAIN)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Regroup the rows of a task into tables of about ``size`` bytes (one row at least)."""
    rest: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, size // per_row)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            rest.append(part)
            held += part.num_rows * per_row
            if held >= size:
                yield pa.Table.from_batches(rest)
                rest, held = [], 0
    if rest:
        yield pa.Table.from_batches(rest)


def split(docs: DataFrame, ask: Callable[[pa.Table], tuple[pa.Table, list[tuple[int, bytes]]]], size: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Pack ``docs`` into chunks; ``ask`` turns a chunk into what is kept of it and its (bucket, keys) cells.

    Returns the kept chunks and the cells, both read from the shared folder.
    """

    def pack(batches):
        first = TaskContext.get().partitionId() << 32
        for number, rows in enumerate(chunks(batches, size)):
            kept, asked = ask(rows)
            yield from cells([(first + number, -1, to_stream(kept), DOCS), *((first + number, b, d, ASKS) for b, d in asked)]).to_batches()

    stored = keep(docs.mapInArrow(pack, SCHEMA), "kind", bucketed=("chunk", partitions(docs.sparkSession)))
    return stored.filter(F.col("kind") == DOCS), stored.filter(F.col("kind") == ASKS)


def answer(asked: DataFrame, reply: Callable[[list[bytes]], list[bytes]], kind: int) -> DataFrame:
    """Per bucket, turn the chunks' keys into as many replies, in the same order."""

    def run(group: pa.Table) -> pa.Table:
        chunk, bucket = group["chunk"].to_pylist(), group["bucket"].to_pylist()
        return cells(zip(chunk, bucket, reply(group["data"].to_pylist()), [kind] * len(chunk)))

    return asked.groupBy("bucket").applyInArrow(run, SCHEMA)


def meet(kept: DataFrame, replies: list[DataFrame], finish: Callable[[pa.Table, list[dict[int, bytes]], int], pa.Table], schema) -> DataFrame:
    """Bring each chunk together with its replies; ``finish`` gets its documents and, per reply kind, data by bucket."""
    kinds = len(replies)

    def run(mine: pa.Table, replied: pa.Table) -> pa.Table:
        got: list[dict[int, bytes]] = [{} for _ in range(kinds)]
        for bucket, data, kind in zip(replied["bucket"].to_pylist(), replied["data"].to_pylist(), replied["kind"].to_pylist()):
            got[kind - 1][bucket] = data
        return finish(from_stream(mine["data"][0].as_buffer()), got, mine["chunk"][0].as_py())

    every = replies[0]
    for r in replies[1:]:
        every = every.unionByName(r)
    return kept.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(run, schema)
