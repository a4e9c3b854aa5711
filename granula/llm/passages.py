"""Substring dedup: words covered by a repeated window of ``window`` words are removed.

Windows are found from anchors. A difference cover modulo a period v is a set of residues
whose differences are all residues; so for any two positions i and j some d < v brings both
i + d and j + d onto the cover. Hashing runs of window - v + 1 words at cover positions only
(5 of 21) is therefore enough: two equal windows share an anchor at the same distance
from their starts. Chunks ask hash buckets which of their anchors occur elsewhere; around those,
and only there, a chunk extends to full windows, hashes them to 64 bits and asks again. What a
bucket answers is one bit per hash, and a passage that thousands of documents share comes
once per chunk.

Defined cases: null and empty texts have no words; texts shorter than a window keep all words;
repeated rows repeat all their windows; overlapping windows of one text count as repeats; a null
text stays null; columns named like the results are replaced; a
task holds one very long text whole; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import cells
from .base import partitions, query, table
from .hashes import places, runs, word_hashes

CHUNK = 8_000_000
#: A perfect difference set. Every residue modulo 21 is a difference of two of its members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Anchors are compared by 48 bits: a chance match only makes windows be asked for in vain.
ANCHOR = np.uint64(0xFFFFFFFFFFFF0000)
RESULTS = ["n_words", "n_removed", "kept_sha256"]


class Chunk:
    """Anchors and windows of a chunk of texts."""

    def __init__(self, texts: list, window: int):
        self.window = window
        self.h, self.counts = word_hashes(texts)
        self.at, self.left = places(self.counts)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions on the cover where an anchor fits into a window of its text, and their hashes."""
        length = self.window - PERIOD + 1
        cover = np.isin(np.arange(PERIOD), COVER)
        fits = cover[self.at % PERIOD] & (self.left >= length) & (self.at + self.left >= self.window)
        where = np.flatnonzero(fits)
        return where, runs(self.h, length)[where] & ANCHOR

    def near(self, where: np.ndarray) -> np.ndarray:
        """Starts of windows that hold one of the anchors at the distances a cover allows."""
        ahead = np.zeros(len(self.h) + PERIOD + 1, np.int32)
        ahead[where + 1] = 1
        upto = np.cumsum(ahead)
        n = len(self.h)
        some = upto[PERIOD:PERIOD + n] > upto[:n]
        return np.flatnonzero(some & (self.left >= self.window))

    def windows(self, starts: np.ndarray) -> np.ndarray:
        return runs(self.h, self.window)[starts] if len(starts) else np.empty(0, np.uint64)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.h) + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.window, -1)
        return np.cumsum(edge)[:-1] > 0


def lookup(hashes: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return bits[np.searchsorted(keys, hashes)] if len(hashes) else np.empty(0, bool)


def drop_passages(docs: DataFrame, text: str = "text", window: int = 35, carry: list[str] | None = None, digest: bool = False) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (words joined by one blank), ``n_words`` (before) and ``n_removed``."""
    if window < PERIOD:
        raise ValueError(f"windows have {PERIOD} words or more")
    buckets = partitions(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    if not digest and text not in carry:
        raise ValueError("the text column must be carried where passages are cut from it")
    docs = docs.select(*dict.fromkeys([*carry, text]))

    def ask(rows: pa.Table):
        return rows, cells.ask_hashes(Chunk(rows[text].to_pylist(), window).anchors()[1], buckets)[1]

    def candidates(rows: pa.Table, anchors: dict[int, bytes]) -> tuple[Chunk, np.ndarray, np.ndarray]:
        chunk = Chunk(rows[text].to_pylist(), window)
        where, hashes = chunk.anchors()
        keys = np.unique(hashes)
        starts = chunk.near(where[lookup(hashes, keys, cells.read_bits(keys, anchors, buckets))])
        return chunk, starts, chunk.windows(starts)

    def extend(rows: pa.Table, got: list[dict[int, bytes]], number: int) -> pa.Table:
        asked = cells.ask_hashes(candidates(rows, got[0])[2], buckets)[1]
        return cells.cells([(number, b, d, cells.ASKS) for b, d in asked])

    def finish(rows: pa.Table, got: list[dict[int, bytes]], _number: int) -> pa.Table:
        chunk, starts, hashes = candidates(rows, got[0])
        keys = np.unique(hashes)
        gone = chunk.covered(starts[lookup(hashes, keys, cells.read_bits(keys, got[1], buckets))])
        ends = np.cumsum(chunk.counts)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], ends])])
        texts, kept = rows[text].to_pylist(), []
        for t, a, e, r in zip(texts, ends - chunk.counts, ends, removed):
            own = (t or "").encode().split()
            kept.append(b" ".join([w for w, g in zip(own, gone[a:e].tolist()) if not g] if r else own))
        out = rows.select(carry)
        if not digest:
            out = out.set_column(out.schema.get_field_index(text), text, pa.array([None if t is None else k.decode() for t, k in zip(texts, kept)], pa.string()))
        out = out.append_column("n_words", pa.array(chunk.counts, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))
        return out.append_column("kept_sha256", pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())) if digest else out

    stored, asked = cells.split(docs, ask, CHUNK)
    anchors = cells.keep(cells.answer(asked, cells.repeated, 1))
    windows = cells.answer(cells.meet(stored, [anchors], extend, cells.SCHEMA), cells.repeated, 2)
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), *([T.StructField("kept_sha256", T.StringType())] if digest else [])])
    return cells.meet(stored, [anchors, windows], finish, schema)


SQL_OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1),
p AS (SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
g AS (SELECT p.r, p.p, p.word, coalesce(max(f.i) OVER (PARTITION BY p.r ORDER BY p.p), -99) >= p.p - 34 AS gone FROM p LEFT JOIN f ON p.r = f.r AND p.p = f.i),
s AS (SELECT r, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(s.n, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.r = s.r
"""


@query("op7_substring_dedup", SQL_OP7)
def op7(spark, sf_dir):
    return drop_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"], digest=True)
