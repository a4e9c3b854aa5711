"""Token counts: huge documents are encoded as overlapping pieces and spliced where both sides must agree.

Byte-level BPE encodes pre-tokens one by one, and its pattern reads from left to right with
one character of look-ahead. Before a blank or control space (blank, tab to carriage return)
that follows a character that is no space of any kind, a pre-token always ends: no alternative
of the pattern joins a non-space with a later space. No special string holds a space, so none
is cut there either. What follows such a *stable boundary* is encoded alike whatever stands
before it, and what stands before it alike whatever follows. Two pieces that overlap are
spliced at the first stable boundary that both see; where the overlap has none (a text without
spaces), it is widened, at last to the whole text.

Between stable boundaries a text falls into units (spaces and the word after them). A task
remembers the token count of units it has met; new units go to the tokenizers library, many
at a time, and their tokens are assigned by offsets.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and ties stay
rows of their own; other columns pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import fresh, keep, partitions, query, table

PIECE, OVERLAP = 32_768, 1_024
MEMO = 400_000
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Characters beyond blank and tab to carriage return that some library counts as space.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


@lru_cache(maxsize=4)
def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def units(text: str) -> list[str]:
    """Cut ``text`` at its stable boundaries."""
    parts = UNIT.findall(text)
    if not ODD.search(text):
        return parts
    out = parts[:1]
    for part in parts[1:]:
        if ODD.match(out[-1][-1]):  # a space that the library may join with what follows
            out[-1] += part
        else:
            out.append(part)
    return out


class Memo(dict):
    """Token counts by unit; forgets all beyond MEMO units."""

    def __init__(self, name: str):
        super().__init__()
        self.tok = tokenizer(name)

    def learn(self, new: list[str]) -> None:
        joined, alone = [], []
        for u in new:
            (joined if u[0] in " \t\n\x0b\f\r" and u[-1] not in " \t\n\x0b\f\r" and not ODD.match(u[-1]) else alone).append(u)
        if joined:  # each starts at a stable boundary of the joined text
            starts = np.cumsum([0, *map(len, joined[:-1])])
            tokens = np.array([a for a, _ in self.tok.encode("".join(joined), add_special_tokens=False).offsets])
            self.update(zip(joined, np.bincount(np.searchsorted(starts, tokens, side="right") - 1, minlength=len(joined)).tolist()))
        if alone:
            self.update(zip(alone, (len(e.ids) for e in self.tok.encode_batch(alone, add_special_tokens=False))))

    def counts(self, parts: list[list[str]]) -> list[list[int]]:
        if len(self) > MEMO:
            self.clear()
        new = list({u for p in parts for u in p}.difference(self))
        for i in range(0, len(new), 5_000):
            self.learn(new[i:i + 5_000])
        return [list(map(self.__getitem__, p)) for p in parts]


@lru_cache(maxsize=2)
def memo(name: str) -> Memo:
    return Memo(name)


def bunches(rows: list, size: int = 500_000):
    """Runs of rows whose texts (first fields) hold about ``size`` characters."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[0] or "")
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def token_counts(docs: DataFrame, name: str, text: str = "text", piece: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text."""
    if overlap > piece:
        raise ValueError("overlap must not exceed piece")
    docs = docs.drop("n_bytes", "n_tokens")
    sized = docs.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    huge = F.coalesce(F.length(text) > piece, F.lit(False))
    schema = T.StructType([*sized.schema, T.StructField("n_tokens", T.LongType())])

    def count(batches):
        for batch in batches:
            at, total = batch.schema.get_field_index(text), []
            for rows in bunches([(t,) for t in batch.column(at).to_pylist()]):
                total += map(sum, memo(name).counts([units(t or "") for t, in rows]))
            yield batch.append_column("n_tokens", pa.array(total, pa.int64()))

    small = sized.filter(~huge).mapInArrow(count, schema)
    key = fresh("doc", sized)
    long = keep(sized.filter(huge).withColumn(key, F.monotonically_increasing_id()))
    totals = splice(long.select(F.col(key).alias("__doc"), F.col(text).alias("text")), name, piece, overlap)
    return small.unionByName(long.join(totals.withColumnRenamed("__doc", key), key).drop(key))


def splice(todo: DataFrame, name: str, piece: int, overlap: int) -> DataFrame:
    """Token counts by ``__doc``: encode overlapping pieces, splice, and widen where a splice fails."""
    done = None
    while True:
        enc = pieces(todo, name, piece, overlap)
        w = Window.partitionBy("__doc").orderBy("k")
        both = enc.withColumn("next", F.lead(F.struct("head_at", "head_n")).over(w))
        joint = F.col("next").isNotNull()
        agree = (F.col("tail_at") >= 0) & (F.col("tail_at") == F.col("next.head_at"))
        sums = keep(both.groupBy("__doc").agg(
            F.sum(F.when(joint, F.col("tail_n") - F.col("next.head_n")).otherwise(F.col("n"))).alias("n_tokens"),
            F.min(F.when(joint, agree).otherwise(True)).alias("agreed")))
        good = sums.filter("agreed").select("__doc", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = sums.filter("NOT agreed").select("__doc")
        if failed.isEmpty():
            return done
        todo = keep(todo.join(failed, "__doc", "left_semi"))
        overlap *= 4
        piece = max(piece, 2 * overlap)


def pieces(docs: DataFrame, name: str, piece: int, overlap: int) -> DataFrame:
    """Encode each piece: its tokens and the first stable boundary inside either overlap, with the tokens before it."""

    def encode(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for some in bunches([(r["part"], r["__doc"], r["k"]) for r in rows]):
                parts = [units(t) for t, *_ in some]
                for (t, doc, k), p, c in zip(some, parts, memo(name).counts(parts)):
                    starts = np.cumsum([0, *map(len, p)])[:-1]
                    before = np.cumsum([0, *c])
                    h, e = 1, int(np.searchsorted(starts, piece, side="right"))
                    head, tail = h < len(starts) and starts[h] <= overlap, e < len(starts)
                    out.append((doc, k, int(before[-1]), int(starts[h]) if head else -1, int(before[h]) if head else 0,
                                int(starts[e]) - piece if tail else -1, int(before[e]) if tail else 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["__doc", "k", "n", "head_at", "head_n", "tail_at", "tail_n"])

    cut = docs.select("__doc", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int"))).alias("k"))
    cut = cut.select("__doc", F.col("k").cast("long").alias("k"), F.expr(f"substring(text, k * {piece} + 1, {piece + overlap + 1})").alias("part"))
    return cut.repartition(partitions(docs.sparkSession), "__doc", "k").mapInArrow(encode, "__doc long, k long, n long, head_at long, head_n long, tail_at long, tail_n long")


@query("op10_token_counts")
def op10(spark, sf_dir):
    out = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "byte_bpe_50k.json")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
