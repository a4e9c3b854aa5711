"""Cross-tokenizer alignment: how the tokens of two tokenizers cut the same bytes.

Tokens of A and B cover the same bytes. One state vector holds the A and B pointer of every
document of a batch (of long ones, of every section); each step emits the link between the two
tokens pointed at, advances the pointer whose token ends first, or both where the ends agree (a
cut), and drops the documents that are finished. A section ends at a stable boundary, where both
tokenizers end a token anyway, so sections keep the vector wide and change no result.

Text falls into units at stable boundaries (see ``token_counts``); a task remembers the tokens of
units it has met and has new ones encoded many at a time. That is exact for B too where no piece
holds the white space behind another character; ``sticky`` finds the exceptions, which are not cut.

Links become counts of documents per id pair: a chunk contributes one row per distinct pair,
Spark sums them, and the sums come back to the chunk by a join on the pair. A pair of all
documents is one row per chunk, and the sums are a written table, so adaptive execution may split
it. Chunks are written once and do not move.

Defined cases: texts that are null, empty, or not covered by B's bytes (those with U+2581)
have no tokens: zeros and an empty digest; texts of white space have tokens; very long texts are
cut into sections, a task holds one text and its tokens; ties for the highest count all count as
best; repeated rows are documents of their own and count each; an empty table gives no rows;
further columns pass through, those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cells
from .base import SPACES, keep, partitions, query, table
from .bpe import planes, ragged, unplanes
from .token_counts import ODD, bunches, units

SECTION = 256
MEMO = 300_000
BODY, PAIR = -1, 0
PER_DOC = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
RESULTS = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "n_best": T.LongType(), "count_sum": T.LongType(), "groups_sha256": T.StringType()}


def byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def sticky(pieces: list[bytes]) -> str:
    """White space that some piece holds behind another character: no cut before it. Refuses blanks there, which would leave no cuts."""
    found = {s for p in pieces for s in SPACES if s.encode() in p.lstrip(b" ")[1:] or s != " " and s.encode() in p[1:]}
    if " " in found:
        raise ValueError("a piece reaches across words")
    return "".join(sorted(found))


class Pair:
    """Both tokenizers, the bytes of their tokens, and the tokens of the units met so far."""

    def __init__(self, a_name: str, b_name: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(a_name))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_name))
        alphabet = byte_of_char()
        self.a_bytes = [bytes(alphabet.get(c, 63) for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sticky = sticky([p for i, p in enumerate(self.b_bytes) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))])
        self.a_size, self.b_size = (np.array([len(x) for x in b], np.int64) for b in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.good = np.empty(0, bool)
        self.tokens = [[np.empty(0, np.int64), np.empty(0, np.int64)] for _ in "ab"]  # ids in a row, tokens per unit

    def learn(self, new: list[str]) -> None:
        """Encode units: those that start with white space and end without as one text, each of the others alone."""
        easy = [u for u in new if u[0] in SPACES and u[-1] not in SPACES and not ODD.match(u[-1]) and "▁" not in u]
        known = set(easy)
        for some in ([easy] if easy else []) + [[u] for u in new if u not in known]:
            if not self.learn_joined(some):
                for u in some if len(some) > 1 else []:
                    self.learn_joined([u])

    def learn_joined(self, some: list[str]) -> bool:
        """Encode units as one text; False where several do not come out as their own bytes (one alone is then known as bad)."""
        raw = [u.encode() for u in some]
        ends, whole = np.cumsum([len(r) for r in raw]), b"".join(raw)
        a = self.a.encode("".join(some), add_special_tokens=False).ids
        b = self.b.encode("x" + "".join(some), num_threads=1)  # a word in front keeps the blank that B adds away from the unit's own white space
        b = b[int(np.searchsorted(np.cumsum(self.b_size[b]), 2)) + 1:]
        good = all(b"".join(map(own.__getitem__, ids)) == whole for own, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        if not good and len(some) > 1:
            return False
        cut = []
        for ids, sizes in ((a, self.a_size), (b, self.b_size)):
            ids = np.array(ids if good else [], np.int64)
            at = np.searchsorted(np.cumsum(sizes[ids]), ends, side="right")
            cut += [ids, np.diff(at, prepend=0)]
        self.keep(some, *cut, good)
        return good

    def keep(self, some: list[str], a, a_n, b, b_n, good: bool) -> None:
        for u in some:
            self.index[u] = len(self.index)
        self.good = np.append(self.good, np.full(len(some), good))
        for side, ids, n in ((0, a, a_n), (1, b, b_n)):
            self.tokens[side] = [np.append(self.tokens[side][0], ids), np.append(self.tokens[side][1], n)]

    def units(self, text: str) -> list[str]:
        """Cut ``text`` where both tokenizers end a token."""
        parts = units(text)
        if not any(c in text for c in self.sticky):
            return parts
        out = parts[:1]
        for part in parts[1:]:
            if part[0] in self.sticky:
                out[-1] += part
            else:
                out.append(part)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Units per text (0: no tokens), per side all ids and tokens per unit, and which unit each belongs to."""
        parts = [self.units(" " + t) if t else [] for t in texts]
        if len(self.index) > MEMO:
            self.forget()
        new = list(dict.fromkeys(u for p in parts for u in p if u not in self.index))
        for i in range(0, len(new), 5_000):
            self.learn(new[i:i + 5_000])
        each = [np.fromiter(map(self.index.__getitem__, p), np.int64, len(p)) for p in parts]
        each = [e if self.good[e].all() else e[:0] for e in each]
        every = np.concatenate(each) if each else np.empty(0, np.int64)
        sides = []
        for flat, n in self.tokens:
            sides.append((ragged(flat, (np.cumsum(n) - n)[every], n[every]), n[every]))
        return np.array([len(e) for e in each], np.int64), sides, every


@lru_cache(maxsize=2)
def pair(a_name: str, b_name: str) -> Pair:
    return Pair(a_name, b_name)


def sections(n_units: np.ndarray, tokens: np.ndarray, section: int) -> np.ndarray:
    """First units of sections: texts start one, and so does the first unit behind every ``section`` tokens of a text."""
    doc = np.repeat(np.arange(len(n_units)), n_units)
    upto = np.cumsum(tokens) - tokens
    start = np.cumsum(n_units) - n_units
    own = (upto - upto[start[doc]]) // section if len(doc) else doc
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])
    return np.flatnonzero(new)


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token, is it the last of its group?) of many documents, in order of tokens.

    ``a_end``, ``b_end``: byte where each token ends, counted through all documents;
    ``first``, ``last``: each document's tokens, end exclusive. Both sides of a document end at the same byte.
    """
    i, j, stop = a_first.copy(), b_first.copy(), a_last
    live = i < stop
    i, j, stop = i[live], j[live], stop[live]
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(i):
        x, y = a_end[i], b_end[j]
        links.append((i, j, x == y))
        i, j = i + (x <= y), j + (y <= x)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    if not links:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    a, b, cut = (np.concatenate(x) for x in zip(*links))
    order = np.argsort(a + b, kind="stable")  # each step advances one of them; documents lie one behind the other
    return a[order], b[order], cut[order]


@lru_cache(maxsize=4)
def digit_table(most: int) -> np.ndarray:
    """Decimal digits of all ids below ``most``, a row of bytes each, zero bytes behind."""
    return np.arange(most).astype("S").view(np.uint8).reshape(most, -1)


def spelled(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, groups: int, doc_a: np.ndarray, doc_b: np.ndarray, most: int) -> list[bytes]:
    """Per document ``a1,a2|b1;a3|b2,b3``; ``doc_a``, ``doc_b``: where the tokens of each document end."""
    size = len(a) + len(b)
    table_ = digit_table(most)
    width = table_.shape[1]
    upto_a, upto_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=groups))]) for g in (a_group, b_group))
    at_a = np.arange(len(a)) + upto_b[a_group]
    at_b = np.arange(len(b)) + upto_a[b_group + 1]
    out = np.zeros((size, width + 1), np.uint8)
    out[at_a, :width], out[at_b, :width] = table_[a], table_[b]
    last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool) for g in (a_group, b_group))
    out[at_a, width], out[at_b, width] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    lengths = np.cumsum((out != 0).sum(1))
    data = out[out != 0].tobytes()
    ends = doc_a + doc_b
    stops = np.where(ends > 0, lengths[np.maximum(ends, 1) - 1], 0).tolist() if size else [0] * len(ends)
    return [data[x:max(x, y - 1)] for x, y in zip([0, *stops], stops)]


def aligned(texts: list[str | None], a_name: str, b_name: str, section: int = SECTION) -> dict[str, list | np.ndarray]:
    """Per text the counts and digest, and links of all texts: text, A id, B id."""
    both = pair(a_name, b_name)
    n_units, ((a, a_n), (b, b_n)), _ = both.encode(texts)
    doc_of_unit = np.repeat(np.arange(len(texts)), n_units)
    n_a, n_b = (np.bincount(doc_of_unit, weights=n, minlength=len(texts)).astype(np.int64) for n in (a_n, b_n))
    first = sections(n_units, a_n, section)
    a_at, b_at = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
    a_first, b_first = a_at[first], b_at[first]
    la, lb, cut = lockstep(np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b]), a_first, b_first, np.append(a_first[1:], len(a)), np.append(b_first[1:], len(b)))
    doc_a, doc_b = np.cumsum(n_a), np.cumsum(n_b)
    doc = np.searchsorted(doc_a, la, side="right")
    group = np.cumsum(cut) - cut
    a_group, b_group = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    a_group[la], b_group[lb] = group, group
    n_groups = np.bincount(doc[cut], minlength=len(texts))
    strings = spelled(a, b, a_group, b_group, int(cut.sum()), doc_a, doc_b, max(len(both.a_bytes), len(both.b_bytes)))
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(doc, minlength=len(texts)), "groups_sha256": [hashlib.sha256(s).hexdigest() if n else "" for s, n in zip(strings, n_a)],
            "groups": strings, "doc": doc, "pair": a[la] * len(both.b_bytes) + b[lb]}


def alignment(docs: DataFrame, a_name: str, b_name: str, text: str = "text", section: int = SECTION, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all) with the results: tokens of A and B, groups between common cuts, links, and how common the links are."""
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    docs = docs.select(*dict.fromkeys([*carry, text]))
    stored_schema = "chunk long, pair long, docs long, data binary, kind int"
    plain = pa.schema([("chunk", pa.int64()), ("pair", pa.int64()), ("docs", pa.int64()), ("data", pa.binary()), ("kind", pa.int32())])

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for rows in cells.chunks(batches, cells.CHUNK_BYTES):
            found: dict[str, list] = {c: [] for c in PER_DOC}
            held, upto = [], 0
            for some in bunches([(t,) for t in rows[text].to_pylist()], 1_000_000):
                own = aligned([t for t, in some], a_name, b_name, section)
                for c in PER_DOC:
                    found[c].extend(own[c])
                order = np.lexsort((own["pair"], own["doc"]))
                d, p = own["doc"][order], own["pair"][order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1])
                at = np.flatnonzero(new)
                held.append((d[at] + upto, p[at], np.diff(np.append(at, len(d)))))
                upto += len(some)
            d, p, times = (np.concatenate(x) for x in zip(*held))
            pairs, place, count = np.unique(p, return_inverse=True, return_counts=True)
            rank = np.empty(len(pairs), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(pairs))  # common pairs get small numbers
            lists = cells.zip_bytes(planes(np.bincount(d, minlength=rows.num_rows)) + planes(rank[place]) + planes(times))
            kept = rows.select(carry)
            for c in PER_DOC:
                kept = kept.append_column(c, pa.array(found[c], pa.string() if c == "groups_sha256" else pa.int64()))
            body = cells.to_stream(kept)
            head = len(lists).to_bytes(8, "little") + lists + body
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([head], pa.binary()), pa.array([BODY], pa.int32())], schema=plain)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), number)), pa.array(pairs), pa.array(count.astype(np.int64)), pa.nulls(len(pairs), pa.binary()), pa.array(np.full(len(pairs), PAIR, np.int32))], schema=plain)
            number += 1

    stored = keep(docs.mapInArrow(pack, stored_schema), "kind", bucketed=("chunk", partitions(docs.sparkSession)))
    bodies = stored.filter(F.col("kind") == BODY).select("chunk", "data")
    asked = stored.filter(F.col("kind") == PAIR).select("chunk", "pair", "docs")
    b_ids = len(pair(a_name, b_name).b_bytes)
    counts = keep(asked.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.floor(F.col("pair") / b_ids)))
    most = keep(counts.groupBy("a").agg(F.max("count").alias("most")))
    told = asked.select("chunk", "pair", "docs").join(keep(counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))), "pair").select(F.col("chunk").alias("home"), "pair", "docs", "count", "best")

    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(c, t) for c, t in RESULTS.items())])

    def finish(mine: pa.Table, replied: pa.Table) -> pa.Table:
        data = mine["data"][0].as_py()
        size = int.from_bytes(data[:8], "little")
        rows = cells.from_stream(pa.py_buffer(data)[8 + size:])
        numbers = cells.unzip_bytes(data[8:8 + size])
        n = rows.num_rows
        per = unplanes(numbers[:4 * n]).astype(np.int64)
        half = (len(numbers) - 4 * n) // 2
        rank, times = unplanes(numbers[4 * n:4 * n + half]).astype(np.int64), unplanes(numbers[4 * n + half:]).astype(np.int64)
        own, key = replied["docs"].to_numpy(), replied["pair"].to_numpy()
        order = np.lexsort((key, -own))  # the ranks given when the chunk was packed
        count, best = replied["count"].to_numpy()[order], replied["best"].to_numpy()[order]
        doc = np.repeat(np.arange(n), per)
        count_sum, n_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(count_sum, doc, count[rank] * times)
        np.add.at(n_best, doc, best[rank] * times)
        for name, values in (("n_best", n_best), ("count_sum", count_sum)):
            rows = rows.append_column(name, pa.array(values))
        return rows.select(schema.fieldNames())

    return bodies.groupBy("chunk").cogroup(told.groupBy("home")).applyInArrow(finish, schema)


@query("op11_alignment")
def op11(spark, sf_dir):
    out = alignment(table(spark, sf_dir, "documents").select("doc_id", "text"), "byte_bpe_50k.json", "piece_bpe_32k.model", carry=["doc_id"])
    return out.select("doc_id", *RESULTS)
