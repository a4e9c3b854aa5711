"""BPE encoding and decoding over a table of distinct words.

Documents are split into words; each chunk of documents keeps its texts as positions into its
list of distinct words, and asks hash buckets for the ids of those words. A bucket sees the
words of all chunks, encodes each distinct one once with the tokenizers library, and replies
with ids; a chunk joins them back by position. Decoding joins each id to its piece.

Cutting at white space is exact for a tokenizer whose pattern drops white space: no pre-token
spans it, normalisation (NFC, lower case per character) never looks across it, and special
strings hold none, so the full library applied to one word gives the ids it gives to that word
inside a text. ``check_word_split`` proves this for the tokenizer at hand before use.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows
stay rows of their own; other columns pass through, whatever their names; a task holds a very long
text as positions into its distinct words; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import cells
from .base import fresh, partitions, query, table
from .token_counts import tokenizer

#: Ranks at which a word falls into the next tier of frequency.
TIERS = np.array([256, 4_096, 65_536])
HEAD = 4 * (len(TIERS) + 1)
OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def check_word_split(name: str) -> None:
    """Refuse a tokenizer that may look across white space."""
    spec = json.loads(tokenizer(name).to_str())
    norm = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
    safe = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace"}
    if any(n["type"] not in safe for n in norm.get("normalizers", [norm])):
        raise ValueError(f"{name}: its normaliser may look across words")
    split = next((p for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"), None)
    if split is None or split["behavior"] != "Removed" or not split["invert"]:
        raise ValueError(f"{name}: its pattern keeps white space")
    if any(set(t["content"]) & set(" \t\n\x0b\f\r") or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{name}: its special strings reach across words")


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers with their bytes of a kind together: compresses better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate flat[start:start + length] of all rows."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def bpe(docs: DataFrame, name: str, outputs: list[str], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Encode every whole text, decode it again, and return the columns ``carry`` (all) with the ``outputs`` asked for."""
    check_word_split(name)
    buckets = partitions(docs.sparkSession)
    column = fresh("words", docs)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in outputs]
    docs = docs.select(*dict.fromkeys([*carry, text]))

    def ask(rows: pa.Table):
        index: dict[bytes, int] = {}
        flat, lengths = [], []
        for t in rows[text].to_pylist():
            found = (t or "").encode().split()
            flat.append(np.fromiter((index.setdefault(w, len(index)) for w in found), np.int32, len(found)))
            lengths.append(len(found))
        known = np.array([*index, b""], object)[:-1]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in index), np.int32, len(index))
        at = np.cumsum([0, *lengths])
        every = np.concatenate(flat) if at[-1] else np.empty(0, np.int32)
        # frequent words get small positions (better compression): by tier of frequency, bucket, word
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(-np.bincount(every, minlength=len(known)), kind="stable")] = np.arange(len(known))
        tier = np.searchsorted(TIERS, rank, side="right")
        sorted_words = np.argsort(known, kind="stable")
        order = sorted_words[np.lexsort((bucket[sorted_words], tier[sorted_words]))]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        by_bucket = np.lexsort((place, bucket))  # a bucket's words, tier after tier
        ends = np.searchsorted(bucket[by_bucket], np.arange(buckets), side="right")
        asked = []
        for b, (a, e) in enumerate(zip([0, *ends], ends)):
            if e > a:
                own = by_bucket[a:e]
                asked.append((b, cells.zip_bytes(np.bincount(tier[own], minlength=len(TIERS) + 1).astype("<u4").tobytes() + b"\n".join(known[own]))))
        at = np.cumsum([0, *lengths])
        seq = place[every] if len(every) else every
        kept = rows.select(carry).append_column(column, pa.array(lengths, pa.int64()))
        return kept.replace_schema_metadata({"words": base64.b64encode(cells.zip_bytes(planes(seq)))}), asked

    def reply(asked: list[bytes]) -> list[bytes]:
        heads, lists = zip(*((d[:HEAD], d[HEAD:].split(b"\n")) for d in map(cells.unzip_bytes, asked)))
        ids: dict[bytes, np.ndarray] = dict.fromkeys(w for one in lists for w in one)
        tok, new = tokenizer(name), list(ids)
        for i in range(0, len(new), 5_000):
            part = new[i:i + 5_000]
            ids.update(zip(part, (np.array(e.ids, "<u4") for e in tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False))))
        out = []
        for head, one in zip(heads, lists):
            got = [ids[w] for w in one]
            out.append(cells.zip_bytes(head + planes(np.fromiter(map(len, got), "<u4", len(got))) + planes(np.concatenate(got))))
        return out

    def finish(rows: pa.Table, got: list[dict[int, bytes]], _chunk: int) -> pa.Table:
        parts = []  # (tier, bucket, lengths, ids)
        for b, data in got[0].items():
            data = cells.unzip_bytes(data)
            tiers = np.frombuffer(data[:HEAD], "<u4").astype(np.int64)
            n = int(tiers.sum())
            length = unplanes(data[HEAD:HEAD + 4 * n]).astype(np.int64)
            ids, ends, at = unplanes(data[HEAD + 4 * n:]), np.cumsum([0, *length]), np.cumsum([0, *tiers])
            parts += [(t, b, length[x:y], ids[ends[x]:ends[y]]) for t, (x, y) in enumerate(zip(at, at[1:])) if y > x]
        parts.sort(key=lambda p: p[:2])
        lengths = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, np.int64)
        flat = np.concatenate([p[3] for p in parts]) if parts else np.empty(0, "<u4")
        starts = np.cumsum(lengths) - lengths
        every = unplanes(cells.unzip_bytes(base64.b64decode(rows.schema.metadata[b"words"]))).astype(np.int64)
        upto = np.cumsum([0, *rows[column].to_pylist()])
        piece = pieces(name) if {"decoded", "decoded_sha256"} & set(outputs) else None
        out: dict[str, list] = {o: [] for o in outputs}
        for a, e in zip(upto, upto[1:]):
            seq = every[a:e]
            ids = ragged(flat, starts[seq], lengths[seq])
            decoded = " ".join(piece[ids]) if piece is not None else ""
            for o, value in (("n_tokens", lambda: len(ids)), ("ids", lambda: ids), ("decoded", lambda: decoded),
                             ("ids_sha256", lambda: hashlib.sha256(ids.tobytes()).hexdigest()), ("decoded_sha256", lambda: hashlib.sha256(decoded.encode()).hexdigest())):
                if o in out:
                    out[o].append(value())
        kept = rows.drop_columns([column]).replace_schema_metadata(None)
        for o in outputs:
            kept = kept.append_column(o, pa.array(out[o], {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}.get(o, pa.string())))
        return kept

    kept, asked = cells.split(docs, ask)
    schema = T.StructType([*(docs.schema[c] for c in carry), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])
    return cells.meet(kept, [cells.answer(asked, reply, 1)], finish, schema)


_PIECES: dict[str, np.ndarray] = {}


def pieces(name: str) -> np.ndarray:
    """Piece by id; as many entries as the vocabulary has."""
    if name not in _PIECES:
        tok = tokenizer(name)
        if tok.decoder is not None:
            raise ValueError(f"{name}: pieces are not joined by blanks")
        _PIECES[name] = np.array([tok.id_to_token(i) for i in range(tok.get_vocab_size())], object)
    return _PIECES[name]


@query("op2_bpe")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe(docs, "word_bpe_49k.json", ["n_tokens", "ids_sha256", "decoded_sha256"], carry=["doc_id"])
