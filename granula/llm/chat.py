"""Chat formatting: whole conversations become one text with a loss mask over its tokens.

A conversation is rendered turn after turn, encoded once with offsets, and a token is under the loss mask when its
span lies in the text of an assistant's turn: both lists of spans are sorted, so a binary search per
token decides. Marks are special tokens of the tokenizer in memory, so no token reaches
from a mark into a text, and masked spans are exactly the assistants' texts. In roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``: no text can hold a mark, and reading undoes it.

Turns are sorted by conversation within their partition and streamed: long conversations
are given out in parts of whole turns, so no conversation has to fit into memory. Marks cut
the encoding too, so parts encode as the whole would.

Defined cases: null texts and roles are empty; turns of the same number keep the order of role,
then text; repeated rows are turns of their own; a null id is a conversation like others; columns besides those named
are not read, whatever their names; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import query, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
READ = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)
PART_CHARS = 1_000_000
FORMATTED = "conv_id long, part int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str | None) -> str:
    return (text or "").replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@lru_cache(maxsize=2)
def marked_tokenizer(name: str):
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    tok.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (TURN, TEXT, END)])
    return tok


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of assistants' texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def loss_mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens that lie within one of the spans; both sorted."""
    if not spans:
        return np.zeros(len(starts), bool)
    first, last = np.array(spans).T
    at = np.searchsorted(first, starts, side="right") - 1
    return (at >= 0) & (ends <= last[np.maximum(at, 0)])


def format_chats(rows: DataFrame, name: str, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part and, per part, the formatted text, token ids, their spans (code points) and the loss mask."""

    def run(batches):
        held, size, now, part = [], 0, None, 0

        def flush():
            text, spans = render(held)
            enc = marked_tokenizer(name).encode(text, add_special_tokens=False)
            at = np.array(enc.offsets, np.int32).reshape(-1, 2)
            mask = loss_mask(spans, at[:, 0], at[:, 1])
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            values = ([now[0]], [part], [text], [enc.ids], [at[:, 0]], [at[:, 1]], [mask])
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["conv_id", "part", "formatted", "ids", "starts", "ends", "loss"])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if held and ((conv,) != now or size > part_chars):
                    yield flush()
                    part = part + 1 if (conv,) == now else 0
                    held, size = [], 0
                held.append((role, text))
                size += len(text or "") + len(role or "")
                now = (conv,)
        if held:
            yield flush()

    turns = rows.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def masked_texts(formatted: str, starts: list[int], ends: list[int], loss: list[bool]) -> list[str]:
    """The text under the mask, one piece per run of masked tokens, escapes undone."""
    mask = np.concatenate([[0], np.array(loss, np.int8), [0]])
    first, last = np.flatnonzero(np.diff(mask) == 1), np.flatnonzero(np.diff(mask) == -1) - 1
    return [unescape(formatted[starts[a]:ends[b]]) for a, b in zip(first, last)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the mask, from the formatted parts in their order."""

    def run(batches):
        now, state = None, None

        def row():
            n, turns, chars, loss, total = state
            values = ([now[0]], [n], [turns.hexdigest()], [chars], [loss.hexdigest()], [total])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["conv_id"],) != now:
                    if now:
                        yield row()
                    now, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in READ.findall(r["formatted"]):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                for text in masked_texts(r["formatted"], r["starts"], r["ends"], r["loss"]):
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(r["formatted"])
        if now:
            yield row()

    return formatted.mapInArrow(run, DIGESTS)


@query("op6_chat_format")
def op6(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(more), "byte_bpe_50k.json"))
