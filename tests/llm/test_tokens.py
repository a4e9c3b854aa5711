"""Token counts and BPE against the library on whole texts."""

import hashlib

import numpy as np
import pytest

from cases import NAMES, docs_of
from granula.llm.bpe import bpe
from granula.llm.token_counts import token_counts, tokenizer, units

TEXTS = ["", None, " ", "hello world", "  two  spaces\n\n\tand tabs \r\n", "don't we'll I'm 123 45.6!!", "naïve café ñandú ß Σίσυφος ΣΑΣ İstanbul", "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c", "x  y z\u0085w \x1c !\x1c ?",
         "日本語 と 中文 mixed", "a" * 3000, "ab " * 2000, "word\n" * 700, "\n" * 300, "🙂🙃 emoji👩‍👩‍👧", "é ȩ́ ́x", "tail space ", "!!! ??? ''s 's", "the THE The " * 50]


@pytest.mark.parametrize("piece,overlap", [(32_768, 1_024), (200, 40), (64, 8)])
def test_token_counts_equal_library(spark, piece, overlap):
    docs = docs_of(spark, TEXTS * 2)
    got = token_counts(docs, "byte_bpe_50k.json", piece=piece, overlap=overlap)
    assert set(docs.columns) <= set(got.columns)
    tok = tokenizer("byte_bpe_50k.json")
    rows = got.collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        t = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)), t[:40]


def test_units_rejoin_and_stand_alone():
    tok = tokenizer("byte_bpe_50k.json")
    for t in filter(None, TEXTS):
        parts = units(t)
        assert "".join(parts) == t
        assert sum(len(tok.encode(p, add_special_tokens=False).ids) for p in parts) == len(tok.encode(t, add_special_tokens=False).ids)


def test_bpe_equals_library(spark):
    docs = docs_of(spark, TEXTS * 3)
    got = bpe(docs, "word_bpe_49k.json", ["n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]).collect()
    tok = tokenizer("word_bpe_49k.json")
    assert len(got) == 3 * len(TEXTS)
    for r in got:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, decoded), r.text
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert all(r[n] == "kept" for n in NAMES)


def test_bpe_refuses_tokenizers_that_keep_spaces(spark):
    with pytest.raises(ValueError):
        bpe(docs_of(spark, ["a"]), "byte_bpe_50k.json", ["ids"])


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    assert token_counts(docs, "byte_bpe_50k.json").collect() == []
    assert bpe(docs, "word_bpe_49k.json", ["ids"]).collect() == []
