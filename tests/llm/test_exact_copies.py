"""Exact dedup against brute force."""

import random
import re

import pytest

from cases import NAMES, docs_of
from granula.llm import exact_copies as ec

WS = re.compile("[\x20\x09-\x0d]+")


def brute(texts, ids):
    keys = [WS.sub(" ", t or "") for t in texts]
    out = []
    for k in keys:
        own = [i for i, x in zip(ids, keys) if x == k]
        named = [i for i in own if i is not None]
        out.append((min(named) if named else None, len(own)))
    return out


def made(seed, n=400):
    rnd = random.Random(seed)
    base = ["", None, " ", "\n\t", "a b", "a  b", " a b", "a b ", "a\xa0b", "x" * 64 + "1", "x" * 64 + "2", "x" * 63 + "é", "long text " * 3000, "long text " * 2999 + "long texx "]
    return base + [" ".join(rnd.choice("ab cd ef".split()) for _ in range(rnd.randint(0, 4))) + rnd.choice(["", " ", "\n"]) for _ in range(n)]


@pytest.mark.parametrize("size", [24_000_000, 2_000])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(ec.cells, "CHUNK_BYTES", size)
    texts = made(1)
    got = {r.doc_id: r for r in ec.exact_copies(docs_of(spark, texts).repartition(7)).collect()}
    assert len(got) == len(texts)
    for i, (least, n) in enumerate(brute(texts, range(len(texts)))):
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (least, n, least == i), texts[i]
        assert r.text == texts[i] and all(r[c] == "kept" for c in NAMES)


def test_one_row_of_each_group_stays(spark):
    texts, ids = ["a", "a", "a", "b", "b", "c", None, ""], [3, 3, None, None, None, None, 9, 9]
    rows = ec.exact_copies(docs_of(spark, texts, ids)).collect()
    assert sorted((r.text or "", r.keep_id or 0, r.group_size, r.kept) for r in rows) == [
        ("", 9, 2, False), ("", 9, 2, True), ("a", 3, 3, False), ("a", 3, 3, False), ("a", 3, 3, True), ("b", 0, 2, False), ("b", 0, 2, True), ("c", 0, 1, True)]


def test_other_id_types_and_replaced_columns(spark):
    docs = spark.createDataFrame([("q", "t", 1), ("p", "t", 2), (None, "t", 3)], "doc_id string, text string, kept int")
    assert sorted((r.doc_id or "", r.keep_id, r.group_size, r.kept) for r in ec.exact_copies(docs).collect()) == [("", "p", 3, False), ("p", "p", 3, True), ("q", "p", 3, False)]


def test_heads_that_agree_are_told_apart_by_whole_texts(spark):
    texts = ["h" * 100 + c for c in "aabc"] + ["other length"]
    got = {r.doc_id: r.keep_id for r in ec.exact_copies(docs_of(spark, texts), head=8).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_empty_table(spark):
    assert ec.exact_copies(docs_of(spark, [])).collect() == []


def test_folding():
    for t in made(3, 50):
        assert ec.folded((t or "").encode()).decode() == WS.sub(" ", t or "")
