"""The pipeline, stage by stage, each on what the stage before kept."""

import collections
import hashlib
import random

import numpy as np

import corpus_pipeline as cp
from cases import docs_of
from granula.llm import quality
from granula.llm.token_counts import tokenizer
from test_duplicates import brute_components, brute_lines, corpus
from test_rules_and_mixing import brute_targets


def test_stages_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    vocab = [f"wort{i}" for i in range(300)]
    # a shared line of its own, so that line dedup has something to drop
    texts = corpus(7, 120) + [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 90))) + f".\nSubscribe to our letter today {i % 2}\nEnd {i}." for i in range(60)]
    texts += ["*** $$$ %%% " * 30] * 3 + ["Word word word word. " * 40]
    sources = [["a", "b", "c", None][i % 4] for i in range(len(texts))]
    docs = docs_of(spark, texts, sources=sources)
    kept = []
    for name, stage in cp.STAGES:
        path = str(tmp_path / name)
        before = docs.collect()
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append((name, before, docs.collect()))
    by = {n: (b, a) for n, b, a in kept}
    columns = docs_of(spark, []).columns
    assert all(list(a[0].asDict()) == columns for n, (b, a) in by.items() if n != "bpe_tokens")

    before, after = by["quality_rules"]
    want = {r.doc_id for r in quality.quality(docs_of(spark, texts, sources=sources)).filter("kept").collect()}
    assert {r.doc_id for r in after} == want and 0 < len(after) < len(before)
    assert not any(len((r.text or "").split()) < 20 for r in after)

    before, after = by["line_dedup"]
    lines = {r.doc_id: x[2] for r, x in zip(before, brute_lines([r.text for r in before], 10))}
    assert {r.doc_id: r.text for r in after} == lines and all(r.n_chars == len(r.text) for r in after)
    assert any(lines[r.doc_id] != r.text for r in before)

    before, after = by["jaccard_join"]
    groups = brute_components([r.text for r in before], [r.doc_id for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in groups}) and len(after) < len(before)

    before, after = by["mixture"]
    size, taken = collections.Counter(), collections.Counter()
    for r in before:
        size[r.source] += len(r.text.split())
    for r in after:
        taken[r.source] += len(r.text.split())
    assert max(collections.Counter(r.doc_id for r in after).values()) <= 3
    for s, t in brute_targets(size).items():
        assert abs(taken[s] - t) <= 90

    before, after = by["bpe_tokens"]
    tok = tokenizer("word_bpe_49k.json")
    ids = [tok.encode(r.text, add_special_tokens=False).ids for r in before]
    want = collections.Counter((r.doc_id, len(i), tuple(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r, i in zip(before, ids))
    assert collections.Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in after) == want


def test_run_and_odd_rows(spark, tmp_path):
    texts = [None, "", " ", "x" * 5_000] + ["A clean line of plain words that goes on for long enough to count as a document of good quality, it does."] * 2 + corpus(8, 16)
    docs_of(spark, texts, ids=[None, *range(1, len(texts))]).write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path))
    assert {"doc_id", "n_tokens"} <= set(got.columns) and got.count() >= 1
    docs_of(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).collect() == []
