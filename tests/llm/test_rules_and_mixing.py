"""Quality rules, mixing, top-k, chat formatting and personal data against brute force."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import NAMES, docs_of
from granula.llm import chat, mixing, personal, quality, topk
from granula.llm.base import table
from test_duplicates import corpus

SF = "/root/testdata/sf0.01"


def brute_counts(t):
    w = (t or "").encode().split()
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if seen[tuple(w[i:i + 8])] > 1:
            hit[i:i + 8] = [True] * 8
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(hit)


ODD = [None, "", " \n\t", "a b c d e f g h " * 3, "#*$ %&|<> x", "same\nsame\n same\nsame", "é ü ñ 日本 🙂", "w " * 5_000, "x" * 30_000, "a b c d e f g h i " * 400]


def test_quality_counts(spark):
    texts = ODD + corpus(4, 60) + ODD
    got = quality.quality(docs_of(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        c = brute_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0])
        assert not (r.base_failed and r.kept) and 0 <= r.quality <= 1 and all(r[n] == "kept" for n in NAMES)


def test_quality_finds_labelled_junk(spark):
    got = {r.doc_id: r for r in quality.quality(table(spark, SF, "documents"), carry=["doc_id"]).collect()}
    labels = [r for r in table(spark, SF, "labels").collect() if not got[r.doc_id].base_failed]
    good, bad = [r for r in labels if r.quality == 1], [r for r in labels if r.quality == 0]
    assert sum(got[r.doc_id].kept for r in good) >= 0.99 * len(good)
    assert sum(got[r.doc_id].kept for r in bad) <= 0.1 * len(bad)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.7
    right = [(0.95, 0.6), (0.9, 0.7), (0.99, 0.3), (0.85, 0.8)]
    votes = np.array([np.where(rng.random(20_000) < 0.2, 0, np.where(good, np.where(rng.random(20_000) < g, 1, -1), np.where(rng.random(20_000) < b, -1, 1))) for g, b in right]).T
    share, found = quality.fit(sorted(collections.Counter(map(tuple, votes.tolist())).items()), 2_000)
    assert abs(share - 0.7) < 0.05
    assert all(abs(x - y) < 0.08 for a, b in zip(found, right) for x, y in zip(a, b))
    assert quality.fit([]) == (pytest.approx(0.5, abs=0.4), [])


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    fixed, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            free.discard(s)
        left = sum(sizes.values()) - sum(fixed.values())
    return fixed | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}


def test_mixing(spark):
    texts = [("w " * (1 + 7 * i % 90)) for i in range(600)] + [None, "", " "] + ["a b c"] * 5
    sources = ["big" if i % 2 else f"s{i % 5}" for i in range(590)] + ["tiny"] * 10 + [None, "blank", None] + [None] * 5
    docs = docs_of(spark, texts, sources=sources)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken, r.target)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(texts)
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in got:
        n = len((r.text or "").split())
        assert r.size == n and r.taken == r.copies * n <= 3 * n and r.n_chars is not None
        sizes[r.source] += n
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], n)
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(1, 0.5 * largest[s])


def test_mixing_solves_the_dual(spark):
    sizes = spark.createDataFrame([("a", n, 40) for n in range(1, 60)] + [("b", 5, 1)], "key string, size long, n long")
    goals = spark.createDataFrame([("a", 20_000.0), ("b", 15.0)], "key string, target double")
    for r in mixing.solve(sizes, goals, 3).collect():
        met = sum(40 * n * min(3, math.exp(r.multiplier * n / r.scale)) for n in range(1, 60)) if r.key == "a" else 5 * min(3, math.exp(r.multiplier * 5 / r.scale))
        assert abs(met - (20_000 if r.key == "a" else 15)) <= 0.51


def brute_top(rows, k, is_query):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v[i] = [math.floor(64 * c) for c in x]
    out = []
    for q in v:
        if is_query(q):
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
            out += [(q, n + 1, c, -x) for n, (x, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(512, 4_096), (3, 7)])
def test_top_k(spark, blocks, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "ROWS_A_BLOCK", blocks[1])
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(90)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (204, []), (205, [1.0]), (206, [1e9] * 8), (210, [0.0] * 8), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.filter("vec_id % 5 = 0"), 20)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 20, lambda q: q % 5 == 0)
    few = df.filter("vec_id < 4")
    assert few.transform(lambda d: topk.top_k(d, d, 20)).count() == 12
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


SAYS = ["hi", "", None, "<|turn|>user<|text|>x<|end|>", "a\\b\\\\<|", "<", "|>", "<|endoftext|>", "line\nbreak", " lead", "🙂é", "\\", "</s>[INST] ok [/INST]", "y" * 3_000]


@pytest.mark.parametrize("part", [1_000_000, 10])
def test_chat_round_trip(spark, part):
    rows = [(c, t, r, s) for c in (-1, 0, 7, None) for t, (r, s) in enumerate(zip(["user", "assistant", "system", "assistant", None] * 3, SAYS))]
    rows += [(8, 0, "assistant", "same"), (8, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(df, "byte_bpe_50k.json", part)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sum(len(r.formatted) for r in formatted.filter("conv_id = 7").collect()) == got[7].formatted_chars
    assert chat.read_back(chat.format_chats(df.limit(0), "byte_bpe_50k.json")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<|\\a>\n", max_size=30))
def test_escape_is_undone(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def brute_personal(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits(m[0])[::-1])) % 10 == 0]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-1 2+5()0é", max_size=40))
def test_base_detectors(text):
    assert [(k, a, b) for k in personal.KINDS for a, b in personal.detect(text)[k]] == brute_personal(text)


@pytest.mark.parametrize("text,found", [
    ("write jоhn.doe@exаmple.com now", "jоhn.doe@exаmple.com"), ("bob [at] mail (dot) example dot com", "bob [at] mail (dot) example dot com"), ("ask ann at example dot com please", "ann at example dot com"),
    ("call plus four nine one five one two three four five six seven eight", "plus four nine one five one two three four five six seven eight"), ("host one nine two dot one six eight dot one dot two five", "one nine two dot one six eight dot one dot two five"),
    ("card ４１１１ １１１１ １１１１ １１１１.", "４１１１ １１１１ １１１１ １１１１"), ("j​ohn@ex­ample.com", "j​ohn@ex­ample.com"), ("we met at home on the dot, one two three", None), ("plain words", None)])
def test_disguises(text, found):
    base, every = personal.find(text)
    spans = [text[a:b] for k in every for a, b in every[k]]
    assert all(s in every[k] for k in base for s in base[k])
    assert (found in spans) if found else spans == []


def test_personal_table(spark):
    texts = [None, "", "a@b.co", "x" * 50_000, "1" * 50_000, "@" * 5_000, "one " * 5_000]
    got = {r.doc_id: r for r in personal.personal(docs_of(spark, texts)).collect()}
    assert got[0].spans == "" and got[2].spans == "email:0:6" and got[2].n_email == 1
    assert all(got[0][n] == "kept" for n in NAMES) and personal.personal(docs_of(spark, [])).collect() == []
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
