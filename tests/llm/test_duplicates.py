"""Line dedup, substring dedup and the Jaccard join against brute force."""

import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import NAMES, docs_of
from granula.llm import near_copies as nc
from granula.llm import passages
from granula.llm.hashes import runs
from granula.llm.lines import drop_lines
from granula.llm.mph import Mph
from granula.llm.rtree import RTree, count_vector, enough, fold, group_count, unpacked

WS = " \t\n\x0b\f\r"


def brute_lines(texts, least):
    keys = [[x.strip(WS).encode().lower().decode() for x in (t or "").split("\n")] for t in texts]
    seen = collections.Counter(k for own in keys for k in set(own) if k)
    out = []
    for t, own in zip(texts, keys):
        raw = (t or "").split("\n")
        kept = [x for x, k in zip(raw, own) if not (k and seen[k] >= least)]
        out.append((len(raw), len(raw) - len(kept), "\n".join(kept)))
    return out


def brute_passages(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts, ids):
    sets = [shingles(t) for t in texts]
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def corpus(seed, n=160):
    """Texts with exact copies, edited copies (some near the threshold), shared passages and lines, and odd ones."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared, line = text(60), "Shared LINE here"
    out = [None, "", "  \n\t ", "one two", "One  TWO", "one two three four five", "x" * 20_000, "a b c d e " * 400]
    base = text(80)
    for i in range(n):
        kind = i % 8
        if kind == 0:
            out.append(text(rng.randint(3, 200)))
        elif kind in (1, 2, 3):  # near copies with ever more edits
            w = base.split()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        elif kind == 4:
            out.append(f"{text(30)} {shared}\n{line}\n{text(rng.randint(1, 40))}")
        elif kind == 5:
            out.append(f"{text(20)}\n  {line.lower()}\t\n{text(10)}")
        elif kind == 6:
            out.append(out[-rng.randint(1, 6)])
        else:
            out.append(f"{text(3)}\n\n{text(4)}\r\n{line} ")
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(spark, least):
    texts = corpus(1)
    got = {r.doc_id: r for r in drop_lines(docs_of(spark, texts), min_docs=least).collect()}
    assert len(got) == len(texts)
    for i, (n, dropped, kept) in enumerate(brute_lines(texts, least)):
        assert (got[i].n_lines, got[i].n_dropped, got[i].text or "") == (n, dropped, kept)
        assert (got[i].text is None) == (texts[i] is None) and all(got[i][c] == "kept" for c in NAMES)


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    high, low = rng.integers(0, 2 ** 63, 5_000, np.uint64), rng.integers(0, 2 ** 63, 5_000, np.uint64)
    high[1] = high[0]  # told apart by the low half
    h = Mph.build(high, low)
    assert sorted(h(high, low)) == list(range(5_000))
    assert h(high[::-1], low[::-1])[0] == h(high, low)[-1]
    assert len(Mph.build(high[:0], low[:0])(high, low)) == 5_000


@pytest.mark.parametrize("window", [21, 35])
def test_substring_dedup(spark, window):
    texts = corpus(2)
    got = {r.doc_id: r for r in passages.drop_passages(docs_of(spark, texts), window=window).collect()}
    for i, (n, removed, kept) in enumerate(brute_passages(texts, window)):
        assert (got[i].n_words, got[i].n_removed, got[i].text or "") == (n, removed, kept)
        assert (got[i].text is None) == (texts[i] is None) and all(got[i][c] == "kept" for c in NAMES)


def test_cover_meets_every_distance():
    assert {(a - b) % passages.PERIOD for a in passages.COVER for b in passages.COVER} == set(range(passages.PERIOD))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.integers(1, 40))
def test_runs_name_equal_runs_alike(values, length):
    h = runs(np.array(values, np.uint64), length)
    named = {}
    for i, x in enumerate(h.tolist()):
        assert named.setdefault(tuple(values[i:i + length]), x) == x
    assert len(set(h.tolist())) == len(named)


@pytest.mark.parametrize("part,rounds", [(4_096, 2), (7, 1), (5, 0)])
def test_jaccard_join(spark, part, rounds):
    texts = corpus(3)
    ids = [None if i == 5 else i // 2 if i > 150 else i for i in range(len(texts))]
    docs = docs_of(spark, texts, ids)
    got = nc.near_copies(docs, part=part, rounds=rounds)
    assert got.columns == [*docs.columns, "n_shingles", "component_id"]
    want = collections.Counter((d, t, *w) for d, t, w in zip(ids, texts, brute_components(texts, ids)))
    assert collections.Counter((r.doc_id, r.text, r.n_shingles, r.component_id) for r in got.collect()) == want


def test_one_row_of_each_component_is_first(spark):
    texts = ["one two three four five six seven"] * 3 + ["", None] + ["a b c d e f g h i"] * 2
    ids = [4, 4, None, 8, 8, None, None]
    got = nc.near_copies(docs_of(spark, texts, ids), first="stays").collect()
    assert sorted((r.text or "", r.doc_id or 0, r.component_id or 0) for r in got if r.stays) == [("", 8, 8), ("", 8, 8), ("a b c d e f g h i", 0, 0), (texts[0], 4, 4)]
    slim = nc.near_copies(docs_of(spark, texts, ids), carry=["doc_id"], first="stays")
    assert slim.columns == ["doc_id", "n_shingles", "component_id", "stays"] and slim.filter("stays").count() == 4


def test_working_tables_go(spark):
    import os

    from granula.session import WorkTables

    with WorkTables() as held:
        nc.near_copies(docs_of(spark, corpus(4, 30))).collect()
    assert len(held.made) == 2 and all(os.path.exists(path.removeprefix("file:")) for _, path, _ in held.made)
    held.drop()
    assert not held.made


def test_leading_shingles_meet():
    rng = random.Random(5)
    for _ in range(300):
        a = {rng.randrange(1 << 40) for _ in range(rng.randint(1, 40))}
        b = (set(rng.sample(sorted(a), rng.randint(1, len(a))))) | {rng.randrange(1 << 40) for _ in range(rng.randint(0, 8))}
        if enough(len(a & b), len(a) + len(b), 75):
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            assert set(nc.leading(x, 75).tolist()) & set(nc.leading(y, 75).tolist())


def test_tree_finds_every_pair_over_the_bound():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64) for _ in range(150)]
    sets = [np.unique(s) for s in sets]
    points = np.array([fold(unpacked(count_vector(s, 32)), 16) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = RTree(points, sizes)
    got = {(min(a, b), max(a, b)) for i, j in tree.pairs(75, lambda: np.arange(150)) for a, b in zip(i.tolist(), j.tolist())}
    for i in range(150):
        for j in range(i):
            bound = int(np.minimum(points[i], points[j]).sum())
            assert bound >= len(np.intersect1d(sets[i], sets[j]))
            assert ((j, i) in got) == bool(enough(bound, sizes[i] + sizes[j], 75))
    assert group_count(1) == 8 and group_count(5_000) >= 1_024


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    assert drop_lines(docs).collect() == [] and passages.drop_passages(docs).collect() == [] and nc.near_copies(docs).collect() == []
