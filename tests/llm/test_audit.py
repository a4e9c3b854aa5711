"""Filter audit against a plain replay of every order."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cases import docs_of
from granula.llm import audit as au

FILTERS = {c: f"fails_{c}" for c in "ABCDE"}
MARKS = {"good_lost": "good", "toxic_lost": "toxic"}


def brute_fails(texts, ids):
    out = []
    for t, i in zip(texts, ids):
        t = t or ""
        words = [w for w in t.encode().split()]
        same = [j for u, j in zip(texts, ids) if (u or "") == t]
        out.append("".join(c for c, bad in zip("ABCDE", [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t),
                                                            i is not None and any(j is not None and j < i for j in same)]) if bad))
    return out


def replay(rows, letters="ABCDE"):
    """rows: (part, fails, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys(letters, 0)
        for order in itertools.permutations(letters):
            left = own
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                shapley[c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(c in r[1] for r in own) - len(gone), sum(r[1] == c for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def told(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_texts_and_steps_against_replay(spark):
    rnd = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    texts = [None, "", "A" * 40, "é" * 9 + "A", "é" * 10 + "A", "a | b", " \n\t"] + [" ".join(rnd.choice(words[:rnd.choice([20, 300])]) for _ in range(rnd.choice([99, 100, 101, 300]))).replace("w1", rnd.choice(["w1", "W1", "#"])) for _ in range(60)]
    texts = texts * 2 + texts[:20]
    ids = [None if i % 17 == 0 else i % 90 for i in range(len(texts))]
    langs = [None if i % 5 == 0 else "" if i % 7 == 0 else "en" if i % 3 else "de" for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, g, "old") for i, t, g in zip(ids, texts, langs)], "doc_id long, text string, lang string, fails_A string").repartition(5)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, 0, 1), (3, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    rows = au.marked(au.text_failures(docs), labels)
    fails = brute_fails(texts, ids)
    got = sorted((r.doc_id is not None, r.doc_id or 0, "".join(c for c in "ABCDE" if r[f"fails_{c}"])) for r in rows.collect())
    assert got == sorted((i is not None, i or 0, f) for i, f in zip(ids, fails))
    plain = [(g or "", f, i in (1, 3), i in (2, 3)) for i, g, f in zip(ids, langs, fails)]
    assert told(au.audit(rows, "lang", FILTERS, MARKS)) == replay(plain)


def test_fields_never_overflow(spark):
    """Counts around the width of a field: 255, 256 and 65,536 rows of one mask."""
    for n in (255, 256, 65_536):
        rows = spark.range(n).selectExpr("'p' AS part", "id % 2 = 0 AS a", "true AS b", "true AS good")
        got = {(r.filter_order, r.step): r for r in au.audit(rows, "part", {"A": "a", "B": "b"}, {"good_lost": "good"}).collect()}
        even = (n + 1) // 2
        assert (got["BA", 1].removed, got["BA", 1].good_lost, got["BA", 2].redundant, got["AB", 1].removed, got["AB", 2].removed, got["AB", 2].unique_fails) == (n, n, even, even, n - even, n - even)


def test_packed_fields_hold_each_outcome():
    for mask in range(16):
        fields = au.unpacked(300 * au.packed(mask, 3, 1, 2), 5, 3, 2)
        for o, order in enumerate(itertools.permutations(range(3))):
            before = False
            for s, f in enumerate(order):
                fail = bool(mask >> f & 1)
                assert fields[:, o, s].tolist() == [300 * x for x in (not fail and not before, fail and not before, fail and before, mask & 7 == 1 << f, fail and not before and mask >= 8)]
                before |= fail


def test_empty_tables_and_null_verdicts(spark):
    docs = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert au.audit(au.marked(au.text_failures(docs), labels), "lang", FILTERS, MARKS).collect() == []
    rows = spark.createDataFrame([("x", None, None)], "part string, a boolean, good boolean")
    got = au.audit(rows, "part", {"A": "a"}, {"good_lost": "good"}).collect()
    assert [(r.kept, r.removed, r.good_lost, r.shapley) for r in got] == [(1, 0, 0, 0)]


def test_repeated_rows_and_labels_count_once_each(spark):
    docs = docs_of(spark, ["same text"] * 3, [7, 7, 8])
    labels = spark.createDataFrame([(7, 1, 0)] * 4, "doc_id long, quality int, toxic int")
    rows = au.marked(au.text_failures(docs), labels).collect()
    assert sorted((r.doc_id, r.fails_E, bool(r.good)) for r in rows) == [(7, False, True), (7, False, True), (8, True, False)]


@pytest.mark.parametrize("name", ["part", "mask", "n", "text_hash", "least_id"])
def test_clashing_columns(spark, name):
    docs = docs_of(spark, ["a", "a"]).withColumn(name, F.lit("own"))
    assert {r[name] for r in au.text_failures(docs).collect()} == {"own"}
