"""Alignment of two tokenizers against the libraries on whole texts and a plain merge."""

import collections
import hashlib
import random
from functools import lru_cache

import numpy as np
import pytest

from cases import NAMES, docs_of
from granula.llm.alignment import RESULTS, aligned, alignment, byte_of_char, lockstep, sections, sticky
from test_tokens import TEXTS

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MORE = ["<|endoftext|> and <s> </s> <unk>", "x▁y", "▁", "a;\r\nb;\r c", "a\0b", "\x1c a\xa0 b　 c", "tab\tseparated\tline", " leading", "é ﬁ ligature", "😀 😀😀", "the the the", "the the the"]


@lru_cache
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))


def brute(text):
    """(A ids, B ids, links, groups) or None."""
    if not text:
        return None
    a, b = libraries()
    alphabet = byte_of_char()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    data = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
    if any(b"".join(d) != (" " + text).encode() for d in data):
        return None
    spans = [list(zip(np.cumsum([0, *map(len, d)]).tolist(), np.cumsum([*map(len, d)]).tolist())) for d in data]
    links, j = [], 0
    for i, (start, end) in enumerate(spans[0]):
        while spans[1][j][1] <= start:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < end:
            links.append((ids[0][i], ids[1][k]))
            k += 1
    cuts, groups, before = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}), [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(x) for x, (_, e) in zip(own, span) if before < e <= cut) for own, span in zip(ids, spans)))
        before = cut
    return *ids, links, groups


def expected(texts):
    each = [brute(t) for t in texts]
    count = collections.Counter(p for e in each if e for p in set(e[2]))
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(len(e[0]), len(e[1]), len(e[3]), len(e[2]), sum(count[p] == most[p[0]] for p in e[2]), sum(count[p] for p in e[2]), hashlib.sha256(";".join(e[3]).encode()).hexdigest()) if e else (0, 0, 0, 0, 0, 0, "") for e in each]


@pytest.mark.parametrize("section", [3, 256])
def test_texts_against_libraries(section):
    rnd = random.Random(7)
    texts = [*TEXTS, *MORE, *("".join(rnd.choice("ab \n\r;\t\xa0é日'1.😀") for _ in range(rnd.randint(1, 40))) for _ in range(300))]
    got = aligned(texts, A, B, section)
    for i, t in enumerate(texts):
        e = brute(t)
        want = (len(e[0]), len(e[1]), len(e[2]), ";".join(e[3])) if e else (0, 0, 0, "")
        assert (got["n_a"][i], got["n_b"][i], got["n_links"][i], got["groups"][i].decode()) == want, t
        assert sorted(got["pair"][got["doc"] == i].tolist()) == sorted(a * 32_000 + b for a, b in (e[2] if e else []))


def test_query_against_brute_force(spark):
    texts = [*TEXTS, *MORE] * 3
    got = {r.doc_id: r for r in alignment(docs_of(spark, texts).repartition(5), A, B).collect()}
    for i, want in enumerate(expected(texts)):
        assert tuple(got[i][c] for c in RESULTS) == want, texts[i]
        assert got[i].text == texts[i] and all(got[i][n] == "kept" for n in NAMES)


def test_repeated_rows_null_ids_and_clashing_names(spark):
    rows = [(None, "same text here"), (None, "same text here"), (1, None), (1, "")]
    docs = spark.createDataFrame([(i, t, "old", 5, "x") for i, t in rows], "doc_id long, text string, groups_sha256 string, docs int, pair string")
    got = sorted(((r.doc_id, r.n_a > 0, r.count_sum == 2 * r.n_links, r.docs, r.pair) for r in alignment(docs, A, B).collect()), key=str)
    assert got == [(1, False, True, 5, "x"), (1, False, True, 5, "x"), (None, True, True, 5, "x"), (None, True, True, 5, "x")]


def test_empty_table(spark):
    assert alignment(docs_of(spark, []), A, B).collect() == []


def test_lockstep_and_sections():
    a, b, cut = lockstep(np.array([2, 3, 6, 7, 9]), np.array([1, 3, 6, 8, 9]), np.array([0, 3]), np.array([0, 3]), np.array([3, 5]), np.array([3, 5]))
    assert list(zip(a.tolist(), b.tolist(), cut.tolist())) == [(0, 0, False), (0, 1, False), (1, 1, True), (2, 2, True), (3, 3, False), (4, 3, False), (4, 4, True)]
    assert sections(np.array([3, 0, 2]), np.array([2, 2, 2, 9, 1]), 4).tolist() == [0, 2, 3, 4]


def test_long_text_takes_few_steps(monkeypatch):
    from granula.llm import alignment as module

    steps, plain = [], np.concatenate
    monkeypatch.setattr(module.np, "concatenate", lambda x, *a: steps.append(len(x)) or plain(x, *a))
    aligned(["several words of one long text " * 20_000], A, B)
    assert max(steps) < 2_000


def test_vocabularies_that_join_words_are_refused():
    assert sticky([b" a", b"  ", b";\r", b"b"]) == "\r"
    with pytest.raises(ValueError):
        sticky([b"a b"])
