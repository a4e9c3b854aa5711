"""Disguised personal data: gates against the patterns behind them, mixed disguises."""

import re

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from granula.llm import personal

ENDING = "|".join(personal.ENDINGS)
BARE = re.compile(rf"(?i)(?<=[A-Za-z0-9._%+-])\s+at\s+(?=[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)*(?:\s+dot\s+|\.)(?:{ENDING})\b)")
NAME = re.compile(r"(?i)[A-Za-z0-9-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+)*")
WORDS = ["at", "At", "aT", "AT", "dot", "Dot", "DOT", "com", "de", "example", "ann", "bob", "x", "a@b.de", "@", ".", "(at)", "[dot]", "one", "Two", "seven", "zéro", "192", "0", "1", "plus", "(", ")", "café", "_"]
TEXT = st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from([" ", " ", " ", "  ", "\t", "\n", ".", ", ", "-", ""])), max_size=24).map(lambda x: "".join(map("".join, x)))


def spans_of(text):
    return {(k, text[a:b]) for k, v in personal.find(text)[1].items() for a, b in v}


def ungated(text):
    """Finds behind the plain patterns, without any test before them."""
    m = personal.Mapped(text)
    m.rewrite(personal.bracketed(m.text))
    bare = [x.span() for x in BARE.finditer(m.text)]
    edits = sorted({(*s, "@") for s in bare} | {(*d.span(), ".") for _, e in bare for d in personal.BARE_DOT.finditer(m.text, e, NAME.match(m.text, e).end())})
    m.rewrite([e for i, e in enumerate(edits) if not i or e[0] >= edits[i - 1][1]])
    m.rewrite([e for x in personal.NUMBER.finditer(m.text) for e in personal.spelled(x)])
    return {k: [m.source(*s) for s in v] for k, v in personal.detect(m.text).items()}


@settings(max_examples=1_500, deadline=None)
@given(TEXT)
@example("ann at  example dot com")
@example("one.Seven.zéro.Two.(one 1 1 two)")
def test_gates_lose_nothing(text):
    base, every = personal.find(text)
    for kind, spans in ungated(text).items():
        covered = {i for a, b in every[kind] for i in range(a, b)}
        for a, b in (s for s in spans if not any(s[0] < y and x < s[1] for x, y in base[kind])):
            words = [x for x in re.finditer(r"\w+", text[a:b]) if x[0].lower() not in ("at", "dot")]
            assert all(a + i in covered for x in words for i in range(*x.span()))


@pytest.mark.parametrize("found", ["ann at  example dot com", "ann\tat\texample dot com", "ann at\nexample dot com", "ann aT example dot com", "ann at mail dot example dot com", "ann at shop dot de dot com", "ann at mail\ndot\nexample dot xyz"])
def test_bare_words(found):
    assert spans_of(f"ask {found}, please") == {("email", found)}


@pytest.mark.parametrize("kind,found", [("phone", "plus one 555 123 456 two"), ("ip", "one.2.3.four"), ("ip", "one dot 2 dot 3 dot four")])
def test_digit_words_beside_signs(kind, found):
    assert (kind, found) in spans_of(f"is ({found})!")


@pytest.mark.parametrize("found", [
    "john (at) mail dot com", "john@mail dot com", "john@mail\ndot\tcom", "john [at] firm dot ch", "bob [at] mail (dot) example dot com", "bob [at] mail dot example (dot) com", "john dot doe at mail dot com", "john dot van dot doe@mail dot com",
    "john Dot doe (at) mail.com", "j.r dot doe at mail dot co dot uk"])
def test_mixed_at_and_dot(found):
    assert spans_of(f"(ask {found}, please)") == {("email", found)}


@pytest.mark.parametrize("found", ["192 dot 168 dot 0 dot 1", "192.168 dot 0 dot 1", "192 dot 168 dot zero dot 1", "192 punto\n168 DOT 0 point 1", "1 9 2 dot 1 6 8 dot 0 dot 1"])
def test_numerals_joined_by_dots(found):
    assert spans_of(f"(port 8080: {found})") == {("ip", found)}
    assert ("ip", found) in spans_of(f"port 8080, {found}, 443")


@pytest.mark.parametrize("text,found", [
    ("ann (at) x.com dot bob (at) y.com", {"ann (at) x.com", "bob (at) y.com"}), ("ann at x dot com dot bob at y dot com", {"ann at x dot com", "bob at y dot com"}), ("a@b dot c at d dot com", {"c at d dot com"}),
    ("john@mail.com dot com", {"john@mail.com"}), ("dot at home dot then", set()), ("see @home dot com, 2 dot 5, 3 dot 1 and 7 on the dot @ 5", set()), ("is one nine two dot 168 dot 0 dot 1", {"one nine two dot 168 dot 0 dot 1"}), ("1 dot 2 dot 3", set()), ("300 dot 1 dot 1 dot 1", set())])
def test_neighbours_of_mixed_disguises(text, found):
    assert {s for _, s in spans_of(text)} == found
