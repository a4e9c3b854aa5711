"""Personal data, also in disguise: detection on normalised text, spans in the source.

Base detectors find e-mail addresses, IPv4 addresses, payment cards (Luhn) and telephone
numbers in the text as it stands. Then transducers rewrite the text and keep, for every character
they emit, the span of source characters it stands for: look-alike letters and digits (and
invisible characters), written-out "at" and "dot", spelled-out digits in long runs, and numerals joined by written-out dots. The same detectors run on
the result; what they find beyond the base is mapped back to source characters and added. Base
spans always stay.

Defined cases: null and empty texts hold nothing; spans count code points, ends exclusive; a disguised
find that touches a base span of its kind is not added; repeated rows repeat their spans;
columns named like the results are replaced, others pass through; where finds of a kind overlap, the leftmost
stays; a task holds one very long text whole; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .base import query, table

KINDS = ["email", "ip", "card", "phone"]
RESULTS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DOTTED = re.compile(r"[0-9]\.[0-9]")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Cyrillic and Greek letters that look like Latin ones.
ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h",
         "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
         "ο": "o", "α": "a", "ι": "i", "ν": "v", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X"}
#: Characters without width.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Digits in English, German, French and Spanish words.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
           "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
           "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
           "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
SIGNS = {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": "."}
_word = "|".join(sorted(SPELLED, key=len, reverse=True))
_sign = "|".join(SIGNS)
#: Seven digits or more, at least two of them words, signs between them allowed.
NUMBER = re.compile(rf"(?i)(?<!\w)(?:(?:{_sign})[ ,-]{{1,2}})?(?:(?:{_word}|[0-9]+)(?:[ ,.-]{{1,2}}|$|(?!\w))(?:(?:{_sign})[ ,-]{{1,2}})?){{4,}}")
#: Four numerals or more, joined by dots, their digits perhaps apart.
DOTS = frozenset(w for w in SIGNS if SIGNS[w] == ".")
_dot = rf"\s++(?:{'|'.join(sorted(DOTS))})\s++"
_digit = rf"(?:[0-9](?!\w)|(?:{_word})\b)"
_numeral = rf"(?:{_digit}(?:[ -]{_digit}){{1,2}}|[0-9]++|(?:{_word})\b)"
NUMERALS = re.compile(rf"(?i)(?:(?<![0-9])(?=[0-9])|(?<!\w)){_numeral}(?:(?:{_dot}|\.){_numeral}){{3,}}")
NUMERAL_PART = re.compile(rf"(?i){_dot}|{_word}|[ -]")
PART = re.compile(rf"(?i){_word}|{_sign}|[0-9]+|[ ,.-]+")
#: "at" and "dot" in brackets, or bare between words where a known ending follows.
BRACKET = re.compile(r"(?i)[\[({<]\s?(at|dot|punkt|arobase|arroba|punto|point)\s?[\])}>]\s{0,2}")
#: Endings of names that make bare words "at" and "dot" count.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "example", "test")
AT = re.compile(r"[@Aa](?:(?<=@)|(?<=\s[Aa])[Tt]\s+)")
BARE_NAME = re.compile(r"(?i)[A-Za-z0-9-]++(?:(?:\s++dot\s++|\.)[A-Za-z0-9-]++)++")
KNOWN = re.compile(rf"(?i)[A-Za-z0-9-]++(?:(?:\s++dot\s++|\.)[A-Za-z0-9-]++)*(?:\s++dot\s++|\.)(?:{'|'.join(ENDINGS)})\b")
BARE_DOT = re.compile(r"(?i)\s+dot\s+")
AT_WORDS = {"at", "arobase", "arroba"}
WORD = re.compile(r"\w+")


@lru_cache(maxsize=1)
def look_alikes() -> dict[str, str]:
    """Table of listed letters, every character whose compatibility form is one ASCII letter, digit or sign, all decimal digits, nothing for unseen ones."""
    found = dict(ALIKE)
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) == "Nd":
            found[c] = str(unicodedata.digit(c))
        elif len(n := unicodedata.normalize("NFKC", c)) == 1 and n < "\x7f" and n > " " and unicodedata.category(c) not in ("Zs", "Mn"):
            found[c] = n
    return found | dict.fromkeys(UNSEEN, "")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if DOTTED.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Mapped:
    """A rewritten text; ``at[i]`` is the source span of its character i."""

    def __init__(self, text: str):
        self.text, self.at = text, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply (start, end, replacement) edits in order; each new character stands for its share of what it replaced."""
        if not edits:
            return
        old = self.at or [(i, i + 1) for i in range(len(self.text))]
        text, at, free = [], [], 0
        for start, end, new in edits:
            text += [self.text[free:start], new]
            at += old[free:start]
            n = end - start
            for i in range(len(new)):
                a, b = start + i * n // len(new), start + max((i + 1) * n // len(new), i * n // len(new) + 1)
                at.append((old[a][0], old[min(b, end) - 1][1]))
            free = end
        self.text, self.at = "".join([*text, self.text[free:]]), at + old[free:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (self.at[start][0], self.at[end - 1][1]) if self.at else (start, end)


def spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn a run of digit words into digits, blanks and commas into nothing."""
    parts = list(PART.finditer(m.string, m.start(), m.end()))
    words = sum(p[0].lower() in SPELLED for p in parts)
    digits = sum(1 if p[0].lower() in SPELLED else len(p[0]) if p[0].isdigit() else 0 for p in parts)
    if words < 2 or digits < 4:
        return []
    out = []
    for k, p in enumerate(parts):
        w = p[0].lower()
        if w in SPELLED or w in SIGNS:
            out.append((*p.span(), SPELLED.get(w) or SIGNS[w]))
        elif not w.isdigit() and k < len(parts) - 1:  # what separates digits; the run's own end stays
            out.append((*p.span(), "." if w.strip() == "." else ""))
    return out


def normalised(text: str) -> Mapped | None:
    """The text without disguises, or nothing where it has none."""
    m = Mapped(text)
    if not text.isascii():
        table_ = look_alikes()
        if here := set(text).intersection(table_):
            m.rewrite([(x.start(), x.end(), table_[x[0]]) for x in re.finditer("[" + "".join(map(re.escape, sorted(here))) + "]", text)])
    m.rewrite(bracketed(m.text))
    m.rewrite(addresses(m.text))
    words = WORD.findall(m.text.lower())
    if sum(w in SPELLED for w in words) > 1:  # a digit word in NUMBER has no word character beside it
        m.rewrite([e for x in NUMBER.finditer(m.text) for e in spelled(x)])
    if any(w in DOTS and numeral(a[-1], a) and numeral(b[0], b) for a, w, b in zip(words, words[1:], words[2:])):
        m.rewrite([e for x in NUMERALS.finditer(m.text) for e in joined(x)])
    return m if m.at else None


def bracketed(text: str) -> list[tuple[int, int, str]]:
    """Edits for "at" and "dot" in brackets, with up to two blanks on either side."""
    out = []
    for x in BRACKET.finditer(text):
        start = x.start()
        while start > max(0, x.start() - 2) and text[start - 1].isspace() and (not out or start > out[-1][1]):
            start -= 1
        out.append((start, x.end(), "@" if x[1].lower() in AT_WORDS else "."))
    return out


def addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits for "at" as a bare word where a name with a known ending follows, and for "dot" as a bare word on both sides of it and of every "@"; whole names count."""
    sites = []
    for x in AT.finditer(text):
        start, end = x.span()
        if bare := x[0] != "@":
            start = blank_from(text, start)
        if start and text[start - 1] in LOCAL and (name := BARE_NAME.match(text, end)) and (not bare or KNOWN.match(text, end)):
            sites.append((start, end, name.end(), bare))
    out, free = [], 0
    for k, (start, end, stop, bare) in enumerate(sites):
        if start < free:
            continue
        dots = [(*d.span(), ".") for d in BARE_DOT.finditer(text, end, stop)]
        if dots and k + 1 < len(sites) and sites[k + 1][0] == stop:  # what follows the last dot is the local part of the next
            cut = dots[-1][0]
            if BARE_NAME.fullmatch(text, end, cut) and (not bare or KNOWN.match(text, end, cut)):
                dots, stop = dots[:-1], cut
            elif not bare:
                free = cut
                continue
        out += local_dots(text, start, free)
        out += [(start, end, "@")] * bare + dots
        free = stop
    return out


def blank_from(text: str, end: int) -> int:
    """Where the blanks that end there begin."""
    while end and text[end - 1].isspace():
        end -= 1
    return end


def local_dots(text: str, end: int, free: int) -> list[tuple[int, int, str]]:
    """Edits for "dot" as a bare word between the words of a local part that ends there and begins at ``free`` or later."""
    out = []
    while True:
        while end > free and text[end - 1] in LOCAL:
            end -= 1
        word = blank_from(text, end)
        start = blank_from(text, max(word - 3, 0))
        if not (free < start < word - 3 and word < end and text[word - 3:word].lower() == "dot" and text[start - 1] in LOCAL):
            return out[::-1]
        out.append((start, end, "."))
        end = start


def numeral(c: str, word: str) -> bool:
    return c.isdigit() or word in SPELLED


def joined(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn numerals joined by written-out dots into plain ones."""
    parts = [(*p.span(), p[0].strip().lower()) for p in NUMERAL_PART.finditer(m.string, m.start(), m.end())]
    if not any(w in DOTS for *_, w in parts):
        return []
    return [(a, b, "." if w in DOTS else SPELLED.get(w, "")) for a, b, w in parts]


def find(text: str | None) -> tuple[dict[str, list], dict[str, list]]:
    """Base spans and all spans, by kind."""
    base = detect(text or "")
    every = {k: list(v) for k, v in base.items()}
    m = normalised(text) if text else None
    if m:
        for kind, spans in detect(m.text).items():
            for a, b in (m.source(*s) for s in spans):
                if all(b <= x or a >= y for x, y in base[kind]):
                    every[kind].append((a, b))
            every[kind].sort()
    return base, every


def written(spans: dict[str, list]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def personal(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with counts of base finds by kind, a digest of the base spans, and all spans."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    docs = docs.select(*dict.fromkeys([*carry, text]))

    def run(batches):
        for batch in batches:
            base, every = zip(*map(find, batch.column(text).to_pylist())) if batch.num_rows else ((), ())
            out = batch.select(carry)
            for kind in KINDS:
                out = out.append_column(f"n_{kind}", pa.array([len(b[kind]) for b in base], pa.int64()))
            out = out.append_column("base_sha256", pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string()))
            yield out.append_column("spans", pa.array([written(e) for e in every], pa.string()))

    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in carry), *fields]))


@query("op9_personal_data")
def op9(spark, sf_dir):
    return personal(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
