"""Quality rules: weak supervision with DataFrame functions only.

Each rule looks at a few counts of a document and votes good (1), bad (-1) or abstains (0).
Votes are packed into one number, so the corpus shrinks to counts by voting pattern: at most
3 ** rules rows (59,049 here), whatever the number of documents. Expectation-maximisation on
those counts estimates the share of good documents and, per rule and class, how often a vote
is right; abstentions carry no evidence. A document's posterior probability is then a sum of
literals chosen by its votes, and replaces "all rules must pass".

Counts (words are ``[^\\x20\\x09-\\x0D]+``): n_words, word_chars, n_symbols (of ``#*$%&|<>``),
n_dup_lines (lines with a word equal to an earlier line), n_repeat_words (words inside
8-word windows that occur twice or more in the text). A window set is first compared by
hash; only where a hash repeats are the windows themselves sorted and compared.

Defined cases: null and empty texts have no words and fail the base; repeated rows are judged
alike; columns with the names of the results are replaced, others pass through; very long texts are one
row like others; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fresh, keep, query, table, words

WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value, body):
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def size(a):
    return F.size(a).cast("long")


def repeat_words(w, k: int = WINDOW):
    """Words covered by ``k``-word windows found twice or more; ``w`` is a column of words."""

    def covered(p):  # sorted starts: each covers up to the next start, k at most
        each = F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1), x + k) - x))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def starts(s):  # sorted windows: those like a neighbour
        same = lambda x, j: F.coalesce(F.get(s, j)["window"] == x["window"], F.lit(False))
        return F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["at"])), lambda p: p.isNotNull()))

    def exact(v):
        windows = F.transform(F.sequence(F.lit(1), F.size(v) - (k - 1)), lambda i: F.struct(F.array_join(F.slice(v, i, k), " ").alias("window"), i.alias("at")))
        return let(F.sort_array(windows), lambda s: let(starts(s), covered))

    def hashes(h):
        return F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.xxhash64(F.slice(h, i, k)))

    def judged(v):
        some = let(F.transform(v, lambda x: F.xxhash64(x)), lambda h: let(hashes(h), lambda a: F.size(F.array_distinct(a)) < F.size(a)))
        return F.when(some, exact(v)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(w) <= k, F.lit(0).cast("long")).otherwise(let(w, judged))


def measure(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The counts of every document, and those that only the rules use, as a struct ``__more``."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in COUNTS]
    t = F.coalesce(F.col(text), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    more = fresh("more", docs)

    def of_words(w):
        return F.struct(
            size(w).alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words"),
            size(F.array_distinct(w)).alias("n_distinct"), size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)).alias("n_stutter"))

    of_lines = let(lines, lambda a: F.struct((size(a) - size(F.array_distinct(a))).alias("n_dup_lines"), size(a).alias("n_lines"), size(F.filter(a, lambda x: F.rtrim(x).rlike("[.!?:;\")]$"))).alias("n_ends")))
    found = docs.select(*carry, let(words(F.col(text)), of_words).alias(more), of_lines.alias(f"{more}_lines"), left(r"[^#*$%&|<>]+").alias("n_symbols"),
                        left("[^A-Z]+").alias(f"{more}_upper"), left("[^!|]+").alias(f"{more}_shout"))
    rest = F.struct(*[F.col(f"{more}.{c}") for c in ("n_distinct", "n_stutter")], *[F.col(f"{more}_lines.{c}") for c in ("n_lines", "n_ends")], F.col(f"{more}_upper").alias("n_upper"), F.col(f"{more}_shout").alias("n_shout"))
    return found.select(*carry, f"{more}.n_words", f"{more}.word_chars", "n_symbols", f"{more}_lines.n_dup_lines", f"{more}.n_repeat_words", rest.alias("__more"))


def rules() -> dict:
    """Votes by name: (good when, bad when); neither: abstain. Shares are compared in whole numbers."""
    n, chars = F.col("n_words"), F.col("word_chars")
    m = lambda c: F.col(f"__more.{c}")
    return {
        "symbols": (100 * F.col("n_symbols") <= n, 100 * F.col("n_symbols") >= 10 * n),
        "symbol_load": (100 * F.col("n_symbols") <= chars, 100 * F.col("n_symbols") >= 5 * chars),
        "word_length": ((chars >= 3 * n) & (chars <= 9 * n), (chars < 2 * n) | (chars > 14 * n)),
        "repeats": (100 * F.col("n_repeat_words") <= 5 * n, 100 * F.col("n_repeat_words") > 25 * n),
        "stutter": (100 * m("n_stutter") <= 3 * n, 100 * m("n_stutter") >= 12 * n),
        "variety": (2 * m("n_distinct") >= n, (n >= 30) & (6 * m("n_distinct") <= n)),
        "lines": (F.col("n_dup_lines") == 0, 10 * F.col("n_dup_lines") > 4 * m("n_lines")),
        "upper": (100 * m("n_upper") <= 8 * chars, 100 * m("n_upper") >= 25 * chars),
        "shout": (100 * m("n_shout") <= 3 * n, 100 * m("n_shout") >= 20 * n),
        "endings": (2 * m("n_ends") >= m("n_lines"), 10 * m("n_ends") < m("n_lines")),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """EM on (votes, count): the share of good documents, and per rule how often its vote is right on good and on bad ones.

    A rule may know one fault of many, so on bad documents it may well vote good most of the
    time; it only must vote good more often on good ones. That, and a start at which bad votes
    weigh more than good ones, fixes which class is the good one. Two imagined votes, one right,
    keep estimates off 0 and 1.
    """
    m = len(patterns[0][0]) if patterns else 0
    share, right = 0.8, [(0.98, 0.4)] * m
    total = sum(c for _, c in patterns)
    for _ in range(rounds):
        good = [[1.0, 2.0] for _ in range(m)]
        bad = [[1.0, 2.0] for _ in range(m)]
        mass = 1.0
        for votes, count in patterns:
            p = count / (1 + math.exp(-max(-700.0, min(700.0, odds(votes, share, right)))))
            mass += p
            for j, v in enumerate(votes):
                if v:
                    good[j][0] += p * (v > 0)
                    good[j][1] += p
                    bad[j][0] += (count - p) * (v < 0)
                    bad[j][1] += count - p
        new = [(max(g[0] / g[1], 1 - b[0] / b[1]), b[0] / b[1]) for g, b in zip(good, bad)]
        moved = max([abs(a - b) for x, y in zip(new, right) for a, b in zip(x, y)], default=0.0)
        share, right = mass / (total + 2), new
        if moved < 1e-9:
            break
    return share, right


def weights(share: float, right: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of the share, and per rule what a good and a bad vote add."""
    return math.log(share / (1 - share)), [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in right]


def odds(votes, share, right) -> float:
    base, each = weights(share, right)
    return base + sum(e[0] if v > 0 else e[1] for v, e in zip(votes, each) if v)


def quality(docs: DataFrame, text: str = "text", carry: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``quality`` (posterior probability) and ``kept``."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*COUNTS, "base_failed", "quality", "kept", "__more", "__votes")]
    named = rules()
    vote = [F.when(good, 1).when(bad, -1).otherwise(0) for good, bad in named.values()]
    code = sum(((v + 1) * 3 ** j for j, v in enumerate(vote)), F.lit(0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = keep(measure(docs, text, carry).select(*carry, *COUNTS, code.alias("__votes"), failed.alias("base_failed")))
    counted = scored.groupBy("__votes").count().collect()  # 3 ** rules rows at most
    patterns = sorted((tuple(r["__votes"] // 3 ** j % 3 - 1 for j in range(len(vote))), r["count"]) for r in counted)
    base, each = weights(*fit(patterns))
    digit = lambda j: F.floor(F.col("__votes") / 3 ** j) % 3
    total = sum((F.when(digit(j) == 2, g).when(digit(j) == 0, b).otherwise(0.0) for j, (g, b) in enumerate(each)), F.lit(base))
    out = scored.withColumn("quality", 1 / (1 + F.exp(-total)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)).drop("__votes")


@query("op1_quality_rules")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, carry=["doc_id"])
