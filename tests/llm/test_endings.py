"""Every quality rule can vote for and against."""

import math

from cases import docs_of
from granula.llm import quality


def test_line_ends_move_the_posterior(spark):
    words = [f"word{i}" for i in range(40)]
    lines = lambda k, end: "\n".join(f"{' '.join(words[i:i + 4])} {k}{end}" for i in range(0, 40, 4))
    good = [lines(k, ".") for k in range(60)]
    junk = ["#*$ %&| " * 30 + lines(k, "") for k in range(10)]
    got = {r.doc_id: r.quality for r in quality.quality(docs_of(spark, [*good, *junk, lines(99, "")])).collect()}
    assert got[0] > 0.9 and got[60] < 0.1
    odds = lambda q: math.log(q / (1 - q))
    assert odds(got[0]) - odds(got[70]) > 1  # as the first one but for its line ends
