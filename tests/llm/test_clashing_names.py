"""Top-k search and chat formatting on repeated ids, columns with clashing names, and empty tables."""

from pyspark.sql import functions as F

from cases import NAMES
from granula.llm.chat import format_chats
from granula.llm.topk import top_k

EXTRA = [*NAMES, "q", "c", "v", "id", "score", "rank", "block", "cutoff", "least", "formatted", "conv"]


def wide(df):
    return df.withColumns({n: F.lit("other") for n in EXTRA if n not in df.columns})


def test_top_k_with_repeated_ids_and_clashing_names(spark):
    vectors = [(1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.5]), (4, None)]
    rows = wide(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in top_k(rows, rows.filter("vec_id <= 2"), k=3).collect())
    whole = [(i, [int(64 * x) for x in v]) for i, v in vectors if v]
    want = []
    for i, v in whole[:4]:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i)[:3]
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1)]
    assert got == sorted(want)
    assert top_k(rows, rows.limit(0)).collect() == [] and top_k(rows.limit(0), rows.limit(0)).collect() == []


def test_chats_with_clashing_names_and_repeated_rows(spark):
    turns = [(1, 0, "user", "hello"), (1, 1, "assistant", "good day"), (1, 1, "assistant", "good day"), (2, 0, None, None)]
    rows = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    plain, more = ({r.conv_id: r for r in format_chats(t, "word_bpe_49k.json").collect()} for t in (rows, wide(rows)))
    assert plain == more and set(plain) == {1, 2} and plain[1].formatted.count("good day") == 2
    assert format_chats(wide(rows).limit(0), "word_bpe_49k.json").collect() == []
