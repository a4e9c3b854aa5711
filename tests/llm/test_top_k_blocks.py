"""How the blocks of the exact top-k travel."""

import numpy as np
import pytest

from granula.llm import topk


@pytest.mark.parametrize("group", [1, 16])
def test_copied_blocks_are_not_broadcast(spark, monkeypatch, group):
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 5)
    monkeypatch.setattr(topk, "ROWS_A_BLOCK", 9)
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "CELLS_A_TASK", 1)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(80, 6))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = topk.top_k(rows, rows, 4)
    steps = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [qb" in steps and "BroadcastHashJoin [qb" not in steps
    w = np.floor(v * 64).astype(int)
    score = w @ w.T
    want = [(q, n + 1, c, score[q, c]) for q in range(80) for n, c in enumerate(sorted((c for c in range(80) if c != q), key=lambda c: (-score[q, c], c))[:4])]
    assert sorted(tuple(r) for r in got.collect()) == want
