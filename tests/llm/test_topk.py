"""Top-k against a full scan, with ties, nulls and bad vectors."""

import math

import numpy as np
import pytest

from chronoweave.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, k=10, every=100):
    fine = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in data if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for i, v in fine:
        if i % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, u, strict=True)), j) for j, u in fine if j != i and len(u) == len(v)))[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("rows", [64, 4096])
def test_against_full_scan(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "ROWS", rows)
    monkeypatch.setattr(topk, "FIRST", 16)
    monkeypatch.setattr(topk, "QUERY_VALUES", 24)
    r = np.random.default_rng(3)
    data = [(i, [float(c) for c in r.normal(0, 0.2, 8)]) for i in range(700)]
    data += [(700, data[3][1]), (800, data[3][1]), (801, data[3][1]), (900, None), (901, [float("nan")] * 8), (902, [None] * 8), (1000, [float("inf")] * 8), (None, data[0][1]), (1100, [1.0, 2.0]), (1200, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA).repartition(5)
    got = topk.top_k(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(x) for x in got.collect()} == brute(data)


def test_lists_are_not_read_to_their_ends():
    """Most entries that a query skips are in the lists of the later, larger blocks."""
    r = np.random.default_rng(4)
    x = np.floor(1024 * (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(r.normal(size=(20000, 32))))
    search = topk.Search(np.arange(20), x[:20], 10)
    search.add(np.arange(len(x)), x, last=True)
    assert search.read / search.rows < 0.8
    for j in range(20):
        score = x @ x[j]
        score[j] = -np.inf
        want = np.lexsort((np.arange(len(x)), -score))[:10]
        assert search.found[j].tolist() == want.tolist() and search.scores[j].tolist() == score[want].tolist()


def test_edges(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).count() == 0
    same = spark.createDataFrame([(0, [1.0], 0), (0, [1.0], 0), (5, [1.0], 0), (5, [1.0], 1)], SCHEMA).withColumn("id", topk.F.lit(1))
    assert sorted(map(tuple, topk.top_k(same).collect())) == [(0, 1, 5, 1048576), (0, 2, 5, 1048576)]
