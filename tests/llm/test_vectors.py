"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsignal.llm import ann, tiles, topk

SCHEMA = "vec_id long, embedding array<float>, score string, query_id string"


@pytest.fixture
def small_tiles(monkeypatch):
    """Many shards and blocks of queries, and two levels of merging."""
    monkeypatch.setattr(tiles, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(tiles, "FAN_IN", 3)
    monkeypatch.setattr(tiles, "shard_count", lambda rows, least, size=0: 11)


def vectors(n=230, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[min(3, n - 1)]  # a third of the rows are one vector
    return [(i * 3 - 50, x[i].tolist(), "s", "q") for i in range(n)]


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(10**6, None, "s", None), (None, [1.0] * 16, None, None), (10**6 + 5, [nan] + [1.0] * 15, "", ""),
            (10**6 + 10, [inf] + [1.0] * 15, "", ""), (10**6 + 15, [None] + [1.0] * 15, "", "")]


def brute(rows, chosen, k, whole):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, *_ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    if whole:
        good = [(i, np.floor(256 * v)) for i, v in good]
    out = {}
    for q, v in good:
        if chosen(q):
            scored = sorted(((-float(v @ w), i) for i, w in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_exact_topk_equals_brute_force(spark, small_tiles):
    rows = vectors() + odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = lists(topk.exact_topk(df, df.where(F.col("vec_id") % 5 == 0), 5))
    want = brute(rows, lambda q: q % 5 == 0, 5, True)
    assert found == {q: [(i, int(s)) for i, s in v] for q, v in want.items()}


def test_exact_topk_of_few_and_no_rows(spark):
    df = spark.createDataFrame(vectors(3), SCHEMA)
    assert {q: len(v) for q, v in lists(topk.exact_topk(df, df, 5)).items()} == {-50: 2, -47: 2, -44: 2}
    assert topk.exact_topk(df.limit(0), df.limit(0), 5).collect() == []
    assert topk.exact_topk(df.limit(0), df, 5).collect() == []


def test_exact_topk_counts_a_repeated_query_once(spark):
    rows = vectors(20)
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    found = lists(topk.exact_topk(df, df.where("vec_id = -50"), 4))
    assert len(found[-50]) == 4


def test_large_components_stay_exact():
    q, x = np.full((1, 2), 2.0**28), np.array([[2.0**28 + 1, 1.0], [2.0**28, 3.0]])
    assert topk.products(q, x).tolist() == [[2**56 + 2**28 + 2**28, 2**56 + 3 * 2**28]]


def test_neighbours_find_nine_tenths(spark, small_tiles):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 32))
    x = (centres[rng.integers(0, 12, 900)] + 0.7 * rng.standard_normal((900, 32))).astype(np.float32)
    rows = [(i, x[i].tolist(), "s", "q") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = lists(ann.neighbours(df, df.where("vec_id % 20 = 0"), 20))
    want = brute(rows, lambda q: q % 20 == 0, 20, False)
    assert found.keys() == want.keys()
    hits = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q, best in found.items():
        for i, s in best:
            assert s == pytest.approx(float(x[q].astype(float) @ x[i].astype(float)), abs=1e-9)


def test_neighbours_with_a_very_common_vector_and_odd_rows(spark, small_tiles):
    rows = vectors(300) + odd_rows() + [(10**6 + 20, [0.0] * 16, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = lists(ann.neighbours(df, df.where("vec_id % 4 = 0"), 20, width=50.0))
    want = brute(rows[:-1], lambda q: q % 4 == 0 and q < 10**6, 20, False)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_neighbours_of_few_and_no_rows(spark):
    df = spark.createDataFrame(vectors(4), SCHEMA)
    assert {len(v) for v in lists(ann.neighbours(df, df, 20)).values()} == {3}
    assert ann.neighbours(df.limit(0), df.limit(0), 20).collect() == []
