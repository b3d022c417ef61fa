"""Mixing against a plain version, its targets, and odd rows."""

import math

import pytest

from gridsignal.llm import mixing

SCHEMA = "doc_id long, text string, source string, block string, epoch string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "b", "e") for i, t, s in rows], SCHEMA).repartition(3)


def corpus(sizes=(400, 60, 9, 1)):
    rows, number = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append((number, " ".join(["w"] * (1 + number % 7)), f"s{s}"))
            number += 1
    return rows


def weights(rows):
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + len(t.split()) + 1
    return total


def entropy(shares):
    return -sum(p * math.log(p) for p in shares if p)


def test_entropy_target(spark):
    rows = corpus()
    totals = weights(rows)
    shares = mixing.source_shares(frame(spark, rows).select("source", mixing.word_tokens(mixing.F.col("text")).alias("tokens")))
    assert {r["source"]: r["total"] for r in shares.collect()} == totals
    for part in (0.5, 0.8, 0.99, 1.0):
        a = mixing.exponent_for_entropy(shares, part)
        every = sum(totals.values())
        mass = lambda e: [(t / every) ** e for t in totals.values()]
        of = lambda e: entropy([m / sum(mass(e)) for m in mass(e)])
        assert of(a) >= part * math.log(4) - 1e-9
        assert a == 1 - 2**-21 or a == 0 or of(a + 2**-20) < part * math.log(4)
    assert mixing.exponent_for_entropy(shares, 0.0) == 1 - 2**-21


@pytest.mark.parametrize("repeats", [1.0, 1.5, 4.0, 1000.0])
def test_repetition_limit(spark, repeats):
    rows = corpus()
    totals = weights(rows)
    got = mixing.mix(frame(spark, rows), repeats=repeats).collect()
    used = {}
    for r in got:
        used[r["source"]] = used.get(r["source"], 0) + r["tokens"]
    longest = max(len(t.split()) + 1 for _, t, _ in rows)
    for s, n in totals.items():
        assert n <= used[s] <= repeats * n + longest
    assert {r["doc_id"] for r in got} == {i for i, _, _ in rows}
    if repeats < 1000:
        assert max(used[s] / n for s, n in totals.items()) > repeats * 0.95 - 0.05


def test_budget_and_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 64)
    rows = corpus((200, 100))
    got = sorted(mixing.mix(frame(spark, rows), entropy=1.0, tokens=3000).collect(), key=lambda r: r["mix_order"])
    used = {s: sum(r["tokens"] for r in got if r["source"] == s) for s in ("s0", "s1")}
    assert all(1500 <= n < 1509 for n in used.values())
    half = [r for r in got if r["mix_order"] < 0.5]
    assert abs(sum(r["tokens"] for r in half if r["source"] == "s0") - 750) < 20
    for s in used:  # one epoch after another, each document once in a full epoch, blocks in one piece
        own = [r for r in got if r["source"] == s]
        assert [r["epoch"] for r in own] == sorted(r["epoch"] for r in own)
        full = [r["doc_id"] for r in own if r["epoch"] == 0]
        assert len(full) == len(set(full))
        place = 0
        for r in own:
            assert r["mix_order"] == pytest.approx(place / 1500)
            place += r["tokens"]
        blocks = [(r["epoch"], r["block"]) for r in own]
        assert len([1 for a, b in zip(blocks, blocks[1:]) if a != b]) + 1 == len(set(blocks)) > 4


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", None), (None, "a b", "s"), (3, "a", "s"), (3, "a", "s"), (4, "word " * 30000, "s")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["source"], r["tokens"], r["epoch"]) for r in got), key=str) == sorted(
        [(1, None, 1, 0), (2, None, 1, 0), (None, "s", 3, 0), (3, "s", 2, 0), (3, "s", 2, 0), (4, "s", 30001, 0)], key=str
    )
    assert mixing.mix(frame(spark, rows).limit(0), repeats=2.0).collect() == []
    assert mixing.mix(frame(spark, rows).limit(0), entropy=0.5, tokens=5).collect() == []


def test_documents_keep_their_columns(spark):
    rows = corpus((30, 3))
    got = mixing.mixed_documents(frame(spark, rows), 2.0)
    assert got.dtypes == frame(spark, rows).dtypes
    assert {tuple(r)[:3] for r in got.collect()} == set(rows)


def test_plan_has_no_python(spark):
    plan = mixing.mix(frame(spark, corpus((20, 5))), repeats=2.0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
