"""Spelling variants against a comparison of all pairs, the counting of words by hand, and edge cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from gridsignal.llm import spelling

SCHEMA = "doc_id long, text string, n int, word string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 3, "word") for i, t in docs], SCHEMA).repartition(3)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def count_by_hand(docs, every=31):
    seen = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                seen[run] = seen.get(run, 0) + 1
    return {w: n for w, n in seen.items() if n >= 2}


def by_hand(docs):
    words = count_by_hand(docs)
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def check(spark, docs):
    got = sorted(tuple(r) for r in spelling.spelling_groups(frame(spark, docs)).collect())
    assert got == by_hand(docs)
    return got


def noisy(chance, letters, count, spread):
    """Texts of some words, each with a few others that one or two edits part from it."""
    roots = ["".join(chance.choice(letters) for _ in range(chance.randrange(6, 12))) for _ in range(count)]
    docs = []
    for i in range(spread):
        words = []
        for _ in range(60):
            w = chance.choice(roots[: 1 + chance.randrange(count)])
            while chance.random() < 0.15:
                at, c = chance.randrange(len(w) + 1), chance.choice(letters)
                w = chance.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if chance.random() < 0.2 else w)
        docs.append((i if i % 17 else None, chance.choice([" ", "-", "1", "\n"]).join(words)))
    return docs


@pytest.mark.parametrize("letters, count, spread", [("ab", 12, 60), ("abcmyéÿ", 30, 80), ("etaoinshrdlu", 200, 120)])
def test_groups_like_all_pairs(spark, letters, count, spread):
    got = check(spark, noisy(random.Random(count), letters, count, spread))
    assert any(r[1] for r in got) or letters == "ab"


def test_small_buckets_and_frontiers_change_nothing(spark, monkeypatch):
    docs = noisy(random.Random(8), "abcde", 40, 80)
    want = by_hand(docs)
    for name, value in (("BUCKET_WORDS", 7), ("BUCKET_SEARCHES", 11), ("FRONTIER", 5), ("PAIR_BYTES", 40)):
        monkeypatch.setattr(spelling, name, value)
    assert sorted(tuple(r) for r in spelling.spelling_groups(frame(spark, docs)).collect()) == want


def test_chains_ties_and_code_points(spark):
    text = " ".join(["station"] * 2 + ["stations"] * 25 + ["stationss"] * 300 + ["zztation"] * 2 + ["étation"] * 25 + ["xtation"] * 3)
    got = {r[0]: r for r in check(spark, [(1, text)])}
    assert got["station"][2] == "stationss"


def test_odd_rows(spark):
    long = "abcdefgh" * 20_000
    docs = [(1, None), (2, ""), (None, "Running runnings Running"), (3, f"{long} {long}x {long}"), (3, f"{long}x"), (4, "1234567 ........")]
    check(spark, docs)
    assert spelling.spelling_groups(frame(spark, docs).limit(0)).collect() == []
    assert spelling.spelling_groups(frame(spark, [(1, "short words only")])).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_every_letter_in_turn_and_without_checksums(spark):
    docs = [(i, "different words matter") for i in range(200)]
    assert {r.word: r.n for r in spelling.word_counts(frame(spark, docs)).collect()} == count_by_hand(docs)
    assert {r.word: r.n for r in spelling.word_counts(frame(spark, docs), every=0).collect()} == count_by_hand(docs, 0)


def test_search_finds_every_pair_once():
    chance = random.Random(2)
    words = sorted({"".join(chance.choice("abcdefg") for _ in range(chance.randrange(7, 10))) for _ in range(600)})
    n = np.array([chance.randrange(2, 9) for _ in words])
    ours, theirs = spelling.search(words, n, words, n)
    for i, (f, g, b, c) in enumerate(zip(ours.found, theirs.found, ours.best(), theirs.best())):
        near = [j for j, v in enumerate(words) if one_edit(v, words[i])]
        assert f + g == len(near)
        assert min((j for j in (b, c) if j >= 0), key=lambda j: (-n[j], j), default=-1) == min(near, key=lambda j: (-n[j], j), default=-1)
    # one more, or one more and then one less
    assert len(spelling.reachable(np.zeros((1, 4), np.int64))) == 1 + 4 + 6
