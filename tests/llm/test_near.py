"""Jaccard join and components against brute force."""

import random

import numpy as np
import pytest

from gridsignal.llm import jaccard
from gridsignal.llm.graph import components
from gridsignal.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, n_shingles string, family string, u long"


def words_of(text):
    return (text or "").encode().lower().split()


def brute_sets(rows, size):
    out = {}
    for i, text in rows:
        w = words_of(text)
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute(rows, percent=85, size=4):
    sets = brute_sets(rows, size)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, families, copies, length, edits):
    """Families of texts with random edits, so that similarities lie around the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, number = [], 100
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, length))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2))]
                w = w or ["x"]
            rows.append((number, rng.choice([" ", "  ", "\n", "\t"]).join(w).replace("w1", rng.choice(["w1", "W1"]))))
            number -= 1 if rng.random() < 0.5 else -7
    rows = list(dict(rows).items())
    rng.shuffle(rows)
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(4)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df, **options).collect()), key=str)


def test_sets_equal_those_of_words():
    texts = ["A b\tc\x0bd E", "a b c", "x", "", "  ", "é É ü Ü é É ü", "a\xa0b c d e", "same same same same same same", "w " * 3000]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    got = shingle_sets(np.frombuffer(b"".join(data), np.uint8), offsets, 4)
    want = brute_sets(list(enumerate(texts)), 4)
    assert [len(s) for s in got] == [len(want[i]) for i in range(len(texts))]
    assert all((np.diff(s.astype(object)) > 0).all() for s in got)


@pytest.mark.parametrize("seed,length,edits", [(1, 40, 4), (2, 12, 2), (3, 300, 12), (4, 6, 1)])
def test_components_equal_brute_force(spark, monkeypatch, seed, length, edits):
    monkeypatch.setattr(jaccard, "FLUSH_KEYS", 500)
    rows = corpus(seed, 60, 8, length, edits)
    want = brute(rows)
    assert run(spark, rows) == sorted(((i, n, c) for i, (n, c) in want.items()), key=str)


def test_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = corpus(9, 3, 90, 60, 9)
    want = brute(rows)
    assert run(spark, rows) == sorted(((i, n, c) for i, (n, c) in want.items()), key=str)


def test_blocks_of_a_family_meet_where_sizes_allow_a_link(spark, monkeypatch):
    """A family of sets of all sizes: texts are sent to few of its blocks, and no pair that can link is left out."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    sizes = [round(12 * 1.02**i) for i in range(200)] + [100] * 50
    members = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "doc_id long, family long, n long")
    placed = {r.doc_id: r for r in jaccard.placed_by_size(members, 80).collect()}
    assert len(placed) == 250 and max(r.own for r in placed.values()) > 20
    for i, m in enumerate(sizes):
        assert placed[i].first <= placed[i].own <= placed[i].last
        assert all(placed[i].first <= placed[j].own <= placed[i].last for j, n in enumerate(sizes) if 80 * m <= 100 * n and 80 * n <= 100 * m)
    blocks = max(r.own for r in placed.values()) + 1
    assert sum(r.last - r.first + 1 for r in placed.values()) < 250 * blocks / 2


def test_other_threshold_and_length(spark):
    rows = corpus(11, 50, 6, 60, 8)
    want = brute(rows, 80, 5)
    assert run(spark, rows, percent=80, words=5) == sorted(((i, n, c) for i, (n, c) in want.items()), key=str)


def test_odd_rows(spark):
    text = "one two three four five six"
    rows = [(5, text), (5, text), (3, text), (None, text), (7, None), (8, ""), (9, "  "), (10, "a b"), (11, "A  b"), (12, "word " * 20000)]
    assert run(spark, rows) == sorted(
        [(5, 3, 3), (5, 3, 3), (3, 3, 3), (None, 3, None), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 1, 10), (12, 1, 12)], key=str
    )
    assert jaccard.join_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keep_one_keeps_columns_and_one_row_of_each_text(spark):
    text, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [
        (5, text, "a", "b", 1), (3, text, "c", "d", 2), (None, text, "e", "f", 3), (6, None, "g", "h", 4), (7, None, "g", "h", 4), (8, "", "i", "j", 5), (8, "", "i", "j", 5),
        (5, other, "k", "l", 6), (9, other + " more words", "m", "n", 7), (9, other + " more words", "m", "n", 7),
        (None, "no id but words enough for a set", "o", "p", 8), (None, "no id but words enough for a set", "o", "p", 8),
    ]
    got = jaccard.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "text", "n_shingles", "family", "u"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[1], *rows[3:8], rows[8], rows[10]], key=str)
    assert jaccard.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keep_one_keeps_a_document_of_each_component(spark):
    rows = corpus(21, 50, 8, 40, 4)
    chance = random.Random(4)
    # ids that stand on several texts: rows are told apart by their place
    docs = [(chance.choice([i, i % 11, None]), t, str(k), "", k) for k, (i, t) in enumerate(rows)]
    component = {k: c for k, (_, c) in brute([(k, t) for k, (_, t) in enumerate(rows)]).items()}
    got = [r["u"] for r in jaccard.keep_one(spark.createDataFrame(docs, SCHEMA).repartition(4)).collect()]
    assert sorted(component[k] for k in got) == sorted(set(component.values()))
    for k in got:
        same = [docs[j][0] for j in component if component[j] == component[k] and docs[j][0] is not None]
        assert docs[k][0] == min(same, default=None)


def test_numbers_of_rows_name_their_batch(spark):
    batches = [0, 1, 5, (3 << 32) + 7, (9000 << 32) + (1 << 20)]
    numbers = [int(n) for b in batches for n in jaccard.row_numbers(b, 3)]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert [r[0] for r in df.select(jaccard.batch_of(jaccard.F.col("n"))).collect()] == [b for b in batches for _ in range(3)]
    assert len(set(numbers)) == len(numbers)


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_linked_sets_share_an_announced_range(percent):
    rng = np.random.default_rng(percent)
    ranges = jaccard.Ranges(percent)
    for _ in range(150):
        n = int(rng.integers(1, 400))
        base = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        most = (100 - percent) * len(base) // 100
        a = np.sort(rng.permutation(base)[: len(base) - int(rng.integers(0, most + 1))])
        b = np.union1d(a, base[: max(1, len(base) // 50)]) if rng.random() < 0.3 else base
        x, y = set(a.tolist()), set(b.tolist())
        if 100 * len(x & y) >= percent * len(x | y):
            assert np.intersect1d(ranges.keys(a), ranges.keys(b)).size


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1001 + i) for i in range(60)] + [(3000, 1060)]
    rng = random.Random(1)
    edges = path + star + [(7, 7)]
    rng.shuffle(edges)
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {i: 1000 for i in [*range(1001, 1061), 3000]}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
