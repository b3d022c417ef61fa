"""Substring deduplication by suffixes and by sentence spans, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from gridsignal.llm import blobs, exchange, spans, suffixes

SCHEMA = "doc_id long, text string, n_chars long, n_bytes string, batch string"
LAST = 1 << 63


def run(spark, rows, fn, parts=3):
    df = spark.createDataFrame([(i, t, len(t or ""), "x", "y") for i, t in rows], SCHEMA).repartition(parts)
    return fn(df)


@pytest.fixture
def small_batches(monkeypatch):
    original = blobs.write_batches
    for module in (suffixes, spans):
        monkeypatch.setattr(module.blobs, "write_batches", lambda df, text="text", size=700: original(df, text, size))


def covered(rows):
    """Marks of the bytes that each row loses."""
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        out.append(gone)
    return out


def brute_digest(rows):
    out = []
    for (i, t), gone in zip(rows, covered(rows)):
        b = np.frombuffer((t or "").encode(), np.uint8)
        padded = np.concatenate([[False], gone])
        out.append((i, len(b), int(gone.sum()), int((padded[1:] & ~padded[:-1]).sum()), hashlib.sha256(b[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def documents(seed, count=60, letters="abc d"):
    """Texts that share passages of about 50 bytes, cut and joined at random."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.randint(40, 130)) for _ in range(6)]
    rows = []
    for i in range(count):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts.append(p[a : a + rng.randint(30, 130)] if rng.random() < 0.6 else text(rng.randint(0, 90)))
        rows.append((rng.randint(0, 10**6), "".join(parts)))
    return rows


@pytest.fixture(params=[12, -22])
def few_key_bits(request, monkeypatch):
    """The second value leaves 16 bits for a key, so that many different strings meet."""
    monkeypatch.setattr(exchange, "SPARE_BITS", request.param)


@pytest.mark.parametrize("seed,letters", [(1, "abc d"), (2, "ab"), (3, "éü€ a"), (4, "a")])
def test_removed_bytes_equal_brute_force(spark, small_batches, few_key_bits, seed, letters):
    rows = documents(seed, letters=letters)
    got = sorted((tuple(r) for r in run(spark, rows, suffixes.dedup_digest).collect()), key=str)
    assert got == brute_digest(rows)


def test_odd_rows_of_suffixes(spark, small_batches):
    t = "".join(random.Random(7).choice("xyz ") for _ in range(300))
    rows = [(5, t), (5, t), (2, t[:120]), (None, t), (None, t[100:]), (9, None), (10, ""), (11, t[:49]), (1, "q" * 40), (12, "z" * 3000), (13, "z" * 60)]
    rows += [(20 + i, t[50:140]) for i in range(40)]
    got = sorted((tuple(r) for r in run(spark, rows, suffixes.dedup_digest, 5).collect()), key=str)
    assert got == brute_digest(rows)
    assert suffixes.dedup_digest(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("most", [0, 5, 30])
def test_hot_anchors_are_taken_apart(spark, small_batches, monkeypatch, most):
    """A phrase with different text around it in every document comes to no task in one piece."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, passage = text(45), text(70)
    rows = [(rng.randint(0, 500), text(rng.randint(0, 60)) + phrase + text(rng.randint(0, 60))) for _ in range(90)]
    rows += [(i, text(9) + phrase[10:] + passage + phrase + "xy" * (i % 3)) for i in rng.sample(range(1000), 20)] + [(None, phrase + passage)]
    plain, anchor = suffixes.resolve, slice(suffixes.BEFORE, suffixes.BEFORE + suffixes.GRAM)

    def bounded(owner, around):
        _, count = np.unique(around[:, anchor], axis=0, return_counts=True)
        assert count.max(initial=0) <= most
        return plain(owner, around)

    monkeypatch.setattr(suffixes, "resolve", bounded)
    monkeypatch.setattr(suffixes, "HOT_HEADS", most)
    got = sorted((tuple(r) for r in run(spark, rows, suffixes.dedup_digest).collect()), key=str)
    assert got == brute_digest(rows)


def test_texts_keep_whole_characters_and_all_columns(spark, small_batches):
    shared = "é" * 60
    rows = [(1, "a" + shared), (2, shared + "tail"), (3, shared), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in run(spark, rows, suffixes.dedup_texts).collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert (got[1]["text"], got[2]["text"], got[4]["text"], got[5]["text"]) == ("a" + shared, "tail", None, "")
    assert (got[2]["n_chars"], got[2]["n_bytes"], got[2]["batch"]) == (4, "x", "y")


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(3)
    right = rng.integers(0, 2, (500, suffixes.LENGTH)).astype(np.uint8)
    right[::3] = right[0]
    right[1::5, :30] = right[2, :30]
    group = np.sort(rng.integers(0, 9, 500))
    order = suffixes.Suffixes(right).sort(group)
    keys = [(int(group[i]), right[i].tobytes(), int(i)) for i in range(500)]
    assert [keys[i] for i in order] == sorted(keys)


def test_collisions_are_seen(monkeypatch):
    """With hashes that all collide, results still follow the bytes."""
    rng = np.random.default_rng(5)
    around = rng.integers(97, 99, (80, suffixes.SPAN)).astype(np.uint8)
    around[::2] = around[0]
    around[1::7, suffixes.BEFORE :] = around[1, suffixes.BEFORE :]
    owner = rng.integers(0, 30, 80)
    want = suffixes.resolve(owner, around)
    monkeypatch.setattr(suffixes, "mix", lambda h: h * np.uint64(0))
    monkeypatch.setattr(suffixes, "WEIGHTS", np.zeros(suffixes.SPAN, np.uint64))
    assert (suffixes.resolve(owner, around) == want).all()


def brute_spans(rows):
    import re

    docs = []
    for n, (i, t) in enumerate(rows):
        parts = [p.strip(" \t\r\n") for p in re.split(r"(?<=[.!?])[ \t\r]+|\n", t or "")]
        docs.append((LAST if i is None else i, n, [p for p in parts if p]))
    seen, gone = set(), {}
    for i, n, s in sorted(docs):
        gone[n] = set()
        for a in range(len(s)):
            b = next((b for b in range(a + 2, len(s) + 1) if sum(len(re.findall(r"[^ \t\r\n]+", x)) for x in s[a:b]) >= 10), None)
            if b is not None:
                key = tuple(s[a:b])
                if key in seen:
                    gone[n] |= set(range(a, b))
                seen.add(key)
    return sorted(
        ((rows[n][0], len(s), len(gone[n]), hashlib.sha256("\n".join(x for k, x in enumerate(s) if k not in gone[n]).encode()).hexdigest()) for _, n, s in docs), key=str
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_equal_brute_force(spark, small_batches, seed):
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice(["ab", "cé", "3.14", "e-f"]) for _ in range(rng.randint(1, 6))) + rng.choice([".", "!", "?!", "", "..."])
    passages = [[sentence() for _ in range(rng.randint(2, 6))] for _ in range(5)]
    rows = []
    for i in rng.sample(range(1000), 50):
        parts = [x for _ in range(rng.randint(0, 4)) for x in (rng.choice(passages) if rng.random() < 0.6 else [sentence()])]
        rows.append((i, "".join(x + rng.choice([" ", "  ", "\n", " \t\n"]) for x in parts)))
    rows += [(2000, None), (2001, ""), (2002, " \n ")]
    got = sorted((tuple(r) for r in run(spark, rows, spans.dedup_digest).collect()), key=str)
    assert got == brute_spans(rows)
    assert spans.dedup_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_span_texts_keep_separators(spark, small_batches):
    p = "One two three four five. Six seven eight nine ten eleven."
    rows = [(1, f"Intro here.  {p}\nEnd."), (2, f"{p}  Other words stay."), (3, None), (None, p)]
    got = {r["doc_id"]: r["text"] for r in run(spark, rows, spans.dedup_texts).collect()}
    assert got == {1: rows[0][1], 2: "Other words stay.", 3: None, None: ""}
