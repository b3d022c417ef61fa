"""Packing as an exact round trip, and ids against the tokenizer library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridsignal.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, length string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


def check(library, rows, got):
    """Every id of every document lies in one piece, sequences have no gaps and no padding."""
    texts = dict(rows)
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for doc_id, parts in pieces.items():
        want, at = ids(library, texts[doc_id]), 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(want)) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(want[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 40)
    rng = random.Random(2)
    topics = [[f"{t}word{i}" for i in range(40)] for t in "abcdef"]
    rows = [(i, " ".join(rng.choice(rng.choice(topics) if rng.random() < 0.2 else topics[i % 6]) for _ in range(int(rng.paretovariate(0.7) * 20) % 4000))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 30000), (1003, " " * 20000), (1004, "long text " * 30000)]
    df = spark.createDataFrame([(i, t, "s", "l") for i, t in rows], SCHEMA).repartition(3)
    check(library, rows, packing.pack(df, PATH).collect())


def test_windows_hold_similar_documents():
    rng = np.random.default_rng(0)
    items = [(i, 0, rng.integers(1000 * (i % 4) + 1, 1000 * (i % 4) + 300, 250).astype(np.uint16)) for i in range(64)]
    frequencies = np.bincount(np.concatenate([np.unique(x) for _, _, x in items]), minlength=5000)
    shard = packing.Shard(items, np.log1p((64 - frequencies + 0.5) / (frequencies + 0.5)), 250.0)
    windows = [w for w in shard.windows() if sum(n for _, _, n in w) == 1024]
    assert np.mean([len({i % 4 for i, _, n in w if n > 10}) == 1 for w in windows]) > 0.7


def test_halves_are_powers_of_two():
    window = [(0, 5, 300), (1, 0, 1), (2, 7, 470)]
    parts = list(packing.halves(window, 771))
    assert [sum(n for _, _, n in p) for p in parts] == [512, 256, 2, 1]
    joined = [(i, s + k) for p in parts for i, s, n in p for k in range(n)]
    assert joined == [(i, s + k) for i, s, n in window for k in range(n)]


def test_ids_equal_those_of_the_library(library):
    coder = packing.encoder(PATH)
    rng = random.Random(4)
    ranges = [(32, 127), (9, 14), (0xA0, 0x250), (0x370, 0x590), (0x2000, 0x2070), (0x4E00, 0x4F00), (0x1F600, 0x1F650), (0x300, 0x370), (0x660, 0x66A), (0x1680, 0x1681), (0x3000, 0x3001)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += ["it's we'll I'VE", "  two  spaces \n\n x", "a<|endoftext|>b", "<|endoftext|>", "1234567890 12 ½ ²", "\r\n\t", "a\x00b\x7f\x85c d"]
    for t in texts:
        assert coder.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("space", [" ", "\n", "\u3000", " \t"])
def test_white_space_of_extreme_length(library, space):
    text = "word" + space * 1_000_001 + "word"
    assert packing.encoder(PATH).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_separators_are_letters_of_a_long_word(library):
    text = "word " + "!\x1c" * 6_000 + " word"
    assert packing.LONG_RUN.search(text) and not packing.LONG_RUN.search("word " * 6_000)
    assert packing.encoder(PATH).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_repeated_rows_without_id_and_empty(spark):
    df = spark.createDataFrame([(None, "a b", "", ""), (1, "c", "", ""), (1, "c", "", "")], SCHEMA)
    got = packing.pack(df, PATH).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got if r["doc_id"] is None) == [("None", 3)] or sum(r["length"] for r in got if r["doc_id"] is None) == 3
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 4
    assert packing.pack(df.limit(0), PATH).collect() == []
