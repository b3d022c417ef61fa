"""Lexical retrieval packing: windows are filled with documents that share rare tokens with a seed document.

Every document is tokenized once into a written table. Full windows of a long document stand alone; what is left of each
document goes into a shard, which holds an inverted index with BM25 weights. A seed takes unused neighbours from the
index, best first, until its window is full; a neighbour that does not fit is cut and its rest stays in the shard.
Document frequencies and lengths are those of all documents.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridsignal.llm.blobs import bounded_records
from gridsignal.session import settle

WINDOW = 1024
END = 0
SHARD_ITEMS = 2048
SHARD_TOKENS = 8 << 20
QUERY_TERMS = 12
NEAREST = 16
K1, B = 1.2, 0.75
LONG_WORD = 10_000

# fixed value: how the byte-level vocabulary splits texts into words
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# the pattern's \s does not hold the four separators that Python counts as white space
_WHITE, _SOLID = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
LONG_RUN = re.compile(rf"(?<!{_WHITE}){_WHITE}{{{LONG_WORD + 1}}}|(?<!{_SOLID}){_SOLID}{{{LONG_WORD + 1}}}")

TOKENS = "doc_id long, n long, ids binary, frequencies binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of a byte-level BPE vocabulary file. A word or white space of extreme length goes to the library
    that copes with it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.size = max([*ranks.values(), *special.values()]) + 1
        self.special = set(special)
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.slow = path, None

    def ids(self, text: str) -> np.ndarray:
        if len(text) > LONG_WORD and LONG_RUN.search(text):
            if self.slow is None:
                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=self.special)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Settled ids of every document, ended by id 0, and per task one row (``n`` 0) with its document frequencies."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        kind = np.uint16 if coder.size <= 1 << 16 else np.uint32
        seen, frequencies = np.zeros(coder.size, np.uint8), np.zeros(coder.size, np.int64)
        for rows in batches:
            counts, blobs = [], []
            for t in rows.column(1).to_pylist():
                ids = np.append(coder.ids(t or ""), END).astype(kind)
                seen[ids] = 1
                frequencies += seen
                seen[ids] = 0
                counts.append(len(ids)), blobs.append(ids.tobytes())
            yield token_rows(rows.column(0), counts, blobs, [None] * len(blobs))
        yield token_rows(pa.array([None], pa.int64()), [0], [b""], [frequencies.tobytes()])

    given = bounded_records(docs).select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return settle(given.mapInArrow(encode, TOKENS))


def token_rows(ids: pa.Array, counts: list[int], blobs: list[bytes], frequencies: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(counts, pa.int64()), pa.array(blobs, pa.binary()), pa.array(frequencies, pa.binary())],
        names=["doc_id", "n", "ids", "frequencies"],
    )


def corpus_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """How many documents hold each id (one number per id of the vocabulary), the number of documents, and the mean
    length of what is left of a document after its full windows."""

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int64) for b in parts["frequencies"].to_pylist())
        return pa.table({"frequencies": pa.array([total.tobytes()], pa.binary())})

    parts = tokens.where("n = 0").groupBy(F.pmod(F.xxhash64("frequencies"), F.lit(64))).applyInArrow(add, "frequencies binary").collect()
    frequencies = sum((np.frombuffer(r["frequencies"], np.int64) for r in parts), np.zeros(1, np.int64))
    facts = tokens.where("n > 0").agg(F.count("*").alias("n"), F.avg(F.col("n") % WINDOW).alias("mean")).first()
    return frequencies, facts["n"], facts["mean"] or 1.0


class Shard:
    """Rests of documents with their inverted index."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]], idf: np.ndarray, mean: float) -> None:
        self.items = items  # row of the document, first id, ids
        count = len(items)
        self.start = np.array([i[1] for i in items], np.int64)
        self.left = np.array([len(i[2]) for i in items], np.int64)
        terms = np.concatenate([i[2] for i in items]).astype(np.int64)
        pairs, tf = np.unique(terms * count + np.repeat(np.arange(count), self.left), return_counts=True)
        term, self.posted = np.divmod(pairs, count)
        fit = K1 * (1 - B + B * self.left[self.posted] / mean)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + fit)
        begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        ends = np.append(begin[1:], len(term))
        which = np.repeat(np.arange(len(begin)), ends - begin)
        self.begin, self.end = begin, ends
        self.forward = np.argsort(self.posted, kind="stable")
        self.of_term = which[self.forward]
        self.of_item = np.searchsorted(self.posted[self.forward], np.arange(count + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every item for the seed's heaviest terms that others have too."""
        own = slice(self.of_item[seed], self.of_item[seed + 1])
        terms = self.of_term[own]
        heavy = np.where(self.end[terms] - self.begin[terms] > 1, self.weight[self.forward[own]], 0)
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(heavy, len(terms) - QUERY_TERMS)[len(terms) - QUERY_TERMS :]]
        spans = [slice(b, e) for b, e in zip(self.begin[terms].tolist(), self.end[terms].tolist())]
        found = np.concatenate([self.posted[s] for s in spans])
        weight = np.concatenate([self.weight[s] for s in spans])
        return np.bincount(found, weight, len(self.items))

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Windows as lists of pieces: item, first id in the document, length. All but the last one are full."""
        longest = np.argsort(-self.left, kind="stable").tolist()
        at = 0
        while at < len(longest):
            seed = longest[at]
            if not self.left[seed]:
                at += 1
                continue
            window, space = [], WINDOW

            def take(item: int) -> None:
                nonlocal space
                n = int(min(space, self.left[item]))
                window.append((item, int(self.start[item]), n))
                self.start[item] += n
                self.left[item] -= n
                space -= n

            take(seed)
            if space:
                score = self.scores(seed)
                score[self.left == 0] = 0
                near = np.argpartition(score, -NEAREST)[-NEAREST:] if len(score) > NEAREST else np.arange(len(score))
                for step in (near, None):
                    if step is None:
                        step = np.flatnonzero((score > 0) & (self.left > 0))
                    for item in step[np.argsort(-score[step], kind="stable")].tolist():
                        if not space or score[item] <= 0:
                            break
                        if self.left[item]:
                            take(item)
                    if not space:
                        break
            other = at + 1
            while space and other < len(longest):
                if self.left[longest[other]]:
                    take(longest[other])
                other += 1
            yield window


def halves(window: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """Cut a window of ``total`` ids into windows whose lengths are powers of two, longest first."""
    rest = list(window)
    for bit in reversed(range(total.bit_length())):
        space = total & (1 << bit)
        part = []
        while space:
            item, start, n = rest.pop(0)
            cut = min(n, space)
            part.append((item, start, cut))
            if cut < n:
                rest.insert(0, (item, start + cut, n - cut))
            space -= cut
        if part:
            yield part


def pack(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids: see ``PIECES`` for the columns.

    A document is its ids and one id 0, so null and empty texts have one id. Every id lies in one piece; pieces of a
    sequence follow without gaps. Sequences hold 1024 ids, except that the last window of a shard is cut into powers of
    two, so that nothing is padded. Null ids and repeated rows are documents of their own, and ties between documents go
    by their place in the shard; no documents give no rows. Other columns are ignored.
    """
    tokens = tokenize(docs, vocabulary, id, text)
    frequencies, documents, mean = corpus_frequencies(tokens)
    idf = np.log1p((documents - frequencies + 0.5) / (frequencies + 0.5))
    broad = docs.sparkSession.sparkContext.broadcast(idf)  # one number per id of the vocabulary
    kind = np.uint16 if len(idf) <= 1 << 16 else np.uint32

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        items: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal sequence, rows, items, held
            columns: list[list] = [[] for _ in range(7)]

            def write(window: list[tuple[int, int, int]], document) -> None:
                nonlocal sequence
                offset = 0
                for item, start, n in window:
                    doc_id, ids = rows[document(item)]
                    crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                    for column, value in zip(columns, (doc_id, start, n, crc, len(ids), sequence, offset)):
                        column.append(value)
                    offset += n
                sequence += 1

            for r, (_, ids) in enumerate(rows):
                for start in range(0, len(ids) - len(ids) % WINDOW, WINDOW):
                    write([(r, start, WINDOW)], lambda item: item)
            if items:
                for window in Shard(items, broad.value, mean).windows():
                    total = sum(n for _, _, n in window)
                    for part in [window] if total == WINDOW else halves(window, total):
                        write(part, lambda item: items[item][0])
            rows, items, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(blob, kind)
                whole = len(ids) - len(ids) % WINDOW
                rows.append((doc_id, ids))
                if whole < len(ids):
                    items.append((len(rows) - 1, whole, ids[whole:]))
                held += len(ids)
                if len(rows) >= SHARD_ITEMS or held >= SHARD_TOKENS:
                    yield close()
        if rows:
            yield close()

    return tokens.where("n > 0").select("doc_id", "ids").mapInArrow(fill, PIECES)
