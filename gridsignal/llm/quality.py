"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of a text are counts of bytes, words and lines. Random Fourier features of them approximate a Gaussian
kernel; ridge scores come from normal equations that partitions sum up; a rising step function, fitted on other labelled
rows, turns scores into shares of good documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsignal.llm.blobs import bounded_records
from gridsignal.session import settle

LABELLED_ROWS = 200_000
FOURIER = 256
RIDGE = 1e-3
THRESHOLD = 0.7
SEED = 23

CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [9, 32], "line": [10, 13],
    "stop": b".?", "comma": b",;:", "quote": b"'\"()-", "symbol": b"!#$%&*+/<=>@[\\]^_`{|}~", "high": range(128, 256),
}
STATISTICS = [
    *CLASSES, "log_bytes", "log_words", "word_mean", "word_spread", "word_longest", "distinct_words", "top_word",
    "repeated_next", "upper_words", "symbol_words", "log_lines", "distinct_lines", "line_mean", "distinct_pairs",
]


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(CLASSES)))
    for j, members in enumerate(CLASSES.values()):
        table[list(members), j] = 1
    return table


CLASS_TABLE = _class_table()
SYMBOL_ENDS = tuple("!#$%&*+/<=>@[\\]^_`{|}~")


def statistics(text: str) -> list[float]:
    """The numbers that stand for one text; all 0 where it has no words."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    shares = np.bincount(data, minlength=256) @ CLASS_TABLE / len(data)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        *shares.tolist(), np.log1p(len(data)), np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(counts) / n ** 0.8, max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n, sum(w.endswith(SYMBOL_ENDS) for w in words) / n, np.log1p(len(lines)),
        len(set(lines)) / len(lines), np.log1p(len(data) / len(lines)), pairs,
    ]


def statistics_rows(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts.to_pylist()], dtype=np.float64).reshape(-1, len(STATISTICS))


def with_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``stats`` of every document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            flat = statistics_rows(rows.column(1))
            stats = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), stats], names=["doc_id", "stats"])

    given = bounded_records(docs).select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(compute, "doc_id long, stats array<double>")


@dataclass
class Model:
    """Ridge weights over Fourier features and the steps of the calibration; ``weights`` is None for a constant score."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None
    edges: np.ndarray
    shares: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.centre, self.spread) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1. A fiftieth of the score is the uncalibrated one, so that documents of a step keep their order."""
        if self.weights is None:
            return np.full(len(stats), self.shares[0])
        raw = self.raw(stats)
        return 0.98 * np.interp(raw, self.edges, self.shares) + 0.02 * np.clip(raw, 0, 1)


def fourier(stats: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant. The directions follow from the seed alone."""
    draw = np.random.default_rng(SEED)
    dim = stats.shape[1]
    width = 1.5 * np.sqrt(dim)
    turn = draw.standard_normal((dim, FOURIER)) / width
    shift = draw.uniform(0, 2 * np.pi, FOURIER)
    x = np.clip((stats - centre) / spread, -4, 4)
    return np.hstack([np.cos(x @ turn + shift) * np.sqrt(2 / FOURIER), np.ones((len(x), 1))])


def fold(id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out. A document without an id is not held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4, F.lit(0))


def normal_equations(rows: DataFrame, centre: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Z'Z`` and ``Z'y`` over all rows: summed in each partition, then row by row of the matrix in a shuffle."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOURIER + 1, FOURIER + 2))
        for b in batches:
            if b.num_rows:
                z = fourier(matrix(b.column(0)), centre, spread)
                total += z.T @ np.column_stack([z, np.asarray(b.column(1), dtype=np.float64)])
        yield pa.RecordBatch.from_pydict({"row": pa.array(range(FOURIER + 1), pa.int32()), "sums": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in parts["sums"].to_pylist())
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    shape = "row int, sums binary"
    found = rows.select("stats", "quality").mapInArrow(sums, shape).groupBy("row").applyInArrow(add, shape).collect()
    total = np.stack([np.frombuffer(r["sums"], np.float64) for r in sorted(found, key=lambda r: r["row"])])
    return total[:, :-1], total[:, -1]


def matrix(stats: pa.Array) -> np.ndarray:
    return np.asarray(pc.list_flatten(stats), dtype=np.float64).reshape(len(stats), -1)


def fit(stats: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> Model:
    """Learn from the labelled documents that are not held out.

    Remainders 0 and 1 give the ridge weights, remainder 3 the calibration. ``most`` bounds the labelled rows of a fit:
    beyond it, about so many are taken by the hash of their id. Repeated labels of a document count once (the larger
    one). With labels of one kind only, or none, the score is the share of good ones (0.5 for none).
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    known = known.where(fold() != 2)
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = settle(stats.join(known, "doc_id").select("stats", "quality", fold().alias("fold")))
    train, check = rows.where("fold < 2"), rows.where("fold = 3")
    kinds = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(len(STATISTICS))
    if len(kinds) < 2 or train.agg(F.countDistinct("quality")).first()[0] < 2:
        good = kinds.get(1.0, 0) / sum(kinds.values()) if kinds else 0.5
        return Model(none, none + 1, None, np.zeros(1), np.array([good]))
    moments = train.select(F.posexplode("stats")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").limit(len(STATISTICS)).collect()
    centre = np.array([r["m"] for r in moments])
    spread = np.array([r["s"] or 1.0 for r in moments])
    zz, zy = normal_equations(train, centre, spread)
    weights = np.linalg.solve(zz + RIDGE * zz[-1, -1] / FOURIER * np.eye(len(zz)), zy)
    model = Model(centre, spread, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"raw": pa.array(model.raw(matrix(b.column(0))) if b.num_rows else [], pa.float64()), "quality": b.column(1)})

    steps = check.select("stats", "quality").mapInArrow(scored, "raw double, quality double")
    if steps.limit(1).count():
        curve = IsotonicRegression(featuresCol="raw", labelCol="quality").fit(steps)
        model.edges, model.shares = np.array(curve.boundaries.toArray()), np.array(curve.predictions.toArray())
    return model


def score(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of statistics."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.score(matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["doc_id", "score"])

    scored = stats.select("doc_id", "stats").mapInArrow(compute, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every document: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Null and empty texts are scored like any other; a null id is allowed and has no label; repeated rows are scored
    alike; no documents give no rows. Only the text is read for the score.
    """
    stats = settle(with_statistics(docs, id, text))
    return score(stats, fit(stats, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    stats = settle(with_statistics(docs, id, text))
    model = fit(stats, labels)
    place = docs.columns.index(text)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(model.score(statistics_rows(b.column(place))) >= threshold))

    return docs.mapInArrow(chosen, docs.schema)
