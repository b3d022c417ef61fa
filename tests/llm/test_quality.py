"""Quality scores: accuracy on held-out rows and degenerate inputs."""

import os
import random
import zlib

import numpy as np
import pytest

from gridsignal.llm import quality

DOCS = "doc_id long, text string, lang string, score string"
SF = "/root/testdata/sf0.01"


def corpus(n=900):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(20, 80))]
        good = int(rng.random() < 0.7)
        kind = rng.randrange(3)
        junk = [" ".join(w + "%%%" for w in words), " ".join(words).upper() + "!!", " ".join(words[:1] * len(words))]
        rows.append((i, (" ".join(words) + ".") if good else junk[kind], "en", "s"))
        labels.append((i, good))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    extra = [(5000, None, None, None), (5001, "", "", ""), (None, "abc def.", "", ""), (0, rows[0][1], "en", "s"), (5002, "word " * 50000, "", "")]
    docs = spark.createDataFrame(rows + extra, DOCS).repartition(4)
    known = spark.createDataFrame(labels + [(None, 1), (3, None), (4, labels[4][1])], "doc_id long, quality int")
    got = quality.quality_scores(docs, known).collect()
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert len(held) > 150 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert len({r["score"] for r in got if r["doc_id"] == 0}) == 1


def test_one_kind_of_label_or_none(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "", "") for i in range(40)], DOCS)
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(docs, one).collect()} == {1.0}
    assert {r["score"] for r in quality.quality_scores(docs, one.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), one).collect() == []


def test_normal_equations_equal_numpy(spark):
    rows, labels = corpus(60)
    stats = quality.with_statistics(spark.createDataFrame(rows, DOCS)).join(spark.createDataFrame([(i, float(q)) for i, q in labels], "doc_id long, quality double"), "doc_id")
    x = np.array([r["stats"] for r in stats.collect()])
    y = np.array([r["quality"] for r in stats.collect()])
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1
    zz, zy = quality.normal_equations(stats, centre, spread)
    z = quality.fourier(x, centre, spread)
    assert np.allclose(zz, z.T @ z) and np.allclose(zy, z.T @ y)


def test_kept_documents_have_all_columns(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, DOCS)
    kept = quality.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.dtypes == docs.dtypes
    truth = dict(labels)
    got = [r["doc_id"] for r in kept.collect()]
    assert sum(truth[i] for i in got) / sum(truth.values()) > 0.97 and sum(1 - truth[i] for i in got) < 0.1 * len(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
