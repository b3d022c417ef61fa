"""License scan: base phrases against plain Python, resolution of overlaps against brute force, and edge cases."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from gridsignal.llm import licenses
from gridsignal.llm.license_rules import BASE, CONFIDENCE, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = list(CONFIDENCE)


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text):
    """Every rule over the words of a text; each detection compared with each other one."""
    words = words_of(text)
    line = "".join(f" {w} " for w in words)
    found = []
    for rule in rules():
        for m in re.finditer(rule.pattern, line):
            first = line[: m.start()].count(" ") // 2
            found.append((first, first + m[0].count(" ") // 2, KINDS.index(rule.kind), rule.order, rule.label))
    inside = lambda d, e: e[0] <= d[0] and d[1] <= e[1] and ((e[0], e[1]) != (d[0], d[1]) or e[2:4] < d[2:4])
    chain = sorted(d for d in found if not any(inside(d, e) for e in found))
    kept = []
    for i, d in enumerate(chain):
        beside = [e for e in chain[max(0, i - 1) : i + 2] if e is not d and e[0] < d[1] and d[0] < e[1]]
        if all(e[2] >= d[2] for e in beside):
            kept.append(d)
    return words, found, kept


def base_places(words):
    out = []
    for phrase, label in BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(out)


def check(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    digest = {r.doc_id: r for r in licenses.license_digest(rows).collect()}
    assert len(got) == len(digest) == len(texts)
    for i, text in enumerate(texts):
        words, _, kept = by_hand(text)
        places = base_places(words)
        assert got[i].n_words == len(words)
        assert sorted((b.start, b.label) for b in got[i].base) == places
        assert [(d.start, d.end, KINDS.index(d.kind), d.rule, d.label) for d in got[i].detections] == kept
        d = digest[i]
        assert (d.n_base, d.base_labels) == (len(places), ",".join(sorted({p[1] for p in places})))
        assert (d.first_word, d.last_word) == ((places[0][0], max(p[0] for p in places)) if places else (None, None))
        assert d.labels == ",".join(sorted({p[1] for p in places} | {k[4] for k in kept}))
        assert d.score == max([CONFIDENCE[KINDS[k[2]]] for k in kept], default=0.0)


def test_notices_and_edge_cases(spark):
    check(spark, [
        None, "", "...", "ß ĸ Apache License", "Released under the MIT License.", "MIT\n-License; mit, license",
        "This work is licensed under the GNU General Public License, version 3.", "licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: GPL-2.0-or-later WITH nothing", "see https://www.apache.org/licenses/LICENSE-2.0.txt",
        "GNU Lesser General Public License v2.1, GNU General Public Licence", "Kit license", "cc by cc by cc by",
        "All rights reserved. Simplified BSD License", "apache license mit license gnu general public license cc by",
    ])


def test_random_texts_resolve_like_brute_force(spark):
    chance = random.Random(5)
    vocabulary = sorted({w for r in rules() for w in re.findall("[a-z0-9]+", r.pattern) if len(w) < 14})
    phrases = [re.sub(r" +", " ", re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", r.pattern.replace("[cs]", "s").replace("?", ""))) for r in rules()]
    texts = []
    for _ in range(250):
        parts = [chance.choice(phrases) if chance.random() < 0.5 else chance.choice(vocabulary) for _ in range(chance.randrange(1, 40))]
        texts.append(" ".join(parts))
    check(spark, texts)


def test_a_very_long_text(spark):
    text = ("lorem ipsum apache license, version 2.0 " * 30_000) + "mit license"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = licenses.license_digest(rows).first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word) == (30_000 * 7 + 2, 30_001, 2, 210_000)
    assert got.labels == "apache,apache-2.0,mit"


def test_rules_are_gated_by_what_every_match_holds():
    given = rules()
    assert len(given) > 300 and all(r.parts and r.gate in r.parts for r in given)
    pattern = re.compile(licenses.gate_pattern(given))
    for rule in given:
        # both ways through every optional part
        for keep in (True, False):
            sample = rule.pattern
            while "(" in sample:
                sample = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: m[1].split("|")[-1 if keep else 0] if keep or not m[2] else "", sample)
            sample = sample.replace("[cs]", "s").replace("[^  ]+", "x").replace("s?", "s" if keep else "").replace("p?", "p").replace("3c?", "3").replace("v?", "v" if keep else "").replace("e?", "e")
            if re.search(rule.pattern, sample):
                assert all(p in sample for p in rule.parts), rule
                assert pattern.search(sample), rule


def test_rows_are_kept_as_they_are(spark):
    rows = spark.createDataFrame([(1, "mit license", 7), (1, "mit license", 7), (None, "cc by", 8)], "doc_id long, text string, n_words int")
    got = licenses.license_digest(rows).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.base_labels) for r in got) == [(0, 2, "cc-by"), (1, 2, "mit"), (1, 2, "mit")]
    assert licenses.license_digest(rows.limit(0)).count() == 0
    plan = licenses.license_digest(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert licenses.scan(rows).agg(F.sum("n_words")).first()[0] == 6
