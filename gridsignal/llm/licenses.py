"""License scan by ordered signature rules, with built-in functions only.

A text becomes its words in lower case with a space before and after each. One pattern over the parts that open rules
picks the texts that any rule can match; in these, a rule is tried if all words that it cannot do without are there. Every
match is a detection: an interval of words with a rule. Detections that overlap are resolved in two steps.

1. Containment: an interval inside another goes; of equal ones, that of the first kind and rule stays.
2. Priority: what is left ascends with its ends as well as its starts. Of two neighbours that overlap, that of the later
   kind goes.

Texts are read in place: nothing is shuffled, and the work on a text grows with its length and its detections only.
"""

from __future__ import annotations

import json
import re
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsignal.llm.license_rules import BASE, CONFIDENCE, Rule, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

RULE = "struct<rank:int,rule:int,label:string,pattern:string,parts:array<string>>"
FOUND = "array<struct<first:int,minus_end:int,rank:int,rule:int,label:string>>"


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def running(values: Column, combine) -> Column:
    """Running sums or maxima of an array: in every round a place takes in what lies 1, 2, 4, ... places before it."""
    rounds = F.ceil(F.log2(F.size(values).cast("double"))).cast("int")
    steps = F.transform(F.sequence(F.lit(0), rounds - 1), lambda i: F.call_function("shiftleft", F.lit(1), i))

    def take_in(held: Column, step: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(None).cast("int"), step), F.slice(held, 1, F.size(held) - step))
        return F.zip_with(held, before, lambda x, y: F.when(y.isNull(), x).otherwise(combine(x, y)))

    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(steps, values, take_in))


def gate_pattern(given: list[Rule]) -> str:
    """One pattern for the parts that open rules, its branches parted by their first letter."""
    parts = sorted({r.gate[1:] for r in given})
    branches = []
    for letter, same in groupby(parts, key=lambda p: p[0]):
        branches.append(letter + "(?:" + "|".join(re.escape(p[1:]).replace("\\ ", " ") for p in same) + ")")
    return " (?:" + "|".join(branches) + ")"


def kept(found: Column) -> Column:
    """Detections that neither containment nor priority removes, by their first word. ``found`` is sorted."""
    ends = F.transform(found, lambda d: -d["minus_end"])
    far = running(ends, lambda x, y: F.greatest(x, y))
    # what comes earlier in this order and ends no earlier holds the interval
    marked = F.zip_with(found, F.concat(F.array(F.lit(-1)), far), lambda d, e: F.struct(d.alias("d"), e.alias("e")))
    outer = F.transform(F.filter(marked, lambda m: m["d"].isNotNull() & (m["e"] < -m["d"]["minus_end"])), lambda m: m["d"])

    def by_priority(chain: Column) -> Column:
        nothing = F.array(F.lit(None).cast(FOUND[6:-1]))
        before, after = F.concat(nothing, chain), F.concat(F.slice(chain, 2, F.greatest(F.size(chain) - 1, F.lit(0))), nothing)
        beside = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        whole = F.zip_with(chain, beside, lambda d, n: F.struct(d.alias("d"), n.alias("n")))
        loses = lambda m: (
            F.coalesce((-m["n"]["b"]["minus_end"] > m["d"]["first"]) & (m["n"]["b"]["rank"] < m["d"]["rank"]), F.lit(False))
            | F.coalesce((m["n"]["a"]["first"] < -m["d"]["minus_end"]) & (m["n"]["a"]["rank"] < m["d"]["rank"]), F.lit(False))
        )
        return F.transform(F.filter(whole, lambda m: m["d"].isNotNull() & ~loses(m)), lambda m: m["d"])

    # a lambda names the chain once; its expression would otherwise be evaluated at every mention
    return F.flatten(F.transform(F.array(outer), by_priority))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, base, detections`` for every row of ``docs``, in place.

    ``base`` lists where the phrases of ``license_rules.BASE`` stand: ``start, label``. ``detections`` are those that are
    left after containment and priority, by their first word: ``start, end, kind, label, rule`` (words from 0, ``end`` is
    not in the interval). Null and empty texts have no words. Equal rows have equal results; null ids stay null; other
    columns are not read; no documents give no rows.
    """
    given = rules()
    kinds = list(CONFIDENCE)
    table = F.from_json(
        F.lit(json.dumps([{"rank": kinds.index(r.kind), "rule": r.order, "label": r.label, "pattern": f"({r.pattern})", "parts": r.parts} for r in given])),
        f"array<{RULE}>",
    )
    parts = F.array(*[F.lit(p) for p in sorted({p for r in given for p in r.parts})])
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER), BETWEEN, " "))
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), plain.alias("plain"))
    rows = rows.select(
        "doc_id", F.when(F.col("plain") == "", 0).otherwise(spaces(F.col("plain")) + 1).cast("long").alias("n_words"),
        F.concat(F.lit(" "), F.replace("plain", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("words"),
    )

    def matches(rule: Column) -> Column:
        # every second piece is a match; a piece holds whole words, two spaces to each
        pieces = F.split(F.regexp_replace(F.col("words"), rule["pattern"], F.lit("\n$1\n")), "\n")
        counts = F.transform(pieces, lambda p: F.expr("cast(0 as int)") + (spaces(p) / 2).cast("int"))

        def intervals(n: Column) -> Column:
            ends = running(n, lambda x, y: x + y)
            both = F.zip_with(n, ends, lambda c, e: F.struct((e - c).alias("first"), (-e).alias("minus_end"), rule["rank"], rule["rule"], rule["label"]))
            return F.filter(both, lambda d, i: i % 2 == 1)

        return F.flatten(F.transform(F.array(counts), intervals))

    there = F.filter(parts, lambda p: F.contains(F.col("words"), p))
    tried = F.flatten(F.transform(F.array(there), lambda t: F.filter(table, lambda r: F.size(F.array_except(r["parts"], t)) == 0)))
    found = F.array_sort(F.flatten(F.transform(tried, matches)))
    opened = F.col("words").rlike(gate_pattern(given))
    rows = rows.select("doc_id", "n_words", F.when(opened, found).otherwise(F.array()).cast(FOUND).alias("found"))
    rows = rows.select("doc_id", "n_words", "found", kept(F.col("found")).alias("left"))
    names = F.array(*[F.lit(k) for k in kinds])
    return rows.select(
        "doc_id", "n_words",
        F.transform(F.filter("found", lambda d: d["rule"] < len(BASE)), lambda d: F.struct(d["first"].cast("long").alias("start"), d["label"].alias("label"))).alias("base"),
        F.transform("left", lambda d: F.struct(
            d["first"].cast("long").alias("start"), (-d["minus_end"]).cast("long").alias("end"), names[d["rank"]].alias("kind"),
            d["label"].alias("label"), d["rule"].alias("rule"))).alias("detections"),
    )


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base``, ``first_word`` and ``last_word`` count the base phrases and give their smallest and largest start (null
    without any). ``labels`` are the base labels and those of the detections; lists are distinct, sorted and joined by
    commas. ``score`` is the confidence of the surest kind of detection, 0 without any. Edge cases are those of ``scan``.
    """
    starts = F.transform("base", lambda b: b["start"])
    base = F.transform("base", lambda b: b["label"])
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return scan(docs, id, text).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: sure[d["kind"]])), F.lit(0.0)).alias("score"),
    )
