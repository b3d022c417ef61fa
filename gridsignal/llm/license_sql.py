"""SQL that states the license scan."""

from __future__ import annotations

from gridsignal.llm.license_rules import BASE, CONFIDENCE, rules
from gridsignal.llm.licenses import BETWEEN, LOWER, UPPER


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_sql() -> str:
    """All rules over all documents, then containment and priority by window functions over each document."""
    kinds = list(CONFIDENCE)
    lines = ",\n ".join(
        f"({r.order}, {kinds.index(r.kind)}, {CONFIDENCE[r.kind]}, {_text(r.label)}, {_text('(' + r.pattern + ')')}, [{', '.join(map(_text, r.parts))}])" for r in rules()
    )
    return f"""WITH rules(rule, rank, sure, label, pattern, parts) AS (VALUES {lines}),
texts AS (SELECT row_number() OVER () AS k, doc_id,
  trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}', ' ', 'g')) AS plain FROM documents),
words AS (SELECT k, doc_id, CASE WHEN plain = '' THEN 0 ELSE length(plain) - length(replace(plain, ' ', '')) + 1 END AS n_words,
  ' ' || replace(plain, ' ', '  ') || ' ' AS words FROM texts),
pieces AS (SELECT k, rule, rank, sure, label, unnest(cut) AS piece, generate_subscripts(cut, 1) AS nth FROM (
  SELECT k, rule, rank, sure, label, string_split(regexp_replace(words, pattern, chr(10) || '\\1' || chr(10), 'g'), chr(10)) AS cut
  FROM words, rules WHERE len([p FOR p IN parts IF NOT contains(words, p)]) = 0 AND regexp_matches(words, pattern))),
counted AS (SELECT *, (length(piece) - length(replace(piece, ' ', ''))) // 2 AS n FROM pieces),
ended AS (SELECT *, CAST(sum(n) OVER (PARTITION BY k, rule ORDER BY nth) AS BIGINT) AS last FROM counted),
found AS (SELECT k, rule, rank, sure, label, last - n AS first, last FROM ended WHERE nth % 2 = 0),
far AS (SELECT *, max(last) OVER (PARTITION BY k ORDER BY first, last DESC, rank, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM found),
outer_ AS (SELECT * FROM far WHERE before IS NULL OR before < last),
beside AS (SELECT *, lag(last) OVER w AS l_last, lag(rank) OVER w AS l_rank, lead(first) OVER w AS r_first, lead(rank) OVER w AS r_rank FROM outer_ WINDOW w AS (PARTITION BY k ORDER BY first)),
kept AS (SELECT * FROM beside WHERE NOT coalesce(l_last > first AND l_rank < rank, FALSE) AND NOT coalesce(r_first < last AND r_rank < rank, FALSE)),
base AS (SELECT k, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found WHERE rule < {len(BASE)} GROUP BY k),
named AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM kept UNION ALL SELECT k, label FROM found WHERE rule < {len(BASE)}) GROUP BY k),
sure AS (SELECT k, max(sure) AS score FROM kept GROUP BY k)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM words LEFT JOIN base USING (k) LEFT JOIN named USING (k) LEFT JOIN sure USING (k)"""
