"""The registered queries of this subpackage, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.llm import ann, htmltext, jaccard, licenses, mixing, packing, quality, spans, spelling, suffixes, topk, warc, whitening
from gridsignal.llm.license_sql import license_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op6_exact_topk",
    """WITH whole AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
)
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


@query("op10_one_bit_neighbours")
def one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


@query(
    "op8_warc",
    """WITH given AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM given),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to FROM kept""",
)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.write_archives(table(spark, sf_dir, "pages")), keep_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


REPEATS = 2.0

MIXING_SQL = f"""WITH RECURSIVE rows_ AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) + 1 AS tokens FROM documents),
totals AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total FROM rows_ GROUP BY source),
shares AS (SELECT *, total / CAST((SELECT sum(total) FROM totals) AS DOUBLE) AS share FROM totals),
ends AS (SELECT max(share) AS high, min(share) AS low FROM shares),
halving AS (SELECT 0 AS step, CAST(0 AS BIGINT) AS low, CAST({1 << mixing.STEPS} AS BIGINT) AS high
  UNION ALL SELECT step + 1,
    CASE WHEN pow(e.high, 1 - mid) * pow(e.low, mid - 1) <= {REPEATS} THEN h.low ELSE (h.low + h.high) // 2 END,
    CASE WHEN pow(e.high, 1 - mid) * pow(e.low, mid - 1) <= {REPEATS} THEN (h.low + h.high) // 2 ELSE h.high END
  FROM (SELECT *, ((low + high) // 2) / {1 << mixing.STEPS}.0::DOUBLE AS mid FROM halving) h, ends e WHERE step < {mixing.STEPS}),
chosen AS (SELECT CASE WHEN (SELECT high = low FROM ends) THEN 0.0 ELSE (SELECT high FROM halving WHERE step = {mixing.STEPS}) / {1 << mixing.STEPS}.0::DOUBLE END AS a),
massed AS (SELECT source, total, pow(share, a) AS mass FROM shares, chosen),
plan AS (SELECT source, total, greatest(total, CAST(floor(mass / (SELECT sum(mass) FROM massed) *
    ((SELECT max(total / mass) FROM massed) * (SELECT sum(mass) FROM massed)) + 0.5) AS BIGINT)) AS budget FROM massed),
placed AS (SELECT r.*, p.total, p.budget, (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
    * CAST(ceil(p.total / {mixing.BLOCK_TOKENS}.0) AS BIGINT)) >> 32 AS block FROM rows_ r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source),
blocks AS (SELECT source, block, total, budget, sum(tokens) AS size FROM placed GROUP BY ALL),
epochs AS (SELECT *, unnest(range(0, CAST(ceil(budget / CAST(total AS DOUBLE)) AS BIGINT))) AS epoch FROM blocks),
ordered AS (SELECT *, epoch * total + sum(size) OVER (PARTITION BY source, epoch
    ORDER BY md5('mix:' || coalesce(source, '') || ':' || block || ':' || epoch), block ROWS UNBOUNDED PRECEDING) - size AS before FROM epochs),
copies AS (SELECT r.doc_id, r.source, r.tokens, o.epoch, r.block, r.budget, o.before + sum(r.tokens) OVER (PARTITION BY r.source, r.block, o.epoch
    ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || o.epoch), r.tokens ROWS UNBOUNDED PRECEDING) - r.tokens AS before
  FROM placed r JOIN ordered o ON r.source IS NOT DISTINCT FROM o.source AND r.block = o.block)
SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, CAST(epoch AS INTEGER) AS epoch, block, CAST(before AS DOUBLE) / CAST(budget AS DOUBLE) AS mix_order
FROM copies WHERE before < budget"""


@query("op1_temperature_mixing", MIXING_SQL)
def temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), repeats=REPEATS)


@query("op3_retrieval_packing")
def retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query(
    "op9_ngram_jaccard_join",
    r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
lines AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m FROM lines a JOIN lines b ON a.g = b.g AND a.doc_id > b.doc_id
  AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM pairs WHERE 100 * common >= 85 * (n + m - common)),
both_ AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT DISTINCT u, u AS r FROM both_ UNION SELECT b.u, reach.r FROM both_ b JOIN reach ON b.v = reach.u),
least_ AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM sized LEFT JOIN least_ ON doc_id = u""",
)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_digest(table(spark, sf_dir, "documents"))


@query(
    "op4_sentence_spans",
    r"""WITH lines AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
units AS (SELECT doc_id, [trim(x, ' ' || chr(9) || chr(10) || chr(13)) FOR x IN parts IF trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''] AS s FROM lines),
rows_ AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM units),
counted AS (SELECT *, sum(len(regexp_extract_all(s, '[^ \t\r\n]+'))) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM rows_),
before_ AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before FROM counted),
ends AS (SELECT a.doc_id, a.pos, min(b.pos) AS last FROM before_ a JOIN before_ b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.upto - a.before >= 10 GROUP BY a.doc_id, a.pos),
runs AS (SELECT e.doc_id, e.pos, e.last, md5(array_to_string(u.s[e.pos:e.last], chr(10))) AS run FROM ends e JOIN units u USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM ranked WHERE nth > 1),
marked AS (SELECT r.*, g.pos IS NOT NULL AS out_ FROM rows_ r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.pos = g.pos)
SELECT d.doc_id, count(m.pos) AS n_sentences, CAST(coalesce(sum(CAST(out_ AS INTEGER)), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(m.s, chr(10) ORDER BY m.pos) FILTER (WHERE NOT out_), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id""",
)
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_digest(table(spark, sf_dir, "documents"))


@query("op13_license_rules", license_sql())
def license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


@query("op12_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def crc_step(b: int) -> int:
    """The checksum's table entry of a byte, by its rule."""
    for _ in range(8):
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return b


SPELLING_SQL = rf"""WITH RECURSIVE step AS (SELECT {[crc_step(b) for b in range(256)]}::BIGINT[] AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS name, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
coded AS (SELECT run, flatten([CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END FOR c IN [CAST(unicode(x) AS BIGINT) FOR x IN string_split(name || run, '')]]) AS bytes FROM runs),
summed AS (SELECT run, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM coded, step),
given AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM summed),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM given WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
shorter AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, CAST(length(word) AS BIGINT) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word),
ranked AS (SELECT p.word, near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, near) AS r FROM pairs p JOIN words w ON p.near = w.word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1),
chain AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM forms f LEFT JOIN ends USING (word)"""


@query("op11_spelling_variants", SPELLING_SQL)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))
