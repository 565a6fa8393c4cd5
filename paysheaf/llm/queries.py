"""Named queries of this subpackage: thin steps from the given tables to the operators and back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hard_negatives, imatch, language_model, licenses, mixing, passages, pieces, quality, secret_scan, simhash, spelling, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents`` as document texts; its ``source`` plays the issuing company."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("company"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(document_text(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


_OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
runs AS (SELECT doc_id, i, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM runs) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(l, '')), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 100 * n_symbols > 10 * word_chars AS f3, 100 * n_dup_lines > 30 * n_lines AS f4 FROM m),
h AS (SELECT source, count(*) AS n, unnest([1, 2, 3, 4]) AS r, unnest([count(*) FILTER (f1), count(*) FILTER (f2), count(*) FILTER (f3), count(*) FILTER (f4)]) AS f
  FROM f WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT r, sum(n) AS n, sum(n) / count(*) AS per, (sum(f) + 0.5) / (sum(n) + 1) AS mean,
    greatest(0.0, sum(f * f / n) / sum(n) - pow(sum(f) / sum(n), 2)) AS spread FROM h GROUP BY r),
b AS (SELECT *, greatest(spread - mean * (1 - mean) / per, 0.0) AS between_var FROM s),
p AS (SELECT r, mean, CASE WHEN between_var > 0 THEN least(per, greatest(1.0, mean * (1 - mean) / between_var - 1)) ELSE per END AS strength FROM b),
bad AS (SELECT DISTINCT source FROM h JOIN p USING (r) WHERE (f + mean * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND bad.source IS NULL AS kept
FROM f LEFT JOIN bad ON f.source = bad.source
"""


@query("op3_quality", _OP3_SQL)
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(document_text(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _spans_sql(kind: str, pattern: str, group: int, least: int, order: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS k,
  CAST(coalesce(list_sum(list_transform(between_[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(all_[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
  length(all_[i]) AS chars, length(part_[i]) AS part_chars, {least} AS least_chars
  FROM (SELECT doc_id, between_, all_, part_, unnest(range(1, len(all_) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS between_,
    regexp_extract_all(t, '{pattern}') AS all_, regexp_extract_all(t, '{pattern}', {group}) AS part_ FROM d))"""


_OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(_spans_sql(r.kind, r.pattern, r.group, r.min_chars, i) for i, r in enumerate(secret_scan.RULES))}),
spans AS (SELECT doc_id, kind, k, s, kind || ':' || s || ':' || (s + chars) AS p FROM raw WHERE part_chars >= least_chars),
agg AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(p, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(p, ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (doc_id)
"""


@query("op4_secrets", _OP4_SQL)
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = document_text(spark, sf_dir).select("doc_id", F.lit(1).alias("attempts"), "text")
    found = secret_scan.secrets(versions)
    base = secret_scan.of_kind(F.col("spans"), *secret_scan.BASE_KINDS)
    counts = [F.size(secret_scan.of_kind(F.col("spans"), k)).cast("bigint").alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.printed(base), 256).alias("base_sha256"), secret_scan.printed(F.col("spans")).alias("spans"))


@query("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(document_text(spark, sf_dir))
    return mixed.select(
        "doc_id", "size", F.col("company_size").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "rate"
    )


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(document_text(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def _license_sql() -> str:
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS i, '{label}' AS label FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d) WHERE "
        + " AND ".join(f"l[i + {j}] = '{w}'" for j, w in enumerate(phrase.split()))
        for phrase, label in licenses.PHRASES.items()
    )
    width = licenses.block_words()
    templates = ", ".join(f"('{label}', {sorted(set(text.split()))})" for label, text in licenses.TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS l FROM documents),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id),
t(label, words) AS (VALUES {templates}),
blocks AS (SELECT doc_id, list_distinct(l[b + 1:b + {width}]) AS w FROM (SELECT doc_id, l, unnest(range(0, len(l), {width // 2})) AS b FROM d)),
pairs AS (SELECT doc_id, label, len(list_intersect(words, w)) / len(words) AS c FROM blocks, t),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM pairs WHERE c >= {licenses.CONTAINMENT} - 1e-9 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op2_licenses", _license_sql())
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licenses(document_text(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


@query("op6_imatch")
def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compared(document_text(spark, sf_dir))


@query("op10_language_model")
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(document_text(spark, sf_dir))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(document_text(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op1_passages")
def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(document_text(spark, sf_dir))


@query("op11_pieces")
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(document_text(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


_OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""


@query("op12_hard_negatives", _OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return hard_negatives.mined(rows.select(F.col("vec_id").alias("row_id"), vector.alias("vector"), label.alias("label"), (F.col("vec_id") % 100 == 0).alias("is_anchor")))


# CRC-32 byte by byte, from the reflected polynomial
_OP13_SQL = f"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], list_transform(range(8), lambda k: CAST(0 AS BIGINT))),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{spelling.RUN[:-1]}{{7,}}')) AS r FROM documents),
own AS (SELECT doc_id, r, count(*) AS m, hex(concat_ws(':', doc_id, r)) AS x FROM runs GROUP BY doc_id, r),
h AS (SELECT r, m, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(length(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t.t[xor(c % 256, b) + 1]))) AS h FROM own, t),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, m FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN w b ON a.s = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN w b ON a.s = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
formed AS (SELECT w.word, w.n, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n, coalesce(n_near, 0) AS n_near FROM w LEFT JOIN best USING (word)),
path AS (SELECT word, word AS place, 0 AS step FROM formed UNION ALL SELECT p.word, f.form, step + 1 FROM path p JOIN formed f ON f.word = p.place WHERE f.form IS NOT NULL)
SELECT word, n, form, root, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN (SELECT word, arg_max(place, step) AS root FROM path GROUP BY word) USING (word)
"""


@query("op13_spelling", _OP13_SQL)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(document_text(spark, sf_dir), spelling.LEAST_CHARS)
    # misprints by a fixed rule, so that there is something to find
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run"))
    at = (h % F.length("run")).cast("int")
    misprint = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return spelling.variants(spelling.word_counts(runs.select("doc_id", F.when(h % 31 == 0, misprint).otherwise(F.col("run")).alias("run"))))
