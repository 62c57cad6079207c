"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (exact_dedup, html_text, language, lexical_search, license_scan, mixing, ngram_quality, packing, quality_rules, simhash,
               spelling, token_counts, token_files)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORD_BPE, WORD_BPE_SIZE = "word_bpe_49k.json", 49_408
BYTE_BPE = "byte_bpe_50k.json"


def register(name: str, sql: str | None = None) -> Callable:
    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register("op1_exact_dedup", r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@register("op2_token_files")
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE),
                                          token_files.token_files_folder(spark), WORD_BPE_SIZE)
    return token_files.read_token_files(files)


@register("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


@register("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


@register("op9_source_mixing", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
k AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS size,
         regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS seen FROM d),
w AS (
  SELECT doc_id, source, size,
         (length(regexp_replace(seen, '[!-@\[-`{-~]', '', 'g')) + 1)::DOUBLE / (length(seen) + 1)::DOUBLE AS weight FROM k),
e AS (
  SELECT *, -ln((('0x' || substr(md5('9:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight AS key FROM w),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM e GROUP BY source),
l AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM s),
v AS (
  SELECT *, row_number() OVER o AS nth,
         (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM l WINDOW o AS (ORDER BY cap / weight, source NULLS LAST), b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, nth) FROM v WHERE level * weight <= cap))::DOUBLE AS target FROM v),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p),
r AS (
  SELECT e.doc_id, e.size, e.source, e.key, q.source_size, q.target, q.epochs, q.target - q.epochs * q.source_size AS rest,
         sum(e.size) OVER (PARTITION BY e.source ORDER BY e.key, e.doc_id) - e.size / 2 AS middle
  FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN middle <= rest THEN 1 ELSE 0 END) AS taken, source FROM r""")
def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("key")


@register("op6_simhash")
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"))


@register("op10_main_text")
def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@register("op8_language")
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@register("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    trusted = ngram_quality.trusted_ids(table(spark, folder, "labels"))
    return ngram_quality.classify(table(spark, folder, "documents"), trusted)


@register("op11_lexical_search", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
a AS (
  SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
t AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, a GROUP BY term, docs),
s AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN w USING (term), a GROUP BY item_id, r, doc_id),
k AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 50""")
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# The checksum goes byte by byte through a table that is made by its rule; neighbours meet under a form with one character deleted.
@register("op12_spelling_variants", r"""
WITH RECURSIVE
t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
h AS (
  SELECT run, times, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c:
           CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END))),
         lambda c, b: xor(crc[xor(c, b) % 256 + 1], c >> 8)), 4294967295) AS h
  FROM r, t WHERE length(run) >= 6),
w AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
k AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
p AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM k a JOIN k b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, k.n, w.word, w.n FROM k JOIN w ON k.key = w.word
  UNION SELECT w.word, w.n, k.word, k.n FROM k JOIN w ON k.key = w.word),
f AS MATERIALIZED (
  SELECT w.word, w.n, count(p.other) AS n_near, min(struct_pack(less := -p.other_n, other := p.other)) AS best FROM w LEFT JOIN p ON w.word = p.word GROUP BY w.word, w.n),
g AS MATERIALIZED (
  SELECT word, n, n_near, CASE WHEN -best.less >= 5 * n THEN best.other END AS form, CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n FROM f),
c AS (
  SELECT word, word AS root, 0 AS step FROM g UNION ALL SELECT c.word, g.form, step + 1 FROM c JOIN g ON c.root = g.word WHERE g.form IS NOT NULL)
SELECT g.word, n, n_near, form, form_n, root FROM g JOIN (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word) USING (word)""")
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@register("op13_license_scan")
def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, folder, "documents")))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
