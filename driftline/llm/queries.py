"""The corpus operators as registered queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_replay, divergence_audit, exact_dedup, hard_negatives, language_id, license_scan, ngram_lm, packing, sharding, simhash, span_hash, token_output, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir))


def _template_rows() -> str:
    rows = []
    for i, t in enumerate(license_scan.prepared(license_scan.TEMPLATES, license_scan.THRESHOLD)):
        rows += [f"({i}, '{t['name']}', {t['size']}, '{gram}', {n})" for gram, n in t["grams"].items()]
    return ", ".join(rows)


OP1_SQL = rf"""
WITH grams(i, name, size, gram, n) AS (VALUES {_template_rows()}),
templates AS (SELECT DISTINCT i, name, size FROM grams),
clean AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS c FROM documents),
units AS (
  SELECT doc_id, u, words FROM (
    SELECT doc_id, u, list_filter(string_split(line, ' '), lambda w: w <> '') AS words FROM (
      SELECT doc_id, generate_subscripts(string_split(c, chr(10)), 1) AS u, unnest(string_split(c, chr(10))) AS line FROM clean
      UNION ALL SELECT doc_id, 0, replace(c, chr(10), ' ') FROM clean WHERE contains(c, chr(10))))),
sized AS (
  SELECT doc_id, u, len(words) - 1 AS size, words FROM units
  WHERE len(words) - 1 BETWEEN (SELECT min(size) * {license_scan.THRESHOLD} / 2 FROM templates) AND (SELECT max(size) * 2 / {license_scan.THRESHOLD} FROM templates)),
own AS (
  SELECT doc_id, u, size, gram, count(*) AS n FROM (
    SELECT doc_id, u, size, unnest(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) AS gram FROM sized)
  GROUP BY ALL),
dices AS (
  SELECT o.doc_id, o.u, g.i, g.name, 2.0::DOUBLE * sum(least(o.n, g.n))::DOUBLE / (o.size + g.size)::DOUBLE AS dice
  FROM own o JOIN grams g USING (gram) GROUP BY o.doc_id, o.u, o.size, g.i, g.name, g.size),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, u ORDER BY dice DESC, i) AS r FROM dices WHERE dice >= {license_scan.THRESHOLD}),
found AS (
  SELECT doc_id, first(name ORDER BY dice DESC, i) AS license_id, max(dice) AS dice, count(*) AS matches FROM best WHERE r = 1 GROUP BY doc_id)
SELECT doc_id, license_id, dice, coalesce(matches, 0) AS matches FROM documents LEFT JOIN found USING (doc_id)
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_span_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_hash.fingerprint_documents(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_replay.bpe_round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(_documents(spark, sf_dir))


SHARD_NAMES = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id")
    return sharding.assign_shards(docs, F.col("doc_id").cast("string"), SHARD_NAMES)


OP9_SQL = f"""
WITH RECURSIVE h AS MATERIALIZED (
  SELECT i, CAST('0x' || substr(md5(name || '/offset'), 1, 8) AS BIGINT) % {sharding.SLOTS} AS origin,
         CAST('0x' || substr(md5(name || '/skip'), 1, 8) AS BIGINT) % {sharding.SLOTS - 1} + 1 AS step
  FROM (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS name FROM range({sharding.SHARDS}) r(i))),
prefers AS MATERIALIZED (
  SELECT i, list(1 + (origin + k * step) % {sharding.SLOTS} ORDER BY k) AS slots FROM h, range({sharding.SLOTS}) r(k) GROUP BY i),
fill AS (
  SELECT 0 AS turn, list_transform(range({sharding.SLOTS}), lambda x: -1) AS owner
  UNION ALL
  SELECT turn + 1, list_concat(owner[:claim - 1], [CAST(i AS INT)], owner[claim + 1:])
  FROM (SELECT turn, owner, i, slots[list_position(list_select(owner, slots), -1)] AS claim
        FROM fill JOIN prefers ON i = turn % {sharding.SHARDS} WHERE turn < {sharding.SLOTS})),
owners AS (SELECT unnest(owner) AS shard, generate_subscripts(owner, 1) - 1 AS slot FROM fill WHERE turn = {sharding.SLOTS})
SELECT doc_id, CAST(slot AS INT) AS slot, CAST(shard AS INT) AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents) JOIN owners USING (slot)
"""


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit_sources(_documents(spark, sf_dir))


_F = "(({p} - {q}) * ({p} - {q}) // ({p} + {q}))"
OP11_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
counted AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
  FROM (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS c FROM counted GROUP BY ALL HAVING sum(docs) >= {divergence_audit.MIN_DOCS}),
sizes AS (SELECT lang, count(term) AS v, coalesce(sum(c), 0) AS lang_total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT * FROM counted SEMI JOIN kept USING (lang, term)) USING (lang, source) GROUP BY ALL),
priced AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS BIGINT) AS p, CAST(1 + 1000000000::HUGEINT * (c + 2) // (lang_total + 2 * v) AS BIGINT) AS q
  FROM totals JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN counted USING (lang, source, term)),
far AS (SELECT a.lang, a.source, b.source AS item, sum({_F.format(p='a.p', q='b.p')}) AS value FROM priced a JOIN priced b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) FROM (SELECT *, {_F.format(p='p', q='q')} AS value FROM priced WHERE n > 0 AND p > q))
SELECT lang, source, part, item, value, CAST(r AS INT) AS rank FROM ranked WHERE part = 'pair' OR r <= {divergence_audit.TOP_TERMS}
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    changed = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine_hard_negatives(changed, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS s
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, n.vec_id AS negative_id, positive_score, n.s AS negative_score
FROM positive JOIN scores n USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * n.s AND 100 * n.s <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.s DESC, n.vec_id) QUALIFY row_number() OVER w <= 3
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language_id.identify_languages(docs, language_id.fit_languages(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_license_scan": op1_license_scan, "op2_exact_dedup": op2_exact_dedup, "op3_simhash": op3_simhash, "op4_token_output": op4_token_output, "op5_toxicity": op5_toxicity, "op6_span_hash": op6_span_hash, "op7_packing": op7_packing, "op8_bpe_replay": op8_bpe_replay, "op9_sharding": op9_sharding, "op10_lm_scoring": op10_lm_scoring, "op11_divergence_audit": op11_divergence_audit, "op12_hard_negatives": op12_hard_negatives, "op13_language_id": op13_language_id, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op9_sharding": OP9_SQL, "op11_divergence_audit": OP11_SQL, "op12_hard_negatives": OP12_SQL}
