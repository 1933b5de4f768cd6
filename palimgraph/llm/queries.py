"""The queries opN of this subpackage's operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, hnsw, katz, languages, licences, mixing, near_dups, packing, reply_trees, toxicity
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.assign_blocks(read(spark, sf_dir, "documents"))
    return chosen.select("row.doc_id", "source", "n_tokens", "block", "shard")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vector_groups(read(spark, sf_dir, "embeddings"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_groups(read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.fit_and_score(read(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = reply_trees.format_trees(reply_trees.from_turns(read(spark, sf_dir, "conversations")))
    return chats.withColumn("path", F.concat_ws("-", F.col("path").cast("array<string>")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicate_groups(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    all_ = (op1_mixing, op2_language_id, op3_packing, op4_embedding_near_dups, op5_fingerprints, op6_lm_scoring, op7_licences, op8_chat_formatting, op9_toxicity, op10_minhash_near_dups)
    return {f.__name__: f for f in all_}


_MIXING = rf"""
WITH s AS (
  SELECT doc_id, coalesce(source, '') AS source, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+'))::BIGINT AS n
  FROM documents),
t AS (
  SELECT source, ceil(sum(n) / {mixing.BLOCK_TOKENS}.0)::BIGINT AS blocks, sqrt(sum(n)::DOUBLE) AS w
  FROM s GROUP BY source HAVING sum(n) > 0),
first_missing AS (SELECT w / (2 * blocks + 1) AS q, source AS name FROM t ORDER BY q DESC, name LIMIT 1),
seats AS (SELECT source, i, w / (2 * i + 1) AS q FROM (SELECT source, w, unnest(range(blocks)) AS i FROM t)),
kept AS (
  SELECT seats.source, i, row_number() OVER (ORDER BY seats.q DESC, seats.source) AS nth, count(*) OVER () AS total
  FROM seats, first_missing f WHERE seats.q > f.q OR (seats.q = f.q AND seats.source < f.name)),
dealt AS (SELECT source, i, len(list_filter(range(1, {mixing.SHARDS + 1}), lambda j: total * j // {mixing.SHARDS} < nth))::BIGINT AS shard FROM kept),
turned AS (
  SELECT *, (SELECT min(a) FROM (SELECT unnest(range(blocks * 5 // 8 + 1, 2 * blocks + 2)) AS a) WHERE gcd(a, blocks) = 1) AS a FROM t),
streams AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT - n AS before FROM s),
placed AS (
  SELECT doc_id, p.source, n, least(before // {mixing.BLOCK_TOKENS}, blocks - 1)::BIGINT AS block, a, blocks
  FROM streams p JOIN turned ON p.source = turned.source)
SELECT doc_id, placed.source AS source, n AS n_tokens, block, shard
FROM placed JOIN dealt ON placed.source = dealt.source AND dealt.i = (a * block + {mixing.SEED} % blocks) % blocks
"""

_CHATS = r"""
WITH RECURSIVE r AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS msg_id FROM r),
p AS (
  SELECT m.conv_id, m.msg_id, max(x.msg_id) AS parent_id, any_value(length(m.text)::DOUBLE) AS score,
         any_value('<|' || replace(replace(m.role, '<|', '< |'), '|>', '| >') || '|>' || chr(10) || replace(m.text, '<|', '< |') || chr(10)) AS body
  FROM m LEFT JOIN m x ON x.conv_id = m.conv_id AND x.msg_id < m.msg_id AND x.role <> m.role
  GROUP BY m.conv_id, m.msg_id),
t AS (
  SELECT conv_id, msg_id, msg_id::VARCHAR AS path, score AS total, body, 1::BIGINT AS n FROM p WHERE parent_id IS NULL
  UNION ALL
  SELECT c.conv_id, c.msg_id, t.path || '-' || c.msg_id::VARCHAR, t.total + c.score, t.body || c.body, t.n + 1
  FROM t JOIN p c ON c.conv_id = t.conv_id AND c.parent_id = t.msg_id)
SELECT conv_id, msg_id AS leaf_id, row_number() OVER (PARTITION BY conv_id ORDER BY total / n DESC, msg_id) AS branch,
       total / n AS score, n AS n_turns, path, body AS text
FROM t WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.conv_id = t.conv_id AND c.parent_id = t.msg_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _MIXING, "op8_chat_formatting": _CHATS}
