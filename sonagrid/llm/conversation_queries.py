"""The queries over ``conversations``, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonagrid.llm import conversation_repair, prefix_trie


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, turns = prefix_trie.rebuilt(_table(spark, sf_dir))
    return prefix_trie.prefix_trie(ids, turns, ["own", "place"])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_report(_table(spark, sf_dir))


_CRC = """
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc(text: str) -> str:
    """crc32 of an ASCII expression, beside ``crc_table``."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH {_CRC},
given AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM given), crc_table),
turns AS (
  SELECT c.conv_id, g.role, g.text, 0 AS own, g.i FROM convs c JOIN given g ON g.conv_id = c.base AND g.i <= c.h
  UNION ALL SELECT conv_id, role, text, 1, i FROM given JOIN convs USING (conv_id) WHERE i > h),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, text,
    list(sha256(length(role) || ':' || role || text)) OVER w AS path
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
rows AS (
  SELECT conv_id, depth, length(text) AS chars, list_aggregate(path, 'string_agg', '') AS path,
    CASE WHEN depth = 1 THEN '' ELSE list_aggregate(path[:-2], 'string_agg', '') END AS parent
  FROM steps
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs),
nodes AS (
  SELECT path, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved
  FROM rows GROUP BY path),
children AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT top.path, sum(n.saved) AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
  FROM nodes top JOIN nodes n ON n.depth >= top.depth AND left(n.path, 64 * top.depth) = top.path LEFT JOIN children c ON c.path = n.path
  GROUP BY top.path),
ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM rows GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.path = n.parent LEFT JOIN children c ON c.path = n.path JOIN below b ON b.path = n.path LEFT JOIN ends e ON e.path = n.path
"""

OP13_SQL = rf"""
WITH RECURSIVE {_CRC},
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations, crc_table),
left_over AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body
  FROM left_over),
turns AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c,
    CASE WHEN body = '' THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM numbered),
steps(s, c, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
named(c, name) AS (VALUES ('u', 'user'), ('a', 'assistant')),
once AS (SELECT s, z, 3 AS cost, 'I' AS audit, chr(10) || name || ':' AS written FROM steps JOIN named USING (c)),
inserts AS (
  SELECT DISTINCT s, s AS z, 0 AS cost, '' AS audit, '' AS written FROM steps
  UNION ALL SELECT * FROM once
  UNION ALL SELECT a.s, b.z, 6, 'II', a.written || b.written FROM once a JOIN once b ON a.z = b.s),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, z AS state, struct_pack(cost := cost, audit := audit, written := written) AS way
  FROM (SELECT DISTINCT conv_id FROM turns), inserts WHERE s = 0
  UNION ALL
  SELECT conv_id, i, state, min(way) FROM (
    SELECT b.conv_id, b.i + 1 AS i, n.z AS state,
      struct_pack(cost := b.way.cost + e.cost + n.cost, audit := b.way.audit || e.audit || n.audit, written := b.way.written || e.written || n.written) AS way
    FROM best b JOIN LATERAL (
      SELECT b.state AS z, 4 AS cost, 'D' AS audit, '' AS written, t.conv_id, t.i FROM turns t
      UNION ALL
      SELECT p.z, CASE fault WHEN 3 THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text, t.conv_id, t.i
      FROM turns t JOIN steps p ON p.c = t.c WHERE p.s = b.state AND fault NOT IN (1, 2)
      UNION ALL
      SELECT p.z, CASE fault WHEN 3 THEN 6 ELSE 3 END, 'R', chr(10) || name || ':' || text, t.conv_id, t.i
      FROM turns t, steps p JOIN named USING (c) WHERE p.s = b.state AND fault NOT IN (1, 2)
    ) e ON e.conv_id = b.conv_id AND e.i = b.i + 1
    JOIN inserts n ON n.s = e.z)
  GROUP BY conv_id, i, state),
final AS (
  SELECT conv_id, min(way) AS way
  FROM best JOIN (SELECT conv_id, max(i) AS i FROM turns GROUP BY conv_id) USING (conv_id, i)
  WHERE state IN (0, 3) GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM turns) GROUP BY conv_id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(way.cost, 0) AS BIGINT) AS cost,
  coalesce(way.audit, '') AS audit, sha256(coalesce(substr(way.written, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counted USING (conv_id) LEFT JOIN final USING (conv_id)
"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": OP11_SQL, "op13_conversation_repair": OP13_SQL}
