"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.llm import conversation_queries, decontamination, fingerprints, language_id, language_model, license_scan, line_dedup, near_dedup, packing, sampling, suffix_dedup, token_counts, toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, where the box keeps it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(modulus: int) -> Column:
    """Whether a document is kept from training."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = language_id.train(docs.filter(~held_out(4)).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), fitted)
    return found.select("doc_id", F.coalesce(held_out(4), F.lit(False)).alias("held_out"), "lang_pred", "score", "known")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 not toxic, 1 toxic, 2 toxic and of low quality. Labels of held-out documents aren't learned from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    hashes = docs.filter("text is not null").select("doc_id", sampling.text_hash().alias("text_hash"))
    labelled = hashes.join(labels.select("doc_id", "toxic", "quality"), "doc_id").filter(~held_out(5))
    model = toxicity.train(labelled, grade, 3, texts=docs.select("text"))
    rated = toxicity.rate(docs, model)
    return rated.select("doc_id", F.coalesce(held_out(5), F.lit(False)).alias("held_out"), "toxic", "severity", "grade", "p_toxic")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_model.train(docs.select("doc_id", "text"), held_out(7))
    scored = language_model.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(7), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents")).drop("keep_bitmap")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP4_SQL = rf"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
hits AS (
  SELECT d.doc_id, d.i, d.size, iw.item_id
  FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
              FROM doc_words, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size)) d
  JOIN item_windows iw ON iw.size = d.size AND iw.win = d.win),
hit_words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP9_SQL = rf"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
    translate(regexp_replace(regexp_replace(parts[pos], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{_UPPER}', '{_LOWER}') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM lines LEFT JOIN repeated USING (key) GROUP BY doc_id
"""

OP12_SQL = """
WITH given AS (SELECT row_number() OVER () AS r, coalesce(doc_id, -9223372036854775808) AS doc, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, doc, s, substr(h, 2 * s + 1, 2 * 249) AS piece FROM (SELECT r, doc, h, unnest(range(0, length(h) // 2 - 49, 200)) AS s FROM given WHERE length(h) >= 100)),
heads AS (SELECT r, doc, s + p AS p, substr(piece, 2 * p + 1, 100) AS head FROM (SELECT r, doc, s, piece, unnest(range(0, length(piece) // 2 - 49)) AS p FROM pieces)),
hit AS (SELECT r, p FROM heads JOIN (SELECT head, min(doc) AS least FROM heads GROUP BY head HAVING count(*) > 1) USING (head) WHERE doc > least),
runs AS (
  SELECT r, min(p) AS s, max(p) + 50 AS e
  FROM (SELECT r, p, sum(CASE WHEN p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS run
        FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM hit))
  GROUP BY r, run),
cut AS (
  SELECT r, s, e, lead(s) OVER (PARTITION BY r ORDER BY s) AS next, row_number() OVER (PARTITION BY r ORDER BY s) AS i FROM runs),
kept AS (
  SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans,
    string_agg(CASE WHEN i = 1 THEN left(h, 2 * s) ELSE '' END || CASE WHEN next IS NULL THEN substr(h, 2 * e + 1) ELSE substr(h, 2 * e + 1, 2 * (next - e)) END, '' ORDER BY s) AS rest
  FROM cut JOIN given USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM given LEFT JOIN kept USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v) and k[2].isdigit()} | conversation_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op9_line_dedup": OP9_SQL, "op12_suffix_dedup": OP12_SQL} | conversation_queries.oracle_sql()
