"""Queries of the problems on whole records (3, 5, 6) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondar.functions.text import source_name
from sondar.llm import formats, mixing, overlap
from sondar.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.found(table(spark, sf_dir, "wildguard_mix"), table(spark, sf_dir, "raw_records"))


def p3_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.sizes(table(spark, sf_dir, "wildguard_mix"), table(spark, sf_dir, "raw_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.found(table(spark, sf_dir, "dialogues"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(table(spark, sf_dir, "dialogues"), source_name(F.col("dataset")))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.dialogue_records(table(spark, sf_dir, "dialogues")), mixing.registry_targets(table(spark, sf_dir, "source_registry"))


def p6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(*_mixed(spark, sf_dir)).withColumnRenamed("id", "sample_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(*_mixed(spark, sf_dir))


QUERIES = {
    "p3_found": p3_found,
    "p3_group_sizes": p3_group_sizes,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_mixture": p6_mixture,
    "p6_report": p6_report,
}

_NAME = "regexp_replace(lower(regexp_replace({}, '^[\\s]+|[\\s]+$', '', 'g')), '[\\s\\-_]+', '_', 'g')"

_MIXING = f"""
WITH records AS (
  SELECT {_NAME.format("dataset")} AS dataset, sample_id AS id,
         CAST(coalesce(list_sum(list_transform(messages, lambda m: coalesce(length(m.content), 0))), 0) AS BIGINT) AS size
  FROM dialogues),
targets AS (
  SELECT {_NAME.format("dataset")} AS dataset, CAST(target_share AS DECIMAL(18,9)) AS share, CAST(max_repeats AS BIGINT) AS max_repeats
  FROM source_registry WHERE target_share > 0 AND max_repeats > 0),
held AS (SELECT dataset, count(*) AS records, CAST(sum(size) AS BIGINT) AS size FROM records GROUP BY dataset HAVING sum(size) > 0),
shares AS (
  SELECT h.*, t.max_repeats, CAST(t.share AS DOUBLE) / CAST(sum(t.share) OVER () AS DOUBLE) AS target,
         CAST(sum(h.size) OVER () AS DOUBLE) AS whole,
         CAST(CAST('0x' || substr(md5('offset|' || h.dataset || '|7'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS off
  FROM held h JOIN targets t USING (dataset)),
plan AS (SELECT *, least(CAST(max_repeats AS DOUBLE), target * whole / CAST(size AS DOUBLE)) AS rate FROM shares),
ranked AS (
  SELECT r.*, p.rate, p.off, CAST(row_number() OVER (PARTITION BY r.dataset ORDER BY md5(CAST(id AS VARCHAR) || '|7'), id) AS DOUBLE) AS k
  FROM records r JOIN plan p USING (dataset)),
mixed AS (
  SELECT dataset, id, records_size, CAST(copies AS BIGINT) AS copies FROM (
    SELECT dataset, id, size AS records_size, floor(k * rate + off) - floor((k - 1) * rate + off) AS copies FROM ranked)
  WHERE copies > 0)
"""

_LETTERS = "regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"

_KEYS = f"""
WITH cells AS (
  SELECT r.raw_id AS id, concat_ws(chr(1), t.fullkey,
    CASE WHEN t.type = 'VARCHAR' THEN 's' || {_LETTERS.format("json_extract_string(t.value, '$')")}
         WHEN t.type = 'OBJECT' THEN 'o' WHEN t.type = 'ARRAY' THEN 'a' || json_array_length(t.value)
         WHEN t.type IN ('NULL', 'BOOLEAN') THEN 'l' || CAST(t.value AS VARCHAR)
         ELSE 'n' || CAST(CAST(CAST(t.value AS VARCHAR) AS DOUBLE) AS VARCHAR) END) AS cell
  FROM raw_records r, json_tree(CASE WHEN json_valid(r.payload) THEN r.payload ELSE 'null' END) t WHERE r.raw_id IS NOT NULL),
keys AS (
  SELECT 'raw_records' AS source_table, r.raw_id AS id, CASE WHEN json_valid(r.payload) THEN k.key END AS key
  FROM (SELECT DISTINCT raw_id, payload FROM raw_records WHERE raw_id IS NOT NULL) r
  LEFT JOIN (SELECT id, array_to_string(list_sort(list(cell)), chr(2)) AS key FROM cells GROUP BY id) k ON r.raw_id = k.id
  UNION ALL
  SELECT DISTINCT 'wildguard_mix', record_id,
    CASE WHEN coalesce(lower(trim(prompt_harm_label)) = 'harmful', false) THEN 'h' ELSE 'u' END || {_LETTERS.format("prompt")}
  FROM wildguard_mix WHERE record_id IS NOT NULL),
groups AS (
  SELECT source_table, key, min(id) AS keep_id, count(*) AS copies FROM keys GROUP BY source_table, key, CASE WHEN key IS NULL THEN id END)
"""

ORACLES: dict[str, str] = {
    "p3_found": _KEYS
    + """SELECT k.source_table, g.keep_id, k.id AS copy_id FROM keys k JOIN groups g ON k.source_table = g.source_table AND k.key = g.key WHERE k.id <> g.keep_id""",
    "p3_group_sizes": _KEYS + "SELECT source_table, keep_id, copies FROM groups",
    "p6_mixture": _MIXING + "SELECT dataset, id AS sample_id, records_size AS size, copies FROM mixed",
    "p6_report": _MIXING
    + """, used AS (SELECT dataset, count(*) AS used, CAST(sum(copies) AS BIGINT) AS copies, CAST(sum(records_size * copies) AS BIGINT) AS mixed FROM mixed GROUP BY dataset)
SELECT p.dataset, round(p.target, 6) AS target, round(coalesce(u.mixed, 0) / CAST(sum(coalesce(u.mixed, 0)) OVER () AS DOUBLE), 6) AS actual,
       round(p.rate, 6) AS rate, p.max_repeats, p.records, coalesce(u.used, 0) AS used, coalesce(u.copies, 0) AS copies, coalesce(u.mixed, 0) AS size
FROM plan p LEFT JOIN used u USING (dataset)""",
}
