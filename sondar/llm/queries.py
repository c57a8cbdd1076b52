"""Queries of the text problems; __spark_entry__.py adds them where this subpackage exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondar.functions.text import LANGUAGE_NAMES
from sondar.llm import bpe, budget, corpus, language, leaks, pairs, reading
from sondar.session import table


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lmsys = language.rows_of(table(spark, sf_dir, "lmsys_chat"), "lmsys_chat", "conversation_id", "conversation")
    arena = language.rows_of(table(spark, sf_dir, "chatbot_arena"), "chatbot_arena", "question_id", "conversation_a")
    return lmsys.unionByName(arena)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.found(_chats(spark, sf_dir))


def p1_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.profiled(_chats(spark, sf_dir))


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(_chats(spark, sf_dir)).drop("named").distinct()


def p2_token_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.totals(budget.update(budget.corpus(spark, sf_dir)).cube)


def p2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.update(budget.corpus(spark, sf_dir)).records.select(*budget.RECORD, "tokens")


def p2_signed_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube after a second snapshot: records that came before 2025 first, then those that came since July 2024."""
    corpus = budget.corpus(spark, sf_dir)
    first = budget.update(corpus.where(F.col("came") < F.lit("2025-01-01").cast("timestamp"))).kept()
    return budget.totals(budget.update(corpus.where(F.col("came") >= F.lit("2024-07-01").cast("timestamp")), first).cube)


def p2_record_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube's records alone, which SQL can count."""
    return budget.totals(budget.update(budget.corpus(spark, sf_dir)).cube).drop("tokens")


def p2_earlier_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier run's side of the comparison, which SQL can count."""
    return p2_earlier_runs(spark, sf_dir).drop("tokens", "ratio")


def p2_earlier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = budget.update(budget.corpus(spark, sf_dir)).records
    return budget.compared(records, table(spark, sf_dir, "token_batches"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.found(table(spark, sf_dir, "dialogues"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "graded_samples"))


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.profile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "graded_samples"))


QUERIES = {
    "p1_found": p1_found,
    "p1_dialogues": p1_dialogues,
    "p1_segments": p1_segments,
    "p2_token_cube": p2_token_cube,
    "p2_token_counts": p2_token_counts,
    "p2_signed_deltas": p2_signed_deltas,
    "p2_earlier_runs": p2_earlier_runs,
    "p2_record_cube": p2_record_cube,
    "p2_earlier_totals": p2_earlier_totals,
    "p4_found": p4_found,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
    **corpus.QUERIES,
}


_NAME = "regexp_replace(lower(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '[\\s\\-_]+', '_', 'g')"
_LABEL = "regexp_replace(lower(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '[\\s_\\-(].*$', '')"
_CODE = f"coalesce(CASE {_LABEL} " + " ".join(f"WHEN '{n}' THEN '{c}'" for c, names in LANGUAGE_NAMES.items() for n in {c: 0, **dict.fromkeys(names)}) + " END, 'und')"

_RECORDS = f"""
WITH topics AS (SELECT {_NAME.format("dataset")} AS source, min(lower(trim(topic))) AS domain FROM source_registry GROUP BY 1),
chats AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ingested_at DESC) AS k FROM lmsys_chat),
records AS (
  SELECT 'documents' AS source_table, CAST(doc_id AS VARCHAR) AS record_id, {_NAME.format("source")} AS source, {_CODE.format("lang")} AS language, lower(trim(text_domain)) AS domain FROM documents
  UNION ALL SELECT 'dialogues', CAST(sample_id AS VARCHAR), {_NAME.format("d.dataset")}, {_CODE.format("metadata['language']")}, t.domain
    FROM dialogues d LEFT JOIN topics t ON t.source = {_NAME.format("d.dataset")}
  UNION ALL SELECT 'lmsys_chat', conversation_id, 'lmsys_chat', {_CODE.format("language")}, t.domain
    FROM chats LEFT JOIN topics t ON t.source = 'lmsys_chat' WHERE k = 1 AND conversation_id IS NOT NULL)
"""
_EACH = "SELECT '{}' AS by, {}, count(*) AS records FROM records GROUP BY {}"
_EMPTY = {c: f"CAST(NULL AS VARCHAR) AS {c}" for c in budget.CELL}


def _level(by: str, kept: list[str]) -> str:
    return _EACH.format(by, ", ".join(c if c in kept else _EMPTY[c] for c in budget.CELL), ", ".join(kept))


ORACLES: dict[str, str] = {
    **corpus.ORACLES,
    "p2_record_cube": _RECORDS
    + " UNION ALL ".join(_level(by, kept) for by, kept in (("cell", budget.CELL), ("table", budget.CELL[:1]), ("source", budget.CELL[:2]), ("language", ["language"]), ("domain", ["domain"]))),
    "p2_earlier_totals": _RECORDS
    + f""", batches AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ingested_at DESC) AS k FROM token_batches WHERE record_ids IS NOT NULL AND offsets IS NOT NULL),
each AS (SELECT CASE WHEN {_NAME.format("dataset")} = 'lmsys_chat' THEN 'lmsys_chat' ELSE 'dialogues' END AS source_table, offsets, record_ids, unnest(range(1, len(record_ids) + 1)) AS i FROM batches WHERE k = 1),
counts AS (SELECT source_table, record_ids[i] AS record_id, max(offsets[i + 1] - offsets[i]) AS earlier FROM each WHERE offsets[i + 1] - offsets[i] IS NOT NULL GROUP BY 1, 2)
SELECT source_table, source, count(*) AS records, CAST(sum(earlier) AS BIGINT) AS earlier FROM counts JOIN records USING (source_table, record_id) GROUP BY 1, 2""",
}
