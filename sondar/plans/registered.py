"""Queries that load registered sources from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondar.functions.text import ROLE_ALIASES
from sondar.sources import registry


def _load(name: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = registry.load(spark, name, sf_dir, shuffled=False)
        return d.groupBy("label", F.size("messages").alias("turns")).agg(F.count("*").alias("n"), F.sum(F.aggregate("messages", F.lit(0).cast("bigint"), lambda a, m: a + F.length(m["content"]))).alias("chars"))

    return run


def _topics(spark, sf):  # noqa: ANN001, ANN202
    rows = [(s.name, s.topic) for s in map(registry.info, registry.list_datasets())]
    return spark.createDataFrame(rows, "name string, topic string").groupBy("topic").agg(F.count("*").alias("sources"))


QUERIES = {f"source_{n}": _load(n) for n in ("lmsys_chat", "chatbot_arena", "wildguard_mix")} | {"source_topics": _topics}

_ROLE = "CASE lower(coalesce(nullif(m.role, ''), 'user')) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLE_ALIASES.items()) + " ELSE lower(coalesce(nullif(m.role, ''), 'user')) END"


def _chat(table: str, column: str) -> str:
    return f"""WITH k AS (SELECT list_filter({column}, lambda m: {_ROLE} IN ('system', 'user', 'assistant') AND coalesce(m.content, '') <> '') AS ms FROM {table})
SELECT 0 AS label, len(ms) AS turns, count(*) AS n, CAST(sum(list_sum(list_transform(ms, lambda m: length(m.content)))) AS BIGINT) AS chars FROM k WHERE len(ms) > 0 GROUP BY 2"""


# How many public sources each topic has.
_TOPIC_SIZES = {
    "agents": 4, "creative": 6, "cybersecurity": 20, "deception": 17, "hallucination": 4, "harmfulness": 28, "legal_finance": 4,
    "medical": 4, "mental_health": 4, "multilingual": 3, "ood": 10, "reasoning": 5, "science": 24, "sparse_probing": 113,
}

ORACLES = {
    "source_topics": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', CAST({n} AS BIGINT))" for t, n in _TOPIC_SIZES.items()) + ") AS t(topic, sources)",
    "source_lmsys_chat": _chat("lmsys_chat", "conversation"),
    "source_chatbot_arena": _chat("chatbot_arena", "conversation_a"),
    "source_wildguard_mix": """WITH d AS (SELECT DISTINCT prompt, CASE WHEN lower(prompt_harm_label) = 'harmful' THEN 1 ELSE 0 END AS label FROM wildguard_mix),
k AS (SELECT label, nullif(regexp_replace(prompt, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '') AS p FROM d)
SELECT label, 2 AS turns, count(*) AS n, CAST(sum(length(p)) + count(*) * length('You are a helpful, honest assistant.') AS BIGINT) AS chars FROM k WHERE p IS NOT NULL GROUP BY label""",
}
