"""Queries of the streaming operators: a file stream of events run to its end.

The stream is closed by one row without a key that comes after all others, so that the
watermark passes every window of the events and none stays open. All files there are come
in one micro-batch, in which no row is late; in a stream that goes on, rows later than the
watermark are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondar.session import checkpoint_dir, cleared, table, written
from sondar.streaming import monitor


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _scored(stream)


def _closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of one row without a key, two days after the last event."""
    last = _scored(table(spark, sf_dir, "events")).agg(F.max("ts").alias("ts"))
    row = last.select((F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("double").alias("score"))
    held = written(row, "closing")
    return spark.readStream.schema(held.schema).parquet(held.inputFiles()[0].rsplit("/", 1)[0])


def _scored(events: DataFrame) -> DataFrame:
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("bigint").alias("key"), (F.col("value") / 500).cast("double").alias("score"))


def _run(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there into a table of the shared folder, and reads it."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/sondar-{name}-{uuid.uuid4().hex}"
    cleared(spark, base)
    out = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _windows(spark, sf):  # noqa: ANN001, ANN202
    stream = _events(spark, sf).unionByName(_closing(spark, sf))
    done = _run(monitor.windowed_scores(stream, "0 seconds", "1 hour"), "windows", "append").where("key IS NOT NULL")
    return done.groupBy("key").agg(F.count("*").alias("windows"), F.sum("n").alias("n"), F.round(F.max("high"), 6).alias("high"))


def _alerts(spark, sf):  # noqa: ANN001, ANN202
    return _run(monitor.alerts(_events(spark, sf), threshold=0.6), "alerts", "append")


def _rises(spark, sf):  # noqa: ANN001, ANN202
    """Alerts at a level that events do reach."""
    return _run(monitor.alerts(_events(spark, sf), threshold=0.4), "rises", "append").select("key", "ts", F.round("level", 6).alias("level"))


def _sessions(spark, sf):  # noqa: ANN001, ANN202
    stream = _events(spark, sf).unionByName(_closing(spark, sf))
    done = _run(monitor.sessions(stream, "0 seconds", "6 hours"), "sessions", "append").where("key IS NOT NULL")
    return done.groupBy("key").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"), F.max("n").alias("longest"), F.round(F.max("high"), 6).alias("high"))


QUERIES = {"stream_windowed_scores": _windows, "stream_alerts": _alerts, "stream_rises": _rises, "stream_sessions": _sessions}

_SCORED = "WITH RECURSIVE e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, user_id AS key, CAST(value AS DOUBLE) / 500.0::DOUBLE AS score FROM events)"

_LEVELS = (
    _SCORED
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS k FROM e),
l AS (SELECT key, k, ts, 0.5::DOUBLE * score AS level, 0.0::DOUBLE AS before FROM o WHERE k = 1
 UNION ALL SELECT o.key, o.k, o.ts, 0.5::DOUBLE * l.level + 0.5::DOUBLE * o.score, l.level FROM l JOIN o ON o.key = l.key AND o.k = l.k + 1)
SELECT key, ts, round(level, 6) AS level FROM l WHERE level > {0} AND before <= {0}"""
)

ORACLES: dict[str, str] = {
    "stream_windowed_scores": _SCORED
    + """, w AS (SELECT key, date_trunc('hour', ts) AS h, count(*) AS n, max(score) AS high FROM e GROUP BY ALL)
SELECT key, count(*) AS windows, CAST(sum(n) AS BIGINT) AS n, round(max(high), 6) AS high FROM w GROUP BY key""",
    "stream_alerts": _LEVELS.format("0.6::DOUBLE"),
    "stream_rises": _LEVELS.format("0.4::DOUBLE"),
    "stream_sessions": _SCORED
    + """, b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS starts FROM e),
s AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM b),
g AS (SELECT key, session, count(*) AS n, max(score) AS high FROM s GROUP BY ALL)
SELECT key, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n, max(n) AS longest, round(max(high), 6) AS high FROM g GROUP BY key""",
}
