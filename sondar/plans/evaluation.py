"""Queries over scores: probes on the embeddings table and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondar.operators import metrics as M
from sondar.session import table


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, slice, y, p): a fixed score of every embedding."""
    e = table(spark, sf_dir, "embeddings")
    z = 10.0 * F.get("embedding", F.lit(0)).cast("double")
    return e.select("vec_id", (F.col("label") % 3).alias("slice"), (F.col("label") >= 5).cast("int").alias("y"), F.round(1.0 / (1.0 + F.exp(-z)), 4).alias("p"))


SCORES = """WITH s AS (SELECT vec_id, label % 3 AS slice, CAST(label >= 5 AS INT) AS y,
 round(1.0::DOUBLE / (1.0::DOUBLE + exp(-10.0::DOUBLE * CAST(embedding[1] AS DOUBLE))), 4) AS p FROM embeddings)
"""

_RANKED = SCORES + """, g AS (SELECT p, count(*) AS n, sum(y) AS k FROM s GROUP BY p),
c AS (SELECT p, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k, CAST(n - k AS DOUBLE) AS m,
 CAST(sum(k) OVER (ORDER BY p DESC) AS DOUBLE) AS ka, CAST(sum(n - k) OVER (ORDER BY p DESC) AS DOUBLE) AS ma,
 CAST(sum(k) OVER () AS DOUBLE) AS pos, CAST(sum(n - k) OVER () AS DOUBLE) AS neg FROM g)
"""


def _one(**metrics):  # noqa: ANN003, ANN202
    """Query of metric columns, each built once a session is there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = M.evaluate(scores(spark, sf_dir), **{name: build() for name, build in metrics.items()})
        return out.select(*[F.round(name, 6).alias(name) for name in metrics])

    return run


def _optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.optimal_threshold(scores(spark, sf_dir)).select(F.round("threshold", 6).alias("threshold"), F.round("error", 6).alias("error"))


def _by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).withColumn("slice", F.explode(F.array(F.col("slice").cast("string"), F.lit("all"))))
    return M.evaluate(s, by=["slice"], auroc=M.auroc(), f1=M.f1(), n=F.sum("n").cast("bigint")).select("slice", F.round("auroc", 6).alias("auroc"), F.round("f1", 6).alias("f1"), "n")


def _bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bootstrap(scores(spark, sf_dir), M.auroc(strict=False), n=200, seed=3)


QUERIES = {
    "metric_auroc": _one(auroc=M.auroc),
    "metric_partial_auroc": _one(partial_auroc=lambda: M.partial_auroc(0.1)),
    "metric_average_precision": _one(average_precision=M.average_precision),
    "metric_threshold_family": _one(
        accuracy=M.accuracy, balanced_accuracy=M.balanced_accuracy, precision=M.precision, recall=M.recall, f1=M.f1
    ),
    "metric_brier": _one(brier=M.brier_score),
    "metric_confusion": _one(tn=M.true_negatives, fp=M.false_positives, fn=M.false_negatives, tp=M.true_positives),
    "metric_fpr_fnr": _one(fpr=lambda: M.fpr(0.4), fnr=lambda: M.fnr(0.4)),
    "metric_recall_at_fpr": _one(recall_at_fpr=lambda: M.recall_at_fpr(0.05)),
    "metric_max_balanced_accuracy": _one(threshold=M.max_balanced_accuracy_threshold, value=M.max_balanced_accuracy),
    "metric_optimal_threshold": _optimal,
    "metric_weighted_error": _one(weighted_error=M.weighted_error_rate),
    "metric_score_stats": _one(mean=M.mean_score, std=M.std_score, p95=lambda: M.percentile(95), p50=lambda: M.percentile(50)),
    "metric_by_slice": _by_slice,
    "metric_bootstrap_auroc": _bootstrap,
}

_AT = "count(*) FILTER (WHERE y = {y} AND p {op} {t})"


def _at(y: int, above: bool, t: float = 0.5) -> str:
    return f"CAST({_AT.format(y=y, op='>' if above else '<=', t=t)} AS DOUBLE)"


TP, FP, FN, TN = _at(1, True), _at(0, True), _at(1, False), _at(0, False)

ORACLES = {
    "metric_auroc": SCORES
    + """SELECT round(avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auroc
FROM s a, s b WHERE a.y = 1 AND b.y = 0""",
    "metric_partial_auroc": _RANKED
    + """, seg AS (SELECT (ma - m) / neg AS f0, ma / neg AS f1, (ka - k) / pos AS t0, ka / pos AS t1 FROM c),
a AS (SELECT sum(CASE WHEN f0 >= 0.1::DOUBLE THEN 0.0::DOUBLE WHEN f1 <= 0.1::DOUBLE THEN (f1 - f0) * (t0 + t1) / 2
 ELSE (0.1::DOUBLE - f0) * (t0 + t0 + (t1 - t0) * (0.1::DOUBLE - f0) / (f1 - f0)) / 2 END) AS area FROM seg)
SELECT round(0.5::DOUBLE * (1 + (area - 0.005::DOUBLE) / (0.1::DOUBLE - 0.005::DOUBLE)), 6) AS partial_auroc FROM a""",
    "metric_average_precision": _RANKED + "SELECT round(sum(k / pos * (ka / (ka + ma))), 6) AS average_precision FROM c",
    "metric_threshold_family": SCORES
    + f"""SELECT round(({TP} + {TN}) / count(*), 6) AS accuracy, round(({TP} / ({TP} + {FN}) + {TN} / ({TN} + {FP})) / 2, 6) AS balanced_accuracy,
round({TP} / ({TP} + {FP}), 6) AS precision, round({TP} / ({TP} + {FN}), 6) AS recall, round(2 * {TP} / (2 * {TP} + {FP} + {FN}), 6) AS f1 FROM s""",
    "metric_brier": SCORES + "SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM s",
    "metric_confusion": SCORES + f"SELECT {TN} AS tn, {FP} AS fp, {FN} AS fn, {TP} AS tp FROM s",
    "metric_fpr_fnr": SCORES
    + f"SELECT round({_at(0, True, 0.4)} / count(*) FILTER (WHERE y = 0), 6) AS fpr, round({_at(1, False, 0.4)} / count(*) FILTER (WHERE y = 1), 6) AS fnr FROM s",
    "metric_recall_at_fpr": SCORES
    + """, neg AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS r, count(*) OVER () AS n FROM s WHERE y = 0),
t AS (SELECT p AS thr FROM neg WHERE r = least(CAST(floor(0.95::DOUBLE * n) AS BIGINT), n - 1))
SELECT round(avg(CASE WHEN p > thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall_at_fpr FROM s, t WHERE y = 1""",
    "metric_max_balanced_accuracy": _RANKED
    + """, b AS (SELECT p, ((ka - k) / pos + (neg - ma + m) / neg) / 2 AS v FROM c)
SELECT round(p, 6) AS threshold, round(v, 6) AS value FROM b ORDER BY v DESC, p LIMIT 1""",
    "metric_optimal_threshold": SCORES
    + """, grid AS (SELECT i, CASE WHEN i = 99 THEN 1.0::DOUBLE ELSE CAST(i AS DOUBLE) * (1.0::DOUBLE / 99) END AS t FROM range(100) r(i)),
e AS (SELECT i, t, (5 * avg(CASE WHEN y = 1 THEN CASE WHEN p <= t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) + 50 * avg(CASE WHEN y = 0 THEN CASE WHEN p > t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)) / 55 AS err
 FROM s, grid GROUP BY i, t)
SELECT round(t, 6) AS threshold, round(err, 6) AS error FROM e ORDER BY round(err, 12), i LIMIT 1""",
    "metric_weighted_error": SCORES
    + f"SELECT round((5 * ({FN} / count(*) FILTER (WHERE y = 1)) + 50 * ({FP} / count(*) FILTER (WHERE y = 0))) / 55, 6) AS weighted_error FROM s",
    "metric_score_stats": SCORES
    + "SELECT round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, round(quantile_cont(p, 0.95), 6) AS p95, round(quantile_cont(p, 0.5), 6) AS p50 FROM s",
    "metric_by_slice": SCORES
    + f""", x AS (SELECT CAST(slice AS VARCHAR) AS slice, y, p, vec_id FROM s UNION ALL SELECT 'all', y, p, vec_id FROM s),
f AS (SELECT slice, round(2 * {TP} / (2 * {TP} + {FP} + {FN}), 6) AS f1, count(*) AS n FROM x GROUP BY slice),
a AS (SELECT a.slice, round(avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auroc
 FROM x a JOIN x b USING (slice) WHERE a.y = 1 AND b.y = 0 GROUP BY a.slice)
SELECT slice, auroc, f1, n FROM f JOIN a USING (slice)""",
}
