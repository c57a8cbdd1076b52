"""Queries of pooling, activation and batching operators over the events of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondar.operators import activations as A
from sondar.operators import batching, pool
from sondar.session import table

LAYERS = (10, 20, 30)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """act_bsh: a user's events in order of time; clicks and purchases are detected, but of users divisible by 10 none."""
    e = table(spark, sf_dir, "events")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts")) - 1
    detected = F.col("event_type").isin("click", "purchase") & (F.col("user_id") % 10 != 0)
    return e.select(F.col("user_id").alias("sample_id"), place.alias("pos"), detected.alias("det"), F.array(F.col("value").cast("double"), F.length("props").cast("double")).alias("vec"))


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id")).distinct()


def layered(spark: SparkSession, sf_dir: str) -> A.Activations:
    t = tokens(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.lit(float(k)).alias("f")) for k in LAYERS])).alias("l")
    data = t.select("sample_id", "pos", "det", "vec", each).select("sample_id", "pos", "det", "l.layer", F.transform("vec", lambda x: x * F.col("l.f")).alias("vec"))
    return A.Activations(data, "blsh", spine(spark, sf_dir), LAYERS)


TOKENS = """WITH t AS (SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos,
 event_type IN ('click', 'purchase') AND user_id % 10 <> 0 AS det, [CAST(value AS DOUBLE), CAST(length(props) AS DOUBLE)] AS vec FROM events),
e AS (SELECT sample_id, pos, det, unnest([0, 1]) AS dim, unnest(vec) AS x FROM t),
s AS (SELECT DISTINCT sample_id, dim FROM e)
"""


def _dims(df: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("sample_id",)
    return df.select(*keys, F.posexplode("vec").alias("dim", "x")).select(*keys, "dim", F.round("x", 9).alias("x"))


def _pooled(name: str, **options):  # noqa: ANN003, ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _dims(pool.pool(name, tokens(spark, sf_dir), spine(spark, sf_dir), **options))

    return run


def _acts(build, *keys: str):  # noqa: ANN001, ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _dims(build(layered(spark, sf_dir)).data, *(keys or ("sample_id",)))

    return run


def _by_label(spark, sf):  # noqa: ANN001, ANN202
    e = table(spark, sf, "embeddings").select(F.col("label").alias("sample_id"), F.lit(True).alias("det"), F.col("embedding").alias("vec"))
    return _dims(pool.mean(e, e.select("sample_id").distinct()))


def _zero_filled(spark, sf):  # noqa: ANN001, ANN202
    p = pool.mean(tokens(spark, sf), spine(spark, sf))
    return p.select(F.forall("vec", lambda x: x == 0).alias("zero")).groupBy("zero").agg(F.count("*").alias("samples"))


def _detected(spark, sf):  # noqa: ANN001, ANN202
    return layered(spark, sf).detected()[1]


def _cat(spark, sf):  # noqa: ANN001, ANN202
    one = layered(spark, sf).select_layer(10)
    both = A.cat([one, one])
    return both.lengths()


def _cat_vectors(spark, sf):  # noqa: ANN001, ANN202
    """One sample of id 0, the mean of all, before all samples twice."""
    pooled = layered(spark, sf).select_layer(10).mean("s")
    whole = pooled.data.agg(pool.layer_mean("vec").alias("vec")).select(F.lit(0).cast("bigint").alias("sample_id"), "vec")
    one = A.Activations(whole, "bh", whole.select("sample_id"))
    return _dims(A.cat([one, pooled, pooled]).data)


def _padded_batches(spark, sf):  # noqa: ANN001, ANN202
    p = layered(spark, sf).select_layer(10).padded(batches=batching.sequence_batches(_lengths(spark, sf), 32))
    return p.select("sample_id", F.size("vecs").alias("length"), F.size(F.filter("mask", lambda m: m)).alias("detected"))


def _finite(spark, sf):  # noqa: ANN001, ANN202
    t = tokens(spark, sf)
    dirty = t.withColumn("vec", F.transform("vec", lambda x: F.when((F.col("pos") == 3) & (x > 100), F.lit(float("nan"))).when((F.col("pos") == 5) & (x > 100), F.lit(float("-inf"))).otherwise(x)))
    return A.quality(dirty)


def _lengths(spark, sf):  # noqa: ANN001, ANN202
    return tokens(spark, sf).groupBy("sample_id").agg(F.count("*").alias("n"))


def _batches(spark, sf):  # noqa: ANN001, ANN202
    return batching.sequence_batches(_lengths(spark, sf), 8, 600).select("sample_id", "n", "batch")


def _feature_batches(spark, sf):  # noqa: ANN001, ANN202
    b = batching.feature_batches(table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id")), 64)
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.min("sample_id").alias("first"))


def _chunks(spark, sf):  # noqa: ANN001, ANN202
    return batching.token_chunks(_lengths(spark, sf), 1000).select("sample_id", "n", "batch")


QUERIES = {
    "pool_mean": _pooled("mean"),
    "pool_max": _pooled("max"),
    "pool_last_token": _pooled("last_token"),
    "pool_ema": _pooled("ema", alpha=0.5),
    "pool_rolling_batch_max": _pooled("rolling", window_size=10),
    "pool_rolling_unpadded": _pooled("rolling", window_size=4, pad_to="none"),
    "pool_vector_mean_by_label": _by_label,
    "pool_zero_fill": _zero_filled,
    "activations_select_layer": _acts(lambda a: a.select_layer(20).mean("s")),
    "activations_select_layers": _acts(lambda a: a.select_layer([30, 10]).max("s"), "sample_id", "layer"),
    "activations_position": _acts(lambda a: a.select_layer(20).select_position(2)),
    "activations_position_negative": _acts(lambda a: a.select_layer(20).select_position(-3)),
    "activations_last_detected": _acts(lambda a: a.select_layer(20).select_position(-1)),
    "activations_layer_mean": _acts(lambda a: a.mean("l").last()),
    "activations_layer_max": _acts(lambda a: a.max("l").mean("s")),
    "activations_flatten": _acts(lambda a: a.mean("s").flatten()),
    "activations_detected_counts": _detected,
    "activations_cat": _cat,
    "activations_cat_vectors": _cat_vectors,
    "activations_padded_batches": _padded_batches,
    "activations_finite_check": _finite,
    "batching_sequences": _batches,
    "batching_features": _feature_batches,
    "batching_token_chunks": _chunks,
}

_MEAN = "avg(x) FILTER (WHERE det)"


def _agg(value: str, source: str = "e") -> str:
    return TOKENS + f", p AS (SELECT sample_id, dim, {value} AS v FROM {source} GROUP BY sample_id, dim) SELECT sample_id, dim, round(coalesce(v, 0), 9) AS x FROM s LEFT JOIN p USING (sample_id, dim)"


def _rolling(w: int, padded: bool) -> str:
    rows = (
        f"""SELECT * FROM e UNION ALL SELECT sample_id, n + i, false, dim, 0 FROM (SELECT sample_id, dim, count(*) AS n FROM e GROUP BY ALL) l, range({w - 1}) r(i),
 (SELECT max(pos) + 1 AS longest FROM e) m WHERE n + i < longest"""
        if padded
        else "SELECT * FROM e"
    )
    return TOKENS + f""", a AS ({rows}),
w AS (SELECT sample_id, dim, avg(CASE WHEN det THEN x END) OVER (PARTITION BY sample_id, dim ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS m FROM a),
p AS (SELECT sample_id, dim, max(m) AS v FROM w GROUP BY sample_id, dim)
SELECT sample_id, dim, round(coalesce(v, 0), 9) AS x FROM s LEFT JOIN p USING (sample_id, dim)"""


ORACLES = {
    "pool_mean": _agg(_MEAN),
    "pool_max": _agg("max(x) FILTER (WHERE det)"),
    "pool_last_token": _agg("arg_max(x, pos) FILTER (WHERE det)"),
    "pool_ema": TOKENS
    + """, d AS (SELECT sample_id, dim, x, row_number() OVER (PARTITION BY sample_id, dim ORDER BY pos) AS k FROM e WHERE det),
r AS (SELECT a.sample_id, a.dim, a.k, sum(0.5::DOUBLE * power(0.5::DOUBLE, a.k - b.k) * b.x) AS v FROM d a JOIN d b ON a.sample_id = b.sample_id AND a.dim = b.dim AND b.k <= a.k GROUP BY ALL),
p AS (SELECT sample_id, dim, max(v) AS v FROM r GROUP BY sample_id, dim)
SELECT sample_id, dim, round(coalesce(v, 0), 9) AS x FROM s LEFT JOIN p USING (sample_id, dim)""",
    "pool_rolling_batch_max": _rolling(10, True),
    "pool_rolling_unpadded": _rolling(4, False),
    "pool_vector_mean_by_label": """WITH e AS (SELECT label AS sample_id, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT sample_id, CAST(dim AS INT) AS dim, round(avg(x), 9) AS x FROM e GROUP BY sample_id, dim""",
    "pool_zero_fill": TOKENS + "SELECT NOT any_det AS zero, count(*) AS samples FROM (SELECT sample_id, bool_or(det) AS any_det FROM t GROUP BY sample_id) GROUP BY 1",
    "activations_select_layer": _agg("avg(20 * x) FILTER (WHERE det)"),
    "activations_select_layers": TOKENS
    + """, l AS (SELECT unnest([10, 30]) AS layer), p AS (SELECT sample_id, layer, dim, max(layer * x) FILTER (WHERE det) AS v FROM e, l GROUP BY ALL)
SELECT sample_id, layer, dim, round(coalesce(v, 0), 9) AS x FROM p""",
    "activations_position": _agg("max(20 * x) FILTER (WHERE pos = 2)"),
    "activations_position_negative": TOKENS
    + """, c AS (SELECT *, max(pos) OVER (PARTITION BY sample_id) + 1 AS n FROM e), p AS (SELECT sample_id, dim, max(20 * x) FILTER (WHERE pos = n - 3) AS v FROM c GROUP BY ALL)
SELECT sample_id, dim, round(coalesce(v, 0), 9) AS x FROM p""",
    "activations_last_detected": _agg("arg_max(20 * x, pos) FILTER (WHERE det)"),
    "activations_layer_mean": _agg("arg_max(20 * x, pos) FILTER (WHERE det)"),
    "activations_layer_max": _agg("avg(30 * x) FILTER (WHERE det)"),
    "activations_flatten": TOKENS
    + f""", p AS (SELECT sample_id, dim, coalesce({_MEAN}, 0) AS v FROM e GROUP BY ALL), l AS (SELECT unnest([0, 1, 2]) AS i, unnest([10, 20, 30]) AS layer)
SELECT sample_id, CAST(2 * i + dim AS INT) AS dim, round(layer * v, 9) AS x FROM p, l""",
    "activations_detected_counts": TOKENS + "SELECT sample_id, count(*) FILTER (WHERE det) AS n FROM t GROUP BY sample_id",
    "activations_cat": TOKENS
    + ", c AS (SELECT sample_id, count(*) AS n FROM t GROUP BY sample_id) SELECT sample_id, n FROM c UNION ALL SELECT sample_id + (SELECT max(sample_id) + 1 FROM c), n FROM c",
    "activations_cat_vectors": TOKENS
    + f""", p AS (SELECT sample_id, dim, coalesce(avg(x * 10) FILTER (WHERE det), 0.0::DOUBLE) AS x FROM e GROUP BY ALL), m AS (SELECT max(sample_id) + 1 AS n FROM p)
SELECT 0 AS sample_id, dim, round(avg(x), 9) AS x FROM p GROUP BY dim UNION ALL SELECT sample_id + 1, dim, round(x, 9) FROM p UNION ALL SELECT sample_id + 1 + n, dim, round(x, 9) FROM p, m""",
    "activations_padded_batches": TOKENS
    + """, c AS (SELECT sample_id, count(*) AS n, count(*) FILTER (WHERE det) AS detected FROM t GROUP BY sample_id),
b AS (SELECT *, (row_number() OVER (ORDER BY n DESC, sample_id) - 1) // 32 AS batch FROM c) SELECT sample_id, max(n) OVER (PARTITION BY batch) AS length, detected FROM b""",
    "activations_finite_check": TOKENS
    + "SELECT count(DISTINCT (sample_id, pos)) AS rows, count(*) FILTER (WHERE pos = 3 AND x > 100) AS nans, count(*) FILTER (WHERE pos = 5 AND x > 100) AS infinities FROM e",
    "batching_sequences": """WITH RECURSIVE l AS (SELECT user_id AS sample_id, count(*) AS n FROM events GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, sample_id) AS k FROM l),
b AS (SELECT k, sample_id, n, 0 AS batch, 1 AS size, n AS longest FROM o WHERE k = 1
 UNION ALL SELECT o.k, o.sample_id, o.n, CASE WHEN b.size >= 8 OR greatest(b.longest, o.n) * (b.size + 1) > 600 THEN b.batch + 1 ELSE b.batch END,
 CASE WHEN b.size >= 8 OR greatest(b.longest, o.n) * (b.size + 1) > 600 THEN 1 ELSE b.size + 1 END,
 CASE WHEN b.size >= 8 OR greatest(b.longest, o.n) * (b.size + 1) > 600 THEN o.n ELSE greatest(b.longest, o.n) END FROM b JOIN o ON o.k = b.k + 1)
SELECT sample_id, n, CAST(batch AS BIGINT) AS batch FROM b""",
    "batching_features": "SELECT CAST(floor(r / 64) AS BIGINT) AS batch, count(*) AS n, min(vec_id) AS first FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings) GROUP BY 1",
    "batching_token_chunks": """WITH RECURSIVE l AS (SELECT user_id AS sample_id, count(*) AS n FROM events GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY sample_id) AS k FROM l),
b AS (SELECT k, sample_id, n, 0 AS batch, n AS held FROM o WHERE k = 1
 UNION ALL SELECT o.k, o.sample_id, o.n, CASE WHEN b.held + o.n > 1000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.held + o.n > 1000 THEN o.n ELSE b.held + o.n END FROM b JOIN o ON o.k = b.k + 1)
SELECT sample_id, n, CAST(batch AS BIGINT) AS batch FROM b""",
}
