import pytest
from pyspark.sql import functions as F

from sondar.operators import activations as A
from sondar.operators import batching, pool


def bsh(spark, samples):
    """samples: list of lists of (vec, det)."""
    data = [(i, k, bool(d), [float(x) for x in v]) for i, s in enumerate(samples) for k, (v, d) in enumerate(s)]
    tokens = spark.createDataFrame(data, "sample_id bigint, pos int, det boolean, vec array<double>")
    return tokens, spark.createDataFrame([(i,) for i in range(len(samples))], "sample_id bigint")


def vecs(df):
    return [list(r.vec) for r in df.orderBy("sample_id").collect()]


SEGMENTS = [[((1, 2), 1), ((3, 4), 0), ((5, 6), 1)], [((7, 8), 0), ((9, 10), 0)], [((11, 12), 1)]]


def test_segment_goldens(spark):
    t, s = bsh(spark, SEGMENTS)
    assert vecs(pool.mean(t, s)) == [[3, 4], [0, 0], [11, 12]]
    assert vecs(pool.last_token(t, s)) == [[5, 6], [0, 0], [11, 12]]
    t, s = bsh(spark, [[((1, 2), 1), ((3, 9), 0), ((5, 6), 1)], *SEGMENTS[1:]])
    assert vecs(pool.maximum(t, s)) == [[5, 6], [0, 0], [11, 12]]


def test_ema_and_rolling_goldens(spark):
    one = lambda xs, det=None: [((x,), 1 if det is None else det[k]) for k, x in enumerate(xs)]
    t, s = bsh(spark, [one([1, 2, 3])])
    assert vecs(pool.ema(t, s, 0.5)) == [[2.125]]
    masked = [one([1, 2, 100, 100], [1, 1, 0, 0]), one([5, 6, 7, 100], [1, 1, 1, 0])]
    t, s = bsh(spark, masked)
    assert vecs(pool.ema(t, s, 0.5)) == [[1.25], [5.625]]
    assert vecs(pool.rolling(t, s, 2)) == [[2.0], [7.0]]
    t, s = bsh(spark, [one([1, 2, 3, 4])])
    assert vecs(pool.rolling(t, s, 2)) == [[3.5]]
    assert vecs(pool.rolling(t, s, 10)) == [[2.5]]
    assert vecs(pool.rolling(t, s, 1)) == vecs(pool.ema(t, s, 1.0)) == vecs(pool.maximum(t, s))
    t, s = bsh(spark, [one([1, 2]), one([0, 0, 0, 0], [0, 0, 0, 0])])
    assert vecs(pool.rolling(t, s, 2, "none")) == [[1.5], [0]]
    assert vecs(pool.rolling(t, s, 2, "batch_max")) == [[2.0], [0]]


def test_nan_wins_the_maximum(spark):
    t, s = bsh(spark, [[((float("nan"),), 1), ((2,), 1)], [((float("-inf"),), 1)]])
    a, b = vecs(pool.maximum(t, s))
    assert a[0] != a[0] and b == [0]


def test_bad_options(spark):
    t, s = bsh(spark, SEGMENTS)
    for call in (lambda: pool.ema(t, s, 0), lambda: pool.rolling(t, s, 0), lambda: pool.pool("sum", t, s)):
        with pytest.raises(ValueError):
            call()


def layered(spark):
    t, s = bsh(spark, SEGMENTS)
    each = t.withColumn("layer", F.explode(F.array(F.lit(4), F.lit(2))))
    data = each.withColumn("vec", F.transform("vec", lambda x: x * F.col("layer")))
    return A.Activations(data, "blsh", s, (4, 2))


def test_layers_and_positions(spark):
    a = layered(spark)
    assert vecs(a.select_layer(2).mean("s").data) == [[6, 8], [0, 0], [22, 24]]
    assert vecs(a.mean("s").flatten().data) == [[12, 16, 6, 8], [0, 0, 0, 0], [44, 48, 22, 24]]
    assert vecs(a.mean("l").last().data) == [[15, 18], [0, 0], [33, 36]]
    assert vecs(a.select_layer(2).select_position(1).data) == [[6, 8], [18, 20], [0, 0]]
    assert vecs(a.select_layer(2).select_position(-1).data) == [[10, 12], [0, 0], [22, 24]]
    assert [r.n for r in a.detected()[1].orderBy("sample_id").collect()] == [2, 0, 1]
    with pytest.raises(ValueError):
        a.select_layer(9)
    with pytest.raises(ValueError):
        a.select_layer(2).mean("l")
    with pytest.raises(ValueError):
        A.Activations(a.data, "bsx", a.spine)


def test_padding_and_concatenation(spark):
    a = layered(spark).select_layer(2)
    p = {r.sample_id: (len(r.vecs), sum(r.mask)) for r in a.padded().collect()}
    assert p == {0: (3, 2), 1: (3, 0), 2: (3, 1)}
    assert [r.n for r in A.cat([a, a]).lengths().orderBy("sample_id").collect()] == [3, 2, 1] * 2
    with pytest.raises(ValueError):
        A.cat([])


def test_checks(spark):
    a = layered(spark).select_layer(2)
    assert A.checked(a, require_seq=True) is a
    with pytest.raises(ValueError, match="sequence"):
        A.checked(a, forbid_seq=True)
    bad = A.Activations(a.data.withColumn("vec", F.array(F.lit(float("nan")), F.lit(float("inf")))), "bsh", a.spine)
    with pytest.raises(ValueError, match="6 NaN and 6 infinite"):
        A.checked(bad)


def test_batches(spark):
    df = spark.createDataFrame([(0, 5), (1, 3), (2, 2)], "sample_id bigint, n bigint")
    plan = {r.sample_id: r.batch for r in batching.sequence_batches(df, 3, 6).collect()}
    assert plan[0] == 0 and plan[1] == plan[2] == 1
    df = spark.createDataFrame([(0, 10), (1, 2), (2, 2)], "sample_id bigint, n bigint")
    plan = {r.sample_id: r.batch for r in batching.sequence_batches(df, 3, 6).collect()}
    assert plan[0] == 0 and plan[1] == plan[2] == 1
    chunks = {r.sample_id: r.batch for r in batching.token_chunks(df, 5).collect()}
    assert chunks == {0: 0, 1: 1, 2: 1}


def test_padding_by_planned_batch_keeps_every_row(spark):
    from sondar.operators import tokens as T

    a = layered(spark)
    lengths = a.data.where("layer = 10").groupBy("sample_id").agg(F.count("*").alias("n")) if "layer" in a.data.columns else a.data.groupBy("sample_id").agg(F.count("*").alias("n"))
    n = {r.sample_id: r.n for r in lengths.collect()}
    order = sorted(n, key=lambda i: (-n[i], i))
    want = {i: n[order[k - k % 2]] for k, i in enumerate(order)}
    assert {r.sample_id: len(r.vecs) for r in a.padded(batches=batching.sequence_batches(lengths, 2)).collect()} == want
    s = spark.createDataFrame([(k, "ab " * k) for k in range(60, 0, -1)] + [(0, "")], "sample_id bigint, text string")
    t = spark.createDataFrame([(k, p, 7) for k in range(61) for p in range(k)], "sample_id bigint, pos int, token_id bigint")
    lengths = s.selectExpr("sample_id", "sample_id AS n")
    p = {r.sample_id: (len(r.ids), sum(r.attention)) for r in T.padded(t, s, batches=batching.sequence_batches(lengths, 4)).collect()}
    assert p == {k: (60 - (60 - k) // 4 * 4, k) for k in range(61)}


def test_dense_and_flat_layouts(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "sample_id bigint, vec array<double>")
    assert A.from_tensor(v).lengths is not None and A.from_tensor(v).dims == "bh"
    with pytest.raises(ValueError):
        A.from_tensor(v, "bsh")
    flat = spark.createDataFrame([(i, [float(i)], i != 2) for i in range(5)], "i bigint, vec array<double>, seen boolean")
    offsets = spark.createDataFrame([(10, 0, 2), (11, 2, 2), (12, 2, 5)], "sample_id bigint, start bigint, stop bigint")
    got = A.from_flat(flat, offsets, "seen")
    assert sorted((r.sample_id, r.pos, r.det, r.vec[0]) for r in got.data.collect()) == [(10, 0, True, 0.0), (10, 1, True, 1.0), (12, 0, False, 2.0), (12, 1, True, 3.0), (12, 2, True, 4.0)]
    assert {r.sample_id: r.vec[0] for r in got.mean("s").data.collect()} == {10: 0.5, 11: 0.0, 12: 3.5}
    with pytest.raises(ValueError):
        A.from_flat(flat, offsets, dims="bh")


def test_cat_of_a_single_sample(spark):
    v = spark.createDataFrame([(0, [1.0])], "sample_id bigint, vec array<double>")
    a = A.from_tensor(v)
    assert sorted(r.sample_id for r in A.cat([a, a, a]).data.collect()) == [0, 1, 2]
    none = A.from_tensor(v.where("false"))
    assert sorted(r.sample_id for r in A.cat([none, a, none, a]).spine.collect()) == [0, 1]


def test_orders_of_batches(spark):
    ids = spark.range(20).selectExpr("id AS sample_id")
    plain = {r.sample_id: r.batch for r in batching.feature_batches(ids, 8).collect()}
    assert plain == {i: i // 8 for i in range(20)}
    shuffled = {r.sample_id: r.batch for r in batching.feature_batches(ids, 8, shuffle_seed=3).collect()}
    assert shuffled != plain and sorted(shuffled.values()) == sorted(plain.values())
    some = batching.feature_batches(ids, 3, indices=ids.where("sample_id % 2 = 0")).collect()
    assert sorted((r.sample_id, r.batch) for r in some) == [(2 * i, i // 3) for i in range(10)]
    lengths = spark.range(30).selectExpr("id AS sample_id", "(id * 7) % 11 + 1 AS n")
    whole = {(r.sample_id, r.batch) for r in batching.sequence_batches(lengths, 4, 30, chunk=None).collect()}
    assert whole == {(r.sample_id, r.batch) for r in batching.sequence_batches(lengths, 4, 30).collect()}
    turned = batching.sequence_batches(lengths, 4, 30, shuffle_seed=1).collect()
    turns = {r.batch: r.turn for r in turned}
    assert len(turned) == 30 and sorted(turns.values()) == list(range(len(turns))) and [turns[b] for b in sorted(turns)] != sorted(turns.values())
    chunks = lambda c: {(r.sample_id, r.batch) for r in batching.token_chunks(lengths, 25, c).collect()}
    assert chunks(None) == chunks(4096)
