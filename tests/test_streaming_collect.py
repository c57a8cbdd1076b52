import datetime as dt
import uuid

import numpy as np
import pytest

from sondar.plans import catalogue
from sondar.probes.linear import LinearModel
from sondar.sources import collect
from sondar.streaming import monitor

T0 = dt.datetime(2024, 1, 1, 12, 0)


def run(stream, tmp_path, mode="append"):
    base = tmp_path / uuid.uuid4().hex
    out = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


@pytest.fixture()
def stream(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=m), key, score) for m, key, score in [(0, "a", 0.9), (1, "a", 0.9), (2, "a", 0.9), (3, "b", 0.2), (4, "a", 0.0), (30, "b", 0.1), (90, "b", 0.3)]]
    spark.createDataFrame(rows, "ts timestamp, key string, score double").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("ts timestamp, key string, score double").parquet(str(tmp_path / "in"))


def test_windows_close_behind_the_watermark(stream, tmp_path):
    got = run(monitor.windowed_scores(stream, "0 seconds", "10 minutes"), tmp_path)
    assert sorted((r.key, r.n, r.high) for r in got.collect()) == [("a", 4, 0.9), ("b", 1, 0.1), ("b", 1, 0.2)]


def test_sessions(stream, tmp_path):
    got = run(monitor.sessions(stream, "0 seconds", "10 minutes"), tmp_path)
    assert sorted((r.key, r.n) for r in got.collect()) == [("a", 4), ("b", 1), ("b", 1)]


def test_an_alert_is_raised_once_per_rise(stream, tmp_path):
    got = run(monitor.alerts(stream, alpha=0.5, threshold=0.6), tmp_path).collect()
    assert [(r.key, r.ts.minute, round(r.level, 4)) for r in got] == [("a", 1, 0.675)]


def test_scoring_is_native(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "vec array<double>")
    r = monitor.scored(df, LinearModel([0.5, -0.25], 0.0)).first()
    assert r.logit == 0 and r.score == 0.5


def model(batch):
    return [np.stack([np.stack([np.full(3, k * t, np.float32) for t in ids]) for k in (1, 2)]) for ids in batch]


def test_collect(spark):
    rows = [(s, p, 10 * s + p, p > 0) for s in (1, 2) for p in range(s + 1)]
    tokens = spark.createDataFrame(rows, "sample_id bigint, pos int, token_id bigint, det boolean")
    samples = spark.createDataFrame([(1,), (2,), (3,)], "sample_id bigint")
    acts = collect.collect(tokens, samples, model, (5, 6), batch_size=1)
    got = {(r.sample_id, r.pos, r.layer): r.vec[0] for r in acts.data.collect()}
    assert got[2, 1, 6] == 42 and got[1, 0, 5] == 10 and len(got) == 10
    pooled = collect.collect(tokens, samples, model, (5, 6), pooling="mean")
    means = {(r.sample_id, r.layer): r.vec[0] for r in pooled.data.collect()}
    assert means == {(1, 5): 11, (1, 6): 22, (2, 5): 21.5, (2, 6): 43, (3, 5): 0, (3, 6): 0}
    with pytest.raises(ValueError):
        collect.collect(tokens, samples, model, (5,), pooling="median")
    parts = [[r.sample_id for r in ids.collect()] for _, ids in collect.stream(acts, 2)]
    assert parts == [[1], [2]]


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 100


def test_collect_to_a_store_goes_on_where_it_ended(spark, tmp_path):
    from sondar.sources import storage

    rows = [(s, p, 10 * s + p, p > 0) for s in (1, 2, 3) for p in range(s + 1)]
    tokens = spark.createDataFrame(rows, "sample_id bigint, pos int, token_id bigint, det boolean")
    samples = spark.createDataFrame([(1,), (2,), (3,)], "sample_id bigint")
    path, first = str(tmp_path / "acts"), lambda df: df.where("sample_id < 3")
    collect.collect_to(path, first(tokens), first(samples), model, (5, 6))

    def refuses(batch):
        assert all(t >= 30 for ids in batch for t in ids), "a sample ran twice"
        return model(batch)

    both = collect.collect_to(path, tokens, samples, refuses, (5, 6))
    whole = collect.collect(tokens, samples, model, (5, 6))
    key = lambda a: sorted((r.sample_id, r.pos, r.layer, r.vec[0]) for r in a.data.collect())
    assert key(both) == key(whole) and sorted(r.sample_id for r in both.spine.collect()) == [1, 2, 3]
    assert len(storage.manifest(path)["parts"]) == 2
    with pytest.raises(ValueError):
        storage.save(whole.select_layer(5), path, append=True)
    again = collect.collect_to(path, tokens, samples, model, (5, 6), resume=False)
    assert key(again) == key(whole) and len(storage.manifest(path)["parts"]) == 1
