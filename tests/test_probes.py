import numpy as np
import pytest

from sondar.probes import Logistic, MassMean, NeuralProbe, scattered, sweep
from sondar.probes import tape as t
from sondar.probes import training
from sondar.probes.linear import LinearModel
from sondar.probes.models import MODELS, Dropout

SMALL = {
    "MLP": {"hidden": 8}, "Bilinear": {"rank": 4}, "EEMLP": {"hidden": 8, "n_layers": 2}, "TPC": {"rank": 4},
    "Attention": {"hidden": 6, "n_epochs": 30}, "MultiMax": {"hidden": 6, "n_heads": 3}, "GatedBipolar": {"hidden": 6, "gate_dim": 4},
    "SoftAttention": {"hidden": 6, "n_heads": 3}, "PositionalAttention": {"n_heads": 2}, "RollingAttention": {"hidden": 6, "n_heads": 3, "window": 3},
    "MHA": {"proj": 8, "n_heads": 2},
}


def data(name, n=40, seed=0):
    rng = np.random.default_rng(seed)
    y = (np.arange(n) % 2).astype(float)
    if not MODELS[name](**SMALL[name]).sequence:
        x = rng.normal(0, 0.5, (n, 5))
        x[:, 0] += np.where(y > 0, 1.5, -1.5) if name != "Bilinear" else np.where(y > 0, 3, 0)
        return x, y, None
    x = [rng.normal(0, 0.3, (rng.integers(2, 7), 5)) for _ in range(n)]
    for k in range(n):
        x[k][:, 0] += 2 if y[k] else -2
    return x, y, [np.ones(len(r), bool) for r in x]


@pytest.mark.parametrize("name", sorted(MODELS))
def test_gradients_match_differences(name):
    model = MODELS[name](**SMALL[name])
    x, y, masks = data(name, 6)
    xs, ms = (x, None) if masks is None else training.pad(x, 5)
    params = model.start(np.random.default_rng(1), np.concatenate(x) if masks is not None else x)
    params = {k: v + (0.1 * np.random.default_rng(2).normal(size=v.shape) if not k.startswith("_") else 0) for k, v in params.items()}
    p = {k: t.Node(v) for k, v in params.items()}
    model.loss(p, xs, ms, y, Dropout(0, None)).backward()

    def loss(q):
        return float(model.loss({k: t.node(v) for k, v in q.items()}, xs, ms, y, Dropout(0, None)).value)

    for k, v in params.items():
        if k.startswith("_") or p[k].grad is None:
            continue
        at = tuple(0 for _ in v.shape)
        up, down = ({**params, k: v.copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert p[k].grad[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=2e-4), (name, k)


@pytest.mark.parametrize("name", sorted(MODELS))
def test_separable_data_and_round_trip(name, tmp_path):
    x, y, masks = data(name)
    options = SMALL[name] | {"n_epochs": 40, "learning_rate": 0.02}
    probe = NeuralProbe(name, options, seed=3).fit_arrays(x, y, masks)
    z = probe.logits(x, masks)
    assert np.mean((z > 0) == (y > 0)) > (0.7 if name == "Bilinear" else 0.85)
    again = NeuralProbe(name, options, seed=3).fit_arrays(x, y, masks)
    assert np.array_equal(again.logits(x, masks), z)
    probe.save(str(tmp_path / "p.npz"))
    assert np.array_equal(NeuralProbe.load(str(tmp_path / "p.npz")).logits(x, masks), z)
    if masks is not None:
        assert np.isfinite(probe.logits(x, [np.zeros(len(r), bool) for r in x])).all()


def test_errors():
    with pytest.raises(ValueError):
        NeuralProbe("Nope")
    with pytest.raises(RuntimeError):
        NeuralProbe("MLP").logits(np.zeros((1, 2)))
    with pytest.raises(ValueError):
        NeuralProbe("MLP").fit_arrays(np.zeros((0, 2)), [])
    with pytest.raises(ValueError):
        NeuralProbe("MLP").fit_arrays(np.zeros((2, 2)), [1, 1])


def frame(spark, n=60):
    x, y, _ = data("MLP", n)
    return spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], "sample_id bigint, label int, vec array<double>"), x, y


def test_linear_probes(spark, tmp_path):
    df, x, y = frame(spark)
    m = MassMean().fit(df)
    d = x[y > 0].mean(0) - x[y == 0].mean(0)
    assert np.allclose(m.weights, d)
    model = Logistic().fit(df)
    z = (x - x.mean(0)) / x.std(0)
    w = np.array(model.weights) * x.std(0)
    s = 1 / (1 + np.exp(-(z @ w + model.bias + x.mean(0) @ np.array(model.weights))))
    assert np.allclose(z.T @ (s - y) / len(y) + w / len(y), 0, atol=1e-5)  # stationary point of the penalised loss
    model.save(str(tmp_path / "m.json"))
    assert LinearModel.load(str(tmp_path / "m.json")) == model
    assert m.transform(df).where("(score > 0.5) = (label = 1)").count() > 55
    with pytest.raises(ValueError):
        MassMean().fit(df.where("label = 1"))


def test_scoring_and_sweep_on_spark(spark):
    df, x, y = frame(spark)
    probes = sweep(df, "MLP", [{"hidden": 4, "n_epochs": 5}, {"hidden": 6, "n_epochs": 5}])
    assert [p.params["w1"].shape for p in probes] == [(5, 4), (5, 6)]
    got = {r.sample_id: r.logit for r in probes[0].transform(df).collect()}
    assert np.allclose([got[i] for i in range(len(x))], probes[0].logits(x))


def test_token_scores_are_zero_where_undetected(spark):
    rows = [(s, p, p != 1, s % 2, [float(p + s), 1.0]) for s in range(8) for p in range(3)]
    tokens = spark.createDataFrame(rows, "sample_id bigint, pos int, det boolean, label int, vec array<double>")
    probe = NeuralProbe("MLP", {"hidden": 3, "n_epochs": 2}).fit(tokens)
    got = scattered(probe.transform(tokens), tokens).collect()
    assert len(got) == 24 and all((r.score == 0) == (r.pos == 1) for r in got)


def _blobs(n=80, d=3, seed=1):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    return rng.normal(0, 1, (n, d)) + y[:, None] * 2.0, y.astype(float)


@pytest.mark.parametrize("optimizer", [training.AdamW, training.Momentum, lambda rate, decay: training.AdamW(rate * 5, 0.0)])
def test_optimizers(optimizer):
    x, y = _blobs()
    model = MODELS["MLP"](hidden=8, n_epochs=60, learning_rate=0.01)
    params = training.train(model, x, y, optimizer=optimizer, schedule=training.cosine(60))
    assert ((training.logits(model, params, x) > 0) == (y > 0)).mean() > 0.9


def test_plateau_and_casts():
    p = training.Plateau(0.5, patience=1)
    for loss, want in ((1.0, 1.0), (1.1, 1.0), (1.2, 0.5), (0.9, 0.5), (0.95, 0.5), (0.95, 0.25)):
        p.seen(loss)
        assert p(0) == want
    assert training.rounded([1.0009765625 + 2**-12], "float16")[0] == 1.0009765625 and training.rounded([1 + 2**-9], "bfloat16")[0] == 1.0
    assert training.rounded([1 / 3], None)[0] == 1 / 3 and training.rounded([1 / 3], "float32")[0] == np.float32(1 / 3)
    with pytest.raises(ValueError):
        training.rounded([1.0], "int3")
    x, y = _blobs()
    seqs, masks = [np.stack([r, r]) for r in x], [np.ones(2, bool)] * len(x)
    model = MODELS["SoftAttention"](hidden=4, n_heads=2, n_epochs=5)
    training.train(model, seqs, y, masks, schedule=training.Plateau(), shuffle=False, sort_by_length=False, cast="bfloat16")


def test_order_of_batches():
    lengths = np.array([3, 9, 1, 5])
    assert [b.tolist() for b in training.batches(lengths, 2, None, None)] == [[1, 3], [0, 2]]
    assert [b.tolist() for b in training.batches(np.zeros(4, int), 2, None, None, lengths)] == [[0, 1], [2, 3]]


def test_training_sets_are_bounded_by_bytes(spark, monkeypatch):
    from sondar.probes import neural

    data = [(i, p, True, i % 2, [float(i), float(p)]) for i in range(40) for p in range(5)]
    df = spark.createDataFrame(data, "sample_id bigint, pos int, det boolean, label int, vec array<double>")
    monkeypatch.setattr(neural, "MAX_BYTES", 2 * 8 * 5 * 7)
    x, y, masks = neural.collected(df, MODELS["SoftAttention"]())
    assert len(x) == 7 and all(len(s) == 5 for s in x)
    x, y, _ = neural.collected(df, MODELS["MLP"]())
    assert len(x) == 35


def test_tokens_have_labels_of_their_own(spark):
    data = [(i, p, p != 1, int(p == 2), [float(p == 2), 1.0]) for i in range(20) for p in range(3)]
    df = spark.createDataFrame(data, "sample_id bigint, pos int, det boolean, label int, vec array<double>")
    x, y, _ = __import__("sondar.probes.neural", fromlist=["x"]).collected(df, MODELS["MLP"]())
    assert len(x) == 40 and sorted(set(zip(x[:, 0], y))) == [(0.0, 0.0), (1.0, 1.0)]


def test_sweep_over_layers(spark):
    from sondar.probes import sweep_layers

    df, x, y = frame(spark)
    from pyspark.sql import functions as F

    layered = df.select("*", F.explode(F.array(F.lit(3), F.lit(7))).alias("layer")).withColumn("vec", F.transform("vec", lambda v: v * F.when(F.col("layer") == 3, 1.0).otherwise(0.0)))
    probes = sweep_layers(layered, "MLP", [{"hidden": 4, "n_epochs": 60, "learning_rate": 0.05}, {"hidden": 6, "n_epochs": 2}])
    assert sorted(probes) == [(3, 0), (3, 1), (7, 0), (7, 1)] and probes[7, 1].params["w1"].shape == (5, 6)
    right = lambda p, a: ((p.logits(a) > 0) == (y > 0)).mean()
    assert right(probes[3, 0], x) > 0.8 and probes[7, 0].logits(x * 0).std() < 1e-9
