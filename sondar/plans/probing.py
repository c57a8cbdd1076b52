"""Queries of probes over the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondar.operators import metrics as M
from sondar.probes import Logistic, MassMean, NeuralProbe, standardisation
from sondar.probes.linear import dot
from sondar.session import table


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"), F.col("embedding").alias("vec"))


def _auroc(scored: DataFrame, score: str = "logit") -> DataFrame:
    s = scored.select(F.col("label").alias("y"), F.round(score, 9).alias("p"))
    return M.evaluate(s, auroc=M.auroc()).select(F.round("auroc", 6).alias("auroc"))


def _massmean_auroc(spark, sf):  # noqa: ANN001, ANN202
    v = vectors(spark, sf)
    return _auroc(MassMean().fit(v).transform(v))


def _massmean_direction(spark, sf):  # noqa: ANN001, ANN202
    m = MassMean().fit(vectors(spark, sf))
    return spark.createDataFrame([(i, round(w, 6)) for i, w in enumerate(m.weights)], "dim int, w double")


def _massmean_scores(spark, sf):  # noqa: ANN001, ANN202
    v = vectors(spark, sf)
    return MassMean().fit(v).transform(v).select("sample_id", F.round("logit", 6).alias("logit"), F.round("score", 6).alias("score"))


def _standardise(spark, sf):  # noqa: ANN001, ANN202
    mean, std = standardisation(vectors(spark, sf))
    return spark.createDataFrame([(i, round(a, 6), round(b, 6)) for i, (a, b) in enumerate(zip(mean, std))], "dim int, mean double, std double")


def _bilinear(spark, sf):  # noqa: ANN001, ANN202
    """Fixed weights: two directions, squares weighted 0.5 and -0.25."""
    v = vectors(spark, sf)
    a, b = dot([0.1] * 64, F.col("vec")), dot([0.01 * i for i in range(64)], F.col("vec"))
    return v.select("sample_id", F.round(0.5 * a * a - 0.25 * b * b + 0.1, 6).alias("logit"))


def _logistic(spark, sf):  # noqa: ANN001, ANN202
    v = vectors(spark, sf)
    return _auroc(Logistic().fit(v).transform(v))


def _neural(name: str, **options):  # noqa: ANN003, ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        probe = NeuralProbe(name, options).fit(v)
        return _auroc(probe.transform(v).join(v.select("sample_id", "label"), "sample_id"))

    return run


# Small fixed weights, in Spark's query and in its SQL alike.
_W1 = [[0.4, -0.3], [0.1, 0.2], [-0.2, 0.5], [0.3, 0.1]]
_B1 = [0.1, -0.05]
_W2 = [[0.6, -0.2], [0.3, 0.7]]
_B2 = [0.02, 0.01]
_TWO = {"ns": [1.0, 0.9, 1.1, 1.0], "nb": [0.0, 0.1, 0.0, -0.1], "w1": _W1, "b1": _B1, "w2": _W2, "b2": _B2}
_FORWARD: dict[str, tuple[dict, dict]] = {
    "MultiMax": ({"hidden": 2, "n_heads": 2}, {**_TWO, "hw": [[1.0, -0.5], [0.4, 0.8]], "hb": [0.05, -0.1], "ow": [[0.7], [-0.3]], "ob": [0.15]}),
    "GatedBipolar": ({"hidden": 2, "gate_dim": 1}, {**_TWO, "pw": [[0.8], [-0.6]], "pb": [0.1], "gw": [[0.5], [0.3]], "gb": [-0.2], "ow": [[0.9], [0.4]], "ob": [0.05]}),
    "SoftAttention": ({"hidden": 2, "n_heads": 1}, {**_TWO, "q": [[0.9], [-0.4]], "v": [[0.5], [1.2]], "ow": [[1.5]], "ob": [0.1]}),
    "RollingAttention": ({"hidden": 2, "n_heads": 1, "window": 3}, {**_TWO, "q": [[0.9], [-0.4]], "v": [[0.5], [1.2]], "ow": [[1.5]], "ob": [0.1]}),
    "Attention": (
        {"hidden": 2},
        {
            "ns": _TWO["ns"], "nb": _TWO["nb"], "w1": _W1, "b1": _B1, "w2": [[0.8], [-0.5]], "b2": [0.1], "cs": [1.0, 1.0, 0.8, 1.2], "cb": [0.0, 0.05, 0.0, 0.0],
            "c0": [[0.5, 0.1, 0.0, -0.2], [0.0, 0.6, 0.2, 0.1], [0.3, 0.0, 0.4, 0.0], [-0.1, 0.2, 0.0, 0.7]], "d0": [0.1, 0.0, -0.1, 0.05],
            "c1": [[0.4, 0.2], [-0.3, 0.5], [0.6, 0.1], [0.2, -0.4]], "d1": [0.05, 0.1], "c2": [[1.1], [-0.7]], "d2": [0.2],
        },
    ),
    "MHA": (
        {"proj": 2, "n_heads": 1, "n_layers": 1},
        {
            "dw": _W1, "db": _B1, "cls": [[[0.3, -0.2]]], "ow": [[0.8], [-0.6]], "ob": [0.1],
            "q0": [[0.5, 0.1], [0.2, 0.4]], "qb0": [0.1, 0.0], "k0": [[0.3, -0.1], [0.6, 0.2]], "kb0": [0.0, 0.05],
            "v0": [[0.7, 0.2], [-0.3, 0.9]], "vb0": [0.02, 0.03], "o0": [[0.6, 0.1], [0.1, 0.5]], "ob0": [0.0, 0.1],
            "s10": [1.0, 0.9], "t10": [0.1, 0.2], "s20": [1.1, 1.0], "t20": [0.3, -0.1],
            "f10": [[0.1 * (i + 1) for i in range(8)], [0.05 * (4 - i) for i in range(8)]], "g10": [0.01 * i for i in range(8)],
            "f20": [[0.1, -0.1 * i] for i in range(8)], "g20": [0.05, -0.05],
        },
    ),
}
_EXITS = ({"n_layers": 2, "hidden": 2}, {
    "w0": [[0.01 * i, 0.1 - 0.002 * i] for i in range(64)], "b0": [0.1, -0.1], "w1": [[1.0, 0.5], [-0.5, 1.0]], "b1": [0.05, 0.0],
    **{f"hw{k}": [[0.1]] * n for k, n in ((0, 64), (1, 2))}, "hw2": [[1.0], [-2.0]], "hb0": [0.0], "hb1": [0.0], "hb2": [0.3], "_mean": [0.1] * 64, "_std": [2.0] * 64,
})


def _in_tokens(v: DataFrame) -> DataFrame:
    """Each embedding as 16 tokens of 4 dimensions, of which every third isn't detected."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("vec", i * 4 + 1, 4))
    return v.select("sample_id", F.posexplode(parts).alias("pos", "vec")).withColumn("det", F.col("pos") % 3 != 2)


def _forward(name: str, options: dict, weights: dict):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        probe = NeuralProbe(name, options, 0, {k: np.array(w, float) for k, w in weights.items()})
        v = vectors(spark, sf_dir)
        return probe.transform(_in_tokens(v) if probe.model.sequence else v.select("sample_id", "vec")).select("sample_id", F.round("logit", 6).alias("logit"))

    return run


def _positional(spark, sf):  # noqa: ANN001, ANN202
    """Fixed weights: one head over each embedding read as 16 tokens of 4 dimensions."""
    v = vectors(spark, sf)
    probe = NeuralProbe("PositionalAttention", {"n_heads": 1}, 0, {"q": np.full((4, 1), 0.5), "v": np.arange(1.0, 5.0)[:, None], "pos": np.array([0.1]), "b": np.array([0.2])})
    return probe.transform(_in_tokens(v)).select("sample_id", F.round("logit", 6).alias("logit"))


QUERIES = {
    "massmean_auroc": _massmean_auroc,
    "massmean_direction": _massmean_direction,
    "massmean_scores": _massmean_scores,
    "probe_standardise": _standardise,
    "probe_bilinear_forward": _bilinear,
    "probe_positional_attention_forward": _positional,
    "probe_logistic_auroc": _logistic,
    "probe_early_exit_forward": _forward("EEMLP", *_EXITS),
    **{f"probe_{n.lower()}_forward": _forward(n, *w) for n, w in _FORWARD.items()},
    "probe_mlp_full_auroc": _neural("MLP"),
    "probe_tpc_full_auroc": _neural("TPC"),
    "probe_mlp_auroc": _neural("MLP", n_epochs=10),
    "probe_tpc_auroc": _neural("TPC", n_epochs=5, rank=8),
}

_VECTORS = """WITH v AS (SELECT vec_id AS sample_id, CAST(label >= 5 AS INT) AS label, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT dim, avg(x) FILTER (WHERE label = 1) AS p, avg(x) FILTER (WHERE label = 0) AS n, avg(x) AS c FROM v GROUP BY dim),
d AS (SELECT dim, p - n AS w, c, p - c AS pc, n - c AS nc FROM m),
b AS (SELECT -(sum(pc * w) + sum(nc * w)) / 2 - sum(c * w) AS bias FROM d),
s AS (SELECT sample_id, label, sum(x * w) + (SELECT bias FROM b) AS logit FROM v JOIN d USING (dim) GROUP BY sample_id, label)
"""



def _linear(inputs: list[str], w: list, b: list) -> list[str]:
    return ["(" + " + ".join([f"{row[j]!r}::DOUBLE * ({c})" for c, row in zip(inputs, w)] + [f"{b[j]!r}::DOUBLE"]) + ")" for j in range(len(b))]


def _layer_norm(inputs: list[str], scale: list, shift: list) -> list[str]:
    n = float(len(inputs))
    mean = f"(({' + '.join(inputs)}) / {n}::DOUBLE)"
    spread = f"(({' + '.join(f'({c} - {mean}) * ({c} - {mean})' for c in inputs)}) / {n}::DOUBLE)"
    return [f"(({c} - {mean}) / sqrt({spread} + 1e-5::DOUBLE) * {a!r}::DOUBLE + {b!r}::DOUBLE)" for c, a, b in zip(inputs, scale, shift)]


def _relu(inputs: list[str]) -> list[str]:
    return [f"greatest(0.0::DOUBLE, {c})" for c in inputs]


def _named(names: list[str], values: list[str], keep: str = "sample_id") -> str:
    return f"SELECT {keep}, " + ", ".join(f"{v} AS {n}" for n, v in zip(names, values))


_X, _Z, _H, _Y = (["x0", "x1", "x2", "x3"], ["z0", "z1", "z2", "z3"], ["h0", "h1"], ["y0", "y1"])
_TOKENS = _VECTORS + f""", tk AS (SELECT sample_id, dim // 4 AS pos, {', '.join(f'max(x) FILTER (WHERE dim % 4 = {i}) AS x{i}' for i in range(4))} FROM v GROUP BY ALL)"""
_STEM = (
    _TOKENS
    + f""", nz AS ({_named(_Z, _layer_norm(_X, _TWO['ns'], _TWO['nb']), 'sample_id, pos, x0, x1, x2, x3')} FROM tk),
hh AS ({_named(_H, _relu(_linear(_Z, _W1, _B1)), 'sample_id, pos, x0, x1, x2, x3')} FROM nz),
yy AS ({_named(_Y, _linear(_H, _W2, _B2), 'sample_id, pos')} FROM hh)"""
)


def _attended(weights: dict) -> str:
    q, v = _linear(_Y, weights["q"], [0.0])[0], _linear(_Y, weights["v"], [0.0])[0]
    return _STEM + f", qv AS (SELECT sample_id, pos, {q} AS q, {v} AS v FROM yy WHERE pos % 3 <> 2)"


def _max_heads(w: dict) -> str:
    heads = _linear(_Y, w["hw"], w["hb"])
    return _STEM + f", s2 AS ({_named(['m0', 'm1'], [f'max({h})' for h in heads])} FROM yy WHERE pos % 3 <> 2 GROUP BY sample_id) SELECT sample_id, round({_linear(['m0', 'm1'], w['ow'], w['ob'])[0]}, 6) AS logit FROM s2"


def _gated(w: dict) -> str:
    value, gate = _linear(_Y, w["pw"], w["pb"])[0], _linear(_Y, w["gw"], w["gb"])[0]
    return _STEM + f", g AS (SELECT sample_id, {value} * ln(1.0::DOUBLE + exp({gate})) AS v FROM yy WHERE pos % 3 <> 2), m2 AS (SELECT sample_id, max(v) AS m0, max(-v) AS m1 FROM g GROUP BY sample_id) SELECT sample_id, round({_linear(['m0', 'm1'], w['ow'], w['ob'])[0]}, 6) AS logit FROM m2"


def _pooled_tokens(w: dict) -> str:
    score = _linear(_H, w["w2"], w["b2"])[0]
    sums = [f"sum(exp(q - mq) * x{i}) / sum(exp(q - mq))" for i in range(4)]
    return (
        _STEM
        + f""", sc AS (SELECT sample_id, x0, x1, x2, x3, {score} / 2.0::DOUBLE AS q FROM hh WHERE pos % 3 <> 2), mq AS (SELECT sample_id, max(q) AS mq FROM sc GROUP BY sample_id),
pl AS ({_named(['p0', 'p1', 'p2', 'p3'], sums)} FROM sc JOIN mq USING (sample_id) GROUP BY sample_id),
n2 AS ({_named(_Z, _layer_norm(['p0', 'p1', 'p2', 'p3'], w['cs'], w['cb']))} FROM pl),
l0 AS ({_named(['a0', 'a1', 'a2', 'a3'], _relu(_linear(_Z, w['c0'], w['d0'])))} FROM n2),
l1 AS ({_named(['e0', 'e1'], _relu(_linear(['a0', 'a1', 'a2', 'a3'], w['c1'], w['d1'])))} FROM l0)
SELECT sample_id, round({_linear(['e0', 'e1'], w['c2'], w['d2'])[0]}, 6) AS logit FROM l1"""
    )


def _class_token(w: dict) -> str:
    c = w["cls"][0][0]
    names = lambda n, k=2: [f"{n}{i}" for i in range(k)]
    wide = names("f", 8)
    return (
        _TOKENS
        + f""", xx AS ({_named(names('u'), _linear(_X, w['dw'], w['db']), 'sample_id, pos')} FROM tk WHERE pos % 3 <> 2
 UNION ALL SELECT DISTINCT sample_id, -1, {c[0]!r}::DOUBLE, {c[1]!r}::DOUBLE FROM tk),
nx AS ({_named(names('n'), _layer_norm(names('u'), w['s10'], w['t10']), 'sample_id, pos, u0, u1')} FROM xx),
kv AS ({_named([*names('k'), *names('v')], _linear(names('n'), w['k0'], w['kb0']) + _linear(names('n'), w['v0'], w['vb0']), 'sample_id')} FROM nx),
qq AS ({_named(names('q'), _linear(names('n'), w['q0'], w['qb0']), 'sample_id, u0, u1')} FROM nx WHERE pos = -1),
sc AS (SELECT sample_id, u0, u1, v0, v1, (q0 * k0 + q1 * k1) / sqrt(2.0::DOUBLE) AS q FROM qq JOIN kv USING (sample_id)),
mq AS (SELECT sample_id, max(q) AS mq FROM sc GROUP BY sample_id),
att AS (SELECT sample_id, max(u0) AS u0, max(u1) AS u1, sum(exp(q - mq) * v0) / sum(exp(q - mq)) AS w0, sum(exp(q - mq) * v1) / sum(exp(q - mq)) AS w1 FROM sc JOIN mq USING (sample_id) GROUP BY sample_id),
r1 AS ({_named(names('r'), [f'u{i} + {e}' for i, e in enumerate(_linear(names('w'), w['o0'], w['ob0']))])} FROM att),
n3 AS ({_named(names('n'), _layer_norm(names('r'), w['s20'], w['t20']), 'sample_id, r0, r1')} FROM r1),
ff AS ({_named(wide, _relu(_linear(names('n'), w['f10'], w['g10'])), 'sample_id, r0, r1')} FROM n3),
r2 AS ({_named(names('t'), [f'r{i} + {e}' for i, e in enumerate(_linear(wide, w['f20'], w['g20']))])} FROM ff)
SELECT sample_id, round({_linear(names('t'), w['ow'], w['ob'])[0]}, 6) AS logit FROM r2"""
    )


_HEAD = "round(1.5::DOUBLE * {} + 0.1::DOUBLE, 6) AS logit"
_MEANS = "sum(exp(q - mq) * v) / sum(exp(q - mq))"
_ROLLED = (
    _attended(_FORWARD["RollingAttention"][1])
    + f""", w AS (SELECT sample_id, s, q, v FROM qv JOIN (SELECT unnest(range(14)) AS s) r ON pos BETWEEN s AND s + 2), mx AS (SELECT sample_id, s, max(q) AS mq FROM w GROUP BY ALL),
a AS (SELECT sample_id, s, {_MEANS} AS m FROM w JOIN mx USING (sample_id, s) GROUP BY ALL) SELECT sample_id, {_HEAD.format("max(m)")} FROM a GROUP BY sample_id"""
)
_EXITED = (
    _VECTORS
    + """, z AS (SELECT sample_id, sum(0.01::DOUBLE * dim * (x - 0.1::DOUBLE) / 2.0::DOUBLE) + 0.1::DOUBLE AS a, sum((0.1::DOUBLE - 0.002::DOUBLE * dim) * (x - 0.1::DOUBLE) / 2.0::DOUBLE) - 0.1::DOUBLE AS b FROM v GROUP BY sample_id),
r AS (SELECT sample_id, greatest(0.0::DOUBLE, a) AS a, greatest(0.0::DOUBLE, b) AS b FROM z),
k AS (SELECT sample_id, greatest(0.0::DOUBLE, a - 0.5::DOUBLE * b + 0.05::DOUBLE) AS a, greatest(0.0::DOUBLE, 0.5::DOUBLE * a + b) AS b FROM r)
SELECT sample_id, round(a - 2.0::DOUBLE * b + 0.3::DOUBLE, 6) AS logit FROM k"""
)

ORACLES = {
    "probe_early_exit_forward": _EXITED,
    "probe_multimax_forward": _max_heads(_FORWARD["MultiMax"][1]),
    "probe_gatedbipolar_forward": _gated(_FORWARD["GatedBipolar"][1]),
    "probe_softattention_forward": _attended(_FORWARD["SoftAttention"][1])
    + f", mx AS (SELECT sample_id, max(q) AS mq FROM qv GROUP BY sample_id) SELECT sample_id, {_HEAD.format(_MEANS)} FROM qv JOIN mx USING (sample_id) GROUP BY sample_id",
    "probe_rollingattention_forward": _ROLLED,
    "probe_attention_forward": _pooled_tokens(_FORWARD["Attention"][1]),
    "probe_mha_forward": _class_token(_FORWARD["MHA"][1]),
    "massmean_auroc": _VECTORS
    + """, r AS (SELECT label AS y, round(logit, 9) AS p FROM s)
SELECT round(avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auroc FROM r a, r b WHERE a.y = 1 AND b.y = 0""",
    "massmean_direction": _VECTORS + "SELECT CAST(dim AS INT) AS dim, round(w, 6) AS w FROM d",
    "massmean_scores": _VECTORS + "SELECT sample_id, round(logit, 6) AS logit, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)), 6) AS score FROM s",
    "probe_standardise": _VECTORS + "SELECT CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-8), 6) AS std FROM v GROUP BY dim",
    "probe_bilinear_forward": _VECTORS
    + """, z AS (SELECT sample_id, sum(0.1::DOUBLE * x) AS a, sum(0.01::DOUBLE * dim * x) AS b FROM v GROUP BY sample_id)
SELECT sample_id, round(0.5::DOUBLE * a * a - 0.25::DOUBLE * b * b + 0.1::DOUBLE, 6) AS logit FROM z""",
    "probe_positional_attention_forward": _VECTORS
    + """, tk AS (SELECT sample_id, dim // 4 AS pos, sum(0.5::DOUBLE * x) AS q, sum((dim % 4 + 1) * x) AS v FROM v GROUP BY ALL),
k AS (SELECT sample_id, q + 0.1::DOUBLE * pos AS q, v FROM tk WHERE pos % 3 <> 2), mx AS (SELECT sample_id, max(q) AS mq FROM k GROUP BY sample_id)
SELECT sample_id, round(sum(exp(q - mq) * v) / sum(exp(q - mq)) + 0.2::DOUBLE, 6) AS logit FROM k JOIN mx USING (sample_id) GROUP BY sample_id""",
}
