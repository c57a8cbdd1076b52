"""Neural probes on Spark: bounded training sets in one task, sweeps in parallel tasks, scoring on Arrow batches.

A model trains on at most max_rows samples (tokens, for feature models) and MAX_BYTES of
vectors, chosen by hash of the id where there are more; scoring covers every row, whole
sequences grouped by sample. Labels of feature models are those of the rows, so that tokens
may have labels of their own; a sequence has the label of its first token.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondar.probes import training
from sondar.probes.models import MODELS, Model, Params
from sondar.session import drawn

MAX_ROWS = 100_000
#: Most bytes of vectors that are collected to train on, or broadcast for a sweep.
MAX_BYTES = 1_000_000_000


class NotFittedError(RuntimeError):
    """Use of a probe before fit."""


def _bounded(df: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    return drawn(df, id_col, max_rows)


def _width(df: DataFrame) -> int:
    row = df.select(F.size("vec").alias("d")).first()
    return row.d if row else 1


def _within_bytes(counts: DataFrame, most: int) -> DataFrame:
    """(sample_id) of counts (sample_id, n), as many as together have at most `most` tokens, in hash order; one at least."""
    held, total = [], 0
    for row in counts.collect():  # as many rows as max_rows allows
        if held and total + row.n > most:
            break
        held.append((row.sample_id,))
        total += row.n
    return F.broadcast(counts.sparkSession.createDataFrame(held, counts.select("sample_id").schema))


def collected(df: DataFrame, model: Model, max_rows: int = MAX_ROWS):  # noqa: ANN201
    """(x, y, masks) of a training set: rows (sample_id, label, vec), or tokens (sample_id, pos, det, label, vec) for sequences."""
    if not model.sequence:
        rows = df.where("det") if "det" in df.columns else df
        most = max(1, min(max_rows, MAX_BYTES // max(1, 8 * _width(rows))))
        return _arrays(_bounded(rows.select("sample_id", "label", "vec"), "sample_id", most).toPandas(), model)
    ids = _within_bytes(_bounded(df.groupBy("sample_id").agg(F.count("*").alias("n")), "sample_id", max_rows), MAX_BYTES // max(1, 8 * _width(df)))
    return _arrays(df.join(ids, "sample_id", "left_semi").select("sample_id", "pos", "det", "label", "vec").toPandas(), model)


def _arrays(pdf: pd.DataFrame, model: Model):  # noqa: ANN202
    """(x, y, masks) of collected rows, in order of their ids."""
    if not model.sequence:
        pdf = pdf[pdf.det] if "det" in pdf else pdf
        x = np.stack([np.asarray(v, float) for v in pdf.vec]) if len(pdf) else np.zeros((0, 1))
        return x, pdf.label.to_numpy(float), None
    x, y, masks = [], [], []
    for _, g in pdf.sort_values(["sample_id", "pos"]).groupby("sample_id", sort=True):
        x.append(np.stack([np.asarray(v, float) for v in g.vec]))
        masks.append(g.det.to_numpy(bool))
        y.append(float(g.label.iloc[0]))
    return x, np.array(y), masks


@dataclass
class NeuralProbe:
    """A model with its parameters once fitted."""

    name: str
    options: dict = field(default_factory=dict)
    seed: int = 0
    params: Params | None = None

    def __post_init__(self) -> None:
        if self.name not in MODELS:
            raise ValueError(f"unknown probe {self.name!r}; there are {sorted(MODELS)}")
        self.model: Model = MODELS[self.name](**self.options)

    @property
    def fitted(self) -> bool:
        return self.params is not None

    def fit(self, df: DataFrame, max_rows: int = MAX_ROWS, **options) -> NeuralProbe:  # noqa: ANN003
        x, y, masks = collected(df, self.model, max_rows)
        return self.fit_arrays(x, y, masks, **options)

    def fit_arrays(self, x, y, masks=None, **options) -> NeuralProbe:  # noqa: ANN001, ANN003
        self.params = training.train(self.model, x, y, masks, seed=self.seed, **options)
        return self

    def logits(self, x, masks=None) -> np.ndarray:  # noqa: ANN001
        if not self.fitted:
            raise NotFittedError(f"{self.name} isn't fitted")
        return training.logits(self.model, self.params, x, masks)

    def transform(self, df: DataFrame) -> DataFrame:
        """(sample_id, [pos], logit, score): one row per row for feature models, one per sample for sequence models."""
        if not self.fitted:
            raise NotFittedError(f"{self.name} isn't fitted")
        model, params = self.model, self.params
        id_type = df.schema["sample_id"].dataType.simpleString()
        if not model.sequence:
            keep = ["sample_id"] + [c for c in ("pos",) if c in df.columns]
            schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep) + ", logit double, score double"

            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for f in frames:
                    z = training.logits(model, params, np.stack([np.asarray(v, float) for v in f.vec])) if len(f) else np.zeros(0)
                    yield f[keep].assign(logit=z, score=1 / (1 + np.exp(-z)))

            rows = df.where("det") if "det" in df.columns else df
            return rows.select(*keep, "vec").mapInPandas(run, schema)

        def one(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("pos")
            z = training.logits(model, params, [np.stack([np.asarray(v, float) for v in f.vec])], [f.det.to_numpy(bool)])
            return pd.DataFrame({"sample_id": f.sample_id.iloc[:1].to_numpy(), "logit": z, "score": 1 / (1 + np.exp(-z))})

        return df.select("sample_id", "pos", "det", "vec").groupBy("sample_id").applyInPandas(one, f"sample_id {id_type}, logit double, score double")

    def save(self, path: str) -> None:
        if not self.fitted:
            raise NotFittedError(f"{self.name} isn't fitted")
        meta = json.dumps({"name": self.name, "options": self.options, "seed": self.seed})
        with open(path, "wb") as f:
            np.savez_compressed(f, __meta__=np.array(meta), **self.params)

    @classmethod
    def load(cls, path: str) -> NeuralProbe:
        with open(path, "rb") as f:
            held = np.load(io.BytesIO(f.read()))
        params = {k: held[k] for k in held.files if k != "__meta__"}
        return cls(**json.loads(str(held["__meta__"])), params=params)


def scattered(scored: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token scores beside all tokens: 0 where a token isn't detected, as (sample_id, pos, logit, score)."""
    held = tokens.select("sample_id", "pos").join(scored.select("sample_id", "pos", "logit", "score"), ["sample_id", "pos"], "left")
    return held.na.fill(0.0, ["logit", "score"])


def sweep(df: DataFrame, name: str, configs: Sequence[dict], max_rows: int = MAX_ROWS, seed: int = 0) -> list[NeuralProbe]:
    """One fitted probe per set of options, each trained in a task of its own on the same bounded, broadcast set."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(collected(df, MODELS[name](), max_rows))
    plan = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(configs)], "i int, options string")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, y, masks = shared.value
        out = io.BytesIO()
        np.savez(out, **training.train(MODELS[name](**json.loads(f.options.iloc[0])), x, y, masks, seed=seed))
        return pd.DataFrame({"i": f.i, "params": [out.getvalue()]})

    fitted = plan.groupBy("i").applyInPandas(run, "i int, params binary").orderBy("i").collect()
    probes = []
    for row, options in zip(fitted, configs):
        held = np.load(io.BytesIO(bytes(row.params)))
        probes.append(NeuralProbe(name, dict(options), seed, {k: held[k] for k in held.files}))
    return probes


def sweep_layers(df: DataFrame, name: str, configs: Sequence[dict], max_rows: int = MAX_ROWS, seed: int = 0) -> dict[tuple[int, int], NeuralProbe]:
    """One fitted probe for each layer and set of options of rows (layer, sample_id, label, vec, [pos, det]), each trained in a
    task of its own. All layers train on the same samples, bounded as in collected() by the share of one layer."""
    model = MODELS[name]()
    counts = df.where(F.col("layer") == df.agg(F.min("layer")).scalar()).groupBy("sample_id").agg(F.count("*").alias("n"))
    ids = _within_bytes(_bounded(counts, "sample_id", max_rows), MAX_BYTES // max(1, 8 * _width(df)))
    columns = ["sample_id", *[c for c in ("pos", "det") if c in df.columns], "label", "vec"]
    each = df.join(ids, "sample_id", "left_semi").select("layer", *columns, F.explode(F.sequence(F.lit(0), F.lit(len(configs) - 1))).alias("i"))
    options = [json.dumps(c) for c in configs]

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x, y, masks = _arrays(f.sort_values([c for c in ("sample_id", "pos") if c in f]), model)
        out = io.BytesIO()
        np.savez(out, **training.train(MODELS[name](**json.loads(options[key[1]])), x, y, masks, seed=seed))
        return pd.DataFrame({"layer": [key[0]], "i": [key[1]], "params": [out.getvalue()]})

    probes = {}
    for row in each.groupBy("layer", "i").applyInPandas(run, "layer int, i int, params binary").collect():  # one row a probe
        held = np.load(io.BytesIO(bytes(row.params)))
        probes[row.layer, row.i] = NeuralProbe(name, dict(configs[row.i]), seed, {k: held[k] for k in held.files})
    return probes


def described(probe: NeuralProbe) -> dict:
    return asdict(probe.model)
