"""Collecting activations: a user's model runs over token batches and its vectors become a table.

The model is a callable on a list of token id lists that returns, for each, an array
[layers, tokens, width]. Batches follow the greedy plan, so a task pads within a budget.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondar.operators import batching, pool
from sondar.operators.activations import Activations
from sondar.sources import storage

Model = Callable[[list[list[int]]], list[np.ndarray]]


def collect(tokens: DataFrame, samples: DataFrame, model: Model, layers: Sequence[int], *, batch_size: int = 32, max_padded_tokens: int | None = None, pooling: str | None = None, metadata: dict | None = None) -> Activations:
    """blsh of (sample_id, pos, token_id, det), or blh with a pooling by name. Unknown poolings raise before anything runs."""
    if pooling is not None and pooling not in pool.POOLS:
        raise ValueError(f"unknown pool {pooling!r}; there are {sorted(pool.POOLS)}")
    lengths = tokens.groupBy("sample_id").agg(F.count("*").alias("n"))
    plan = batching.sequence_batches(lengths, batch_size, max_padded_tokens).select("sample_id", "chunk", "batch")
    id_type = tokens.schema["sample_id"].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        groups = [g.sort_values("pos") for _, g in f.groupby("sample_id", sort=True)]
        rows = []
        for g, out in zip(groups, model([g.token_id.tolist() for g in groups])):
            for k, layer in enumerate(layers):
                rows.extend(zip(g.sample_id, g.pos, g.det, [layer] * len(g), list(np.asarray(out[k], np.float32))))
        return pd.DataFrame(rows, columns=["sample_id", "pos", "det", "layer", "vec"])

    joined = tokens.select("sample_id", "pos", "token_id", "det").join(plan, "sample_id")
    data = joined.groupBy("chunk", "batch").applyInPandas(run, f"sample_id {id_type}, pos int, det boolean, layer int, vec array<float>")
    acts = Activations(data, "blsh", samples.select("sample_id"), tuple(layers), metadata)
    if pooling is None:
        return acts
    pooled = pool.pool(pooling, data, acts._spine(), keys=acts.keys)
    return Activations(pooled, "blh", acts.spine, acts.layers, metadata)


def collect_to(path: str, tokens: DataFrame, samples: DataFrame, model: Model, layers: Sequence[int], *, dtype: str = "float32", resume: bool = True, **options) -> Activations:  # noqa: ANN003
    """collect() into a store. With resume the samples a store there holds already are left as they are, and only the others
    run through the model."""
    done = storage.load(tokens.sparkSession, path).spine if resume and storage.has_store(path) else None
    if done is not None:
        tokens, samples = (df.join(done.select("sample_id").distinct(), "sample_id", "left_anti") for df in (tokens, samples))
    storage.save(collect(tokens, samples, model, layers, **options), path, dtype=dtype, append=done is not None)
    return storage.load(tokens.sparkSession, path)


def stream(acts: Activations, chunk_tokens: int = 500_000) -> Iterator[tuple[Activations, DataFrame]]:
    """Chunks of whole samples of a table that is already collected."""
    return storage.chunks(acts, chunk_tokens)
