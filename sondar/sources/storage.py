"""Storage of activation tables: Parquet, split by layer, with a manifest.

Writing is atomic: rows go to a part of their own and the manifest, which lists the parts, is
written last. A folder without one (or with another format's) is no store, and a part that no
manifest lists, of a job that ended early, is never read. Loading layers reads their folders only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondar.operators.activations import Activations
from sondar.session import written
from sondar.sources import files

FORMAT = "sondar-activations"
_TYPES = {"float32": "float", "bfloat16": "float", "float64": "double"}


def save(acts: Activations, path: str, *, dtype: str = "float32", compression: str = "zstd", format: str = "auto", append: bool = False) -> None:  # noqa: A002
    """Writes a store, or with append adds samples to one of the same layout; metadata must be JSON. bfloat16 keeps the upper
    16 bits of each float, rounded to even."""
    if format not in ("auto", "parquet"):
        raise ValueError(f"unknown format {format!r}")
    if dtype not in _TYPES:
        raise ValueError(f"dtype must be one of {sorted(_TYPES)}")
    layout = {"format": FORMAT, "dims": acts.dims, "layers": list(acts.layers) if acts.layers else None, "dtype": dtype}
    try:
        metadata = json.loads(json.dumps(acts.metadata))
    except TypeError as e:
        raise TypeError("metadata must be JSON") from e
    old = manifest(path) if append and has_store(path) else None
    if old and any(old[k] != v for k, v in layout.items()):
        raise ValueError(f"{path} holds another layout: {old}")
    data = acts.cast(_TYPES[dtype]).data
    if dtype == "bfloat16":
        data = data.withColumn("vec", rounded_bfloat16(F.col("vec")))
    spark, part = data.sparkSession, uuid.uuid4().hex
    writer = data.write.option("compression", compression)
    (writer.partitionBy("layer") if acts.layers else writer).parquet(f"{path}/data/{part}")
    acts.spine.select("sample_id").write.parquet(f"{path}/spine/{part}")
    parts = [*(old["parts"] if old else []), part]
    files.write_text(spark, f"{path}/manifest.json", json.dumps({**layout, "metadata": old["metadata"] if old else metadata, "parts": parts}))
    for name in ("data", "spine"):  # parts that were replaced, or left by a job that ended early
        for held in files.matches(spark, f"{path}/{name}/*"):
            if held.rsplit("/", 1)[1] not in parts:
                files.remove(spark, held)


def rounded_bfloat16(vec):  # noqa: ANN001, ANN201
    """Floats rounded to 8 bits of mantissa, halves to even: through the bits of the float as an integer."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<float>")
    def cut(vectors: pd.Series) -> pd.Series:
        def one(v):  # noqa: ANN001, ANN202
            a = np.asarray(v, np.float32)
            bits = a.view(np.uint32).astype(np.uint64)
            up = (bits + 0x7FFF + ((bits >> 16) & 1)) & 0xFFFF0000
            return np.where(np.isfinite(a), up.astype(np.uint32).view(np.float32), a)

        return vectors.map(one)

    return cut(vec)


def manifest(path: str) -> dict:
    spark = SparkSession.active()
    if not files.exists(spark, f"{path}/manifest.json"):
        raise FileNotFoundError(f"{path} is no store of activations")
    held = json.loads(files.read_text(spark, f"{path}/manifest.json"))
    if held.get("format") != FORMAT:
        raise ValueError(f"{path} is no store of activations")
    return held


def has_store(path: str) -> bool:
    try:
        manifest(path)
    except (OSError, ValueError):
        return False
    return True


def load(spark: SparkSession, path: str, *, layers: int | Sequence[int] | None = None, cast: str | None = None) -> Activations:
    """A store; an integer layer drops the axis, a list keeps it in its order, unknown layers raise."""
    held = manifest(path)
    data = reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/data/{p}") for p in held["parts"]])
    spine = spark.read.parquet(*[f"{path}/spine/{p}" for p in held["parts"]])
    acts = Activations(data, held["dims"], spine, tuple(held["layers"]) if held["layers"] else None, held["metadata"])
    if layers is not None:
        acts = acts.select_layer(layers)
    return acts.cast(cast) if cast else acts


def stream(spark: SparkSession, path: str, *, layers: int | Sequence[int] | None = None, chunk_tokens: int = 500_000) -> Iterator[tuple[Activations, DataFrame]]:
    """(activations, ids) of whole samples, at most chunk_tokens together but at least one sample; samples without tokens
    come in none."""
    acts = load(spark, path, layers=layers)
    if "s" not in acts.dims:
        raise ValueError("only stores with a sequence axis can be streamed")
    yield from chunks(acts, chunk_tokens)


def chunks(acts: Activations, chunk_tokens: int) -> Iterator[tuple[Activations, DataFrame]]:
    """(activations, ids) of whole samples in chunks of tokens. The rows are written once to the shared folder by chunk, so
    that a chunk reads its own files only."""
    from sondar.operators.batching import token_chunks

    keys = ("chunk", "batch")
    plan = written(token_chunks(acts.lengths().where("n > 0"), chunk_tokens).select("sample_id", *keys), "chunks")
    rows = written(acts.data.join(plan, "sample_id"), "chunked", keys)
    for row in plan.select(*keys).distinct().orderBy(*keys).toLocalIterator():
        here = (F.col("chunk") == row.chunk) & (F.col("batch") == row.batch)
        ids = plan.where(here).select("sample_id")
        yield Activations(rows.where(here).drop(*keys), acts.dims, ids, acts.layers, acts.metadata), ids


def remove(path: str) -> None:
    if not has_store(path):
        raise ValueError(f"{path} is no store of activations")
    files.remove(SparkSession.active(), path)
