"""Pooling of token sequences to one vector per sample.

Input is act_bsh (sample_id, pos, det, vec) and the spine (sample_id, ...), one row per
sample; a sample without a detected token pools to zeros. mean, max and last are partial
aggregates and never hold a sequence; ema and rolling fold a sample's ordered tokens, so
their memory is that of one sample. Vectors are never exploded into rows of numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("sample_id",)
#: Where the summarizer starts from; a maximum that stays there has seen nothing but negative infinity.
LOWEST = -1.7976931348623157e308


def _doubles(vec: str | Column = "vec") -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def layer_mean(vec: str) -> Column:
    """Aggregate: the elementwise mean of vectors."""
    return vector_to_array(Summarizer.mean(array_to_vector(_doubles(vec))))


def layer_max(vec: str) -> Column:
    """Aggregate: the elementwise maximum of vectors; NaN wins."""
    nan = array_to_vector(F.transform(vec, lambda x: F.when(F.isnan(x), 1.0).otherwise(0.0)))
    plain = array_to_vector(F.transform(_doubles(vec), lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x)))
    value = lambda v, m: F.when(m > 0, F.lit(float("nan"))).when(v <= LOWEST, F.lit(float("-inf"))).otherwise(v)
    return F.zip_with(vector_to_array(Summarizer.max(plain)), vector_to_array(Summarizer.max(nan)), value)


def width(tokens: DataFrame) -> Column:
    """Scalar subquery: the width of the vectors."""
    return tokens.agg(F.max(F.size("vec"))).scalar()


def filled(pooled: DataFrame, tokens: DataFrame, spine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Zeros for the samples of the spine that have no pooled vector."""
    zeros = F.array_repeat(F.lit(0.0), F.coalesce(width(tokens), F.lit(0)))
    return spine.select(*keys).join(pooled, list(keys), "left").select(*keys, F.coalesce("vec", zeros).alias("vec"))


def mean(tokens: DataFrame, spine: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean of the detected tokens."""
    detected = tokens.where("det").select(*keys, array_to_vector(_doubles()).alias("v"))
    pooled = detected.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("vec"))
    return filled(pooled, tokens, spine, keys)


def maximum(tokens: DataFrame, spine: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Elementwise maximum of the detected tokens; NaN wins, and negative infinity becomes 0."""
    detected = tokens.where("det").select(*keys, _doubles().alias("a"))
    has_nan = F.transform("a", lambda x: F.when(F.isnan(x), 1.0).otherwise(0.0))
    plain = F.transform("a", lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x))
    folded = detected.select(*keys, array_to_vector(plain).alias("v"), array_to_vector(has_nan).alias("m"))
    both = folded.groupBy(*keys).agg(vector_to_array(Summarizer.max(F.col("v"))).alias("v"), vector_to_array(Summarizer.max(F.col("m"))).alias("m"))
    value = F.zip_with("v", "m", lambda v, m: F.when(m > 0, F.lit(float("nan"))).when(v <= LOWEST, 0.0).otherwise(v))
    return filled(both.select(*keys, value.alias("vec")), tokens, spine, keys)


def last_token(tokens: DataFrame, spine: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Vector of the last detected token."""
    pooled = tokens.where("det").groupBy(*keys).agg(F.max_by(_doubles(), "pos").alias("vec"))
    return filled(pooled, tokens, spine, keys)


def ema(tokens: DataFrame, spine: DataFrame, alpha: float = 0.5, keys: Sequence[str] = KEY) -> DataFrame:
    """Maximum over the detected tokens of s = (1 - alpha) s + alpha x, which starts at 0 and skips other tokens."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    detected = tokens.where("det").select(*keys, F.struct("pos", _doubles().alias("x")).alias("t"))
    ordered = detected.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("t"))
    zeros = F.transform(F.get("t", F.lit(0))["x"], lambda _: F.lit(0.0))
    lows = F.transform(F.get("t", F.lit(0))["x"], lambda _: F.lit(float("-inf")))

    def step(acc: Column, t: Column) -> Column:
        s = F.zip_with(acc["s"], t["x"], lambda s, x: s * (1 - alpha) + x * alpha)
        return F.struct(s.alias("s"), F.zip_with(acc["best"], s, lambda a, b: F.greatest(a, b)).alias("best"))

    folded = F.aggregate("t", F.struct(zeros.alias("s"), lows.alias("best")), step, lambda acc: acc["best"])
    return filled(ordered.select(*keys, folded.alias("vec")), tokens, spine, keys)


def rolling(tokens: DataFrame, spine: DataFrame, window_size: int = 10, pad_to: str = "batch_max", keys: Sequence[str] = KEY) -> DataFrame:
    """Maximum over positions of the mean of the detected tokens among the last window_size positions.

    Windows without a detected token don't count. With pad_to='batch_max' the windows run on past a
    sample's end up to the longest sample of the input, as undetected positions; with 'none' they end there.
    """
    if window_size < 1:
        raise ValueError("window_size must be positive")
    if pad_to not in ("batch_max", "none"):
        raise ValueError("pad_to is 'batch_max' or 'none'")
    t = F.sort_array(F.collect_list(F.struct("pos", "det", _doubles().alias("x"))))
    packed = tokens.groupBy(*keys).agg(t.alias("t"), (F.max("pos") + 1).alias("n"))
    extra = F.lit(0)
    if pad_to == "batch_max":
        longest = tokens.agg(F.max("pos") + 1).scalar()
        extra = F.greatest(F.least(F.lit(window_size - 1), longest - F.col("n")), F.lit(0))
    vectors, detected = F.flatten(F.transform("t", lambda r: r["x"])), F.transform("t", lambda r: r["det"].cast("int"))
    pooled = packed.select(*keys, _best_windows(window_size)(vectors, detected, extra.cast("int")).alias("vec")).where("vec IS NOT NULL")
    return filled(pooled, tokens, spine, keys)


def _best_windows(size: int):  # noqa: ANN202
    """Arrow UDF on a sample's vectors, one after the other: the elementwise maximum of the window means; null without any."""

    @F.pandas_udf("array<double>")
    def best(vectors: pd.Series, detected: pd.Series, extra: pd.Series) -> pd.Series:
        out = []
        for flat, det, more in zip(vectors, detected, extra):
            det = np.concatenate([np.asarray(det, bool), np.zeros(more, bool)])
            if not det.any():
                out.append(None)
                continue
            x = np.zeros((len(det), len(flat) // (len(det) - more)))
            x[: len(det) - more] = np.asarray(flat, float).reshape(-1, x.shape[1])
            x[~det] = 0
            sums, counts = x.copy(), det.astype(float)
            for k in range(1, min(size, len(det))):  # not by running sums, in which one NaN would stay
                sums[k:] += x[:-k]
                counts[k:] += det[:-k]
            held = counts > 0
            out.append((sums[held] / counts[held, None]).max(0))
        return pd.Series(out, dtype=object)

    return best


POOLS = {"mean": mean, "max": maximum, "last_token": last_token, "ema": ema, "rolling": rolling}


def pool(name: str, tokens: DataFrame, spine: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    if name not in POOLS:
        raise ValueError(f"unknown pool {name!r}; there are {sorted(POOLS)}")
    return POOLS[name](tokens, spine, **options)
