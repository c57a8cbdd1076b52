"""Operators of activation tables.

Four layouts: bh (sample_id, vec), blh (+ layer), bsh (sample_id, pos, det, vec) and
blsh (+ layer). Samples without tokens are rows of the spine (sample_id) only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondar.operators import batching, pool

DIMS = ("bh", "bsh", "blh", "blsh")


@dataclass(frozen=True)
class Activations:
    """A table of activations with its layout, its spine and, with layers, their order."""

    data: DataFrame
    dims: str
    spine: DataFrame
    layers: tuple[int, ...] | None = None
    metadata: dict | None = None

    def __post_init__(self) -> None:
        if self.dims not in DIMS:
            raise ValueError(f"dims must be one of {DIMS}, not {self.dims!r}")
        need = {"sample_id", "vec"} | ({"pos", "det"} if "s" in self.dims else set()) | ({"layer"} if "l" in self.dims else set())
        if missing := need - set(self.data.columns):
            raise ValueError(f"{self.dims} needs the columns {sorted(missing)}")
        if ("l" in self.dims) != (self.layers is not None):
            raise ValueError("layers belong to a layout with l, and only there")
        if self.layers is not None and len(set(self.layers)) != len(self.layers):
            raise ValueError("layers must be distinct")

    @property
    def keys(self) -> list[str]:
        return ["sample_id"] + (["layer"] if "l" in self.dims else [])

    # Sizes.
    def batch_size(self) -> int:
        return self.spine.count()

    def lengths(self) -> DataFrame:
        """(sample_id, n): tokens of every sample, empty ones with 0."""
        self._need("s")
        one = self.data.where(F.col("layer") == self.layers[0]) if self.layers else self.data
        counts = one.groupBy("sample_id").agg(F.count("*").alias("n"))
        return self.spine.select("sample_id").join(counts, "sample_id", "left").na.fill(0, ["n"])

    def shape(self) -> DataFrame:
        """One row (batch_size, n_layers, seq_len, hidden_size, total_tokens)."""
        n = self.lengths() if "s" in self.dims else self.spine.select("sample_id", F.lit(1).alias("n"))
        sizes = n.agg(F.count("*").alias("batch_size"), F.max("n").alias("seq_len"), F.sum("n").alias("total_tokens"))
        layers = F.lit(len(self.layers) if self.layers else 0).alias("n_layers")
        return sizes.select("batch_size", layers, "seq_len", pool.width(self.data).alias("hidden_size"), "total_tokens")

    # Reductions.
    def mean(self, dim: str) -> Activations:
        return self._pooled("mean") if dim == "s" else self._layer_reduced("mean", dim)

    def max(self, dim: str) -> Activations:
        return self._pooled("max") if dim == "s" else self._layer_reduced("max", dim)

    def last(self) -> Activations:
        return self._pooled("last_token")

    def ema(self, alpha: float = 0.5) -> Activations:
        return self._pooled("ema", alpha=alpha)

    def rolling(self, window_size: int = 10, pad_to: str = "batch_max") -> Activations:
        return self._pooled("rolling", window_size=window_size, pad_to=pad_to)

    def _pooled(self, name: str, **options) -> Activations:  # noqa: ANN003
        self._need("s")
        data = pool.pool(name, self.data, self._spine(), keys=self.keys, **options)
        return replace(self, data=data, dims=self.dims.replace("s", ""))

    def _layer_reduced(self, how: str, dim: str) -> Activations:
        if dim != "l":
            raise ValueError(f"can't reduce over {dim!r}")
        self._need("l")
        keys = ["sample_id", "pos"] if "s" in self.dims else ["sample_id"]
        keys += ["det"] if "s" in self.dims else []
        vec = pool.layer_mean("vec") if how == "mean" else pool.layer_max("vec")
        return replace(self, data=self.data.groupBy(*keys).agg(vec.alias("vec")), dims=self.dims.replace("l", ""), layers=None)

    # Selection.
    def select_layer(self, layer: int | Sequence[int]) -> Activations:
        """A layer id drops the axis; a list keeps it in the order given. Only those partitions are read."""
        self._need("l")
        wanted = [layer] if isinstance(layer, int) else list(layer)
        if unknown := [k for k in wanted if k not in self.layers]:
            raise ValueError(f"layers {unknown} aren't among {list(self.layers)}")
        data = self.data.where(F.col("layer").isin(wanted))
        if isinstance(layer, int):
            return replace(self, data=data.drop("layer"), dims=self.dims.replace("l", ""), layers=None)
        return replace(self, data=data, layers=tuple(wanted))

    def select_position(self, index: int) -> Activations:
        """-1 is the last detected token; any other index is a position, whatever its mask. Zeros where there is none."""
        self._need("s")
        if index == -1:
            return self.last()
        data = self.data
        if index < 0:
            data = data.withColumn("_n", F.max("pos").over(W.partitionBy(*self.keys)) + 1).where(F.col("pos") == F.col("_n") + index)
        else:
            data = data.where(F.col("pos") == index)
        vec = F.transform("vec", lambda x: x.cast("double")).alias("vec")
        filled = pool.filled(data.select(*self.keys, vec), self.data, self._spine(), self.keys)
        return replace(self, data=filled, dims=self.dims.replace("s", ""))

    def flatten(self) -> Activations:
        """Layers one after the other in one vector, in stored order."""
        self._need("l")
        keys = ["sample_id", "pos", "det"] if "s" in self.dims else ["sample_id"]
        place = F.array_position(F.array(*[F.lit(k) for k in self.layers]), F.col("layer"))
        parts = F.sort_array(F.collect_list(F.struct(place.alias("at"), "vec")))
        data = self.data.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p["vec"])).alias("vec"))
        return replace(self, data=data, dims=self.dims.replace("l", ""), layers=None)

    def iter_layers(self):  # noqa: ANN201
        self._need("l")
        for layer in self.layers:
            yield layer, self.select_layer(layer)

    def detected(self) -> tuple[DataFrame, DataFrame]:
        """The detected tokens, and (sample_id, n) with how many each sample has, zeros included."""
        self._need("s")
        kept = self.data.where("det")
        one = kept.where(F.col("layer") == self.layers[0]) if self.layers else kept
        counts = one.groupBy("sample_id").agg(F.count("*").alias("n"))
        return kept, self.spine.select("sample_id").join(counts, "sample_id", "left").na.fill(0, ["n"])

    def padded(self, ids: DataFrame | None = None, batches: DataFrame | None = None) -> DataFrame:
        """(keys..., vecs, mask): each sample's vectors filled up with zeros to the longest of the ids (all if None) or,
        with planned batches (sample_id, n, batch), of its batch."""
        self._need("s")
        data, spine = (self.data, self._spine()) if ids is None else (self.data.join(ids, "sample_id", "left_semi"), self._spine().join(ids, "sample_id", "left_semi"))
        rows = data.groupBy(*self.keys).agg(F.sort_array(F.collect_list(F.struct("pos", "vec", "det"))).alias("t"))
        joined = spine.join(rows, self.keys, "left")
        if batches is None:
            joined = joined.withColumn("_len", data.agg(F.max("pos") + 1).scalar())
        else:
            joined = joined.join(batching.longest(batches).withColumnRenamed("longest", "_len"), "sample_id")
        missing = F.col("_len") - F.greatest(F.coalesce(F.size("t"), F.lit(0)), F.lit(0))
        zeros = F.array_repeat(F.lit(0.0), pool.width(data))
        vecs = F.concat(F.coalesce(F.transform("t", lambda s: F.transform(s["vec"], lambda x: x.cast("double"))), F.array().cast("array<array<double>>")), F.array_repeat(zeros, missing.cast("int")))
        mask = F.concat(F.coalesce(F.transform("t", lambda s: s["det"]), F.array().cast("array<boolean>")), F.array_repeat(F.lit(False), missing.cast("int")))
        return joined.select(*self.keys, vecs.alias("vecs"), mask.alias("mask"))

    def cast(self, dtype: str) -> Activations:
        return replace(self, data=self.data.withColumn("vec", F.transform("vec", lambda x: x.cast(dtype))))

    def _spine(self) -> DataFrame:
        spine = self.spine.select("sample_id")
        return spine.select("sample_id", F.explode(F.array(*[F.lit(k) for k in self.layers])).alias("layer")) if self.layers else spine

    def _need(self, axis: str) -> None:
        if axis not in self.dims:
            raise ValueError(f"{self.dims} has no axis {axis!r}")


def cat(parts: Sequence[Activations]) -> Activations:
    """Samples of all parts, in order; their ids are shifted past those of the parts before."""
    if not parts:
        raise ValueError("nothing to concatenate")
    first = parts[0]
    if len(parts) == 1:
        return first
    if any(p.dims != first.dims or p.layers != first.layers for p in parts):
        raise ValueError("dims and layers must be equal")
    widths = {r[0] for p in parts for r in [p.data.agg(F.max(F.size("vec"))).first()]} - {None}
    if len(widths) > 1:
        raise ValueError(f"vectors have different widths: {sorted(widths)}")
    shift, data, spines = 0, [], []
    for p in parts:
        moved = (F.col("sample_id") + F.lit(shift)).alias("sample_id")
        data.append(p.data.select(moved, *[c for c in p.data.columns if c != "sample_id"]))
        spines.append(p.spine.select(moved))
        last = p.spine.agg(F.max("sample_id")).first()[0]
        shift += 0 if last is None else last + 1
    same = all(p.metadata == first.metadata for p in parts)
    metadata = first.metadata if same else {"sources": [p.metadata for p in parts]}
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    return replace(first, data=union(data), spine=union(spines), metadata=metadata)


def from_tensor(vectors: DataFrame, dims: str = "bh", layers: Sequence[int] | None = None, metadata: dict | None = None) -> Activations:
    """From dense vectors (sample_id, [layer], vec) without a sequence axis."""
    if "s" in dims:
        raise ValueError("from_tensor takes no sequence axis: use from_padded or from_flat")
    held = ["sample_id"] + (["layer"] if "l" in dims else [])
    return Activations(vectors.select(*held, "vec"), dims, vectors.select("sample_id").distinct(), tuple(layers) if layers is not None else None, metadata)


def from_flat(flat: DataFrame, offsets: DataFrame, detection: str | None = None, dims: str = "bsh", layers: Sequence[int] | None = None, metadata: dict | None = None) -> Activations:
    """From tokens (i, [layer], vec, [detection]) in one running number i from 0 on, and offsets (sample_id, start, stop) of
    the samples in it; samples may be empty. Without a detection column every token is detected."""
    if "s" not in dims:
        raise ValueError("from_flat needs a sequence axis")
    numbers = offsets.where("stop > start").select("sample_id", F.col("start").alias("_start"), F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("i"))
    det = F.col(detection).cast("boolean") if detection else F.lit(True)
    held = ["layer"] if "l" in dims else []
    data = flat.join(numbers, "i").select("sample_id", (F.col("i") - F.col("_start")).cast("int").alias("pos"), det.alias("det"), *held, "vec")
    return Activations(data, dims, offsets.select("sample_id"), tuple(layers) if layers is not None else None, metadata)


def from_padded(padded: DataFrame, dims: str, layers: Sequence[int] | None = None, attention: str | None = None, detection: str | None = None) -> Activations:
    """From (sample_id, [layer], vecs, masks...): kept are the tokens of the attention mask, else of the detection
    mask, else all; a token is detected by the detection mask, else if it is kept."""
    held = ["sample_id"] + (["layer"] if layers is not None else [])
    keep = attention or detection
    columns = [F.transform("vecs", lambda v: F.lit(True)) if c is None else F.col(c) for c in (keep, detection or attention)]
    zipped = F.arrays_zip(F.col("vecs").alias("vec"), columns[0].alias("keep"), columns[1].alias("det"))
    rows = padded.select(*held, F.posexplode(zipped).alias("at", "t")).where("t.keep")
    place = F.row_number().over(W.partitionBy(*held).orderBy("at")) - 1
    data = rows.select(*held, place.alias("pos"), F.col("t.det").alias("det"), F.col("t.vec").alias("vec"))
    return Activations(data, dims, padded.select("sample_id").distinct(), tuple(layers) if layers is not None else None)


def checked(x: Activations, *, require_layer: bool = False, forbid_layer: bool = False, require_seq: bool = False, forbid_seq: bool = False, ensure_finite: bool = True, ensure_non_empty: bool = True, estimator: str = "estimator") -> Activations:
    """x, after checks of its axes and one aggregate over its values; ValueError tells what to do."""
    if require_layer and "l" not in x.dims:
        raise ValueError(f"{estimator} needs a layer axis; {x.dims} has none")
    if forbid_layer and "l" in x.dims:
        raise ValueError(f"{estimator} takes no layer axis: select_layer or flatten first")
    if require_seq and "s" not in x.dims:
        raise ValueError(f"{estimator} needs a sequence axis; {x.dims} has none")
    if forbid_seq and "s" in x.dims:
        raise ValueError(f"{estimator} takes no sequence axis: pool it first")
    row = quality(x.data).first()
    if ensure_non_empty and not row.rows:
        raise ValueError(f"{estimator} got no rows")
    if ensure_finite and (row.nans or row.infinities):
        raise ValueError(f"{estimator} got {row.nans} NaN and {row.infinities} infinite values")
    return x


def quality(data: DataFrame) -> DataFrame:
    """One row (rows, nans, infinities) over all values."""
    count = lambda test: F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, v: a + test(v).cast("bigint"))
    nans = count(lambda v: F.isnan(v))
    infinite = count(lambda v: F.abs(v.cast("double")) == float("inf"))
    return data.agg(F.count("*").alias("rows"), F.coalesce(F.sum(nans), F.lit(0)).alias("nans"), F.coalesce(F.sum(infinite), F.lit(0)).alias("infinities"))


def vector_column(values: Sequence[Column]) -> Column:
    return F.array(*[v.cast("double") for v in values])
