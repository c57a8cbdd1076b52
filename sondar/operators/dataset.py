"""Dataset operators: filters, gather, order, sampling, splits, union, deduplication.

A dataset is a DataFrame (sample_id, messages, label, metadata..., and its name). Order
is by md5 of id and seed, which gives the same permutation on any partitioning; counts
(n, n_pos, ...) are tiny aggregates, and every choice of rows is a rank compared with
such a count. Ranks within a class are distributed: leading digits of the hash split the
class, a small table of counts gives each part's start, so no class is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondar.session import small, written

SEED = 42
DIGITS = 2


def order_hash(seed: int = SEED, id_col: str = "sample_id") -> Column:
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def positive(df: DataFrame) -> DataFrame:
    return df.where("label = 1")


def negative(df: DataFrame) -> DataFrame:
    return df.where("label = 0")


def gather(df: DataFrame, indices: Sequence[int] | slice, order_by: str = "sample_id") -> DataFrame:
    """Rows at positions in order of `order_by`, with (idx): order and repeats of the indices are kept;
    negative ones count from the end; out of range raises. The indices go to the rows if they are few; else both are
    sorted. The rows are never broadcast, however small their files are."""
    ranked = _positions(df, order_by)
    n = df.count()
    chosen = list(range(*indices.indices(n))) if isinstance(indices, slice) else [i + n if i < 0 else i for i in indices]
    if bad := [i for i in chosen if not 0 <= i < n]:
        raise IndexError(f"positions {bad[:3]} of {n} rows")
    wanted = df.sparkSession.createDataFrame(list(enumerate(chosen)), "idx bigint, pos bigint")
    return small(wanted).join(ranked.hint("merge"), "pos").drop("pos")


def _positions(df: DataFrame, order_by: str) -> DataFrame:
    """df with (pos): its rank by a column. Rows are range-partitioned and sorted once and written, as another evaluation
    could cut other ranges; a row's place in its partition is in its running number."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(parts, order_by).sortWithinPartitions(order_by).withColumn("_id", F.monotonically_increasing_id())
    held = written(ordered, "ordered").withColumns({"_part": F.shiftright("_id", 33), "_rank": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
    # As many rows as partitions.
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return held.join(F.broadcast(starts), "_part").withColumn("pos", F.col("_start") + F.col("_rank")).drop("_part", "_start", "_rank", "_id")


def ranked(df: DataFrame, seed: int = SEED, by: Sequence[str] = (), id_col: str = "sample_id", name: str = "rank", digits: int = DIGITS) -> DataFrame:
    """df with its 1-based rank in hash order within each group of `by`."""
    placed = df.withColumn("_place", order_hash(seed, id_col)).withColumn("_bucket", F.substring("_place", 1, digits))
    counts = placed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    keys = [*by, "_bucket"]
    joined = placed.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy("_place", id_col)))
    on = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = joined.alias("a").join(starts.alias("b"), on)
    return both.select("a.*", (F.col("b._start") + F.col("a._rank")).alias(name)).drop("_place", "_bucket", "_rank")


def shuffle(df: DataFrame, seed: int = SEED, id_col: str = "sample_id") -> DataFrame:
    """df with (rank), its place in a permutation that depends on ids and seed only."""
    return ranked(df, seed, id_col=id_col)


def sample(df: DataFrame, n: int, stratified: bool = False, seed: int = SEED, id_col: str = "sample_id") -> DataFrame:
    """n rows without replacement; stratified keeps the share of positives: round(n * share), halves
    to even, capped at what there is and topped up from the other class."""
    if n < 0:
        raise ValueError("n must not be negative")
    if not stratified:
        return ranked(df, seed, id_col=id_col).where(F.col("rank") <= n).drop("rank")
    counts = df.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count("*").alias("all"))
    wanted = F.least(F.lit(n), F.col("all"))
    first = F.least(F.rint(wanted * F.try_divide(F.col("pos"), F.col("all"))), F.col("pos"))
    k_neg = F.least(wanted - first, F.col("all") - F.col("pos"))
    k_pos = F.least(first + (wanted - first - k_neg), F.col("pos"))
    sizes = counts.select(F.array(F.struct(F.lit(1).alias("_class"), k_pos.alias("_k")), F.struct(F.lit(0).alias("_class"), k_neg.alias("_k"))).alias("c"))
    sizes = F.broadcast(sizes.select(F.explode("c").alias("c")).select("c.*"))  # two rows
    classed = ranked(df.withColumn("_class", (F.col("label") == 1).cast("int")), seed, ["_class"], id_col)
    return classed.join(sizes, "_class").where(F.col("rank") <= F.col("_k")).drop("_class", "_k", "rank")


def split(df: DataFrame, frac: float = 0.8, stratified: bool = False, seed: int = SEED, id_col: str = "sample_id") -> DataFrame:
    """df with (part): 'train' for the first int(n * frac) rows in hash order (of each class if stratified), else 'test'."""
    if not 0 <= frac <= 1:
        raise ValueError("frac must be in [0, 1]")
    by = ["_class"] if stratified else []
    classed = df.withColumn("_class", (F.col("label") == 1).cast("int")) if stratified else df
    sizes = classed.groupBy(*by).agg(F.floor(F.count("*") * F.lit(frac)).alias("_k"))
    placed = ranked(classed, seed, by, id_col)
    joined = placed.join(F.broadcast(sizes), by) if by else placed.withColumn("_k", sizes.scalar())  # two rows or one
    return joined.withColumn("part", F.when(F.col("rank") <= F.col("_k"), "train").otherwise("test")).drop("_class", "_k", "rank")


def capped(df: DataFrame, by: str, most: int, seed: int = SEED, id_col: str = "sample_id") -> DataFrame:
    """At most `most` rows of each group, the first in hash order."""
    return ranked(df, seed, [by], id_col).where(F.col("rank") <= most).drop("rank")


def first_n(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """The first n rows by a column (before any shuffle)."""
    return df.orderBy(order_by).limit(n)


def drop_repeats(df: DataFrame, keys: Sequence[Column | str], order_by: str) -> DataFrame:
    """The first row of each key. Rows travel as ids only: the first id of a key is a partial aggregate."""
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    firsts = df.select(F.md5(F.to_json(F.struct(*named), {"ignoreNullFields": "false"})).alias("_key"), order_by).groupBy("_key").agg(F.min(order_by).alias(order_by))
    return df.join(firsts.select(order_by), order_by, "left_semi")


def union(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Union with merged columns: missing ones are null, and `source` is the dataset's name where it has no such column."""
    sides = [df if "source" in df.columns else df.withColumn("source", F.lit(name)) for df, name in ((left, left_name), (right, right_name))]
    return sides[0].unionByName(sides[1], allowMissingColumns=True)


def coerce_label(value: Column) -> Column:
    """1 for positive, pos, true, 1; 0 for negative, neg, false, 0; else whether the integer is 1. Case aside."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("positive", "pos", "true", "1"), 1).when(low.isin("negative", "neg", "false", "0"), 0).otherwise((low.try_cast("bigint") == 1).cast("int"))


def row_label(df: DataFrame) -> Column:
    """label_value before label."""
    present = [F.col(c).cast("string") for c in ("label_value", "label") if c in df.columns]
    if not present:
        raise KeyError("label")
    return coerce_label(F.coalesce(*present))


def broadcast_labels(tokens: DataFrame, samples: DataFrame) -> DataFrame:
    """Each token with its sample's label."""
    return tokens.join(samples.select("sample_id", "label"), "sample_id")


def keep_ids(df: DataFrame, ids: DataFrame, on: str = "sample_id") -> DataFrame:
    return df.join(ids, on, "left_semi")


def exclude_ids(df: DataFrame, ids: DataFrame, on: str = "sample_id") -> DataFrame:
    return df.join(ids, on, "left_anti")


def lookup(column: Column, table: dict[str, object]) -> Column:
    """Values of a small dictionary; null for keys it doesn't have."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column)
