"""Mixing sources to target shares of the total size (problem 6), by systematic sampling.

Every record of a source is expected rate = share * total / size of the source times,
at most max_repeats times. Expected copies are prefix-summed within the source in hash
order, one offset drawn for the source is added, and a record is emitted once for each
integer boundary that its step crosses: floor or ceil of the rate, never more than
max_repeats, and the source's sum is exact to within one record.

The prefix sum is distributed: the leading digits of the order hash split each source
into buckets, whose counts (sources x 16**digits rows, however many records) give the
bucket's start; ranks within a bucket need no other bucket. A source that holds a third
of all rows is spread over all its buckets.

Defined results
    shares             -> normalised over the sources that have records; total is the size of these
    capped sources     -> contribute max_repeats times their size, less than their share; reported
    null share, null repeats, share or repeats <= 0 -> not in the mixture
    source without records, record of an unknown source -> not in the mixture
    null messages or contents -> size 0; such records still take part
    ties of the hash   -> broken by id; repeated rows -> each row is a record of its own
    empty tables       -> empty mixture; extra columns are ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondar.functions.text import source_name

SEED = 7
#: Hex digits of the order hash that split a source.
DIGITS = 3
_SHARE = "decimal(18,9)"


def dialogue_size(messages: Column) -> Column:
    """Characters of all contents."""
    lengths = F.transform(messages, lambda m: F.coalesce(F.length(m["content"]), F.lit(0)).cast("bigint"))
    return F.coalesce(F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))


def rates(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """(dataset, target, max_repeats, records, size, rate, offset) of the sources in the mixture.

    One row per source: as small as the list of targets."""
    wanted = targets.where("target_share > 0 AND max_repeats > 0 AND dataset IS NOT NULL").select(
        "dataset", F.col("target_share").cast(_SHARE).alias("share"), F.col("max_repeats").cast("bigint").alias("max_repeats")
    )
    held = records.groupBy("dataset").agg(F.count("*").alias("records"), F.sum("size").alias("size")).where("size > 0")
    both = held.join(wanted, "dataset")
    everything = W.partitionBy()
    whole = F.lit(float(total)) if total else F.sum("size").over(everything).cast("double")
    share = F.col("share").cast("double") / F.sum("share").over(everything).cast("double")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("offset"), "dataset", F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return both.select(
        "dataset",
        share.alias("target"),
        "max_repeats",
        "records",
        "size",
        F.least(F.col("max_repeats").cast("double"), share * whole / F.col("size").cast("double")).alias("rate"),
        draw.alias("offset"),
    )


def mixture(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, digits: int = DIGITS) -> DataFrame:
    """(dataset, id, size, copies) of records (dataset, id, size): how often each is used, if at all."""
    plan = rates(records, targets, total, seed).select("dataset", "rate", "offset")
    order = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))))
    placed = records.where("dataset IS NOT NULL").select("dataset", "id", "size", order.alias("place")).withColumn("bucket", F.substring("place", 1, digits))
    counts = placed.groupBy("dataset", "bucket").agg(F.count("*").alias("n"))
    by_bucket = W.partitionBy("dataset").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(by_bucket), F.lit(0)))
    starts = starts.join(plan, "dataset").select("dataset", "bucket", "start", "rate", "offset")
    within = W.partitionBy("dataset", "bucket").orderBy("place", "id")
    ranked = placed.withColumn("k", F.row_number().over(within)).join(starts, ["dataset", "bucket"])
    k = (F.col("start") + F.col("k")).cast("double")
    copies = F.floor(k * F.col("rate") + F.col("offset")) - F.floor((k - 1) * F.col("rate") + F.col("offset"))
    return ranked.select("dataset", "id", "size", copies.cast("bigint").alias("copies")).where("copies > 0")


def report(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED) -> DataFrame:
    """(dataset, target, actual, rate, used, copies, size): what each source contributes."""
    used = mixture(records, targets, total, seed).groupBy("dataset").agg(
        F.count("*").alias("used"), F.sum("copies").alias("copies"), F.sum(F.col("size") * F.col("copies")).alias("mixed")
    )
    plan = rates(records, targets, total, seed)
    joined = plan.join(used, "dataset", "left").na.fill(0, ["used", "copies", "mixed"])
    share = F.col("mixed") / F.sum("mixed").over(W.partitionBy())
    return joined.select(
        "dataset",
        F.round("target", 6).alias("target"),
        F.round(share, 6).alias("actual"),
        F.round("rate", 6).alias("rate"),
        F.col("max_repeats"),
        "records",
        "used",
        "copies",
        F.col("mixed").alias("size"),
    )


def dialogue_records(dialogues: DataFrame) -> DataFrame:
    return dialogues.select(source_name(F.col("dataset")).alias("dataset"), F.col("sample_id").alias("id"), dialogue_size(F.col("messages")).alias("size"))


def registry_targets(registry: DataFrame) -> DataFrame:
    return registry.select(source_name(F.col("dataset")).alias("dataset"), "target_share", "max_repeats")
