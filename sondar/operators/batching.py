"""Plans of batches for stages that run a model: fixed size, and greedy under a budget of padded tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def feature_batches(df: DataFrame, batch_size: int = 1024, order_by: str = "sample_id", shuffle_seed: int | None = None, indices: DataFrame | None = None) -> DataFrame:
    """df with (batch): rows in order, batch_size at a time, the last one partial. With a seed the order is that of a hash of
    the id; with indices (sample_id) only those rows take part."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    from sondar.operators.dataset import _positions, order_hash

    rows = df if indices is None else df.join(indices.select("sample_id").distinct(), "sample_id", "left_semi")
    if shuffle_seed is not None:
        rows, order_by = rows.withColumn("_place", order_hash(shuffle_seed, "sample_id")), "_place"
    return _positions(rows, order_by).withColumn("batch", F.floor(F.col("pos") / batch_size).cast("bigint")).drop("pos", "_place")


def greedy(lengths: Column, batch_size: int, max_padded_tokens: int | None) -> Column:
    """Batch number of each of an ordered array of lengths: a new one opens when the batch is full, or would hold
    more than the budget once padded to its longest; a longer sample than the budget is alone."""
    budget = F.lit(max_padded_tokens).cast("bigint")

    def step(acc: Column, n: Column) -> Column:
        longest = F.greatest(acc["longest"], n)
        full = acc["size"] >= batch_size
        over = (longest * (acc["size"] + 1) > budget) if max_padded_tokens else F.lit(False)
        opens = (acc["size"] > 0) & (full | over)
        batch = acc["batch"] + opens.cast("bigint")
        return F.struct(
            batch.alias("batch"),
            F.when(opens, F.lit(1).cast("bigint")).otherwise(acc["size"] + 1).alias("size"),
            F.when(opens, n).otherwise(longest).alias("longest"),
            F.concat(acc["out"], F.array(batch)).alias("out"),
        )

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("batch"), zero.alias("size"), zero.alias("longest"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def sequence_batches(df: DataFrame, batch_size: int = 32, max_padded_tokens: int | None = None, sort_by_length: bool = True, group: str | None = None, chunk: int | None = 4096, shuffle_seed: int | None = None) -> DataFrame:
    """(group, chunk, sample_id, n, batch) of (sample_id, n): greedy batches within chunks of `chunk` samples.

    Longest samples come first, ties by id. A chunk is a range of that order, so batches are planned in parallel
    and no task holds more than a chunk's lengths; with up to `chunk` samples there is one plan over all of them.
    With chunk=None there always is: the plan of a sequential pass, for which one task holds all lengths (24 bytes
    each). With a seed there is a column turn, the place of a batch in a random order of them.
    """
    if batch_size < 1 or (max_padded_tokens is not None and max_padded_tokens < 1):
        raise ValueError("batch_size and max_padded_tokens must be positive")
    from sondar.operators.dataset import _positions

    keys = [group] if group else []
    place = F.concat(F.lpad((F.lit(10**12) - F.col("n")).cast("string"), 13, "0"), F.lit("|"), F.lpad(F.col("sample_id").cast("string"), 20, "0")) if sort_by_length else F.lpad(F.col("sample_id").cast("string"), 20, "0")
    ordered = _positions(df.select(*keys, "sample_id", F.col("n").cast("bigint").alias("n"), place.alias("place")), "place")
    chunked = ordered.withColumn("chunk", F.floor(F.col("pos") / chunk) if chunk else F.lit(0).cast("bigint"))
    planned = chunked.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "sample_id", "n"))).alias("s"))
    batches = planned.withColumn("batch", greedy(F.transform("s", lambda x: x["n"]), batch_size, max_padded_tokens))
    each = batches.select(*keys, "chunk", F.explode(F.arrays_zip("s", "batch")).alias("z"))
    out = each.select(*keys, "chunk", F.col("z.s.sample_id").alias("sample_id"), F.col("z.s.n").alias("n"), F.col("z.batch").alias("batch"))
    return out if shuffle_seed is None else _turned(out, keys, shuffle_seed)


def _turned(plan: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """plan with (turn): the place of each batch in the order of a hash of it."""
    from sondar.operators.dataset import _positions

    batches = plan.select(*keys, "chunk", "batch").distinct()
    place = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in (*keys, "chunk", "batch")], F.lit(str(seed))))
    turns = _positions(batches.withColumn("_place", place), "_place").withColumnRenamed("pos", "turn").drop("_place")
    return plan.join(turns, [*keys, "chunk", "batch"])


def longest(batches: DataFrame) -> DataFrame:
    """(sample_id, longest) of planned batches: the length of the longest sample of each sample's batch."""
    keys = [c for c in batches.columns if c not in ("sample_id", "n")]
    return batches.select("sample_id", F.max("n").over(W.partitionBy(*keys)).alias("longest"))


def token_chunks(df: DataFrame, chunk_tokens: int = 500_000, chunk: int | None = 4096) -> DataFrame:
    """(chunk, sample_id, n, batch): whole samples in order, at most chunk_tokens together but at least one sample. Planned
    within ranges of `chunk` samples; with None as a sequential pass would, in one task."""
    from sondar.operators.dataset import _positions

    ordered = _positions(df.select("sample_id", F.col("n").cast("bigint").alias("n")), "sample_id").withColumn("chunk", F.floor(F.col("pos") / chunk) if chunk else F.lit(0).cast("bigint"))
    planned = ordered.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("sample_id", "n"))).alias("s"))

    def step(acc: Column, s: Column) -> Column:
        opens = (acc["held"] > 0) & (acc["held"] + s["n"] > chunk_tokens)
        batch = acc["batch"] + opens.cast("bigint")
        held = F.when(opens, s["n"]).otherwise(acc["held"] + s["n"])
        return F.struct(batch.alias("batch"), held.alias("held"), F.concat(acc["out"], F.array(batch)).alias("out"))

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("batch"), zero.alias("held"), F.array().cast("array<bigint>").alias("out"))
    batches = planned.withColumn("b", F.aggregate("s", start, step, lambda acc: acc["out"]))
    return batches.select("chunk", F.explode(F.arrays_zip("s", "b")).alias("z")).select("chunk", F.col("z.s.sample_id").alias("sample_id"), F.col("z.s.n").alias("n"), F.col("z.b").alias("batch"))
