"""Threshold and ranking metrics of binary scores, as aggregates over one curve.

Scores (y, p) are first folded into a curve: one row per distinct score and slice, with
its weight n and positive weight k, and the weight of positives and negatives below it.
The running sums are distributed: approximate quantiles of the scores split the curve into
buckets, a small table of bucket totals gives each bucket's start, and only the window
inside a bucket orders rows. Every metric is then an aggregate over that curve, so any
number of metrics costs one shuffle of distinct scores, and slices (by) cost nothing more.

A prediction is positive if p is greater than the threshold, not equal. Metrics that
need both classes raise an error for a slice with one class (strict=False: null).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of the running sums.
BUCKETS = 256
#: Column of scores whose buckets are known already.
_KNOWN = "_bucket"
NAN = float("nan")


def probability(column: Column) -> Column:
    """Column 1 of a pair of class probabilities."""
    return F.get(column, F.lit(1))


def _bucketed(df: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """df (p, ...) with (cuts), approximate quantiles of all scores, and (bucket), how many of them are not above p: buckets
    as full as each other whatever the scores are, logits, probabilities or saturated ones. Found by halving."""
    cuts = scores.where("p IS NOT NULL").agg(F.percentile_approx(F.col("p").cast("double"), [i / n for i in range(n)], 10 * n)).scalar()

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        below = F.col("p") >= F.get("cuts", middle)
        go = at["lo"] < at["hi"]
        return F.struct(F.when(go & below, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(go & ~below, middle).otherwise(at["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size("cuts"), F.lit(0)).alias("hi"))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), start, halve, lambda at: at["lo"])
    return df.withColumn("cuts", cuts).withColumn("bucket", place)


def curve(scores: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., p, n, k, kb, mb, pos, neg): distinct scores with weights, positives and negatives below, and totals."""
    by = list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col("y").cast("int")
    known = [_KNOWN] if _KNOWN in scores.columns else []
    folded = (
        scores.where("y IS NOT NULL AND p IS NOT NULL")
        .select(*by, F.col("p").cast("double").alias("p"), *known, y.alias("y"), w.alias("w"))
        .groupBy(*by, "p", *known)
        .agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("k"))
        .where("n > 0")
    )
    placed = folded.withColumnRenamed(_KNOWN, "bucket") if known else _bucketed(folded, scores, BUCKETS).drop("cuts")
    sums = placed.groupBy(*by, "bucket").agg(F.sum("k").alias("bk"), F.sum("n").alias("bn"))
    slice_, before = W.partitionBy(*by), W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        *by,
        "bucket",
        F.coalesce(F.sum("bk").over(before), F.lit(0.0)).alias("k0"),
        F.coalesce(F.sum(F.col("bn") - F.col("bk")).over(before), F.lit(0.0)).alias("m0"),
        F.sum("bk").over(slice_).alias("pos"),
        F.sum(F.col("bn") - F.col("bk")).over(slice_).alias("neg"),
    )
    within = W.partitionBy(*by, "bucket").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    below = placed.select(
        *by,
        "bucket",
        "p",
        "n",
        "k",
        F.coalesce(F.sum("k").over(within), F.lit(0.0)).alias("k1"),
        F.coalesce(F.sum(F.col("n") - F.col("k")).over(within), F.lit(0.0)).alias("m1"),
    )
    joined = below.join(starts, [*by, "bucket"])
    return joined.select(*by, "p", "n", "k", (F.col("n") - F.col("k")).alias("m"), (F.col("k0") + F.col("k1")).alias("kb"), (F.col("m0") + F.col("m1")).alias("mb"), "pos", "neg")


def _c(*names: str) -> list[Column]:
    return [F.col(c) for c in names]


def _totals() -> tuple[Column, Column]:
    return F.first("pos"), F.first("neg")


def _divide(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(empty))


def _both(value: Column, strict: bool) -> Column:
    pos, neg = _totals()
    missing = F.raise_error(F.lit("the metric needs both classes")).cast("double") if strict else F.lit(None).cast("double")
    return F.when((pos > 0) & (neg > 0), value).otherwise(missing)


def _sum_where(column: str, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0.0))


def confusion(threshold: float = 0.5) -> dict[str, Column]:
    above = F.col("p") > F.lit(threshold)
    return {"tn": _sum_where("m", ~above), "fp": _sum_where("m", above), "fn": _sum_where("k", ~above), "tp": _sum_where("k", above)}


def true_negatives(threshold: float = 0.5) -> Column:
    return confusion(threshold)["tn"]


def false_positives(threshold: float = 0.5) -> Column:
    return confusion(threshold)["fp"]


def false_negatives(threshold: float = 0.5) -> Column:
    return confusion(threshold)["fn"]


def true_positives(threshold: float = 0.5) -> Column:
    return confusion(threshold)["tp"]


def auroc(strict: bool = True) -> Column:
    """Area under the ROC curve; tied scores count half."""
    k, m, mb = _c("k", "m", "mb")
    pos, neg = _totals()
    return _both(F.sum(k * (mb + m / 2)) / (pos * neg), strict)


def partial_auroc(max_fpr: float = 0.1, strict: bool = True) -> Column:
    """Standardised area below max_fpr: 0.5 for chance, 1 for perfect."""
    if not 0 < max_fpr <= 1:
        raise ValueError("max_fpr must be in (0, 1]")
    k, m, kb, mb, pos, neg = _c("k", "m", "kb", "mb", "pos", "neg")
    f0, f1, t0, t1 = (neg - mb - m) / neg, (neg - mb) / neg, (pos - kb - k) / pos, (pos - kb) / pos
    width = F.greatest(F.least(f1, F.lit(max_fpr)) - f0, F.lit(0.0))
    end = t0 + (t1 - t0) * F.when(f1 > f0, width / F.when(f1 > f0, f1 - f0)).otherwise(F.lit(0.0))
    area = F.sum(F.when((pos > 0) & (neg > 0), width * (t0 + end) / 2))
    least = max_fpr * max_fpr / 2
    scaled = area / max_fpr if max_fpr == 1 else (1 + (area - least) / (max_fpr - least)) / 2
    return _both(scaled, strict)


def average_precision(strict: bool = True) -> Column:
    k, kb, mb, pos, neg = _c("k", "kb", "mb", "pos", "neg")
    precision = (pos - kb) / (pos - kb + neg - mb)
    return _both(F.sum(k * precision) / F.first("pos"), strict)


def accuracy(threshold: float = 0.5) -> Column:
    c = confusion(threshold)
    return (c["tp"] + c["tn"]) / F.sum("n")


def balanced_accuracy(threshold: float = 0.5) -> Column:
    """Mean recall over the classes there are."""
    c, (pos, neg) = confusion(threshold), _totals()
    recalls = _divide(c["tp"], pos) + _divide(c["tn"], neg)
    return recalls / ((pos > 0).cast("int") + (neg > 0).cast("int"))


def precision(threshold: float = 0.5) -> Column:
    c = confusion(threshold)
    return _divide(c["tp"], c["tp"] + c["fp"])


def recall(threshold: float = 0.5) -> Column:
    return _divide(confusion(threshold)["tp"], F.first("pos"))


def f1(threshold: float = 0.5) -> Column:
    c = confusion(threshold)
    return _divide(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"])


def brier_score() -> Column:
    p, k, m = _c("p", "k", "m")
    return F.sum(k * (p - 1) * (p - 1) + m * p * p) / F.sum("n")


def recall_at_fpr(fpr: float = 0.05) -> Column:
    """Recall above the ascending negative of rank min(int((1 - fpr) n), n - 1); 0 without positives, 1 without negatives."""
    if not 0 <= fpr <= 1:
        raise ValueError("fpr must be in [0, 1]")
    p, k, m, kb, mb, pos, neg = _c("p", "k", "m", "kb", "mb", "pos", "neg")
    rank = F.least(F.floor((F.lit(1.0) - F.lit(fpr)) * neg), neg - 1)
    at = (m > 0) & (mb + m >= rank + 1)
    found = F.min(F.when(at, F.struct(p, (pos - kb - k).alias("above"))))["above"]
    pos1, neg1 = _totals()
    return F.when(pos1 == 0, F.lit(0.0)).when(neg1 == 0, F.lit(1.0)).otherwise(found / pos1)


def fpr(threshold: float = 0.5) -> Column:
    return _divide(confusion(threshold)["fp"], F.first("neg"), NAN)


def fnr(threshold: float = 0.5) -> Column:
    return _divide(confusion(threshold)["fn"], F.first("pos"), NAN)


def _best(strict: bool) -> Column:
    p, k, m, kb, mb, pos, neg = _c("p", "k", "m", "kb", "mb", "pos", "neg")
    balanced = F.when((pos > 0) & (neg > 0), ((pos - kb - k) / pos + (mb + m) / neg) / 2)
    return F.max(F.struct(balanced.alias("value"), (-p).alias("minus")))


def max_balanced_accuracy_threshold(strict: bool = True) -> Column:
    """The lowest of the best thresholds among the scores."""
    return _both(-_best(strict)["minus"], strict)


def max_balanced_accuracy(strict: bool = True) -> Column:
    return _both(_best(strict)["value"], strict)


def mean_score() -> Column:
    p, n = _c("p", "n")
    return F.sum(p * n) / F.sum(n)


def std_score() -> Column:
    """Population standard deviation."""
    p, n = _c("p", "n")
    mean = F.sum(p * n) / F.sum(n)
    return F.sqrt(F.greatest(F.sum(p * p * n) / F.sum(n) - mean * mean, F.lit(0.0)))


def percentile(q: float = 95) -> Column:
    """Percentile of the scores by linear interpolation."""
    if not 0 <= q <= 100:
        raise ValueError("q must be in [0, 100]")
    p, n, kb, mb, pos, neg = _c("p", "n", "kb", "mb", "pos", "neg")
    at = F.lit(q / 100) * (pos + neg - 1)
    through = kb + mb + n
    low = F.min(F.when(through >= F.floor(at) + 1, p))
    high = F.min(F.when(through >= F.ceil(at) + 1, p))
    part = F.first(at - F.floor(at))
    return low + (high - low) * part


def weighted_error_rate(threshold: float = 0.5, fnr_weight: float = 5.0, fpr_weight: float = 50.0) -> Column:
    """Weighted mean of the two error rates; a missing class adds nothing."""
    c, (pos, neg) = confusion(threshold), _totals()
    return (_divide(c["fn"], pos) * fnr_weight + _divide(c["fp"], neg) * fpr_weight) / (fnr_weight + fpr_weight)


METRICS: dict[str, Callable[..., Column]] = {
    "auroc": auroc,
    "partial_auroc": partial_auroc,
    "accuracy": accuracy,
    "balanced_accuracy": balanced_accuracy,
    "precision": precision,
    "recall": recall,
    "f1": f1,
    "average_precision": average_precision,
    "brier_score": brier_score,
    "recall_at_fpr": recall_at_fpr,
    "fpr": fpr,
    "fnr": fnr,
    "max_balanced_accuracy_threshold": max_balanced_accuracy_threshold,
    "max_balanced_accuracy": max_balanced_accuracy,
    "mean_score": mean_score,
    "std_score": std_score,
    "percentile": percentile,
    "weighted_error_rate": weighted_error_rate,
    "true_negatives": true_negatives,
    "false_positives": false_positives,
    "false_negatives": false_negatives,
    "true_positives": true_positives,
}


def get_metric(name: str) -> Callable[..., Column]:
    if name not in METRICS:
        raise KeyError(f"unknown metric {name!r}; there are {sorted(METRICS)}")
    return METRICS[name]


def evaluate(scores: DataFrame, *, by: Sequence[str] = (), weight: str | None = None, **columns: Column) -> DataFrame:
    """One row per slice with the named metric columns, for example evaluate(s, auc=auroc(), f=f1(0.3))."""
    return curve(scores, by, weight).groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])


def optimal_threshold(scores: DataFrame, n_thresholds: int = 100, fnr_weight: float = 5.0, fpr_weight: float = 50.0) -> DataFrame:
    """(threshold, error): the first of n equally spaced thresholds in [0, 1] with the least weighted error."""
    step = F.lit(1.0 / (n_thresholds - 1)) if n_thresholds > 1 else F.lit(0.0)
    grid = lambda i: F.when(i >= n_thresholds - 1, F.lit(1.0)).otherwise(i.cast("double") * step)
    p = F.col("p")
    base = F.greatest(F.least(F.floor(p * (n_thresholds - 1)), F.lit(n_thresholds)), F.lit(0)) - 1
    passed = base
    for j in range(3):  # the arithmetic guess is off by one at most
        i = base + j
        passed = passed + ((i >= 0) & (i < n_thresholds) & (p > grid(i))).cast("int")
    passed = F.greatest(passed, F.lit(0))
    counts = (
        scores.where("y IS NOT NULL AND p IS NOT NULL")
        .groupBy(passed.cast("int").alias("passed"))
        .agg(F.sum(F.col("y").cast("double")).alias("k"), F.sum(1.0 - F.col("y")).alias("m"))
    )
    every = scores.sparkSession.range(n_thresholds + 1).select(F.col("id").cast("int").alias("passed"))
    filled = every.join(counts, "passed", "left").na.fill(0.0)
    up, whole = W.orderBy("passed").rowsBetween(W.unboundedPreceding, 0), W.partitionBy()  # n_thresholds + 1 rows
    misses = filled.select(
        "passed",
        F.sum("k").over(up).alias("fn"),
        (F.sum("m").over(whole) - F.sum("m").over(up)).alias("fp"),
        F.sum("k").over(whole).alias("pos"),
        F.sum("m").over(whole).alias("neg"),
    ).where(F.col("passed") < n_thresholds)
    error = (_divide(F.col("fn"), F.col("pos")) * fnr_weight + _divide(F.col("fp"), F.col("neg")) * fpr_weight) / (fnr_weight + fpr_weight)
    errors = misses.select(error.alias("error"), grid(F.col("passed")).alias("threshold"))
    best = F.min(F.struct("error", "threshold"))
    return errors.agg(best.alias("b")).select(F.col("b.threshold").alias("threshold"), F.col("b.error").alias("error"))


def bootstrap(scores: DataFrame, metric: Column, n: int = 1000, confidence: float = 0.95, seed: int = 0, bins: int = 2_000) -> DataFrame:
    """(point, lower, upper, valid): the metric and its percentile interval over n resamples.

    More than `bins` distinct scores are rounded down to that many quantiles for the resamples (not for the point), so that
    these have at most 2 * bins * n rows, however many scores there are.

    Rows are first folded to distinct (p, y); the copies of a row in a resample are drawn
    from the Poisson distribution of its count, by hash of row, resample and seed, so that
    resamples need no row numbers and no shuffle beyond that of their curves. Resamples of
    one class don't count; with fewer than n / 2 left the bounds are NaN. Build the metric
    with strict=False.
    """
    if not 0 < confidence < 1:
        raise ValueError("confidence must be in (0, 1)")
    held = scores.where("y IS NOT NULL AND p IS NOT NULL").select(F.col("p").cast("double").alias("p"), "y")
    if held.select("p").distinct().limit(bins + 1).count() > bins:
        rounded = F.get("cuts", F.greatest(F.col("bucket") - 1, F.lit(0)))
        held = _bucketed(held, held, bins).select(rounded.alias("p"), "y")
    folded = held.groupBy("p", "y").agg(F.count("*").alias("c"))
    folded = _bucketed(folded, folded, BUCKETS).drop("cuts").withColumnRenamed("bucket", _KNOWN)
    each = folded.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
    unit = lambda tag: (F.pmod(F.xxhash64("p", "y", "rep", F.lit(seed), F.lit(tag)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # Counts up to 30 by inversion of the distribution function, larger ones by its normal limit.
    steps = F.aggregate(
        F.sequence(F.lit(0), F.lit(80)),
        F.struct(F.exp(-F.col("c").cast("double")).alias("term"), F.exp(-F.col("c").cast("double")).alias("total"), F.lit(0).alias("k")),
        lambda a, i: F.struct(
            (a["term"] * F.col("c") / (i + 1)).alias("term"),
            (a["total"] + a["term"] * F.col("c") / (i + 1)).alias("total"),
            F.when(a["total"] < F.col("u"), i + 1).otherwise(a["k"]).alias("k"),
        ),
        lambda a: a["k"].cast("double"),
    )
    normal = F.sqrt(-2.0 * F.log(F.col("u"))) * F.cos(2 * 3.141592653589793 * F.col("v"))
    large = F.greatest(F.rint(F.col("c") + F.sqrt(F.col("c").cast("double")) * normal), F.lit(0.0))
    drawn = each.withColumn("u", unit("u")).withColumn("v", unit("v")).withColumn("w", F.when(F.col("c") <= 30, steps).otherwise(large))
    values = evaluate(drawn.where("w > 0"), by=["rep"], weight="w", value=metric).where("value IS NOT NULL AND NOT isnan(value)")
    low, high = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    bounds = values.agg(F.count("*").alias("valid"), F.percentile("value", F.lit(low)).alias("lower"), F.percentile("value", F.lit(high)).alias("upper"))
    enough = F.col("valid") >= n / 2
    point = evaluate(scores, point=metric).scalar()
    nan = F.lit(NAN)
    return bounds.select(point.alias("point"), F.when(enough, F.col("lower")).otherwise(nan).alias("lower"), F.when(enough, F.col("upper")).otherwise(nan).alias("upper"), "valid")
