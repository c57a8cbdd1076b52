import math
import random

import numpy as np
import pytest

from sondar.operators import metrics as M


def scores(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


def value(spark, y, p, metric):
    return M.evaluate(scores(spark, y, p), v=metric).first().v


PERFECT = ([1, 1, 1, 0, 0, 0], [0.9, 0.8, 0.7, 0.3, 0.2, 0.1])


def test_perfect_scores(spark):
    row = M.evaluate(scores(spark, *PERFECT), a=M.auroc(), b=M.partial_auroc(), c=M.average_precision(), d=M.accuracy(), e=M.precision(), f=M.recall(), g=M.f1()).first()
    assert all(abs(x - 1) < 1e-12 for x in row)


def test_ties_and_simple_values(spark):
    assert value(spark, PERFECT[0], [0.5] * 6, M.auroc()) == 0.5
    c = M.evaluate(scores(spark, [0, 0, 1, 1], [0.1, 0.7, 0.4, 0.9]), **M.confusion()).first()
    assert tuple(c) == (1, 1, 1, 1)
    assert value(spark, [0, 1], [0.25, 0.75], M.brier_score()) == 0.0625
    assert value(spark, [0, 0, 1, 1], [0.3, 0.6, 0.4, 0.9], M.weighted_error_rate()) == 0.5
    assert abs(value(spark, [0] * 4, [0.6] * 4, M.weighted_error_rate()) - 50 / 55) < 1e-12
    assert abs(value(spark, [1] * 4, [0.1] * 4, M.weighted_error_rate()) - 5 / 55) < 1e-12
    assert value(spark, [1, 1, 0, 0], [0.9, 0.6, 0.4, 0.1], M.accuracy(0.8)) == 0.75
    assert value(spark, [0, 0], [0.1, 0.2], M.recall_at_fpr()) == 0
    assert value(spark, [1, 1], [0.1, 0.2], M.recall_at_fpr()) == 1
    assert math.isnan(value(spark, [1, 1], [0.1, 0.2], M.fpr()))
    assert value(spark, range(9), [0.1 * k for k in range(1, 10)], M.percentile(50)) == pytest.approx(0.5)
    assert value(spark, [0] * 9, [0.1 * k for k in range(1, 10)], M.percentile(90)) == pytest.approx(0.82)


def test_one_class_is_an_error_or_null(spark):
    with pytest.raises(Exception, match="both classes"):
        value(spark, [1, 1], [0.1, 0.2], M.auroc())
    assert value(spark, [1, 1], [0.1, 0.2], M.auroc(strict=False)) is None


def test_against_brute_force(spark):
    rng = random.Random(3)
    y = [rng.randint(0, 1) for _ in range(300)]
    p = [round(min(1, max(0, rng.gauss(0.4 + 0.2 * a, 0.25))), 2) for a in y]
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    pairs = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert value(spark, y, p, M.auroc()) == pytest.approx(pairs)
    best = max((np.mean([a > t for a in pos]) + np.mean([b <= t for b in neg])) / 2 for t in set(p))
    assert value(spark, y, p, M.max_balanced_accuracy()) == pytest.approx(best)
    grid = np.linspace(0, 1, 100)
    errors = [(5 * np.mean(np.array(pos) <= t) + 50 * np.mean(np.array(neg) > t)) / 55 for t in grid]
    row = M.optimal_threshold(scores(spark, y, p)).first()
    assert row.threshold == pytest.approx(grid[int(np.argmin(errors))]) and row.error == pytest.approx(min(errors))
    assert value(spark, y, p, M.std_score()) == pytest.approx(np.std(p))
    thr = sorted(neg)[min(int(0.95 * len(neg)), len(neg) - 1)]
    assert value(spark, y, p, M.recall_at_fpr(0.05)) == pytest.approx(np.mean([a > thr for a in pos]))


def test_slices_equal_their_own_scores(spark):
    df = spark.createDataFrame([(k % 2, int(k % 3 == 0), (k * 7 % 10) / 10) for k in range(40)], "s int, y int, p double")
    both = {r.s: r.a for r in M.evaluate(df, by=["s"], a=M.auroc()).collect()}
    for s in (0, 1):
        assert both[s] == pytest.approx(M.evaluate(df.where(f"s = {s}"), a=M.auroc()).first().a)


def test_bootstrap_is_reproducible_and_brackets_the_point(spark):
    s = scores(spark, [0, 1] * 50, [((k * 37) % 100) / 100 for k in range(100)])
    a, b = (M.bootstrap(s, M.accuracy(), n=60, seed=1).first() for _ in range(2))
    assert a == b and a.lower <= a.point <= a.upper and a.valid == 60


def test_empty_and_null_scores(spark):
    df = spark.createDataFrame([(1, None), (None, 0.5)], "y int, p double")
    assert M.evaluate(df, a=M.accuracy()).first().a is None


def test_logits_and_saturated_scores_fill_all_buckets(spark):
    data = [(i % 2, (i - 500) / 7.0) for i in range(1000)] + [(1, 1 - 1e-12 * i) for i in range(1000)]
    s = spark.createDataFrame(data, "y int, p double")
    sizes = [r["count"] for r in M._bucketed(s, s, 16).groupBy("bucket").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 200
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(M.evaluate(s, a=M.auroc()).first().a - want) < 1e-9


def test_bootstrap_of_many_scores_rounds_them(spark):
    s = spark.createDataFrame([(int(i % 100 < 40 + i // 50), i / 1000) for i in range(1000)], "y int, p double")
    fine, rough = (M.bootstrap(s, M.auroc(strict=False), n=60, seed=1, bins=b).first() for b in (2000, 50))
    assert fine.point == rough.point and abs(fine.lower - rough.lower) < 0.02 and abs(fine.upper - rough.upper) < 0.02
    a = M.bootstrap(s, M.accuracy(0.5), n=40, seed=1, bins=50).first()
    assert a.lower - 0.02 <= a.point <= a.upper + 0.02
