import os

import pytest

from sondar.llm import bpe, budget

PATH = bpe.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="needs the vocabulary files")
SCHEMA = "source_table string, record_id string, source string, language string, domain string, text string"


def snapshot(spark, data):
    return spark.createDataFrame([("t", *r) for r in data], SCHEMA)


def cube(state):
    return {tuple(r[c] for c in budget.CELL): (r.records, r.tokens) for r in state.cube.collect()}


FIRST = [("1", "a", "en", None, "one two"), ("2", "a", "en", None, "one two"), ("3", "b", "fr", "x", None), ("4", "b", "fr", "x", ""), ("5", None, "und", None, "gone soon")]
SECOND = [("1", "a", "en", None, "one two three"), ("2", "b", "en", None, "one two"), ("3", "b", "fr", "x", None), ("4", "b", "fr", "x", ""), ("6", "a", "en", "y", "new text")]


def test_deltas_equal_a_fresh_count(spark):
    old = budget.update(snapshot(spark, FIRST)).kept()
    assert cube(old) == {("t", "a", "en", None): (2, 4), ("t", "b", "fr", "x"): (2, 0), ("t", None, "und", None): (1, 2)}
    new = budget.update(snapshot(spark, SECOND), old)
    assert cube(new) == cube(budget.update(snapshot(spark, SECOND)))
    marks = new.counts.groupBy("content", "tokenizer").count()
    assert marks.where("count > 1").count() == 0 and new.counts.count() == 5
    again = budget.update(snapshot(spark, SECOND), new.kept())
    assert cube(again) == cube(new)


def test_empty_and_everything_removed(spark):
    old = budget.update(snapshot(spark, FIRST)).kept()
    assert cube(budget.update(snapshot(spark, []), old)) == {} == cube(budget.update(snapshot(spark, [])))


def test_totals(spark):
    rows = budget.totals(budget.update(snapshot(spark, SECOND)).cube).collect()
    by = lambda name, column: {r[column]: (r.records, r.tokens) for r in rows if r.by == name}
    assert by("table", "source_table") == {"t": (5, 7)}
    assert by("language", "language") == {"en": (3, 7), "fr": (2, 0)}
    assert by("domain", "domain") == {None: (2, 5), "x": (2, 0), "y": (1, 2)}


def test_earlier_runs(spark):
    data = [
        (1, "LMSYS-chat", ["a", "b"], [0, 3, 7], "2024-01-01"), (1, "lmsys_chat", ["a", "b"], [0, 3, 7], "2024-02-01"),
        (2, "alpaca", ["5", "6"], [0, 4], "2024-01-01"), (3, "alpaca", ["7"], None, "2024-01-01"), (4, None, None, [0], "2024-01-01"),
    ]
    df = spark.createDataFrame(data, "batch_id bigint, dataset string, record_ids array<string>, offsets array<bigint>, ingested_at string")
    assert sorted(map(tuple, budget.earlier_runs(df).collect())) == [("dialogues", "5", 4), ("lmsys_chat", "a", 3), ("lmsys_chat", "b", 4)]
