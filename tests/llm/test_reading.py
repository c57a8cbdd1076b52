from sondar.llm import reading as R

PLAIN = "The cat sat on the mat. We like the red ball. She had a nap. "
MIDDLE = "The report explains how the new filter works. Most users can change the setting themselves. "
HARD = "Epistemological foundationalism presupposes counterfactual identifiability. Deontological constraints remain contentious. "


def graded(spark):
    return spark.createDataFrame([(t * k, b) for b, t in zip(R.BANDS, (PLAIN, MIDDLE, HARD)) for k in (4, 5, 6)] + [(None, "basic")], "text string, band string").selectExpr("1 AS grade_id", "*")


def test_levels(spark):
    docs = [
        (1, PLAIN * 8), (2, HARD.upper() * 6), (3, MIDDLE * 6), (4, None), (5, ""), (6, PLAIN), (7, "Никто пока не знает, почему дети пошли в сад. " * 20),
        (8, PLAIN * 8 + "\n```python\nfor i in range(3):\n    print(i)\n```\n| a | b |\nНикто пока не знает."), (9, HARD * 8 + "\n" + PLAIN), (1, PLAIN * 8),
        (10, "zzz qqq www " * 40), (11, PLAIN * 3000),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS band", "1 AS words")
    assert sorted(map(tuple, R.found(df, graded(spark)).collect())) == [(1, "basic"), (2, "advanced"), (8, "basic"), (9, "advanced"), (11, "basic")]
    assert {r.doc_id: r.band for r in R.levels(df, graded(spark)).collect()}[3] == "intermediate"
    assert R.found(df.where("false"), graded(spark)).count() == 0
    assert R.found(df, graded(spark).where("false")).count() == 0


def test_coverage_rank_is_the_smallest_top_that_covers():
    ranks = R.vocabularies([("a a a b b c " * 10, "basic"), ("x y z " * 10, "advanced"), ("m", "intermediate")])
    assert ranks["basic"] == {"a": 1, "b": 2, "c": 3}
    words, _, basic, middle, hard = R.Reader(ranks).features("a b b c c c " * 10)
    assert (words, basic, middle, hard) == (60, 3, 15, 15)
    assert R.Reader(ranks).features("a a b " * 20)[2] == 1


def test_every_document_has_a_row(spark):
    df = spark.createDataFrame([(1, PLAIN * 8), (2, None), (3, "short"), (3, "short")], "doc_id bigint, text string")
    got = {r.doc_id: (r.band, r.words is None) for r in R.profile(df, graded(spark)).collect()}
    assert got == {1: ("basic", False), 2: (None, True), 3: (None, True)}


def test_more_graded_samples_than_are_read(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_GRADED", 6)
    more = graded(spark).unionByName(graded(spark).selectExpr("grade_id", "concat(text, ' The end.') AS text", "band"))
    df = spark.createDataFrame([(1, PLAIN * 8)], "doc_id bigint, text string")
    assert R.levels(df, more).count() == 1
