import json

import pytest
from pyspark.sql import functions as F

from sondar.functions.text import language_code, letters_digits, split_name
from sondar.operators import dataset as D
from sondar.sources import builders as B
from sondar.sources import io, registry, storage
from tests.conftest import rows
from tests.test_sequences import layered, vecs


def labelled(spark, n=50, pos=20):
    return spark.createDataFrame([(i, int(i < pos)) for i in range(n)], "sample_id bigint, label int")


@pytest.mark.parametrize("parts", [1, 7])
def test_sampling_does_not_depend_on_partitions(spark, parts):
    df = labelled(spark)
    again = D.sample(df.repartition(parts), 11, stratified=True)
    assert rows(again) == rows(D.sample(df, 11, stratified=True))
    assert [r["count"] for r in again.groupBy("label").count().orderBy("label").collect()] == [7, 4]
    assert D.sample(df, 500).count() == 50 and D.sample(df, 7).count() == 7


def test_split_counts(spark):
    df = labelled(spark)
    parts = {(r.label, r.part): r["count"] for r in D.split(df, 0.7, stratified=True).groupBy("label", "part").count().collect()}
    assert parts == {(0, "train"): 21, (0, "test"): 9, (1, "train"): 14, (1, "test"): 6}
    assert D.split(df, 0.5).where("part = 'train'").count() == 25


def test_gather_repeats_and_range(spark):
    got = D.gather(labelled(spark), [3, -1, 3]).orderBy("idx").collect()
    assert [r.sample_id for r in got] == [3, 49, 3]
    with pytest.raises(IndexError):
        D.gather(labelled(spark), [50])


def test_dedup_union_labels(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 1), (2, None, 1), (3, None, 1), (4, "a", 0)], "sample_id bigint, prompt string, label int")
    assert [r.sample_id for r in D.drop_repeats(df, ["prompt", "label"], "sample_id").orderBy("sample_id").collect()] == [0, 2, 4]
    u = D.union(df.withColumn("difficulty", F.lit("easy")), df.withColumn("category", F.lit("safety")), "a", "b")
    assert {(r.source, r.difficulty, r.category) for r in u.collect()} == {("a", "easy", None), ("b", None, "safety")}
    words = spark.createDataFrame([("Positive", 1), ("neg", 0), ("TRUE", 1), ("2", 0), ("1", 1)], "v string, want int")
    assert all(r.got == r.want for r in words.select(D.coerce_label(F.col("v")).alias("got"), "want").collect())


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße 12!", "en_GB", " Dev "), (None, "?", None), ("", "Português", "Held-Out")], "t string, l string, s string")
    got = df.select(letters_digits(F.col("t")).alias("t"), language_code(F.col("l")).alias("l"), split_name(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("strasse12", "en", "validation"), (None, None, None), ("", "pt", "test")]


def test_builders(spark):
    df = spark.createDataFrame([(["q one two three four five six"], "x</s>y</s>z")], "c array<string>, t string")
    head, tail = B.head_and_tail(F.get("c", F.lit(0)))
    before, rest = B.before_last(F.col("t"), "</s>")
    r = df.select(head.alias("h"), tail.alias("t"), before.alias("b"), rest.alias("r")).first()
    assert tuple(r) == ("q one", " two three four five six", "x</s>y", "</s>z")
    text = spark.createDataFrame([(1, "noise\nUSER: hi\nthere\nASSISTANT: yo")], "id int, text string")
    got = B.transcript(text, "id", "text", {"USER:": "user", "ASSISTANT:": "assistant"}).first().messages
    assert [tuple(m) for m in got] == [("user", "hi\nthere"), ("assistant", "yo")]
    roll = spark.createDataFrame([([("user", "q"), ("assistant", "")], ["a", "b", "c"], ["7", "1", "4"])], "m array<struct<role:string,content:string>>, o array<string>, g array<string>")
    out = B.rollouts(roll, "m", "o", "g").orderBy("rollout").collect()
    assert [(r.label, r.messages[-1].content, len(r.messages)) for r in out] == [(1, "a", 2), (0, "b", 2)]
    ids = spark.createDataFrame([([("user", "[ID] x"), ("user", "y"), ("user", "[ID] z")],)], "m array<struct<role:string,content:string>>")
    assert [m.content for m in B.numbered_placeholders(ids, "id", "m", "[ID]").first().m] == ["1 x", "y", "2 z"]


def test_records_round_trip(spark, tmp_path):
    records = [
        {"messages": [{"role": "user", "content": "hi"}], "label": 1, "metadata": {"source": "unit", "id": "n"}, "id": "a"},
        {"messages": [{"from": "human", "value": "yo"}], "label": "negative", "metadata": {"source": "unit"}, "id": "b"},
    ]
    df = io.from_records(spark, records)
    got = io.metadata_columns(df, ["id", "source"]).orderBy("sample_id").collect()
    assert [(r.label, r.id, r.source) for r in got] == [(1, "a", "unit"), (0, "b", "unit")]
    with pytest.raises(KeyError):
        io.from_records(spark, [{"label": 1}])
    with pytest.raises(TypeError):
        io.from_records(spark, [{"messages": [], "label": 1, "metadata": 3}])
    path = tmp_path / "x.jsonl"
    path.write_text("\n\n".join(map(json.dumps, records)))
    again = io.from_json_lines(spark, str(path)).orderBy("sample_id").collect()
    assert [(r.dataset, r.label, r.metadata["id"], r.messages[0].role) for r in again] == [("x", 1, "a", "user"), ("x", 0, "b", "user")]


def test_registry(spark, tmp_path):
    assert len(registry.list_datasets()) >= 133 and set(registry.list_topics()) <= set(registry.TOPICS)
    with pytest.raises(KeyError):
        registry.info("nothing")
    with pytest.raises(FileNotFoundError):
        registry.load(spark, "alpaca", str(tmp_path))
    spark.createDataFrame([("do it", "done"), (None, "x")], "instruction string, output string").write.parquet(str(tmp_path / "alpaca-cleaned"))
    got = registry.load(spark, "alpaca", str(tmp_path)).collect()
    assert [[tuple(m) for m in r.messages] for r in got] == [[("user", "do it"), ("assistant", "done")]] and got[0].label == 0
    conv = "conversation array<struct<role:string,content:string>>, annotations array<struct<span:string,label:string,index:int>>, model string"
    item = ([("user", "p"), ("assistant", "abc def")], [("abc", "Not Supported", 0), None, ("zzz", "Supported", 1)], "m")
    spark.createDataFrame([item], conv).write.parquet(str(tmp_path / "longfact-annotations"))
    assert registry.load(spark, "longfact", str(tmp_path)).first().label == 1
    assert registry.register_manifest([{"id": 5, "name": "x"}, {"id": 6, "name": "y"}], ["6"]) == ["sparse_probing_5_x"]


def test_storage(spark, tmp_path):
    a, path = layered(spark), str(tmp_path / "acts")
    storage.save(a, path)
    assert storage.has_store(path) and not storage.has_store(str(tmp_path))
    back = storage.load(spark, path, layers=2)
    assert vecs(back.mean("s").data) == vecs(a.select_layer(2).mean("s").data)
    parts = [sorted(r.sample_id for r in ids.collect()) for _, ids in storage.stream(spark, path, chunk_tokens=5)]
    assert parts == [[0, 1], [2]]
    with pytest.raises(ValueError):
        storage.load(spark, path, layers=99)
    with pytest.raises(TypeError):
        storage.save(A_with_bad_metadata(a), path)


def A_with_bad_metadata(a):
    from dataclasses import replace

    return replace(a, metadata={"x": object()})
