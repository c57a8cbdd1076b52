import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sondar.llm import formats, mixing, overlap
from tests.conftest import rows

WILD = "record_id bigint, prompt string, prompt_harm_label string, id bigint, n bigint"
MSG = "array<struct<role:string,content:string>>"


def test_format_copies(spark):
    data = [
        (5, "Hello, World!", "harmful", 1, 1), (3, "hello   world", "HARMFUL", 1, 1), (4, "hello world", None, 1, 1), (9, "HELLO-WORLD", "unharmful", 1, 1),
        (1, None, None, 1, 1), (2, None, None, 1, 1), (7, "", None, 1, 1), (8, "...", None, 1, 1), (10, "Straße", None, 1, 1), (11, "STRASSE", None, 1, 1),
        (3, "hello   world", "HARMFUL", 1, 1),
    ]
    w = spark.createDataFrame(data, WILD)
    assert rows(formats.copies(formats.wildguard_cells(w)).distinct()) == [(10, 11), (3, 5), (4, 9), (7, 8)]


def test_json_copies(spark):
    base = {"messages": [{"role": "user", "content": "A b!"}], "label": 1, "metadata": {"batch": 6, "x": None}}
    turned = '{"metadata": {"x": null, "batch": 6.0}, "label": 1e0, "messages": [{"content": "a\\tB", "role": "USER"}]}'
    others = [{**base, "label": "1"}, {**base, "label": True}, {**base, "metadata": {"batch": 6}}, {**base, "messages": base["messages"] * 2}]
    texts = [json.dumps(base), turned, json.dumps(base)[:-3], None, "", *map(json.dumps, others), '{"a": NaN}', '{"a": NaN}', "[" * 5000, '"\\ud800"', '""']
    df = spark.createDataFrame(list(enumerate(texts)), "raw_id bigint, payload string")
    assert set(rows(formats.copies(formats.json_cells(df, "raw_id", "payload")))) == {(0, 1), (len(texts) - 2, len(texts) - 1)}
    empty = df.where("false")
    assert formats.copies(formats.json_cells(empty, "raw_id", "payload")).count() == 0


def test_group_sizes_count_every_record(spark, tmp_path):
    from sondar.llm import corpus

    w = [(1, "a b", None), (2, "A, b!", None), (3, None, None), (4, None, "harmful"), (5, "c", None)]
    r = [(1, '{"a": 1}'), (2, '{"a": 1.0}'), (3, '{"a": '), (4, None), (5, '{"a": '), (5, '{"a": ')]
    spark.createDataFrame(w, "record_id bigint, prompt string, prompt_harm_label string").write.parquet(f"{tmp_path}/wildguard_mix.parquet")
    spark.createDataFrame(r, "raw_id bigint, payload string").write.parquet(f"{tmp_path}/raw_records.parquet")
    got = corpus.p3_group_sizes(spark, str(tmp_path)).select("source_table", "keep_id", "copies")
    want = [("wildguard_mix", *x) for x in ((1, 2), (3, 1), (4, 1), (5, 1))] + [("raw_records", *x) for x in ((1, 2), (3, 1), (4, 1), (5, 1))]
    assert rows(got) == sorted(want, key=repr)


def dialogues(spark, data):
    return spark.createDataFrame([(i, s, [("user", t)] if t is not None else None, "x") for i, s, t in data], f"sample_id bigint, split string, messages {MSG}, words string")


def edit(words, n, rng):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = "zz" + str(rng.random())[2:8]
    return words


def brute(data, tolerance=10):
    side = {"train": 0, "training": 0, "test": 1, "dev": 1}
    held = [(i, side[s.lower().strip()], t.lower().replace("!", "").split()) for i, s, t in data if s and s.lower().strip() in side and t and t.split()]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    return sorted((min(i, j), max(i, j)) for (i, s, a), (j, u, b) in itertools.combinations(held, 2) if s != u and i != j and distance(a, b) <= max(len(a), len(b)) // tolerance)


def test_overlaps_against_brute_force(spark):
    rng, data = random.Random(5), []
    vocabulary = [f"w{k}" for k in range(400)]
    for k in range(30):
        n = rng.choice([3, 9, 14, 22, 35, 38, 60, 110])
        base = [rng.choice(vocabulary) for _ in range(n)]
        data.append((10 * k, "train", " ".join(base)))
        data.append((10 * k + 1, "Test ", " ".join(base).upper() + "!"))
        data.append((10 * k + 2, "dev", " ".join(edit(base, n // 10, rng))))
        data.append((10 * k + 3, "dev", " ".join(edit(base, min(n, n // 10 + 2), rng))))
        data.append((10 * k + 4, "training", " ".join(base[: n // 2] + ["extra"] + base[n // 2 :]) if n >= 10 else None))
    data += [(900, None, data[0][2]), (901, "other", data[0][2]), (902, "test", ""), (903, "train", " "), (904, "train", None), (905, "test", None)]
    want, got = set(brute(data)), {tuple(r) for r in overlap.found(dialogues(spark, data)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert {p for p in want if p not in got} == want - got and len(want) > 60


def test_every_pair_at_the_tolerance_is_found(spark):
    rng, data, want = random.Random(11), [], set()
    for k, n in enumerate([9, 10, 10, 11, 18, 19, 20, 27, 36, 45, 45, 50, 50, 60, 60, 71, 72, 80, 100, 120, 150, 300] * 5):
        base = [f"v{rng.randrange(4000)}" for _ in range(n)]
        even = list(base)
        for j in range(n // 10):  # spread as far apart as can be
            even[min(n - 1, (j + 1) * n // (n // 10 + 1))] = f"even{k}x{j}"
        shorter = list(base)
        for j in sorted(rng.sample(range(n), n // 10), reverse=True):
            del shorter[j]
        longer = list(base)
        for j in range(n // 9):
            longer.insert(rng.randrange(len(longer) + 1), f"more{k}x{j}")
        for j, words in enumerate((base, edit(base, n // 10, rng), even, shorter, longer)):
            data.append((10 * k + j, "test" if j else "train", " ".join(words)))
            if j:
                want.add((10 * k, 10 * k + j))
    assert want <= {tuple(r) for r in overlap.found(dialogues(spark, data)).collect()}


def test_copies_of_one_wording_meet_every_partner(spark):
    data = [(i, "train", "the same words all over " * 3) for i in range(40)] + [(100, "test", "The same, words all over " * 3)]
    assert overlap.found(dialogues(spark, data)).count() == 40
    assert overlap.report(dialogues(spark, data).withColumn("d", F.lit("a")), F.col("d")).first().pairs == 40
    assert overlap.found(dialogues(spark, [])).count() == 0


@pytest.mark.parametrize("digits", [1, 3])
def test_mixture(spark, digits):
    data = [("big", i, 100) for i in range(900)] + [("small", 10_000 + i, 50) for i in range(60)] + [(None, 1, 5), ("unknown", 2, 5), ("zero", 3, 0)]
    r = spark.createDataFrame(data, "dataset string, id bigint, size bigint")
    t = spark.createDataFrame([("big", 0.5, 2), ("small", 0.5, 3), ("absent", 0.5, 3), ("unknown", None, 3), ("zero", 0.2, 1)], "dataset string, target_share double, max_repeats int")
    m = mixing.mixture(r, t, digits=digits)
    sums = {x.dataset: (x.n, x.most, x.size) for x in m.groupBy("dataset").agg(F.sum("copies").alias("n"), F.max("copies").alias("most"), F.sum(F.col("copies") * F.col("size")).alias("size")).collect()}
    total = 900 * 100 + 60 * 50
    assert abs(sums["big"][2] - total / 2) <= 100 and sums["small"] == (180, 3, 9000) and set(sums) == {"big", "small"}
    assert rows(m) == rows(mixing.mixture(r.repartition(5), t))
    assert mixing.mixture(r.where("false"), t).count() == 0
    shares = {x.dataset: x.actual for x in mixing.report(r, t).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-5


def test_a_small_total_takes_each_record_at_most_once(spark):
    r = spark.createDataFrame([("a", i, 10) for i in range(100)], "dataset string, id bigint, size bigint")
    t = spark.createDataFrame([("a", 1.0, 5)], "dataset string, target_share double, max_repeats int")
    m = mixing.mixture(r, t, total=300)
    assert m.count() in (30, 31) and m.agg(F.max("copies")).first()[0] == 1


def test_large_groups_and_the_rest_are_joined_alike(spark, monkeypatch):
    data = [(i, "same words" if i % 3 else f"w{i // 6}", None, 1, 1) for i in range(200)]
    w = spark.createDataFrame(data, WILD)
    want = rows(formats.copies(formats.wildguard_cells(w)))
    monkeypatch.setattr(formats, "LARGE", 2)
    assert rows(formats.copies(formats.wildguard_cells(w))) == want and len(want) > 150


def test_identifiers_are_integers_of_field_and_canonical_value():
    d = formats.Dictionary()
    a = d.identifier("prompt", "string", "Hello, World!")
    assert a == d.identifier("prompt", "string", "hello   world") != d.identifier("label", "string", "hello world")
    assert formats.compact(d.tuple_of([("a", "string", "x"), ("b", "string", "Y")])) == formats.compact(d.tuple_of([("b", "string", "y"), ("a", "string", " X")]))
    assert d.identifier("a", "number", "1e1") != d.identifier("a", "string", "1e1")
    assert formats.canonical("Ａb-ß İ 2²") == formats.canonical("ａB SS i̇2")


def test_split_digests_lose_no_pair(spark, monkeypatch):
    """A third of all records open with the same words, at many lengths and edits; every digest counts as common."""
    rng, data = random.Random(21), []
    opening = [f"open{k}" for k in range(12)]
    for k in range(60):
        n = rng.choice([5, 14, 20, 33, 50, 90, 140])
        base = (opening + [f"v{rng.randrange(3000)}" for _ in range(n)])[: max(n, 3)]
        data.append((10 * k, "train", " ".join(base)))
        data.append((10 * k + 1, "test", " ".join(edit(base, len(base) // 10, rng))))
        data.append((10 * k + 2, "test", " ".join(edit(base, min(len(base), len(base) // 10 + 2), rng))))
    monkeypatch.setattr(overlap, "SAMPLE", 1)
    monkeypatch.setattr(overlap, "MANY_PAIRS", 1e18)
    want = sorted(tuple(r) for r in overlap.found(dialogues(spark, data)).collect())
    plain = {(r.train_id, r.held_out_id): r.overlap for r in overlap.overlaps(overlap.dialogue_records(dialogues(spark, data))).collect()}
    monkeypatch.setattr(overlap, "MANY_PAIRS", 1)
    assert sorted(tuple(r) for r in overlap.found(dialogues(spark, data)).collect()) == want == brute(data)
    split = {(r.train_id, r.held_out_id): r.overlap for r in overlap.overlaps(overlap.dialogue_records(dialogues(spark, data))).collect()}
    assert set(split) == set(plain) and all(abs(split[p] - plain[p]) < 1e-9 for p in plain)


def test_partners_are_counted_from_wordings(spark):
    same = "these words are the same in all of them"
    data = [(i, "train", same) for i in range(5)] + [(3, "test", same), (100, "dev", same), (101, "dev", same), (102, "dev", "other words altogether here now")]
    got = sorted(map(tuple, overlap.partners(overlap.dialogue_records(dialogues(spark, data))).collect()))
    assert got == [(3, 4), (100, 5), (101, 5)]
    pairs = overlap.overlaps(overlap.dialogue_records(dialogues(spark, data))).select("train_id", "held_out_id").distinct().count()
    report = {(r.split, r.dataset): (r.pairs, r.records) for r in overlap.report(dialogues(spark, data).withColumn("d", F.lit("a")), F.col("d")).collect()}
    assert report == {("test", "a"): (4, 1), ("validation", "a"): (10, 2)} and pairs == 14


def test_records_of_one_repeated_word(spark):
    data = [(1, "train", "ha " * 3000), (2, "test", "HA " * 3000), (3, "test", "ha " * 2800), (4, "test", "ha " * 2600)]
    assert [tuple(r) for r in overlap.found(dialogues(spark, data)).orderBy("sample_id_b").collect()] == [(1, 2), (1, 3)]
