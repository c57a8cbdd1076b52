import pytest
from pyspark.sql import functions as F

from sondar.llm import language
from sondar.llm import pairs as P
from tests.llm.test_language import TEXTS

MSG = "array<struct<role:string,content:string>>"


@pytest.mark.parametrize("text", [None, "", " \n\t", "...", "—", "{}", '""', "<p></p>", "```\n```", "N/A", "[no response]", "(No answer)", "​", "null"])
def test_empty(text):
    assert P.is_empty(text)


@pytest.mark.parametrize("text", ["42", "no", "ok", "A", "中", "`x`"])
def test_not_empty(text):
    assert not P.is_empty(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("It is done.", "done"), ("It is done. And then the", "broken"), ("He said “so.”", "done"), ("Fine. 🙂", "done"), ("42", "done"), ("about 2672", "done"),
        ("All good.\n\n-- the desk", "done"), ("Text here.\nTotal: 42 rows", "done"), ("Text.\n```python\nx = [1,", "broken"), ("Text.\n```\nx\n```", "done"),
        ("- one is here.\n- two is", "broken"), ("- one is here\n- two is there", "doubtful"), ("One. Two is:", "broken"), ("One. Two (", "broken"),
        ("这是第一句。这是第二", "broken"), ("这是第一句。", "done"), ("| a | b |\n|---|---|\n| 1 | 2 |", "done"), ("Hope this helps :)", "done"),
        ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen", "doubtful"),
    ],
)
def test_endings(text, want):
    assert P.ending(text) == want


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with that.", "Sorry, my rules stop me at this point. I hope you understand.", "Lo siento, pero no puedo ayudarte con eso.", "抱歉，我无法帮助您完成这个请求。请咨询专业人士。", "Dabei kann ich nicht helfen."])
def test_refusals(text):
    assert P.is_refusal(text)


@pytest.mark.parametrize("text", ["Sorry for the wait. Here is the plan.", 'The bot said "I can\'t help with that" here, which was wrong.', "I can't be certain, but it works.", "I can't help with that part. " + "However the first step is to open the file and read all of it twice before lunch. " * 3])
def test_no_refusals(text):
    assert not P.is_refusal(text)


def test_copies():
    q = "Can you tell me what happens to the spam filter now? It was slow for all of us last week."
    assert P.is_copy(q, q.upper())
    assert P.is_copy(q, "It was slow — for all of us, last week!")
    assert not P.is_copy(q, "> " + q + "\n\nIt was replaced by another one on Monday, so nothing happens to it any more.")
    assert not P.is_copy(q, "")
    assert P.is_copy(q, q + " " + q)


def dialogue(spark, data):
    return spark.createDataFrame([(i, "Set-A", m, {}) for i, m in data], f"sample_id bigint, dataset string, messages {MSG}, metadata map<string,string>").withColumn("defects", F.lit(1))


def test_found(spark):
    english, german = TEXTS["en"], TEXTS["de"]
    cut = "- the quick brown fox jumps over the lazy"
    data = [
        (1, [("user", english), ("gpt", None)]),
        (2, [("human", english), ("assistant", german)]),
        (3, [("user", english + " Please answer in German."), ("assistant", german)]),
        (4, [("user", english), ("system", "x"), ("assistant", "")]),
        (5, [("user", None), ("assistant", german)]),
        (6, [("user", english), ("assistant", english)]),
        (7, [("user", english), ("assistant", german + " Und dann kam")]),
        (8, [("user", english), ("assistant", "```\nder die das und nicht ein\n```")]),
        (9, []), (10, None), (11, [("assistant", "")]),
        (12, [("user", english), ("assistant", cut)]),
        (13, [("user", english), ("assistant", cut + " dog of the old house")]),
        (13, [("user", english), ("assistant", cut + " dog of the old house")]),
    ]
    got = sorted(map(tuple, P.found(dialogue(spark, data), language.seed_dictionaries()).collect()))
    assert got == [(1, 1, "empty"), (2, 1, "other_language"), (6, 1, "copies_question"), (7, 1, "other_language"), (7, 1, "truncated"), (12, 1, "truncated")]
    assert P.found(dialogue(spark, []), language.seed_dictionaries()).count() == 0


def test_length_spikes(spark):
    data = [(i, [("user", "q"), ("assistant", "x" * (150 if i < 40 else 100 + i))]) for i in range(120)]
    assert [tuple(r) for r in P.spikes(dialogue(spark, data)).collect()] == [("set_a", 150)]


def test_copies_broken_anywhere_and_chinese():
    q = "We asked about the first thing, then the second thing came up, and at last the third thing was mentioned by all of us in the room."
    words = q.split()
    pieces = [words[i : i + 7] for i in range(0, len(words) - 6, 7)]
    answer = " ".join(w for k, piece in enumerate(reversed(pieces)) for w in [*piece, *(["new"] if k % 2 else [])])
    assert P.is_copy(q, answer) and not P.is_copy(q, answer + " with much more of its own to say about all that")
    assert P.is_copy("你好。请把下面的句子翻译成英文，并且说明理由。", "请把下面的句子翻译成英文，并且说明理由")
    assert not P.is_copy("你好。请把下面的句子翻译成英文，并且说明理由。", "翻译成英文以后意思完全不同，所以没有什么理由")


@pytest.mark.parametrize("n", [10, 60, 400])
def test_length_does_not_change_the_rules(n):
    assert P.is_empty("&nbsp;" * n) and P.is_empty("none" + " " * n) and not P.is_empty("none " * n)


def test_how_a_neighbour_goes_on():
    key = P.sort_key("one two  three four five six\nseven version...")
    on = lambda text: P.goes_on(key, P.sort_key("one two three four five six\nseven version" + text))
    assert (on(" is out"), on("s"), on("\nis out"), on("."), on(", 2"), on("")) == (True, True, False, False, True, False)
    assert not P.goes_on(key, None) and not P.goes_on("short", "short and more")


def test_closed_and_open_ends_take_part(spark):
    head = "here is what we know about all of it so far\n"
    data = [
        (1, [("user", "q"), ("assistant", head + "the answer: a b")]),
        (2, [("user", "q"), ("assistant", head + "The  answer: a b c and then some more of it, as it stood.")]),
        (3, [("user", "q"), ("assistant", head + "it grew by a large...")]),
        (4, [("user", "q"), ("assistant", head + "it grew by a large factor in all.")]),
        (5, [("user", "q"), ("assistant", head + "it was finished on time.")]),
        (6, [("user", "q"), ("assistant", head + "it was finished on time. And then more came.")]),
    ]
    for parts in (1, 7):
        got = sorted(map(tuple, P.found(dialogue(spark, data).repartition(parts), language.seed_dictionaries()).collect()))
        assert got == [(1, 1, "truncated"), (3, 1, "truncated")]


def test_a_closed_end_at_a_length_limit(spark):
    heads = [f"{i:03d} here is what we know about all of it so far" for i in range(40)]
    data = [(i, [("user", "q"), ("assistant", h + " " * 60 + "it ended.")]) for i, h in enumerate(heads)]
    data += [(100 + i, [("user", "q"), ("assistant", h + " it ended. Then it went on.")]) for i, h in enumerate(heads[:5])]
    got = P.found(dialogue(spark, data), language.seed_dictionaries()).where("defect = 'truncated'").collect()
    assert sorted(r.sample_id for r in got) == [0, 1, 2, 3, 4]


def test_neighbours_across_ranges(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta "
    keys = [f"{base}{k:04d}" for k in range(400)] + [f"{base}{k:04d} and more" for k in range(0, 400, 2)]
    df = spark.createDataFrame([(bytes([k % 256, k // 256]), key) for k, key in enumerate(keys)], "mark binary, key string")
    got = {bytes(r.mark) for r in P.shortened(df.unionByName(df)).collect()}
    assert got == {bytes([k % 256, k // 256]) for k in range(0, 400, 2)}


def test_a_repeated_answer_is_no_length_limit(spark):
    same = "the same long answer without any mark at its end " * 4
    data = [(i, [("user", "q"), ("assistant", same.strip())]) for i in range(40)] + [(100 + i, [("user", "q"), ("assistant", "word " * (30 + i) + "end.")]) for i in range(30)]
    assert P.found(dialogue(spark, data), language.seed_dictionaries()).count() == 0
    limit = [(i, [("user", "q"), ("assistant", (f"{i} alpha beta gamma delta " * 20)[:151].strip().ljust(151, "x"))]) for i in range(40)]
    assert P.found(dialogue(spark, limit), language.seed_dictionaries()).where("defect = 'truncated'").count() == 40
