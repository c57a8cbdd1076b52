import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondar import session
from sondar.operators import masks as M
from sondar.operators import tokens as T
from tests.conftest import rows


def chars(text):
    """One token for each character."""
    return list(range(len(text))), list(range(len(text))), list(range(1, len(text) + 1))


def token_rows(spark, texts):
    s = spark.createDataFrame([(i, t, [(1, 0, len(t))]) for i, t in enumerate(texts)], "sample_id bigint, text string, spans array<struct<role_id:int,s:int,e:int>>")
    return T.tokenize(s, chars), s


def chosen(spark, text, mask):
    t, s = token_rows(spark, [text])
    return [r.pos for r in M.apply(t, mask, s).where("det").orderBy("pos").collect()]


@pytest.mark.parametrize(
    "text, mask, want",
    [
        ("alpha beta gamma", M.contains("BETA"), range(6, 10)),
        ("banana", M.contains("ana"), range(1, 6)),
        ("alpha beta gamma", M.contains(""), []),
        ("alpha beta gamma", M.regex("b.ta"), range(6, 10)),
        ("abc", M.regex("(?=b)"), [1]),
        ("pre <think>abc</think> post", M.thinking(), range(4, 22)),
        ("pre <think>abc</think> post", M.thinking(inclusive=False), range(11, 14)),
        ("alpha beta gamma", M.after("alpha "), range(6, 16)),
        ("alpha beta gamma", M.before(" gamma"), range(10)),
        ("alpha", M.after("alpha"), []),
        ("a[b]c.E", M.between("[", "]", inclusive=True), range(1, 4)),
        ("x(a)", M.between("(", ")"), []),
        ("abcdef", M.padding(M.contains("cd"), 1, 1), range(1, 5)),
        ("abc", M.none() | ~M.all(), []),
    ],
)
def test_text_masks(spark, text, mask, want):
    assert chosen(spark, text, mask) == list(want)


def test_without_texts_text_masks_select_nothing(spark):
    t, _ = token_rows(spark, ["alpha"])
    assert M.apply(t, M.contains("a")).where("det").count() == 0


def test_positions_in_messages(spark):
    data = [(0, k, 10 * (k % 3), "x", k, k + 1, m, 1) for k, m in enumerate([0, 0, 1, 1, 1, 2])]
    t = spark.createDataFrame(data, "sample_id bigint, pos int, " + T.TOKEN)
    pick = lambda m: [r.det for r in M.apply(t, m).orderBy("pos").collect()]
    assert pick(M.last_n_tokens(2)) == [True, True, False, True, True, True]
    assert pick(M.first_n_tokens(2)) == [True, True, True, True, False, True]
    assert pick(M.nth_message(-1)) == [False] * 5 + [True]
    assert pick(M.nth_message(-9)) == [False] * 6
    assert pick(M.special_tokens([20])) == [False, False, True] * 2
    with pytest.raises(ValueError):
        M.last_n_tokens(0)
    with pytest.raises(ValueError):
        M.role("narrator")
    assert M.after("a") == M.after("a") and (M.all() & M.none()).key == "and(all(), none())"


def dialogue(spark, *messages):
    return spark.createDataFrame([(0, list(messages))], f"sample_id bigint, messages {T.MESSAGES}")


def test_merge_and_fold(spark):
    d = dialogue(spark, ("system", " be kind "), ("human", "a "), ("user", None), ("user", "b"), ("gpt", "c"))
    got = d.select(T.merged(F.col("messages")).alias("m")).first().m
    assert [tuple(m) for m in got] == [("system", "be kind"), ("user", "a b"), ("assistant", "c")]
    folded = d.select(T.merged(F.col("messages"), True).alias("m")).first().m
    assert [tuple(m) for m in folded] == [("user", "be kind\n\n a b"), ("assistant", "c")]
    lone = dialogue(spark, ("assistant", "x")).select(T.merged(F.col("messages"), True).alias("m")).first().m
    assert [tuple(m) for m in lone] == [("user", ""), ("assistant", "x")]


def test_spans_point_at_the_content(spark):
    d = dialogue(spark, ("system", "sys"), ("user", "héllo you"), ("assistant", "fine"))
    for template in (T.PLAIN, *T.TEMPLATES.values()):
        r = T.rendered(d, template).first()
        texts = [r.text[s.s : s.e] for s in r.spans]
        assert texts[-1] == "fine" and "héllo you" in texts[-2]
    assert T.rendered(dialogue(spark, ("user", "bare"))).first().text == "bare"
    assert T.rendered(dialogue(spark)).first().text == ""


def test_roles_dilate_and_later_roles_win(spark):
    roles = [-1, 1, -1, -1, 2, -1]
    data = [(0, k, 7, "x", k, k + 1, -1, r) for k, r in enumerate(roles)]
    t = spark.createDataFrame(data, "sample_id bigint, pos int, " + T.TOKEN)
    got = [r.role_id_padded for r in T.with_padded_roles(t, (3, 1)).orderBy("pos").collect()]
    assert got == [1, 2, 2, 2, 2, 2]


def test_truncate(spark):
    det = [0, 0, 0, 0, 1, 1, 0, 1, 0, 0]
    data = [(0 if k < 6 else 1, k if k < 6 else k - 6, k, bool(d)) for k, d in enumerate(det)]
    t = spark.createDataFrame(data, "sample_id bigint, pos int, token_id bigint, det boolean")
    left = T.truncate(t, 3, "left").orderBy("sample_id", "pos").collect()
    assert [r.token_id for r in left] == [3, 4, 5, 7, 8, 9]
    with pytest.raises(Exception, match="preserved"):
        T.truncate(t, 2, "right").collect()
    assert T.truncate(t, 2, "right", None).count() == 4


def test_templates():
    assert T.detect_template("Meta-Llama-3") == "llama" and T.detect_template("", "<|im_start|> <think>") == "qwen3"
    with pytest.raises(ValueError):
        T.get_template(template="nope")


def test_the_tokenizing_stage_gives_what_windows_give(spark):
    rng = random.Random(3)
    words = ["a", "bb", "Über", "x_y", "...", "中文", "\n", "  "]
    data = [(i, [(rng.choice(["system", "user", "assistant"]), "".join(rng.choice(words) + rng.choice([" ", ""]) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(5))]) for i in range(60)]
    s = T.rendered(spark.createDataFrame(data, "sample_id bigint, messages array<struct<role:string,content:string>>"), T.TEMPLATES["qwen"])
    plain = T.tokenize(s)
    full = T.tokenize(s, padding=(3, 2), places=True)
    assert rows(full.select(*plain.columns)) == rows(plain)
    assert rows(full.select("sample_id", "pos", "role_id_padded")) == rows(T.with_padded_roles(plain, (3, 2)).select("sample_id", "pos", "role_id_padded"))
    for mask in (M.first_n_tokens(2), M.last_n_tokens(2), M.nth_message(-1), M.nth_message(-2), M.nth_message(1)):
        assert rows(M.apply(full, mask).select("sample_id", "pos", "det")) == rows(M.apply(plain, mask).select("sample_id", "pos", "det"))
    sums = plain.groupBy("sample_id").agg(F.count("*").alias("n"), F.max("char_end").cast("bigint").alias("chars"), F.sum("char_start").alias("starts"))
    assert rows(T.lossless_sums(s).where("n > 0")) == rows(sums)


def test_text_masks_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("aab. \n1") for _ in range(rng.randrange(40)))
        ids, starts, ends = T.lossless(text)
        order = list(range(len(ids)))
        rng.shuffle(order)
        needle = rng.choice(["a", "aa", ". ", "ab", "b"])
        pick = [starts[i] for i in order], [ends[i] for i in order]
        bits = M._bits([M.contains(needle), M.regex("[0-9]+|a{2}"), M.after(needle), M.before(needle, inclusive=True)], text, *(np.array(x, int) for x in (order, *pick)))
        spans = [m.start() for m in re.finditer(f"(?={re.escape(needle)})", text)]
        at = text.find(needle)
        for k, i in enumerate(order):
            s, e = starts[i], ends[i]
            first = next((j for j in range(len(ids)) if starts[j] <= at + len(needle) < ends[j]), None) if at >= 0 else None
            until = next((j for j in range(len(ids)) if starts[j] <= at + len(needle) - 1 < ends[j]), None) if at >= 0 else None
            want = (
                any(a < e and a + len(needle) > s for a in spans),
                any(m.start() < e and m.end() > s for m in re.finditer("[0-9]+|a{2}", text)),
                first is not None and i >= first,
                until is not None and i <= until,
            )
            assert tuple(bool(bits[k] >> j & 1) for j in range(4)) == want


def test_tokenize_dataset_and_generation_prompt(spark):
    d = spark.createDataFrame([(1, [("user", "hi there"), ("assistant", "yes")])], "sample_id bigint, messages array<struct<role:string,content:string>>")
    text = lambda t, **k: T.rendered(d, T.TEMPLATES[t], **k).first().text
    assert text("gemma", add_generation_prompt=True) == text("gemma") + "<start_of_turn>model\n"
    assert text("llama", add_generation_prompt=True).endswith("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n")
    assert T.rendered(d, add_generation_prompt=True).first().text == T.rendered(d).first().text
    got = T.tokenize_dataset(d, M.assistant(include_padding=False) | M.contains("hi"), T.TEMPLATES["qwen"]).where("det")
    assert [r.token for r in got.orderBy("pos").collect()] == ["hi", "yes"]


@pytest.mark.parametrize("most", [session.BROADCAST_BYTES, 0])
def test_gather_never_broadcasts_rows_or_tokens(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(session, "BROADCAST_BYTES", most)
    data = [(i, "word " * i, [(1, 0, 5 * i)]) for i in range(1, 9)]
    spark.createDataFrame(data, "sample_id bigint, text string, spans array<struct<role_id:int,s:int,e:int>>").write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))  # files of a known size, far below the limit for broadcasts
    got = T.gather(T.tokenize(s), s, [3, 0, -1, 3])
    joins = [line for line in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [sample_id" in line or "Join [pos" in line]
    assert len(joins) == 2 and all("BuildLeft" in j if most else "SortMergeJoin" in j for j in joins)
    counts = got.groupBy("idx", "sample_id").count()
    assert rows(counts) == [(0, 4, 8), (1, 1, 2), (2, 8, 16), (3, 4, 8)]
