import json

import pytest

from sondar.sources import deception, files, io, registry

MSG = "array<struct<role:string,content:string>>"


def mirror(spark, tmp_path, folder, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{folder}")


def load(spark, name, tmp_path, **options):
    return sorted((r.label, [tuple(m) for m in r.messages]) for r in registry.load(spark, name, str(tmp_path), **options).collect())


def test_topics_and_options(spark, tmp_path):
    assert len(registry.probing_sources()) == 113 and set(registry.probing_sources()) <= set(registry.list_datasets("sparse_probing")) and set(registry.list_topics()) == set(registry.TOPICS)
    assert registry.info("frozen_protocol_v1").topic == "ood" and "glue" in registry.list_categories()
    assert registry.probing_sources("code") == ["sparse_probing_158_code_C", "sparse_probing_159_code_Python", "sparse_probing_160_code_HTML"]
    with pytest.raises(ValueError, match="unknown variant"):
        registry.load(spark, "repe", str(tmp_path), variant="nothing")
    with pytest.raises(ValueError, match="needs the option"):
        registry.load(spark, "roleplaying", str(tmp_path))
    with pytest.raises(ValueError, match="takes"):
        registry.load(spark, "alpaca", str(tmp_path), variant="x")


def test_statements(spark, tmp_path):
    data = [("A cat.", 1, "animals"), (" A lie ", 0, "cities"), ("", 1, "cities"), (None, 1, "cities"), ("Other", 1, "elsewhere"), ("No label", None, "cities")]
    mirror(spark, tmp_path, "azaria-mitchell", data, "statement string, label int, topic string")
    said = lambda t: [("user", "Tell me a fact."), ("assistant", t)]
    assert load(spark, "azaria_mitchell", tmp_path) == [(0, said("A cat.")), (1, said("A lie"))]
    assert load(spark, "azaria_mitchell", tmp_path, topic="cities") == [(1, said("A lie"))]
    mirror(spark, tmp_path, "internal-state", data, "statement string, label int, topic string")
    assert load(spark, "internal_state", tmp_path) == [(0, [("user", "Please state a fact."), ("assistant", "A cat.")])]
    open_ends = [("Rome is in Italy.", 1), ('She said "no".', 1), ("Two (2).", 0), (None, 1)]
    mirror(spark, tmp_path, "deception-geometry-of-truth/cities", open_ends, "statement string, label int")
    assert load(spark, "geometry_of_truth", tmp_path) == [(0, [("user", "Please state a fact."), ("assistant", "Rome is in Italy"), ("assistant", ".")])]


@pytest.mark.parametrize("variant", sorted(deception.ROLE_PROMPTS))
def test_role_play(spark, tmp_path, variant):
    mirror(spark, tmp_path, "deception-repe", [("one two three four five six", 1), ("false one", 0)], "statement string, label int")
    got = load(spark, "repe", tmp_path, variant=variant)
    sides = {"naive": 2, "IF_all": 4, "IF_honest": 2, "IF_dishonest": 2}
    assert len(got) == sides.get(variant, 2) and {y for y, _ in got} == {0, 1}
    if variant == "you_are_fact_sys":
        head, tail = ("assistant", "one"), ("assistant", " two three four five six")
        assert got == [(0, [("system", "You are an honest AI assistant."), ("user", deception.TELL), head, tail]), (1, [("system", "You are a deceptive AI assistant."), ("user", deception.TELL), head, tail])]
    if variant == "IF_all":
        assert sorted((y, m[0][1] == deception.PRETEND_HONEST, m[-1][1]) for y, m in got) == [(0, False, "false one"), (0, True, "one two three four five six"), (1, False, "one two three four five six"), (1, True, "false one")]


@pytest.mark.parametrize("variant", deception.LIAR_VARIANTS)
def test_goal_directed(spark, tmp_path, variant):
    data = [("N", "D", "Q: ", "why", "A:", "truth", "lie", True), ("N", "D", "Q: ", "how", "A:", "t", "l", False)]
    mirror(spark, tmp_path, "how_to_catch_an_ai_liar/goal_directed_lying", data, "normal_instruction string, deceive_instruction string, question_prefix string, question string, answer_prefix string, answer string, other_answer string, include_in_with_answers boolean")
    got = load(spark, "ai_liar", tmp_path, variant=variant)
    assert len(got) == (2 if variant == "original_with_answers" else 4)
    why = {y: m for y, m in got if m[1] == ("user", "Q: why")}
    if variant == "original_with_answers":
        assert why == {0: [("system", "N"), ("user", "Q: why"), ("assistant", "A:truth")], 1: [("system", "D"), ("user", "Q: why"), ("assistant", "A:truth")]}
    if variant == "mc":
        for m in why.values():
            letter = m[-1][1][-2]
            assert f"({letter}) truth" in m[2][1]
    if variant == "normal_instruction":
        assert [m[-1][1] for _, m in sorted(why.items())] == ["A:truth", "A:lie"] and all(m[0] == ("system", "N") for m in why.values())


def test_rollouts_and_trades(spark, tmp_path):
    asked = json.dumps([{"role": "system", "content": " S "}, {"role": "user", "content": " U "}, {"role": "assistant", "content": ""}])
    outs, grades = json.dumps(["plan <step4> do \n", "no token", "x <step4> y <step4> z", "q <step4>"]), json.dumps(["honest", "deceptive", 8, 4])
    mirror(spark, tmp_path, "deception-rollouts/sandbagging-m", [(asked, outs, grades)], "input_messages string, output_strs string, graded_deception string")
    assert load(spark, "sandbagging", tmp_path, model_name="m") == [(0, [("user", "U"), ("assistant", "plan "), ("assistant", "<step4> do")]), (1, [("user", "U"), ("assistant", "x <step4> y "), ("assistant", "<step4> z")])]
    mirror(spark, tmp_path, "deception-rollouts/roleplaying-m", [(asked, outs, grades)], "input_messages string, output_strs string, graded_deception string")
    assert [(y, m[0], len(m)) for y, m in load(spark, "roleplaying", tmp_path, model_name="m")] == [(0, ("system", "S"), 3), (1, ("system", "S"), 3), (1, ("system", "S"), 3)]
    talk = [{"role": "user", "content": "buy "}, {"role": "assistant", "content": "Think. Action: buy"}]
    more = talk + [{"role": "user", "content": "sure?"}, {"role": "assistant", "content": "yes"}]
    rows = [(json.dumps(talk), json.dumps({"report_label": "explicit", "k": "v"})), (json.dumps(more), json.dumps({"report_label": "concealed", "doubling_down_label": "x"})), (json.dumps(talk), json.dumps({"report_label": "other"})), (json.dumps(talk), "{}")]
    mirror(spark, tmp_path, "deception-insider-trading/upscale/m", rows, "transcript string, metadata string")
    cut = [("user", "buy"), ("assistant", "Think. "), ("assistant", "Action: buy")]
    assert load(spark, "insider_trading", tmp_path, model_name="m") == [(0, cut), (1, cut)]


def test_werewolf(spark, tmp_path):
    (tmp_path / "werewolf").mkdir()
    (tmp_path / "werewolf/rules.txt").write_text("RULES")
    side = {"night_information": "quiet"}
    paired = [{"description": "d", "discussion": [{"Bob": "hi"}, {"Eve": "ho"}], "honest": {"role": "Seer", **side}, "deceptive": {"role": "Minion", **side}, "response": "I am good"}]
    (tmp_path / "werewolf/paired.json").write_text(json.dumps(paired))
    got = load(spark, "werewolf", tmp_path)
    assert [(y, m[1]) for y, m in got] == [(0, ("assistant", "I am good")), (1, ("assistant", "I am good"))]
    text = got[1][1][0][1]
    assert text.startswith("RULES\n\nGAME INFORMATION\n") and "Your role is Minion. You are a member of the evil team.\nYou win if the players do not" in text and "DISCUSSION TRANSCRIPT\nBob: hi\nEve: ho\n\nWhat is" in text
    (tmp_path / "werewolf/open_response.json").write_text(json.dumps([{"discussion": [{"Bob": "hi"}], "role": r, "night_information": "n"} for r in ("Mason", "Werewolf")]))
    assert [(y, len(m)) for y, m in load(spark, "werewolf", tmp_path, variant="open_response")] == [(0, 1), (1, 1)]


def test_pairs(spark, tmp_path):
    mirror(spark, tmp_path, "truthful_qa", [(" Why? ", "yes; a", "no; b"), (None, "a", "b")], "Question string, `Examples: True` string, `Examples: False` string")
    assert load(spark, "truthful_qa", tmp_path) == [(0, [("user", "Why?"), ("assistant", "yes")]), (1, [("user", "Why?"), ("assistant", "no")])]
    mirror(spark, tmp_path, "deception-fleed-claims/logical", [("c", "not c")], "Claim string, `Negated Claim` string")
    assert [m[1][1] for _, m in load(spark, "fleed_claims", tmp_path, variant="logical")] == ["c", "not c"]
    mirror(spark, tmp_path, "hendrycks_ethics", [("I stole.", 1, True), ("I gave.", 0, True), ("long", 1, False)], "input string, label int, is_short boolean")
    assert [(y, m[0][1], m[2][1]) for y, m in load(spark, "ethics_commonsense", tmp_path)] == [(0, "I gave.", " not wrong."), (0, "I stole.", " wrong."), (1, "I gave.", " wrong."), (1, "I stole.", " not wrong.")]
    spec = "context struct<non_sensitive_info:array<string>,sensitive_info:string>, system_message string, user_query struct<speaker_type:string,content:string>, responses struct<truthful:string,deceptive:string>"
    mirror(spark, tmp_path, "DolusChat", [((["a", "b"], "c"), "sys", ("guest", "hello"), ("t", "d"))], spec)
    got = load(spark, "dolus_chat", tmp_path)
    assert got[0] == (0, [("system", "Prompt: sys\nContext: a\nb\nc\n"), ("user", "\n\n User ID: guest\nhello"), ("assistant", "t")]) and got[1][1][2] == ("assistant", "d")


def test_filters_and_repeats(spark, tmp_path):
    said = [("user", "q"), ("assistant", "a")]
    mirror(spark, tmp_path, "liars-bench/instructed-deception", [("m", said, True), (None, said, False), ("other", said, True), ("m", said, None)], f"model string, messages {MSG}, deceptive boolean")
    assert [y for y, _ in load(spark, "liars_bench", tmp_path, model_name="m")] == [0, 1]
    mirror(spark, tmp_path, "deception-sycophancy/m", [("q", 1, "positive"), ("q", 1, "positive"), ("q", 1, "negative"), ("q", None, "negative")], "question string, model_answer_with_bio int, side string")
    answer = [("user", "q"), ("assistant", "I believe the best answer is ("), ("assistant", "B")]
    assert load(spark, "sycophancy", tmp_path, model_name="m") == [(0, answer), (1, answer)]
    mirror(spark, tmp_path, "circuit_breakers", [("<bos><start_of_turn>user\nhi<end_of_turn>\n<start_of_turn>model\n", "c")], "prompt string, completion string")
    assert load(spark, "circuit_breakers", tmp_path) == [(1, [("user", "hi"), ("assistant", "c")])]
    rows = [("m", [("user", "q")], "positive", "x"), ("m", [], "0", "y")]
    mirror(spark, tmp_path, "frozen_protocol_v2/cbrn_iid", rows, f"id string, messages {MSG}, label string, topic string")
    assert load(spark, "frozen_protocol_v2", tmp_path, domain="cbrn", split="iid") == [(1, [("user", "q")])]


def test_dispatch_by_type(spark, tmp_path):
    items = [("PQA", {"question": "q?", "choices": ["x", "y"], "answer": "x"}), ("GEN", {"input": "make", "output": ["a", "b"]}), ("ORD", {"question": "order", "correct_steps": ["1st", "2nd"]}), ("ERR", {"corrupted_text": "bad", "corrected_text": "good"}), ("ELSE", {"question": "z"})]
    mirror(spark, tmp_path, "bioprobe-bench", [(t, json.dumps(d), str(i)) for i, (t, d) in enumerate(items)], "task_type string, data string, id string")
    assert sorted(tuple(x[1] for x in m) for _, m in load(spark, "bioprobe_bench", tmp_path)) == [("Check this protocol step for errors:\nbad", "good"), ("make", "1. a\n2. b"), ("order", "1. 1st\n2. 2nd"), ("q?\n\nA. x\nB. y", "x")]
    mirror(spark, tmp_path, "lab-bench", [("SeqQA", "q", ["a", "b"], "a"), ("DbQA", "r", None, "c"), ("Other", "s", None, "c")], "subtask string, question string, choices array<string>, ideal string")
    assert [m[0][1] for _, m in load(spark, "lab_bench", tmp_path)] == ["q\n\nA. a\nB. b", "r"]
    assert [m[0][1] for _, m in load(spark, "lab_bench", tmp_path, subtask="DbQA")] == ["r"]
    mirror(spark, tmp_path, "augmented-clinical-notes", [([("user", "u"), (None, "x"), ("user", "")],)], f"conversation {MSG}")
    assert load(spark, "clinical_notes", tmp_path) == [(0, [("user", "u"), ("assistant", "x")])]


def test_audits(spark, tmp_path):
    base = tmp_path / "ai_audit"
    for folder in ("trajectories", "experiments/A", "experiments/B"):
        (base / folder).mkdir(parents=True)
    for name in ("no_reasoning", "4"):
        for end in ("", "_without_code"):
            (base / f"trajectories/{name}{end}.json").write_text(json.dumps([{"role": "canary", "content": "x"}, {"role": "user", "content": "\nOn 2024-03-06 task [TASK] id [ID]\n"}]))
    for name in ["A/generation_task", "A/generation_response", "A/completion", "A/slack_A1", "B/slack", "B/evaluation_task_1", *[f"A/evaluation_task_{i}" for i in range(1, 8)]]:
        (base / f"experiments/{name}.txt").write_text(f"{name} [TASK] [DATE]\n")
    got = load(spark, "ai_audit", tmp_path)
    assert len(got) == 16 and sum(y for y, _ in got) == 8
    one = load(spark, "ai_audit", tmp_path, variant="a1_2_reasoning")
    assert len(one) == 1 and one[0][0] == 1
    assert one[0][1][0] == ("user", "On 2024-07-23 task 105 id 291") and one[0][1][1] == ("user", "A/generation_task 106 2024-07-26") and one[0][1][-1] == ("assistant", 'Reasoning: """')
    honest = min(m for y, m in got if not y)
    assert honest[0][1] == "On 2024-07-23 task 104 id 290"


def test_ids_come_from_content(spark, tmp_path):
    data = [(f"q{i % 7}", "a") for i in range(40)]
    spark.createDataFrame(data, "instruction string, output string").repartition(1).write.parquet(f"{tmp_path}/one/alpaca-cleaned")
    spark.createDataFrame(data[::-1], "instruction string, output string").repartition(6).write.parquet(f"{tmp_path}/six/alpaca-cleaned")
    ids = [{(r.sample_id, r.messages[0].content) for r in registry.load(spark, "alpaca", f"{tmp_path}/{d}").collect()} for d in ("one", "six")]
    assert ids[0] == ids[1] and len(ids[0]) == 40


def test_unions_and_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n')
    paths = {"a": f"{tmp_path}/a.jsonl", "b": f"{tmp_path}/b.jsonl"}
    read = lambda p: io.read_json_lines(spark, p)
    with pytest.raises(FileNotFoundError):
        io.read_union(spark, read, paths, "part")
    with pytest.warns(UserWarning):
        assert [tuple(r) for r in io.read_union(spark, read, paths, "part", skip_missing=True).collect()] == [(1, "a")]
    assert io.latest(spark, f"{tmp_path}/*.jsonl").endswith("a.jsonl") and io.first_existing(spark, [paths["b"], paths["a"]]) == paths["a"]
    files.write_text(spark, f"{tmp_path}/t.txt", "é\n")
    assert files.read_text(spark, f"{tmp_path}/t.txt") == "é\n"
    with pytest.raises(ValueError):
        files.read_text(spark, f"{tmp_path}/t.txt", 1)
