"""Registry of dataset sources: declarative specifications that turn mirrored tables into labelled dialogues.

A specification says where the mirror of a dataset lies under a root folder, which columns
hold its texts, how a row is labelled and what metadata stays, and which options (variant,
model, topic, ...) it takes. Loading resolves the folder in any file system Spark reads, reads
Parquet, JSON, JSON lines, CSV or YAML, and applies native expressions; nothing is fetched from
a network. Families of many similar sources are built from rules or from a manifest.

Sample ids are hashes of the content and of its number among equal rows, so that they, and
every shuffle, sample and cap by them, don't depend on how the files are split.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondar.functions.text import strip_all
from sondar.operators import dataset as D
from sondar.sources import builders as B
from sondar.sources import deception as X
from sondar.sources import files, io, probing_tasks

TOPICS = (
    "deception", "harmfulness", "ood", "multilingual", "medical", "mental_health", "cybersecurity",
    "agents", "reasoning", "creative", "legal_finance", "science", "hallucination", "sparse_probing",
)

ROOT = os.environ.get("SONDAR_MIRROR", "/data/mirror")


@dataclass(frozen=True)
class Spec:
    """One source. Columns are given as tuples of aliases, the first filled one counts."""

    name: str
    topic: str
    folder: str
    user: tuple[str, ...] = ()
    assistant: tuple[str, ...] = ()
    system: tuple[str, ...] = ()
    messages: str | None = None
    label: str = "0"
    where: str | None = None
    metadata: tuple[str, ...] = ()
    build: Callable[..., DataFrame] | None = None
    #: Whether build gives the messages as they are to be, empty ones included.
    final: bool = False
    #: Options and their defaults; None where one has to be given. They fill the folder's name and go to build.
    options: Mapping[str, str | None] = field(default_factory=dict)
    #: Values that an option may have.
    choices: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    #: Options that are the text of a file beside the table.
    texts: Mapping[str, str] = field(default_factory=dict)
    #: Reads the rows itself: (session, path, options).
    read: Callable[..., DataFrame] | None = None
    description: str = ""

    def resolved(self, given: Mapping[str, str | None]) -> dict[str, str | None]:
        """All options; ValueError for one that is unknown or has a value it can't have, or that is missing."""
        if unknown := set(given) - set(self.options):
            raise ValueError(f"{self.name} takes {sorted(self.options)}, not {sorted(unknown)}")
        held = {**self.options, **given}
        for name, value in held.items():
            if value is None and name not in self.choices and f"{{{name}}}" in self.folder:
                raise ValueError(f"{self.name} needs the option {name!r}")
            if value is not None and value not in self.choices.get(name, (value,)):
                raise ValueError(f"{self.name}: unknown {name} {value!r}; there are {list(self.choices[name])}")
        return held

    def dialogues(self, rows: DataFrame, options: Mapping[str, str | None] | None = None) -> DataFrame:
        """(messages, label, metadata) of the source's rows; rows without a dialogue or a label are dropped."""
        if self.build is not None:
            rows = self.build(rows, **(options or {}))
        if self.where:
            rows = rows.where(self.where)
        if self.final:
            built = F.col("messages")
        elif "messages" in rows.columns and self.messages in (None, "messages") and not self.user and not self.assistant:
            built = B.from_structs(F.col("messages")) if "struct" in rows.schema["messages"].dataType.simpleString() else B.from_messages(F.col("messages"))
        elif self.messages:
            typed = F.from_json(self.messages, "array<map<string,string>>") if rows.schema[self.messages].dataType.simpleString() == "string" else F.transform(self.messages, lambda m: F.from_json(F.to_json(m), "map<string,string>"))
            built = B.from_messages(typed)
        else:
            built = _turns(rows, self.system, self.user, self.assistant)
        label = F.col("label") if self.build is not None and "label" in rows.columns and self.label == "0" else F.expr(self.label)
        metadata = F.create_map(*[x for c in self.metadata for x in (F.lit(c), (F.col(c) if c in rows.columns else F.lit(None)).cast("string"))]) if self.metadata else F.create_map().cast("map<string,string>")
        out = rows.select(built.alias("messages"), label.cast("int").alias("label"), metadata.alias("metadata"))
        return out.where("size(messages) > 0 AND label IS NOT NULL")


def content_hash(rows: DataFrame) -> Column:
    """A hash of all columns of a row."""
    maps = [f.name for f in rows.schema.fields if "map<" in f.dataType.simpleString()]
    return F.xxhash64(*[F.to_json(c) if c in maps else F.col(f"`{c}`") for c in rows.columns])


def _turns(rows: DataFrame, system: Sequence[str], user: Sequence[str], assistant: Sequence[str]) -> Column:
    """System, user and assistant messages that have text; null where a user text is asked for and missing."""

    def text(names: Sequence[str]) -> Column:
        held = [F.nullif(strip_all(F.col(f"`{c}`").cast("string")), F.lit("")) for c in names if c in rows.columns]
        return F.coalesce(*held) if held else F.lit(None).cast("string")

    sides = [("system", text(system)), ("user", text(user)), ("assistant", text(assistant))]
    built = F.array_compact(F.array(*[F.when(t.isNotNull(), B.message(role, t)) for role, t in sides]))
    return F.when(text(user).isNotNull(), built) if user else built


def _choices(question: str, choices: str, answer: str | None, positive: bool) -> Callable[[DataFrame], DataFrame]:
    def build(rows: DataFrame) -> DataFrame:
        text = B.multiple_choice(F.concat(F.col(question), F.lit("\n")), F.col(choices))
        out = rows.withColumn("q", text)
        if answer:
            at = F.col(answer).cast("int")
            out = out.withColumn("a", F.concat(F.lit("The answer is "), F.char(F.lit(65) + at), F.lit(": "), F.get(F.col(choices), at)))
        return out.withColumn("label", F.lit(int(positive)))

    return build


def _paired(prompt: str | None, negative: str, positive: str) -> Callable[[DataFrame], DataFrame]:
    def build(rows: DataFrame) -> DataFrame:
        def side(c: str) -> Column:
            return F.array(B.message("user", F.col(prompt)), B.message("assistant", F.col(c))) if prompt else F.array(B.message("user", F.col(c)))

        return B.paired(rows.drop("messages", "label"), side(negative), side(positive))

    return build


def _spans(rows: DataFrame) -> DataFrame:
    """Long answers with annotated spans: the last two turns, positive if any span isn't supported."""
    n = F.size("conversation")
    turns = F.array(B.message("user", F.get("conversation", n - 2)["content"]), B.message("assistant", F.get("conversation", n - 1)["content"]))
    completion = F.get("conversation", n - 1)["content"]
    good = F.filter("annotations", lambda a: a.isNotNull() & a["index"].isNotNull() & (F.coalesce(a["span"], F.lit("")) != "") & completion.contains(a["span"]))
    bad = F.exists(good, lambda a: a["label"].isin("Not Supported", "NS", "Insufficient Information"))
    return rows.select("*", turns.alias("messages"), bad.cast("int").alias("label"), F.to_json(good).alias("spans"))


def _judged(rows: DataFrame) -> DataFrame:
    """Short answers whose exact answer stands in the completion; NS is positive, unknown labels are dropped."""
    kept = rows.where("llm_judge_label IN ('S', 'NS', 'N/A') AND contains(gt_completion, exact_answer)")
    at = (F.instr("gt_completion", F.col("exact_answer")) - 1).cast("string")
    return kept.select("*", (F.col("llm_judge_label") == "NS").cast("int").alias("label"), F.array(B.message("user", F.col("question")), B.message("assistant", F.col("gt_completion"))).alias("messages"), at.alias("index"))


def _transcript(text: str, marks: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    def build(rows: DataFrame) -> DataFrame:
        numbered = rows.withColumn("_row", F.monotonically_increasing_id())
        return B.transcript(numbered, "_row", text, marks).withColumn("label", F.lit(0))

    return build


def _conversation(rows: DataFrame) -> DataFrame:
    """A conversation by its type: text is one assistant message, a list of texts several, records have their own roles."""
    name = "conversation" if "conversation" in rows.columns else "dialogue"
    kind = rows.schema[name].dataType.simpleString()
    if kind == "string":
        built = F.array(B.message("assistant", F.col(name)))
    elif kind == "array<string>":
        built = F.transform(name, lambda t: B.message("assistant", t))
    else:
        built = F.transform(name, lambda m: B.message(F.coalesce(m["role"], F.lit("assistant")), m["content"]))
    return rows.withColumn("messages", F.filter(built, lambda m: F.coalesce(m["content"], F.lit("")) != ""))


# Marks of a chat template that are cut from prompts.
TEMPLATE_MARKS = ("<bos><start_of_turn>user\n", "<end_of_turn>\n<start_of_turn>model\n")


def _without_marks(rows: DataFrame) -> DataFrame:
    """Prompts without the marks of a chat template around them."""
    text = F.col("prompt")
    for mark in TEMPLATE_MARKS:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return rows.withColumn("prompt", text)


def _lettered(choices: Column) -> Column:
    """'A. first' and so on, line by line."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), c.cast("string"))), "\n")


def _protocols(rows: DataFrame) -> DataFrame:
    """Protocol tasks by their type: PQA questions with choices, GEN and ORD numbered steps, ERR a step to check."""
    item = F.from_json("data", "question string, choices array<string>, answer string, input string, output string, correct_steps string, corrupted_text string, corrected_text string")
    item = rows.withColumn("_i", item)
    numbered = lambda c: F.coalesce(F.array_join(F.transform(F.from_json(c, "array<string>"), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n"), c)
    asked = F.col("_i.question")
    with_choices = F.when(F.size("_i.choices") > 0, F.concat(asked, F.lit("\n\n"), _lettered(F.col("_i.choices")))).otherwise(asked)
    wrong = F.concat(F.lit("Check this protocol step for errors:\n"), F.coalesce("_i.corrupted_text", F.lit("")))
    kind = F.col("task_type")
    q = F.when(kind == "PQA", with_choices).when(kind == "GEN", F.col("_i.input")).when(kind == "ORD", asked).when(kind == "ERR", wrong)
    a = F.when(kind == "PQA", F.col("_i.answer")).when(kind == "GEN", numbered(F.col("_i.output"))).when(kind == "ORD", numbered(F.col("_i.correct_steps"))).when(kind == "ERR", F.col("_i.corrected_text"))
    return item.withColumns({"q": q, "a": a}).drop("_i")


# Subtasks of the lab questions.
LAB_SUBTASKS = ("LitQA2", "CloningScenarios", "ProtocolQA", "SeqQA", "FigQA", "TableQA", "DbQA", "SuppQA")


def _lab(rows: DataFrame, subtask: str | None) -> DataFrame:
    """Questions with lettered choices; of one subtask or of all."""
    rows = rows.where(F.col("subtask") == subtask if subtask else F.col("subtask").isin(*LAB_SUBTASKS))
    asked = B.first_filled(*[F.col(c) for c in ("question", "input") if c in rows.columns])
    held = [F.col(c) for c in ("choices", "options") if c in rows.columns]
    choices = F.coalesce(*[F.when(F.size(c) > 0, c) for c in held]) if held else F.lit(None).cast("array<string>")
    return rows.withColumn("q", F.when(choices.isNotNull(), F.concat(asked, F.lit("\n\n"), _lettered(choices))).otherwise(asked))


def _first_two(field_: str, content: str = "value") -> Callable[[DataFrame], DataFrame]:
    def build(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.get(field_, F.lit(0))[content].alias("q"), F.get(field_, F.lit(1))[content].alias("a"))

    return build


def _rollouts(rows: DataFrame) -> DataFrame:
    return B.rollouts(rows.drop("label"), "input_messages", "output_strs", "graded_deception", {"honest": 0, "deceptive": 1})


def _deduplicated(rows: DataFrame) -> DataFrame:
    """wildguard: one row of each prompt and label, under a fixed system text."""
    numbered = rows.withColumn("_row", content_hash(rows)).withColumn("label", (F.lower("prompt_harm_label") == "harmful").cast("int")).na.fill(0, ["label"])
    return D.drop_repeats(numbered, ["prompt", "label"], "_row").withColumn("_system", F.lit("You are a helpful, honest assistant."))


def _capped_jailbreaks(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.nullif(strip_all(F.col("adversarial")), F.lit("")), F.nullif(strip_all(F.col("vanilla")), F.lit("")))
    numbered = rows.withColumn("_row", content_hash(rows)).withColumn("q", text)
    return D.capped(numbered, "data_type", 12_500, seed=0, id_col="_row")


QA = ("question", "problem", "instruction", "input", "prompt", "query")
ANSWER = ("answer", "solution", "output", "response", "completion")
_YES = "CAST(label = 1 AS INT)"


def _specs() -> list[Spec]:
    s = Spec
    out = [
        # agents
        s("xlam_function_calling", "agents", "xlam-function-calling-60k", ("query",), ("answers",), ("tools",), metadata=("tools", "answers")),
        s("glaive_function_calling", "agents", "glaive-function-calling", build=_transcript("sample", {"SYSTEM:": "system", "USER:": "user", "ASSISTANT:": "assistant", "FUNCTION RESPONSE:": "user"})),
        s("hermes_function_calling", "agents", "hermes-function-calling-v1", messages="conversations"),
        s("function_calling_sharegpt", "agents", "function-calling-sharegpt", messages="conversations"),
        # creative
        s("synthetic_persona_chat", "creative", "Synthetic-Persona-Chat", build=lambda d: d.withColumn("messages", B.delimited(F.col("Best Generated Conversation"), ["User 1:", "User 2:"])), metadata=("user 1 personas", "user 2 personas")),
        s("persona_based_chat", "creative", "persona-based-chat", build=lambda d: d.withColumn("messages", B.alternating(F.col("dialogue"), F.concat(F.lit("Persona: "), F.array_join("persona_b", "\n")))), metadata=("persona_b", "conv_id")),
        s("roleplay", "creative", "roleplay", messages="conversations", metadata=("character",)),
        s("multi_character_dialogue", "creative", "multi-character-dialogue", assistant=("dialogue",), metadata=("genre",)),
        s("literary_genre", "creative", "literary-genre-examples", ("genre", "category"), ("example", "text", "content"), metadata=("genre",)),
        s("writing_prompts", "creative", "writingPromptAug", ("prompt", "input"), ("story", "output", "response")),
        # cybersecurity
        s("trendyol_cybersecurity", "cybersecurity", "Trendyol-Cybersecurity-Instruction-Tuning-Dataset", ("user",), ("assistant",), ("system",)),
        s("cybersecurity_dpo", "cybersecurity", "Code_Vulnerability_Security_DPO", build=_paired("question", "chosen", "rejected")),
        s("defensive_cybersecurity", "cybersecurity", "Cybersecurity-Dataset-v1", ("user", "instruction", "input", "question"), ("assistant", "response", "output", "answer"), ("system",)),
        s("bigcodebench", "cybersecurity", "bigcodebench", ("instruct_prompt", "complete_prompt"), ("canonical_solution",), metadata=("task_id", "libs")),
        s("cyberseceval", "cybersecurity", "CyberSecEval", ("prompt",), label="1", metadata=("cwe_identifier", "language")),
        s("cysecbench", "cybersecurity", "cysecbench", ("Prompt",), label="1", metadata=("Category",)),
        s("intercode_ctf", "cybersecurity", "ic_ctf", ("query",), metadata=("task_id", "tags")),
        s("hackaprompt", "cybersecurity", "hackaprompt-dataset", ("user_input",), ("completion",), label="CAST(coalesce(correct, false) AS INT)", metadata=("level", "model", "correct")),
        s("cyberrisk_qa", "cybersecurity", "cyberrisk-qa-pairs", ("question",), ("answer",), label="1", where="question <> '' AND answer <> ''", metadata=("topic", "subtopic", "question_type", "augmentation", "language", "base_id")),
        # legal and finance
        s("caselaw", "legal_finance", "case-law", assistant=("text",), metadata=("court",)),
        s("finance_tasks", "legal_finance", "finance-tasks", ("instruction", "input"), ("output", "response")),
        s("financial_phrasebank", "legal_finance", "financial_phrasebank", assistant=("sentence",), metadata=("sentiment",), build=lambda d: d.withColumn("sentiment", D.lookup(F.col("label").cast("string"), {"0": "negative", "1": "neutral", "2": "positive"})).drop("label").withColumn("label", F.lit(0))),
        s("legal_advice_reddit", "legal_finance", "pile-of-law", ("text",)),
        # medical
        s("meddialog", "medical", "meddialog", ("lead",), ("text",), build=lambda d: d.withColumn("lead", F.lit("Medical consultation:"))),
        s("medical_soap", "medical", "medical-dialogue-to-soap-summary", ("dialogue",), metadata=("soap",)),
        s("clinical_notes", "medical", "augmented-clinical-notes", build=_conversation, metadata=("patient_summary",)),
        s("know_medical", "medical", "know_medical_dialogue_v2", ("Patient", "patient", "input"), ("Doctor", "doctor", "output")),
        # mental health
        s("mentalchat", "mental_health", "MentalChat16K", ("input",), ("output",), ("instruction",)),
        s("mental_health_counseling", "mental_health", "mental_health_counseling_conversations", ("Context", "context", "input"), ("Response", "response", "output")),
        s("prosocial_dialog", "mental_health", "prosocial-dialog", ("context",), ("response",), label="CAST(coalesce(safety_label, '__casual__') <> '__casual__' AS INT)", metadata=("safety_label", "rots", "source")),
        s("emotional_support", "mental_health", "mental_health_chatbot_dataset", ("question", "input", "text", "context"), ("answer", "output", "response", "reply")),
        # multilingual
        s("wildchat", "multilingual", "WildChat-1M", messages="conversation", metadata=("language", "model", "country", "toxic", "turn")),
        s("multilingual_thinking", "multilingual", "Multilingual-Thinking", messages="messages", metadata=("language",)),
        s("palo_multilingual", "multilingual", "palo_multilingual_dataset", messages="conversations", metadata=("language",)),
        # out of distribution
        s("ultrachat", "ood", "ultrachat", ("instruction",), ("output",)),
        s("ultrachat_200k", "ood", "ultrachat_200k", messages="messages"),
        s("lmsys_chat", "ood", "lmsys_chat", messages="conversation", metadata=("model", "language", "redacted", "conversation_id")),
        s("sharegpt", "ood", "ShareGPT52K", messages="conversations", metadata=("id",)),
        s("chatbot_arena", "ood", "chatbot_arena", messages="conversation_a", metadata=("model_a", "model_b", "winner", "language")),
        s("alpaca", "ood", "alpaca-cleaned", ("instruction",), ("output",)),
        s("generic_spanish", "ood", "evol-instruct-spanish", ("q",), ("a",), build=_first_two("conversations")),
        s("math_instruct", "ood", "MathInstruct", ("instruction",), ("output",)),
        # reasoning
        s("openr1_math", "reasoning", "OpenR1-Math-220k", ("problem",), ("solution",), metadata=("problem_type", "source", "answer")),
        s("openmath_reasoning", "reasoning", "OpenMathReasoning", ("problem", "question", "input"), ("solution", "response", "output"), metadata=("problem_source",)),
        s("numina_math", "reasoning", "NuminaMath-CoT", ("problem",), ("solution",), metadata=("source",)),
        s("math_instruct_enhanced", "reasoning", "MathInstruct", ("instruction",), ("output",), metadata=("source",)),
        s("math_hendrycks", "reasoning", "MATH-lighteval", ("problem",), ("solution",), metadata=("level", "type")),
        # spam and toxicity
        s("enron_spam", "harmfulness", "enron_spam", ("text",), label=_YES),
        s("sms_spam", "harmfulness", "sms_spam", ("sms",), label=_YES),
        s("spam_detection", "harmfulness", "spam-detection-dataset", ("text",), label="CAST(CAST(label AS STRING) IN ('1', 'spam') AS INT)"),
        s("toxic_conversations", "harmfulness", "toxic_conversations_50k", ("text",), label=_YES),
        # harmfulness
        s("wild_jailbreak", "harmfulness", "wildjailbreak", ("adversarial",), ("completion",), label="CAST(data_type = 'adversarial_harmful' AS INT)", where="data_type IN ('adversarial_harmful', 'adversarial_benign')"),
        s("wild_jailbreak_aug", "harmfulness", "wildjailbreak", ("q",), ("completion",), label="CAST(contains(data_type, 'harmful') AS INT)", build=_capped_jailbreaks),
        s("circuit_breakers", "harmfulness", "circuit_breakers", ("prompt",), ("completion",), label="1", build=_without_marks),
        s("benign_instructions", "harmfulness", "benign_instructions", ("prompt",), ("completion",), build=_without_marks),
        s("wildguard_mix", "harmfulness", "wildguard_mix", ("prompt",), system=("_system",), build=_deduplicated, metadata=("prompt_harm_label", "response_refusal_label", "response_harm_label", "adversarial", "subcategory", "response")),
        s("xstest_response", "harmfulness", "xstest-response", ("prompt",), ("response",), label="CAST(label = 'harmful' AS INT)"),
        *[s(f"clearharm_{m}", "harmfulness", f"clearharm/{m}", ("prompt",), ("generated_text",), label="1") for m in ("llama3", "mistral", "qwen3")],
        s("fortress_public", "harmfulness", "fortress_public", build=_paired(None, "benign_prompt", "adversarial_prompt")),
        s("or_bench", "harmfulness", "or-bench", ("prompt",), metadata=("category",)),
        # hallucination
        *[s(n, "hallucination", f, build=_spans, metadata=("spans", "model")) for n, f in (("longfact", "longfact-annotations"), ("longfact_augmented", "longfact-augmented-annotations"), ("healthbench", "healthbench-annotations"))],
        s("triviaqa_hallucination", "hallucination", "triviaqa-balanced", build=_judged, metadata=("exact_answer", "index")),
        # science
        s("scienceqa", "science", "ScienceQA", ("q",), ("a",), build=_choices("question", "choices", "answer", False), metadata=("subject", "topic", "grade")),
        s("mmmu", "science", "MMMU", ("q",), ("answer",), build=_choices("question", "options", None, False), metadata=("subject", "subfield")),
        s("biology_tot", "science", "cleand_moremilk_ToT-Biology", ("question",), ("answer",), metadata=("id", "total_token", "base_datasets_id", "thought")),
        s("biochem_reasoning", "science", "reasoning-biochem", ("question",), ("response",), metadata=("reasoning_chains",)),
        s("stem_qa", "science", "physics", ("message_1", "instruction"), ("message_2", "response"), metadata=("topic",)),
        s("bioprobe_bench", "science", "bioprobe-bench", ("q",), ("a",), build=_protocols, metadata=("task_type", "id")),
        s("lab_bench", "science", "lab-bench", ("q",), ("ideal", "answer", "correct_answer"), build=_lab, options={"subtask": None}, choices={"subtask": LAB_SUBTASKS}, metadata=("subtask", "id")),
        s("pmc_virology_abstracts", "science", "PubMedQA", ("question",), ("long_answer",), metadata=("pubid",)),
        s("virology_qa", "science", "virology-qa-pairs", ("question",), ("answer",), label="1", where="question <> '' AND answer <> ''", metadata=("topic", "subtopic", "question_type", "augmentation", "language", "base_id")),
    ]
    for name, topic in (("wmdp_cyber", "cybersecurity"), ("wmdp_bio", "science"), ("wmdp_chem", "science")):
        out.append(s(name, topic, f"wmdp/{name.replace('_', '-')}", ("q",), ("a",), build=_choices("question", "choices", "answer", True)))
    judged = "question <> '' AND answer <> '' AND judge_score >= 0.6"
    kept = ("id", "base_id", "generator_model", "taxonomy_category", "topic", "subtopic", "language", "augmentation", "label_reason", "judge_score")
    held_out = "taxonomy_category IN ('assay_selection_strategy', 'operational_constraint_handling')"
    primary = "contains(generator_model, 'gemma-3-27b')"
    for suffix, condition in (("", "true"), ("_train", f"{primary} AND NOT {held_out}"), ("_iid", f"{primary} AND {held_out}"), ("_ood_held_generator", "contains(generator_model, 'Qwen2.5-72B')")):
        out.append(s(f"cbrn_synth_v1{suffix}", "science", "cbrn-synth-v1", ("question",), ("answer",), label="1", where=f"{judged} AND {condition}", metadata=kept))
    out += _deception()
    kept = ("id", "domain", "split", "site", "taxonomy_category", "topic", "generator_model", "generation_method", "content_safety_mode", "source_protocol_version", "prohibited_ood_sources")
    locked = {"domain": ("cbrn", "hallucination", "cyber_assistant", "deception"), "split": ("train", "calibration", "iid")}
    for version in ("v1", "v2"):
        out.append(
            s(f"frozen_protocol_{version}", "ood", f"frozen_protocol_{version}/{{domain}}_{{split}}", messages="messages", build=lambda d, **_: d.withColumn("_y", D.row_label(d)), label="_y", options={"domain": None, "split": None}, choices=locked, metadata=kept)
        )
    return out + _multi_turn()


def _deception() -> list[Spec]:
    """Deception sources; variants, models and topics are options."""
    model = {"model_name": None}

    def s(name: str, folder: str, build: Callable[..., DataFrame], **more) -> Spec:  # noqa: ANN003
        return Spec(name, "deception", folder, build=build, final=True, **more)

    def variant(default: str, *names: str) -> dict:
        return {"options": {"variant": default}, "choices": {"variant": names}}

    return [
        s("dolus_chat", "DolusChat", X.secrets),
        s("roleplaying", "deception-rollouts/roleplaying-{model_name}", X.rollouts(), options=model),
        s("insider_trading", "deception-insider-trading/{variant}/{model_name}", X.insider, options={"variant": "upscale", **model}, choices={"variant": ("upscale", "onpolicy", "doubledown")}, metadata=("report", "expected_label")),
        s("truthful_qa", "truthful_qa", X.truthful),
        s("ai_liar", "how_to_catch_an_ai_liar/goal_directed_lying", X.goal_directed, **variant("original_with_answers", *X.LIAR_VARIANTS)),
        s("azaria_mitchell", "azaria-mitchell", X.statements("Tell me a fact.", X.FACT_TOPICS), options={"topic": None}, metadata=("topic",)),
        s("repe", "deception-repe", X.role_play, **variant("you_are_fact_sys", *X.ROLE_PROMPTS)),
        s("werewolf", "werewolf/{variant}", X.werewolf, **variant("paired", "paired", "open_response"), texts={"rules": "werewolf/rules.txt"}, metadata=("description", "role", "night_info", "discussion")),
        s("sandbagging", "deception-rollouts/sandbagging-{model_name}", X.rollouts("<step4>", keep_system=False), options=model),
        s("ai_audit", "ai_audit", X.audits, read=X.audit_rows, **variant("no_reasoning", "no_reasoning", "reasoning", "a1_2", "a1_2_reasoning"), metadata=("experiment", "experiment_variation")),
        s("liars_bench", "liars-bench/{config}", X.liars, options={"config": "instructed-deception", **model}, metadata=("model",)),
        s("fleed_claims", "deception-fleed-claims/{variant}", X.claims, **variant("definitional", "definitional", "evidential", "fictional", "logical")),
        s("geometry_of_truth", "deception-geometry-of-truth/{variant}", X.open_statements, **variant("cities", "cities", "neg_cities", "larger_than", "smaller_than", "common_claim_true_false", "companies_true_false")),
        s("internal_state", "internal-state", X.statements(X.STATE, X.FACT_TOPICS, "variant"), **variant("animals", *[t for t in X.FACT_TOPICS if t != "generated"])),
        s("ethics_commonsense", "hendrycks_ethics", X.ethics),
        s("sycophancy", "deception-sycophancy/{model_name}", X.sycophancy, options={"variant": "mmlu_stem_same_conf_all", **model}, choices={"variant": ("mmlu_stem_all", "mmlu_stem_conf_all", "mmlu_stem_same_conf_all")}),
        s("alpaca_rollout", "deception-rollouts/alpaca-{model_name}", X.rollouts(), options=model),
    ]


def _multi_turn() -> list[Spec]:
    """Sources by method, by context length, and benign ones: JSON conversations with their own metadata."""
    methods = {
        "cyberrisk": ("prefix_stitch", "middle_stitch", "topic_chain", "kill_chain", "backward_context", "escalation"),
        "virology": ("prefix_stitch", "middle_stitch", "topic_chain", "backward_context", "escalation"),
        "harmfulness": ("prefix_stitch", "middle_stitch", "backward_context", "escalation"),
    }
    topics = {"cyberrisk": "cybersecurity", "virology": "science", "harmfulness": "harmfulness"}
    out = []
    for family, names in methods.items():
        for method in [*names, *[f"long_context_{k}k" for k in (4, 8, 16, 32)]]:
            name = f"{family}_{method}"
            out.append(Spec(name, topics[family], f"multi-turn/{name}", messages="conversation", label="1", metadata=("base_ids", "method", "n_turns")))
    for name in ("wildchat_multi_turn", *[f"long_context_{k}k" for k in (4, 8, 16, 32)]):
        out.append(Spec(f"{name}_negative", "harmfulness", f"multi-turn/negatives/{name}", messages="conversation", metadata=("base_ids",)))
    return out


REGISTRY: dict[str, Spec] = {}


def _ready() -> dict[str, Spec]:
    if not REGISTRY:
        REGISTRY.update({s.name: s for s in _specs()})
        register_manifest([{"id": str(i), "name": n, "category": c} for i, n, c in probing_tasks.TASKS])
    return REGISTRY


def register(spec: Spec) -> None:
    """Adds a source of one's own."""
    if spec.topic not in TOPICS:
        raise ValueError(f"unknown topic {spec.topic!r}")
    _ready()[spec.name] = spec


def register_manifest(manifest: Sequence[Mapping[str, str]], excluded: Sequence[str] = ()) -> list[str]:
    """Binary probing tasks of a manifest of (id, name, category): `sparse_probing_{id}_{name}`, a prompt labelled 1 or not."""
    skip, names = set(map(str, excluded)), []
    for row in manifest:
        if str(row["id"]) in skip:
            continue
        name = f"sparse_probing_{row['id']}_{row['name']}"
        register(Spec(name, "sparse_probing", f"sparse_probing/{row['id']}_{row['name']}", ("prompt",), label=_YES, description=row.get("category", "")))
        names.append(name)
    return names


def list_datasets(topic: str | None = None) -> list[str]:
    return sorted(n for n, s in _ready().items() if topic in (None, s.topic))


def list_categories() -> list[str]:
    """Categories of the binary probing tasks."""
    return sorted({c for _, _, c in probing_tasks.TASKS})


def probing_sources(category: str | None = None) -> list[str]:
    """The binary probing tasks of a category, or all."""
    return [f"sparse_probing_{i}_{n}" for i, n, c in probing_tasks.TASKS if category in (None, c)]


def list_topics() -> list[str]:
    return sorted({s.topic for s in _ready().values()})


def info(name: str) -> Spec:
    if name not in _ready():
        raise KeyError(f"no source {name!r}; there are {sorted(_ready())}")
    return _ready()[name]


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Whatever format the mirror holds at a path: a file with a suffix, or the files of a folder."""
    readers = ((".parquet", spark.read.parquet), (".jsonl", lambda p: io.read_json_lines(spark, p)), (".json", lambda p: io.read_json_array(spark, p)), (".csv", lambda p: io.read_csv(spark, p)), (".tsv", lambda p: io.read_tsv(spark, p)), (".yaml", lambda p: io.read_yaml_records(spark, p)))
    for suffix, read in readers:
        if files.exists(spark, path + suffix):
            return read(path + suffix)
        if files.matches(spark, f"{path}/*{suffix}"):
            return read(f"{path}/*{suffix}")
    raise FileNotFoundError(f"no mirror of the source at {path}")


def numbered(dialogues: DataFrame) -> DataFrame:
    """dialogues with sample_id, a hash of the content and of its number among equal rows. Equal rows share a task."""
    content = F.md5(F.to_json(F.struct("messages", "label", F.array_sort(F.map_entries("metadata")).alias("m"))))
    hashed = dialogues.withColumn("_h", content)
    place = F.row_number().over(W.partitionBy("_h").orderBy("_h"))
    return hashed.withColumn("sample_id", F.xxhash64("_h", place)).drop("_h")


def load(spark: SparkSession, name: str, root: str | None = None, shuffled: bool = True, **options: str | None) -> DataFrame:
    """(sample_id, dataset, messages, label, metadata) of a source under its options, with its place in the shuffled order."""
    spec = info(name)
    held, base = spec.resolved(options), root or ROOT
    path = f"{base}/{spec.folder.format(**held)}"
    rows = spec.read(spark, path, **held) if spec.read else _read(spark, path)
    held |= {k: files.read_text(spark, f"{base}/{file}") for k, file in spec.texts.items()}
    out = numbered(spec.dialogues(rows, held)).select("sample_id", F.lit(name).alias("dataset"), "messages", "label", "metadata")
    return D.shuffle(out) if shuffled else out
