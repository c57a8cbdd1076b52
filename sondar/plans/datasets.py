"""Queries of dataset operators and dialogue builders over dialogues, wildguard_mix, documents and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondar.functions.text import ROLE_ALIASES, normalize_role, source_name, split_name
from sondar.operators import dataset as D
from sondar.sources import builders as B
from sondar.session import table


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dialogues").select("sample_id", source_name(F.col("dataset")).alias("dataset"), split_name(F.col("split")).alias("split"), "messages", "label", "metadata")


DIALOGUES = """WITH d AS (SELECT sample_id, regexp_replace(lower(regexp_replace(dataset, '^\\s+|\\s+$', '', 'g')), '[\\s\\-_]+', '_', 'g') AS dataset, split, messages, label, metadata FROM dialogues)
"""
_ROLE = "CASE lower({r}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLE_ALIASES.items()) + " ELSE lower({r}) END"
_HASH = "md5(CAST(sample_id AS VARCHAR) || '|42')"
_IDS = "SELECT sample_id, label FROM "


def _two(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "label")


def _where_positive(spark, sf):  # noqa: ANN001, ANN202
    return _two(D.positive(dialogues(spark, sf)))


def _label_coerce(spark, sf):  # noqa: ANN001, ANN202
    harm = F.regexp_replace(F.lower("prompt_harm_label"), "^unharmful$", "negative")
    harm = F.regexp_replace(harm, "^harmful$", "Positive")
    w = table(spark, sf, "wildguard_mix").select("record_id", D.coerce_label(harm).alias("label"))
    return w.groupBy("label").agg(F.count("*").alias("n"))


def _shuffle(spark, sf):  # noqa: ANN001, ANN202
    return D.shuffle(dialogues(spark, sf)).select("sample_id", F.col("rank").cast("bigint").alias("rank"))


def _sample(spark, sf):  # noqa: ANN001, ANN202
    return _two(D.sample(dialogues(spark, sf), 500))


def _sample_stratified(spark, sf):  # noqa: ANN001, ANN202
    return _two(D.sample(dialogues(spark, sf), 501, stratified=True))


def _split(spark, sf):  # noqa: ANN001, ANN202
    return D.split(dialogues(spark, sf), 0.8).select("sample_id", "part")


def _split_stratified(spark, sf):  # noqa: ANN001, ANN202
    return D.split(dialogues(spark, sf), 0.7, stratified=True).select("sample_id", "part")


def _capped(spark, sf):  # noqa: ANN001, ANN202
    return D.capped(dialogues(spark, sf), "dataset", 20).select("sample_id", "dataset")


def _dedup(spark, sf):  # noqa: ANN001, ANN202
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return D.drop_repeats(docs, ["text", "lang"], "doc_id").select("doc_id")


def _dedup_dialogue(spark, sf):  # noqa: ANN001, ANN202
    return _two(D.drop_repeats(dialogues(spark, sf), ["messages", "label"], "sample_id"))


def _union(spark, sf):  # noqa: ANN001, ANN202
    a = dialogues(spark, sf).select(F.col("sample_id").alias("id"), "label", F.try_element_at("metadata", F.lit("difficulty")).alias("difficulty"))
    b = table(spark, sf, "wildguard_mix").select(F.col("record_id").alias("id"), F.lit(1).alias("label"), "subcategory")
    return D.union(a, b, "dialogues", "wildguard").groupBy("source", "label", "difficulty", "subcategory").agg(F.count("*").alias("n"))


def _limit(spark, sf):  # noqa: ANN001, ANN202
    return _two(D.first_n(dialogues(spark, sf).where("label = 1"), 100, "sample_id"))


def _gather(spark, sf):  # noqa: ANN001, ANN202
    return D.gather(dialogues(spark, sf), [5, 0, 5, -1, 17]).select("idx", "sample_id")


def _keep(spark, sf):  # noqa: ANN001, ANN202
    ids = table(spark, sf, "source_registry").where("topic = 'harmfulness'").select(source_name(F.col("dataset")).alias("dataset"))
    return _two(D.keep_ids(dialogues(spark, sf), ids, "dataset"))


def _exclude(spark, sf):  # noqa: ANN001, ANN202
    ids = table(spark, sf, "source_registry").where("target_share IS NOT NULL").select(source_name(F.col("dataset")).alias("dataset"))
    return _two(D.exclude_ids(dialogues(spark, sf), ids, "dataset"))


def _lookup(spark, sf):  # noqa: ANN001, ANN202
    level = F.try_element_at("metadata", F.lit("difficulty"))
    d = dialogues(spark, sf).withColumn("grade", D.lookup(level, {"easy": 1, "medium": 2, "hard": 3}))
    return d.groupBy("grade").agg(F.count("*").alias("n"))


def _roles(spark, sf):  # noqa: ANN001, ANN202
    m = dialogues(spark, sf).select(F.explode("messages").alias("m")).select(normalize_role(F.col("m.role")).alias("role"))
    return m.groupBy("role").agg(F.count("*").alias("n"))


def _from_messages(spark, sf):  # noqa: ANN001, ANN202
    d = dialogues(spark, sf).select("sample_id", F.posexplode(B.from_structs(F.col("messages"))).alias("i", "m"))
    return d.select("sample_id", F.col("i").cast("bigint").alias("i"), "m.role", F.length("m.content").alias("chars"))


def _question_answer(spark, sf):  # noqa: ANN001, ANN202
    w = table(spark, sf, "wildguard_mix")
    qa = B.question_answer([F.col("prompt"), F.col("response")], [F.col("response")], [F.col("subcategory")])
    return w.select("record_id", F.size(qa).alias("n"), F.get(qa, F.lit(0))["role"].alias("first"))


def _paired(spark, sf):  # noqa: ANN001, ANN202
    w = table(spark, sf, "wildguard_mix").where("response IS NOT NULL").select("record_id", "prompt", "response")
    p = B.paired(w, F.array(B.message("user", F.col("prompt"))), F.array(B.message("user", F.col("response"))))
    return p.select("record_id", "label", F.length(F.get("messages", F.lit(0))["content"]).alias("chars"))


def _choices(spark, sf):  # noqa: ANN001, ANN202
    p = table(spark, sf, "part")
    text = B.multiple_choice(F.col("p_name"), F.array("p_brand", "p_type", F.col("p_size").cast("string")))
    return p.select("p_partkey", text.alias("text"))


def _alternating(spark, sf):  # noqa: ANN001, ANN202
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    turns = B.alternating(F.filter(F.split("text", "\\. "), lambda t: t != ""))
    return d.select("doc_id", F.size(F.filter(turns, lambda m: m["role"] == "user")).alias("users"), F.size(turns).alias("turns"))


def _last_words(spark, sf):  # noqa: ANN001, ANN202
    w = table(spark, sf, "wildguard_mix")
    head, tail = B.head_and_tail(F.col("prompt"))
    return w.select("record_id", head.alias("head"), tail.alias("tail"))


def _last_message(spark, sf):  # noqa: ANN001, ANN202
    d = dialogues(spark, sf)
    return d.select("sample_id", F.length(B.last_of_role(F.col("messages"), "user")).alias("user_chars"), F.length(B.last_of_role(F.col("messages"), "assistant")).alias("assistant_chars"))


def _before_last(spark, sf):  # noqa: ANN001, ANN202
    w = table(spark, sf, "wildguard_mix")
    head, tail = B.before_last(F.col("prompt"), ". ")
    return w.select("record_id", F.length(head).alias("head"), F.length(tail).alias("tail"))


def _transcript(spark, sf):  # noqa: ANN001, ANN202
    d = table(spark, sf, "documents").where("text LIKE '%User: %'")
    t = B.transcript(d, "doc_id", "text", {"User:": "user", "Assistant:": "assistant"})
    return t.select("doc_id", F.size("messages").alias("turns"), F.size(F.filter("messages", lambda m: m["role"] == "user")).alias("users"))


QUERIES = {
    "dataset_where_positive": _where_positive,
    "dataset_label_coerce": _label_coerce,
    "dataset_shuffle_rank": _shuffle,
    "dataset_sample_n": _sample,
    "dataset_sample_stratified": _sample_stratified,
    "dataset_split_plain": _split,
    "dataset_split_stratified": _split_stratified,
    "dataset_cap_per_group": _capped,
    "dataset_dedup_keep_first": _dedup,
    "dataset_dedup_dialogue_label": _dedup_dialogue,
    "dataset_union_with_source": _union,
    "dataset_limit_before_shuffle": _limit,
    "dataset_gather_indices": _gather,
    "dataset_keep_semi": _keep,
    "dataset_exclude_anti": _exclude,
    "dataset_lookup_map": _lookup,
    "builder_normalize_role": _roles,
    "builder_from_messages": _from_messages,
    "builder_question_answer": _question_answer,
    "builder_paired": _paired,
    "builder_multiple_choice": _choices,
    "builder_alternating": _alternating,
    "builder_last_words": _last_words,
    "builder_last_of_role": _last_message,
    "builder_before_last": _before_last,
    "builder_transcript": _transcript,
}

_KIND = "CASE WHEN label = 1 THEN 1 ELSE 0 END"
_NAME = "regexp_replace(lower(regexp_replace(dataset, '^\\s+|\\s+$', '', 'g')), '[\\s\\-_]+', '_', 'g')"

ORACLES = {
    "dataset_where_positive": "SELECT sample_id, label FROM dialogues WHERE label = 1",
    "dataset_label_coerce": """SELECT CASE lower(prompt_harm_label) WHEN 'harmful' THEN 1 WHEN 'unharmful' THEN 0 END AS label, count(*) AS n FROM wildguard_mix GROUP BY 1""",
    "dataset_shuffle_rank": f"SELECT sample_id, row_number() OVER (ORDER BY {_HASH}, sample_id) AS rank FROM dialogues",
    "dataset_sample_n": f"SELECT sample_id, label FROM dialogues ORDER BY {_HASH}, sample_id LIMIT 500",
    "dataset_sample_stratified": f"""WITH c AS (SELECT count(*) FILTER (WHERE label = 1) AS pos, count(*) AS n FROM dialogues),
k AS (SELECT least(round_even(501.0::DOUBLE * pos / n, 0), pos) AS kp, 501 - least(round_even(501.0::DOUBLE * pos / n, 0), pos) AS kn FROM c),
r AS (SELECT sample_id, label, row_number() OVER (PARTITION BY {_KIND} ORDER BY {_HASH}, sample_id) AS rk FROM dialogues)
SELECT sample_id, label FROM r, k WHERE rk <= CASE WHEN label = 1 THEN kp ELSE kn END""",
    "dataset_split_plain": f"""WITH r AS (SELECT sample_id, row_number() OVER (ORDER BY {_HASH}, sample_id) AS rk, count(*) OVER () AS n FROM dialogues)
SELECT sample_id, CASE WHEN rk <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r""",
    "dataset_split_stratified": f"""WITH r AS (SELECT sample_id, row_number() OVER (PARTITION BY {_KIND} ORDER BY {_HASH}, sample_id) AS rk, count(*) OVER (PARTITION BY {_KIND}) AS n FROM dialogues)
SELECT sample_id, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r""",
    "dataset_cap_per_group": DIALOGUES
    + f", r AS (SELECT sample_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY {_HASH}, sample_id) AS rk FROM d) SELECT sample_id, dataset FROM r WHERE rk <= 20",
    "dataset_dedup_keep_first": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang",
    "dataset_dedup_dialogue_label": "SELECT min(sample_id) AS sample_id, label FROM dialogues GROUP BY messages, label",
    "dataset_union_with_source": """SELECT source, label, difficulty, subcategory, count(*) AS n FROM (
SELECT 'dialogues' AS source, label, metadata['difficulty'] AS difficulty, NULL AS subcategory FROM dialogues
UNION ALL SELECT 'wildguard', 1, NULL, subcategory FROM wildguard_mix) GROUP BY ALL""",
    "dataset_limit_before_shuffle": "SELECT sample_id, label FROM dialogues WHERE label = 1 ORDER BY sample_id LIMIT 100",
    "dataset_gather_indices": """WITH r AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS pos, count(*) OVER () AS n FROM dialogues),
w(idx, p) AS (VALUES (0, 5), (1, 0), (2, 5), (3, -1), (4, 17))
SELECT CAST(idx AS BIGINT) AS idx, sample_id FROM w JOIN r ON r.pos = CASE WHEN p < 0 THEN n + p ELSE p END""",
    "dataset_keep_semi": DIALOGUES + f"SELECT sample_id, label FROM d WHERE dataset IN (SELECT {_NAME} FROM source_registry WHERE topic = 'harmfulness')",
    "dataset_exclude_anti": DIALOGUES + f"SELECT sample_id, label FROM d WHERE dataset NOT IN (SELECT {_NAME} FROM source_registry WHERE target_share IS NOT NULL)",
    "dataset_lookup_map": "SELECT CASE metadata['difficulty'] WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 END AS grade, count(*) AS n FROM dialogues GROUP BY 1",
    "builder_normalize_role": f"SELECT {_ROLE.format(r='m.role')} AS role, count(*) AS n FROM (SELECT unnest(messages) AS m FROM dialogues) GROUP BY 1",
    "builder_from_messages": f"""WITH x AS (SELECT sample_id, unnest(list_filter(list_transform(messages, lambda m: {{'role': {_ROLE.format(r="coalesce(m.role, 'user')")}, 'content': coalesce(m.content, '')}}),
 lambda m: m.role IN ('system', 'user', 'assistant') AND m.content <> '')) AS m,
 generate_subscripts(list_filter(list_transform(messages, lambda m: {{'role': {_ROLE.format(r="coalesce(m.role, 'user')")}, 'content': coalesce(m.content, '')}}),
 lambda m: m.role IN ('system', 'user', 'assistant') AND m.content <> ''), 1) - 1 AS i FROM dialogues)
SELECT sample_id, CAST(i AS BIGINT) AS i, m.role AS role, length(m.content) AS chars FROM x""",
    "builder_question_answer": """SELECT record_id, CASE WHEN coalesce(nullif(prompt, ''), nullif(response, '')) IS NULL THEN NULL ELSE
 1 + CASE WHEN nullif(response, '') IS NULL THEN 0 ELSE 1 END + CASE WHEN nullif(subcategory, '') IS NULL THEN 0 ELSE 1 END END AS n,
 CASE WHEN coalesce(nullif(prompt, ''), nullif(response, '')) IS NULL THEN NULL WHEN nullif(subcategory, '') IS NULL THEN 'user' ELSE 'system' END AS first FROM wildguard_mix""",
    "builder_paired": """SELECT record_id, 0 AS label, length(prompt) AS chars FROM wildguard_mix WHERE response IS NOT NULL
UNION ALL SELECT record_id, 1, length(response) FROM wildguard_mix WHERE response IS NOT NULL""",
    "builder_multiple_choice": "SELECT p_partkey, p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_size AS text FROM part",
    "builder_alternating": """WITH t AS (SELECT doc_id, len(list_filter(string_split(text, '. '), lambda x: x <> '')) AS turns FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(ceil(turns / 2.0) AS BIGINT) AS users, turns FROM t""",
    "builder_last_words": """WITH w AS (SELECT record_id, string_split(prompt, ' ') AS w FROM wildguard_mix)
SELECT record_id, CASE WHEN len(w) > 5 THEN array_to_string(w[1:len(w) - 5], ' ') WHEN w IS NULL THEN NULL ELSE '' END AS head,
 CASE WHEN len(w) > 5 THEN ' ' || array_to_string(w[len(w) - 4:], ' ') ELSE array_to_string(w, ' ') END AS tail FROM w""",
    "builder_last_of_role": f"""SELECT sample_id, length(list_filter(messages, lambda m: {_ROLE.format(r='m.role')} = 'user')[-1].content) AS user_chars,
 length(list_filter(messages, lambda m: {_ROLE.format(r='m.role')} = 'assistant')[-1].content) AS assistant_chars FROM dialogues""",
    "builder_before_last": """SELECT record_id, CASE WHEN contains(prompt, '. ') THEN length(prompt) - strpos(reverse(prompt), ' .') - 1 END AS head,
 CASE WHEN contains(prompt, '. ') THEN strpos(reverse(prompt), ' .') + 1 END AS tail FROM wildguard_mix""",
    "builder_transcript": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text LIKE '%User: %'),
m AS (SELECT *, CASE WHEN starts_with(line, 'User:') THEN 'user' WHEN starts_with(line, 'Assistant:') THEN 'assistant' END AS role FROM l),
g AS (SELECT *, count(role) OVER (PARTITION BY doc_id ORDER BY i) AS turn FROM m),
t AS (SELECT doc_id, turn, max(role) AS role, string_agg(CASE WHEN role IS NULL THEN line ELSE substr(line, strpos(line, ':') + 1) END, chr(10) ORDER BY i) AS content FROM g WHERE turn > 0 GROUP BY doc_id, turn)
SELECT doc_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS users FROM t WHERE regexp_replace(content, '[\\s]+', '', 'g') <> '' GROUP BY doc_id""",
}
