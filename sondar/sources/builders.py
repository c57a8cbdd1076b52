"""Builders of dialogues from rows of other shapes, as native expressions.

A dialogue is ARRAY<STRUCT<role, content>>. Null inputs give null or dropped messages as
each docstring says; no builder needs a Python worker or a shuffle unless it says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondar.functions.text import normalize_role, strip_all

MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def from_messages(messages: Column, role_field: str = "role", content_field: str = "content") -> Column:
    """Messages of any records: role from role_field or 'from' (default user), content from content_field or
    'value'; only system, user and assistant messages with content are kept, with aliases mapped."""

    def field(m: Column, *names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in names])

    built = F.transform(messages, lambda m: message(normalize_role(F.coalesce(field(m, role_field, "from"), F.lit("user"))), F.coalesce(field(m, content_field, "value"), F.lit(""))))
    return F.filter(built, lambda m: m["role"].isin("system", "user", "assistant") & (m["content"] != ""))


def from_structs(messages: Column) -> Column:
    """The same for messages that already are (role, content) structs."""
    built = F.transform(messages, lambda m: message(normalize_role(F.coalesce(m["role"], F.lit("user"))), F.coalesce(m["content"], F.lit(""))))
    return F.filter(built, lambda m: m["role"].isin("system", "user", "assistant") & (m["content"] != ""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def question_answer(user: Sequence[Column], assistant: Sequence[Column], system: Sequence[Column] = ()) -> Column:
    """[system] user [assistant] from the first filled alias of each side; null without a user text."""
    asked = first_filled(*user)
    parts = [F.when(first_filled(*system).isNotNull(), message("system", first_filled(*system)))] if system else []
    parts.append(message("user", asked))
    if assistant:
        parts.append(F.when(first_filled(*assistant).isNotNull(), message("assistant", first_filled(*assistant))))
    return F.when(asked.isNotNull(), F.array_compact(F.array(*parts)))


def paired(df: DataFrame, negative: Column, positive: Column) -> DataFrame:
    """One row becomes two: the negative dialogue with label 0 and the positive one with label 1."""
    both = F.array(F.struct(F.lit(0).alias("label"), negative.alias("messages")), F.struct(F.lit(1).alias("label"), positive.alias("messages")))
    return df.select("*", F.explode(both).alias("_pair")).select("*", "_pair.label", "_pair.messages").drop("_pair")


def variants(df: DataFrame, prompts: Sequence[tuple[str, int]], text: Column) -> DataFrame:
    """Each row under every (prompt, label): the prompts are a literal array, so no join is needed."""
    each = F.array(*[F.struct(F.lit(p).alias("prompt"), F.lit(y).alias("label")) for p, y in prompts])
    exploded = df.select("*", F.explode(each).alias("_v")).select("*", "_v.prompt", "_v.label").drop("_v")
    return exploded.withColumn("messages", F.array(message("user", F.concat(F.col("prompt"), text))))


def multiple_choice(question: Column, choices: Column) -> Column:
    """The question and one line 'A. choice' for each choice."""
    lines = F.transform(choices, lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), c))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"))


def alternating(turns: Column, persona: Column | None = None) -> Column:
    """Even turns are the user's, odd ones the assistant's; a persona becomes a system message."""
    built = F.transform(turns, lambda t, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), t))
    return built if persona is None else F.concat(F.array(message("system", persona)), built)


def last_of_role(messages: Column, role: str) -> Column:
    """Content of the last message of a role; null if there is none."""
    return F.get(F.filter(messages, lambda m: normalize_role(m["role"]) == role), F.size(F.filter(messages, lambda m: normalize_role(m["role"]) == role)) - 1)["content"]


def head_and_tail(text: Column, n: int = 5) -> tuple[Column, Column]:
    """All but the last n words, and the last n with a blank before them if there were more."""
    words = F.split(text, " ")
    size = F.size(words)
    tail = F.array_join(F.slice(words, F.greatest(size - n + 1, F.lit(1)), n), " ")
    head = F.when(size > n, F.array_join(F.slice(words, 1, F.greatest(size - n, F.lit(1))), " ")).otherwise(F.lit(""))
    return head, F.when(size > n, F.concat(F.lit(" "), tail)).otherwise(tail)


def before_last(text: Column, token: str) -> tuple[Column, Column]:
    """The text before the last occurrence of a token, and from it on; nulls where it doesn't occur."""
    at = F.length(text) - F.instr(F.reverse(text), token[::-1]) - len(token) + 1
    has = text.contains(token)
    return F.when(has, F.substr(text, F.lit(1), at)), F.when(has, F.substr(text, at + 1))


def transcript(df: DataFrame, id_col: str, text_col: str, marks: dict[str, str]) -> DataFrame:
    """(id, messages) of texts whose lines begin with a speaker's mark; other lines go on with the message before."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    role, body = F.lit(None).cast("string"), F.col("line")
    for mark, name in sorted(marks.items(), key=lambda x: -len(x[0]))[::-1]:
        starts = F.col("line").startswith(mark)
        role = F.when(starts, F.lit(name)).otherwise(role)
        body = F.when(starts, strip_all(F.substr(F.col("line"), F.lit(len(mark) + 1)))).otherwise(body)
    marked = lines.select(id_col, "line_no", role.alias("role"), body.alias("body"))
    order = W.partitionBy(id_col).orderBy("line_no")
    grouped = marked.withColumn("turn", F.count("role").over(order)).where("turn > 0")
    turns = grouped.groupBy(id_col, "turn").agg(F.max("role").alias("role"), F.sort_array(F.collect_list(F.struct("line_no", "body"))).alias("lines"))
    content = strip_all(F.array_join(F.transform("lines", lambda x: x["body"]), "\n"))
    built = turns.select(id_col, F.struct("turn", "role", content.alias("content")).alias("m")).where("m.content <> ''")
    return built.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: message(m["role"], m["content"])).alias("messages"))


def delimited(text: Column, marks: Sequence[str]) -> Column:
    """Alternating turns of a text split at any of the marks; blank parts are dropped."""
    pattern = "|".join(f"\\Q{m}\\E" for m in marks)
    return alternating(F.filter(F.transform(F.split(text, pattern), strip_all), lambda t: t != ""))


def rollouts(df: DataFrame, messages: str, outputs: str, grades: str, table: dict[str, int] | None = None, keep_system: bool = True, trim_token: str | None = None) -> DataFrame:
    """One labelled row per output: string grades by table, integer grades from 6 on positive, up to 2 negative, others
    dropped. The output fills a trailing empty assistant message or is appended; trim_token cuts it at its last occurrence."""
    each = df.select("*", F.posexplode(F.arrays_zip(F.col(outputs).alias("output"), F.col(grades).alias("grade"))).alias("rollout", "_r"))
    grade = F.col("_r.grade").cast("string")
    number = grade.try_cast("double")
    label = F.when(number >= 6, 1).when(number <= 2, 0)
    if table:
        label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), grade), label)
    output = F.col("_r.output")
    base = F.col(messages) if keep_system else F.filter(F.col(messages), lambda m: m["role"] != "system")
    last = F.get(base, F.size(base) - 1)
    fills = (last["role"] == "assistant") & (F.coalesce(last["content"], F.lit("")) == "")
    kept = F.when(fills, F.slice(base, 1, F.greatest(F.size(base) - 1, F.lit(0)))).otherwise(base)
    out = each.withColumn("_out", output if trim_token is None else before_last(output, trim_token)[0]).where(F.col("_out").isNotNull())
    return out.withColumn("label", label).where("label IS NOT NULL").withColumn("messages", F.concat(kept, F.array(message("assistant", F.col("_out"))))).drop("_r", "_out")


def numbered_placeholders(df: DataFrame, id_col: str, messages: str, placeholder: str, first: Column | None = None) -> DataFrame:
    """messages with each placeholder replaced by a counter, from first (1) on, that grows by one per message of the row that
    holds it."""
    first = F.lit(1) if first is None else first
    holds = lambda m: F.coalesce(m["content"].contains(placeholder), F.lit(False))
    counted = F.aggregate(
        F.col(messages),
        F.struct(F.lit(0).alias("n"), F.array().cast(MESSAGES).alias("out")),
        lambda a, m: F.struct(
            (a["n"] + holds(m).cast("int")).alias("n"),
            F.concat(a["out"], F.array(message(m["role"], F.replace(m["content"], F.lit(placeholder), (a["n"] + first).cast("string"))))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return df.withColumn(messages, counted)


def spans_label(spans: Column, bad: str = "Not Supported") -> Column:
    """1 if any annotated span has the bad label; malformed spans don't count."""
    good = F.filter(spans, lambda s: s.isNotNull() & s["index"].isNotNull() & s["span"].isNotNull())
    return F.exists(good, lambda s: s["label"] == bad).cast("int")


def with_default_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing columns as nulls of the given types."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
