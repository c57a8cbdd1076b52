"""Tokens of dialogues with their places, messages and roles.

Messages are merged and rendered natively; every rendered piece knows its message, so
content spans are exact by construction. Tokens come from an Arrow stage, one row each:
(sample_id, pos, token_id, token, char_start, char_end, msg_idx, role_id), with -1 where
no message or role is. A sample without tokens is a row of the samples table only.

The Arrow stage has a whole sample at hand, so what masks need of a token's neighbours (the
role dilated by the template's padding, places in the message) can be had from it, without
a window or a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondar.functions.text import normalize_role, strip_all
from sondar.operators import batching
from sondar.session import small, spread

ROLE_IDS = {"system": 0, "user": 1, "assistant": 2}
TOKEN = "token_id bigint, token string, char_start int, char_end int, msg_idx int, role_id tinyint"
#: Fixed value: ids of tokens that may open a sequence.
BOS_IDS = (0, 1, 2, 128000)


@dataclass(frozen=True)
class Template:
    """How a family of chat models marks messages: text before all, before and after each message, names of roles, whether
    system text goes into the first user turn, and how many tokens left and right of a message count as its padding."""

    start: str = ""
    before: str = ""
    after: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    fold_system: bool = False
    padding: tuple[int, int] = (0, 0)


# Markup and token padding of the four families.
TEMPLATES = {
    "llama": Template("<|begin_of_text|>", "<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>", (), False, (4, 1)),
    "gemma": Template("<bos>", "<start_of_turn>{role}\n", "<end_of_turn>\n", (("assistant", "model"),), True, (3, 2)),
    "qwen": Template("", "<|im_start|>{role}\n", "<|im_end|>\n", (), False, (3, 2)),
    "qwen3": Template("", "<|im_start|>{role}\n", "<|im_end|>\n", (), False, (7, 2)),
}
#: Without a template: 'System: ', 'User: ' and 'Assistant: ' before each message; a lone user message stands bare.
PLAIN = Template("", "{Role}: ", "\n\n")


def detect_template(name: str = "", chat_template: str | None = None) -> str:
    """Family by the tokenizer's name, else by the markup of its chat template, else 'unknown'."""
    low = (name or "").lower()
    for family in ("llama", "gemma", "qwen3", "qwen"):
        if family in low:
            return family
    marks = (("<|start_header_id|>", "llama"), ("<start_of_turn>", "gemma"), ("<|im_start|>", "qwen"))
    found = next((family for mark, family in marks if mark in (chat_template or "")), "unknown")
    thinks = any(mark in (chat_template or "") for mark in ("enable_thinking", "<think>"))
    return "qwen3" if found == "qwen" and thinks else found


def get_template(name: str = "", chat_template: str | None = None, template: str | None = None) -> Template:
    if template is not None:
        if template not in TEMPLATES:
            raise ValueError(f"unknown template {template!r}; there are {sorted(TEMPLATES)}")
        return TEMPLATES[template]
    return TEMPLATES.get(detect_template(name, chat_template), PLAIN)


MESSAGES = "array<struct<role:string,content:string>>"


def merged(messages: Column, fold_system: bool = False) -> Column:
    """Stripped messages, neighbours of one role joined by a blank, null content as empty. With fold_system leading system
    text becomes user text before two line ends, and a dialogue that doesn't begin with the user gets an empty user turn."""
    plain = F.transform(messages, lambda m: F.struct(normalize_role(m["role"]).alias("role"), strip_all(F.coalesce(m["content"], F.lit(""))).alias("content")))
    if fold_system:
        head = F.get(plain, F.lit(0))
        folded = F.struct(F.lit("user").alias("role"), F.concat(head["content"], F.lit("\n\n")).alias("content"))
        plain = F.when(head["role"] == "system", F.concat(F.array(folded), F.slice(plain, 2, F.greatest(F.size(plain) - 1, F.lit(0))))).otherwise(plain)

    def step(out: Column, m: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        text = F.when(last["content"] == "", m["content"]).when(m["content"] == "", last["content"]).otherwise(F.concat_ws(" ", last["content"], m["content"]))
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["role"].alias("role"), text.alias("content"))))
        return F.when(last["role"] == m["role"], joined).otherwise(F.concat(out, F.array(m)))

    out = F.aggregate(plain, F.array().cast(MESSAGES), step)
    if fold_system:
        empty = F.array(F.struct(F.lit("user").alias("role"), F.lit("").alias("content")))
        out = F.when((F.size(out) > 0) & (F.get(out, F.lit(0))["role"] != "user"), F.concat(empty, out)).otherwise(out)
    return out


def pieces(messages: Column, template: Template = PLAIN) -> Column:
    """(before, content, after) of each merged message under a template."""
    names = dict(template.roles)

    def piece(m: Column) -> Column:
        role = m["role"]
        for theirs, ours in names.items():
            role = F.when(m["role"] == theirs, ours).otherwise(role)
        before = F.replace(F.replace(F.lit(template.before), F.lit("{role}"), role), F.lit("{Role}"), F.initcap(role))
        return F.struct(before.alias("before"), m["content"].alias("content"), F.lit(template.after).alias("after"))

    built = F.transform(messages, piece)
    if template is PLAIN:
        alone = (F.size(messages) == 1) & (F.get(messages, F.lit(0))["role"] == "user")
        bare = F.transform(messages, lambda m: F.struct(F.lit("").alias("before"), m["content"].alias("content"), F.lit("").alias("after")))
        built = F.when(alone, bare).otherwise(built)
    return built


def rendered(dialogues: DataFrame, template: Template = PLAIN, id_col: str = "sample_id", messages: str = "messages", add_generation_prompt: bool = False) -> DataFrame:
    """(sample_id, text, spans): the text, and (msg_idx, role_id, s, e) of each message's content in it. A generation prompt
    opens the assistant's turn after all messages; without a template there is none."""
    m = dialogues.select(F.col(id_col).alias("sample_id"), merged(F.col(messages), template.fold_system).alias("m"))
    p = m.withColumn("p", pieces(F.col("m"), template))
    whole = F.concat(F.lit(template.start), F.array_join(F.transform("p", lambda x: F.concat(x["before"], x["content"], x["after"])), ""))
    if add_generation_prompt and template is not PLAIN:
        whole = F.concat(whole, F.lit(template.before.replace("{role}", dict(template.roles).get("assistant", "assistant"))))
    text = F.regexp_replace(whole, r"\s+$", "") if template is PLAIN else whole
    start = F.struct(F.lit(len(template.start)).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["before"])
        e = s + F.length(x["content"])
        return F.struct((e + F.length(x["after"])).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    spans = F.aggregate("p", start, step, lambda acc: acc["out"])
    with_roles = F.zip_with("m", spans, lambda m, s: F.struct(_role_id(m["role"]).alias("role_id"), s["s"].alias("s"), s["e"].alias("e")))
    return p.select("sample_id", text.alias("text"), with_roles.alias("spans"))


def _role_id(role: Column) -> Column:
    out = F.lit(-1)
    for name, k in ROLE_IDS.items():
        out = F.when(role == name, F.lit(k)).otherwise(out)
    return out.cast("int")


_LOSSLESS = re.compile(r"[ \t\n\f\r]+|[A-Za-z0-9_]+|[^ \t\n\f\rA-Za-z0-9_]+")
Encoding = tuple[list[int], list[int], list[int]]


_MEMO = 200_000
_IDS: dict[str, int] = {}


def lossless(text: str) -> Encoding:
    """(ids, starts, ends): runs of white space, of ASCII word characters and of all else; ids are hashes of the token."""
    tokens = _LOSSLESS.findall(text)
    ids = list(map(_IDS.get, tokens))
    if None in ids:
        if len(_IDS) > _MEMO:
            _IDS.clear()
        for token in tokens:
            if token not in _IDS:
                _IDS[token] = xxhash.xxh3_64_intdigest(token) >> 1
        ids = [_IDS[t] for t in tokens]
    ends = list(accumulate(map(len, tokens)))
    return ids, [0, *ends[:-1]] if ends else [], ends


def lossless_sums(samples: DataFrame) -> DataFrame:
    """(sample_id, n, chars, starts) of the lossless tokens of (sample_id, text): how many there are, their characters, and the
    sum of their starts. Narrow, with one row a sample."""
    id_type = samples.schema["sample_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                sizes = list(map(len, _LOSSLESS.findall(text or "")))
                total = sum(sizes)
                rows.append((len(sizes), total, sum(accumulate(sizes)) - total))
            sums = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in sums)], ["sample_id", "n", "chars", "starts"])

    return spread(samples.select("sample_id", "text")).mapInArrow(run, f"sample_id {id_type}, n bigint, chars bigint, starts bigint")


def tokenizer_file(path: str) -> Callable[[str], Encoding]:
    """Encoder of a tokenizer file (JSON) that gives character offsets; loaded once in each worker."""
    held: list = []

    def encode(text: str) -> Encoding:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        e = held[0].encode(text, add_special_tokens=False)
        return e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets]

    return encode


#: Columns of places: of a token in its message, from either end from 1 on, and of the last message that has tokens.
PLACES = "msg_up int, msg_down int, last_msg int"


def dilated(roles: np.ndarray, padding: tuple[int, int]) -> np.ndarray:
    """Roles of a sample's tokens, each spread over `left` tokens before and `right` after it; of several, assistant goes
    before user before system."""
    left, right = padding
    n, out = len(roles), roles.copy()
    at = np.arange(n)
    lo, hi = np.maximum(at - right, 0), np.minimum(at + left + 1, n)
    for k in sorted(ROLE_IDS.values()):
        seen = np.concatenate([[0], np.cumsum(roles == k)])
        out[seen[hi] > seen[lo]] = k
    return out


def _message_places(messages: np.ndarray) -> list[np.ndarray]:
    """The PLACES of a sample's tokens. The tokens of a message, and those of none, may lie apart."""
    order = np.argsort(messages, kind="stable")
    ordered = messages[order]
    first = np.searchsorted(ordered, ordered, "left")
    size = np.searchsorted(ordered, ordered, "right") - first
    up, down = np.empty(len(messages), np.int32), np.empty(len(messages), np.int32)
    up[order] = np.arange(len(messages)) - first + 1
    down[order] = size - (np.arange(len(messages)) - first)
    return [up, down, np.full(len(messages), messages.max(initial=-1), np.int32)]


def tokenize(samples: DataFrame, encode: Callable[[str], Encoding] = lossless, padding: tuple[int, int] | None = None, bos_ids: Sequence[int] = BOS_IDS, places: bool = False) -> DataFrame:
    """One row per token of (sample_id, text, spans). A token has the role of the content it overlaps. With padding also
    role_id_padded, as with_padded_roles() gives it, and with places the columns of PLACES. Narrow: no shuffle."""
    id_type = samples.schema["sample_id"].dataType.simpleString()
    schema = f"sample_id {id_type}, pos int, {TOKEN}" + (", role_id_padded tinyint" if padding else "") + (f", {PLACES}" if places else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, texts, columns = [], [], [[] for _ in names[2:]]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids, starts, ends = encode(text or "")
                sizes.append(len(ids))
                texts.extend([text[a:b] for a, b in zip(starts, ends)])
                start, end = np.array(starts, np.int32), np.array(ends, np.int32)
                held = [(i, s["role_id"], s["s"], s["e"]) for i, s in enumerate(spans or []) if s["e"] > s["s"]]
                which, role, lo, hi = np.array([*held, (-1, -1, 2**31 - 1, 2**31 - 1)], np.int64).T
                at = np.searchsorted(hi, start, "right")
                inside = lo[at] < end
                messages, roles = np.where(inside, which[at], -1).astype(np.int32), np.where(inside, role[at], -1).astype(np.int8)
                own = [np.array(ids, np.int64), None, start, end, messages, roles]
                if padding:
                    padded = dilated(roles, padding)
                    if ids and ids[0] in bos_ids:
                        padded[0] = 0
                    own.append(padded)
                if places:
                    own.extend(_message_places(messages))
                for column, values in zip(columns, own):
                    column.append(values)
            sizes = np.array(sizes, np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            arrays = [pa.array(texts, pa.string()) if n == "token" else pa.array(np.concatenate(c) if c else []) for n, c in zip(names[2:], columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(pos.astype(np.int32)), *[a.cast(t) for a, t in zip(arrays, types)]], names)

    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int8(), *([pa.int8()] if padding else []), *([pa.int32()] * 3 if places else [])]
    return spread(samples.select("sample_id", "text", "spans")).mapInArrow(run, schema)


def tokenize_dataset(dialogues: DataFrame, mask, template: Template = PLAIN, encode: Callable[[str], Encoding] = lossless, add_generation_prompt: bool = False) -> DataFrame:  # noqa: ANN001
    """Tokens of (sample_id, messages) with (det) by a mask: rendered, tokenized with the template's padding, and masked."""
    from sondar.operators import masks

    samples = rendered(dialogues, template, add_generation_prompt=add_generation_prompt)
    return masks.apply(tokenize(samples, encode, padding=template.padding, places=True), mask, samples)


def with_padded_roles(tokens: DataFrame, padding: tuple[int, int], bos_ids: Sequence[int] = BOS_IDS) -> DataFrame:
    """tokens with (role_id_padded): a token has a role if one within `right` tokens before or `left` tokens after it has;
    of several, assistant goes before user before system. A first token that opens a sequence counts as system text."""
    left, right = padding
    frame = W.partitionBy("sample_id").orderBy("pos").rowsBetween(-right, left)
    value = F.col("role_id").cast("int")
    for k in sorted(ROLE_IDS.values()):
        value = F.when(F.max((F.col("role_id") == k).cast("int")).over(frame) == 1, k).otherwise(value)
    opens = (F.col("pos") == 0) & F.col("token_id").isin(*bos_ids)
    return tokens.withColumn("role_id_padded", F.when(opens, 0).otherwise(value).cast("tinyint"))


def lengths(tokens: DataFrame, samples: DataFrame) -> DataFrame:
    counts = tokens.groupBy("sample_id").agg(F.count("*").alias("n"))
    return samples.select("sample_id").join(counts, "sample_id", "left").na.fill(0, ["n"])


def gather(tokens: DataFrame, samples: DataFrame, indices: Sequence[int]) -> DataFrame:
    """Tokens of the samples at positions in order of id, with (idx); order and repeats kept, negative ones from the end.
    The chosen ids go to the tokens if they are few; else both are sorted. The tokens are never broadcast: what the files of
    their texts measure says nothing of how many there are."""
    from sondar.operators.dataset import gather as rows

    chosen = rows(samples.select("sample_id"), indices)
    return small(chosen).join(tokens.hint("merge"), "sample_id")


def truncate(tokens: DataFrame, max_tokens: int, side: str = "left", preserve: str | None = "det") -> DataFrame:
    """At most max_tokens of each sample: its last ones for side 'left', its first for 'right'; positions start again at 0.
    Raises if a token of the preserve column would be cut."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be positive")
    if side not in ("left", "right"):
        raise ValueError("side is 'left' or 'right'")
    n = F.count("*").over(W.partitionBy("sample_id"))
    numbered = tokens.withColumn("_n", n)
    first = F.greatest(F.col("_n") - max_tokens, F.lit(0)) if side == "left" else F.lit(0)
    kept = (F.col("pos") >= first) & (F.col("pos") < first + max_tokens)
    if preserve and preserve in tokens.columns:
        cut = F.when(F.col(preserve) & ~kept, F.raise_error(F.lit("a preserved token would be cut"))).otherwise(kept)
        numbered = numbered.withColumn("_kept", cut.cast("boolean"))
    else:
        numbered = numbered.withColumn("_kept", kept)
    return numbered.where("_kept").withColumn("pos", (F.col("pos") - first).cast("int")).drop("_n", "_kept")


def padded(tokens: DataFrame, samples: DataFrame, pad_id: int = 0, padding_side: str = "right", batches: DataFrame | None = None) -> DataFrame:
    """(sample_id, ids, attention): ids of each sample filled up on one side, to the longest one of all or, with
    planned batches (sample_id, n, batch), of its batch."""
    rows = tokens.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token_id"))), lambda t: t["token_id"]).alias("ids"))
    joined = samples.select("sample_id").join(rows, "sample_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    joined = joined.withColumn("longest", tokens.agg(F.max("pos") + 1).scalar()) if batches is None else joined.join(batching.longest(batches), "sample_id")
    missing = (F.col("longest") - F.size("ids")).cast("int")
    fill, real, none = F.array_repeat(F.lit(pad_id).cast("bigint"), missing), F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), missing)
    pair = (lambda a, b: F.concat(a, b)) if padding_side == "right" else (lambda a, b: F.concat(b, a))
    return joined.select("sample_id", pair(F.col("ids"), fill).alias("ids"), pair(real, none).alias("attention"))
