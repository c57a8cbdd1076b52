"""Masks over tokens: boolean columns from roles, messages, positions and text, closed under &, | and ~.

A mask is a small tree with a canonical key; masks of equal keys are equal. Applying one
adds a boolean column. Positions in messages come from the tokenizing stage or, where
tokens have none, from windows over one partitioning by sample. For text masks the tokens
of a sample meet its text once; one Arrow stage finds the places of all of them by binary
search, linear in the text, and gives each token a bit for each mask.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondar.operators.tokens import ROLE_IDS

# Fixed value: ids that are special where a tokenizer names none.
SPECIAL_IDS = (0, 1, 2, 3, 106, 107, 128000, 128001, 128256)
#: Text masks that fit in the bits of one integer.
MOST_TEXT_MASKS = 60


@dataclass(frozen=True)
class Mask:
    """A node: what it is, its parameters and the masks below it."""

    kind: str
    params: tuple = ()
    below: tuple[Mask, ...] = ()

    @property
    def key(self) -> str:
        inner = ", ".join([*map(repr, self.params), *[m.key for m in self.below]])
        return f"{self.kind}({inner})"

    def __and__(self, other: Mask) -> Mask:
        return Mask("and", (), (self, other))

    def __or__(self, other: Mask) -> Mask:
        return Mask("or", (), (self, other))

    def __invert__(self) -> Mask:
        return Mask("not", (), (self,))

    def __repr__(self) -> str:
        return self.key


def all() -> Mask:  # noqa: A001
    return Mask("all")


def none() -> Mask:
    return Mask("none")


def role(name: str, include_padding: bool = True) -> Mask:
    if name not in ROLE_IDS:
        raise ValueError(f"unknown role {name!r}")
    return Mask("role", (name, include_padding))


def assistant(include_padding: bool = True) -> Mask:
    return role("assistant", include_padding)


def user(include_padding: bool = True) -> Mask:
    return role("user", include_padding)


def system(include_padding: bool = True) -> Mask:
    return role("system", include_padding)


def nth_message(n: int) -> Mask:
    """Tokens of message n; negative n counts from the sample's last message."""
    return Mask("nth_message", (n,))


def first_n_tokens(n: int) -> Mask:
    """The first n tokens of each message."""
    return Mask("first_n", (_positive(n),))


def last_n_tokens(n: int) -> Mask:
    """The last n tokens of each message."""
    return Mask("last_n", (_positive(n),))


def last_token() -> Mask:
    return last_n_tokens(1)


def _positive(n: int) -> int:
    if n < 1:
        raise ValueError("n must be positive")
    return n


def between(start: str, end: str, inclusive: bool = False) -> Mask:
    """From every occurrence of start to the first end whose token comes after it. Exclusive bodies of one token are skipped."""
    return Mask("between", (start, end, inclusive))


def thinking(start: str = "<think>", end: str = "</think>", inclusive: bool = True) -> Mask:
    return between(start, end, inclusive)


def after(string: str, inclusive: bool = False) -> Mask:
    """From the first occurrence, or the character after it, to the end."""
    return Mask("after", (string, inclusive))


def before(string: str, inclusive: bool = False) -> Mask:
    """Up to the first occurrence, or with its last character."""
    return Mask("before", (string, inclusive))


def contains(text: str, case_sensitive: bool = False) -> Mask:
    """Every token that an occurrence touches; occurrences may overlap; an empty text occurs nowhere."""
    return Mask("contains", (text, case_sensitive))


def regex(pattern: str, flags: int = 0) -> Mask:
    """Every token that a match touches; an empty match selects the token at its place."""
    re.compile(pattern, flags)
    return Mask("regex", (pattern, flags))


def padding(base: Mask, before: int = 2, after: int = 2) -> Mask:  # noqa: A002
    """The mask and some tokens before and after each of its runs."""
    return Mask("padding", (before, after), (base,))


def special_tokens(ids: Sequence[int] | None = None) -> Mask:
    return Mask("special", (tuple(ids) if ids is not None else SPECIAL_IDS,))


TEXT_KINDS = ("between", "after", "before", "contains", "regex")


def _leaves(mask: Mask) -> list[Mask]:
    return [mask] if not mask.below else [leaf for m in mask.below for leaf in _leaves(m)]


def apply(tokens: DataFrame, mask: Mask, samples: DataFrame | None = None, name: str = "det") -> DataFrame:
    """tokens with the mask as a boolean column. samples (sample_id, text) are needed for text masks; without
    them those masks select nothing."""
    texts = list(dict.fromkeys(leaf for leaf in _leaves(mask) if leaf.kind in TEXT_KINDS))
    out, made = tokens, []
    places: dict[Mask, int] = {}
    if texts and samples is not None:
        out = _marked(tokens, samples, texts)
        places = {leaf: k for k, leaf in enumerate(texts)}
        made.append("_bits")
    counter = iter(range(10_000))

    def build(df: DataFrame, m: Mask) -> tuple[DataFrame, Column]:
        """The mask as a column of df; windows become columns of their own, as they can't be nested."""

        def windowed(value: Column) -> tuple[DataFrame, Column]:
            column = f"_m{next(counter)}"
            made.append(column)
            return df.withColumn(column, value), F.col(column)

        if m.kind in ("and", "or"):
            df, a = build(df, m.below[0])
            df, b = build(df, m.below[1])
            return df, (a & b) if m.kind == "and" else (a | b)
        if m.kind == "not":
            df, a = build(df, m.below[0])
            return df, ~a
        if m.kind == "padding":
            df, a = build(df, m.below[0])
            frame = W.partitionBy("sample_id").orderBy("pos").rowsBetween(-m.params[1], m.params[0])
            return windowed(F.max(a.cast("int")).over(frame) == 1)
        if m.kind in ("all", "none"):
            return df, F.lit(m.kind == "all")
        if m.kind == "role":
            column = "role_id_padded" if m.params[1] and "role_id_padded" in tokens.columns else "role_id"
            return df, F.col(column) == ROLE_IDS[m.params[0]]
        if m.kind == "nth_message":
            n = m.params[0]
            if n >= 0:
                return df, F.col("msg_idx") == n
            if "last_msg" in tokens.columns:
                return df, (F.col("msg_idx") == F.col("last_msg") + 1 + n) & (F.col("last_msg") + 1 + n >= 0)
            wanted = F.max("msg_idx").over(W.partitionBy("sample_id")) + 1 + n
            return windowed((F.col("msg_idx") == wanted) & (wanted >= 0))
        if m.kind in ("first_n", "last_n"):
            column = "msg_up" if m.kind == "first_n" else "msg_down"
            if column in tokens.columns:
                return df, (F.col("msg_idx") >= 0) & (F.col(column) <= m.params[0])
            order = F.col("pos").asc() if m.kind == "first_n" else F.col("pos").desc()
            rank = F.row_number().over(W.partitionBy("sample_id", "msg_idx").orderBy(order))
            return windowed((F.col("msg_idx") >= 0) & (rank <= m.params[0]))
        if m.kind == "special":
            return df, F.col("token_id").isin(*m.params[0])
        if m.kind in TEXT_KINDS:
            if m not in places:
                return df, F.lit(False)
            return df, F.getbit("_bits", F.lit(places[m])) == 1
        raise ValueError(f"unknown mask {m.kind!r}")

    out, column = build(out, mask)
    return out.withColumn(name, column).drop(*made)


def _marked(tokens: DataFrame, samples: DataFrame, leaves: Sequence[Mask]) -> DataFrame:
    """tokens with (_bits): for each text mask a bit. Tokens are shuffled once, by sample, and lie beside their text."""
    if len(leaves) > MOST_TEXT_MASKS:
        raise ValueError(f"more than {MOST_TEXT_MASKS} different text masks")
    held = [c for c in tokens.columns if c != "sample_id"]
    packed = tokens.groupBy("sample_id").agg(F.collect_list(F.struct(*held)).alias("_t")).join(samples.select("sample_id", "text"), "sample_id", "left")

    @F.pandas_udf("array<bigint>")
    def bits(texts: pd.Series, positions: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_bits(leaves, *row) for row in zip(texts, positions, starts, ends)], dtype=object)

    marks = bits("text", F.col("_t.pos"), F.col("_t.char_start"), F.col("_t.char_end"))
    rows = packed.select("sample_id", F.explode(F.arrays_zip(F.col("_t").alias("t"), marks.alias("b"))).alias("_r"))
    return rows.select("sample_id", *[F.col(f"_r.t.{c}").alias(c) for c in held], F.col("_r.b").alias("_bits")).select(*tokens.columns, "_bits")


def _bits(leaves: Sequence[Mask], text: str | None, positions: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of a sample's tokens, in the order they are given in."""
    order = np.argsort(positions, kind="stable")
    view = _Text(text or "", np.asarray(starts)[order], np.asarray(ends)[order])
    out = np.zeros(len(order), np.int64)
    for k, leaf in enumerate(leaves):
        edges = np.zeros(len(order) + 1, np.int64)
        a, b = view.covered(leaf)
        np.add.at(edges, a, 1)
        np.add.at(edges, b + 1, -1)
        out[order] |= (np.cumsum(edges[:-1]) > 0).astype(np.int64) << k
    return out


_NOWHERE = np.zeros(0, np.int64)


class _Text:
    """A text and the characters of its tokens, in order; answers which tokens a mask covers, as intervals of positions."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.s, self.e, self.n = text, starts, ends, len(ends)

    def token_at(self, c: np.ndarray) -> np.ndarray:
        """Position of the first token with start <= c < end; -1 if there is none."""
        at = np.searchsorted(self.e, c, "right")
        held = (c >= 0) & (at < self.n)
        held[held] = self.s[at[held]] <= c[held]
        return np.where(held, at, -1)

    def places(self, needle: str, overlapping: bool, text: str | None = None) -> np.ndarray:
        """Places of a literal in the text."""
        hay = self.text if text is None else text
        out, step = [], 1 if overlapping else len(needle)
        at = hay.find(needle) if needle else -1
        while at >= 0:
            out.append(at)
            at = hay.find(needle, at + step)
        return np.array(out, np.int64)

    def touched(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that character intervals [s, e) touch; empty ones touch the token at s."""
        a, b = np.searchsorted(self.e, s, "right"), np.searchsorted(self.s, e, "left") - 1
        empty = e <= s
        if empty.any():
            at = self.token_at(s)
            a, b = np.where(empty, at, a), np.where(empty, at, b)
        kept = (a >= 0) & (a <= b)
        return a[kept], b[kept]

    def covered(self, m: Mask) -> tuple[np.ndarray, np.ndarray]:
        if not self.n:
            return _NOWHERE, _NOWHERE
        if m.kind == "contains":
            needle, sensitive = m.params
            at = self.places(needle if sensitive else needle.lower(), True, None if sensitive else self.text.lower())
            return self.touched(at, at + len(needle))
        if m.kind == "regex":
            found = [x.span() for x in re.compile(*m.params).finditer(self.text)]
            s, e = np.array(found, np.int64).reshape(-1, 2).T
            return self.touched(s, e)
        last = self.n - 1
        if m.kind in ("after", "before"):
            string, inclusive = m.params
            at = self.text.find(string)
            if at < 0:
                return _NOWHERE, _NOWHERE
            if m.kind == "after":
                first = self.token_at(np.array([at if inclusive else at + len(string)]))
                return first[first >= 0], np.full((first >= 0).sum(), last)
            until = self.token_at(np.array([at + len(string) - 1 if inclusive else at - 1]))
            return np.zeros((until >= 0).sum(), np.int64), until[until >= 0]
        start, end, inclusive = m.params
        starts, ends = self.places(start, False), self.places(end, False)
        if inclusive:
            opened = self.token_at(starts)
            closed = np.where(self.token_at(ends) >= 0, self.token_at(ends + len(end) - 1), -1)
        else:
            after = self.token_at(starts + len(start) - 1)
            opened = np.where((self.token_at(starts) >= 0) & (after >= 0) & (after + 1 <= last), after + 1, -1)
            before = self.token_at(ends)
            closed = np.where(before > 0, before - 1, -1)
        opened, closed = opened[opened >= 0], np.sort(closed[closed >= 0])
        at = np.searchsorted(closed, opened, "right")  # the first close after each opening
        held = at < len(closed)
        return opened[held], closed[at[held]]
