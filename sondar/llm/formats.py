"""Copies of records that differ in formatting only (problem 3).

Dictionary encoding: every record falls apart into cells (field, kind, value). A task's
dictionary canonicalises each distinct value it meets once and gives the field and the
canonical value an integer identifier of 128 bits. Identifiers are hashes, so that all tasks
give the same value the same one and no cell has to be joined with a dictionary. A record
becomes the sorted tuple of its identifiers, and equal tuples, compacted to two integers,
are one group.

    records -> cells -> identifiers -> tuples (Arrow, narrow; (id, tuple) written once, 24 bytes a record)
            -> groups (partial aggregation) -> (keep_id, copy_id)

Texts never leave the task that read them. A group that a third of the rows share is folded by
partial aggregation; where its records meet it again, groups of LARGE records or more are joined
by broadcast if they fit, the rest by a shuffle. No group is ever collected.

Defined results
    strings       equal if their letters and digits, in order, case aside, are equal
    numbers       equal if their values are (1, 1.0, 1e0); never equal to strings or booleans
    null          a value of its own; a missing field differs from a null field
    payload null or unparsable -> the record has no copies, and is a group of one
    prompt null   -> the record has no copies, and is a group of one
    id null       -> no record
    repeated ids  -> one row for each different content (an id isn't a copy of itself)
    empty tables  -> empty result; extra columns are ignored
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondar.functions.text import strip_all
from sondar.session import small, spread, written

#: Records from which on a group is joined with its records by broadcast.
LARGE = 10_000

_MEMO = 200_000
_OTHERS = regex.compile(r"[^\p{L}\p{Nd}]+")
_ASCII_OTHERS = bytes(c for c in range(128) if not chr(c).isalnum())


def canonical(text: str) -> bytes:
    """Letters and digits of a text, in order, with case aside."""
    if text.isascii():
        return text.encode().translate(None, _ASCII_OTHERS).lower()
    return _OTHERS.sub("", text.upper().casefold()).encode("utf-8", "ignore")


class Dictionary:
    """Identifiers of fields and values; a distinct value is canonicalised once while it is remembered."""

    def __init__(self) -> None:
        self.identifiers: dict[int, int] = {}

    def identifier(self, field: str, kind: str, value: str) -> int:
        raw = xxhash.xxh3_128_intdigest(f"{field}\0{kind}\0{value}".encode("utf-8", "ignore"))
        if kind != "string":
            return raw
        held = self.identifiers.get(raw)
        if held is None:
            if len(self.identifiers) >= _MEMO:
                self.identifiers.clear()
            held = self.identifiers[raw] = xxhash.xxh3_128_intdigest(f"{field}\0{kind}\0".encode() + canonical(value))
        return held

    def tuple_of(self, cells: list[tuple[str, str, str]]) -> list[int]:
        """The sorted identifiers of a record's cells."""
        return sorted([self.identifier(*cell) for cell in cells])


def compact(identifiers: list[int]) -> tuple[int, int]:
    """A tuple of identifiers as two integers of 64 bits."""
    digest = hashlib.blake2b(b"".join([i.to_bytes(16) for i in identifiers]), digest_size=16).digest()
    return int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True)


@dataclass(frozen=True)
class Cells:
    """Records in a table (id, columns) and the function that makes the cells of one record of its columns; None if it has none."""

    records: DataFrame
    flatten: Callable[..., list[tuple[str, str, str]] | None]


def _number(n: Decimal) -> str:
    sign, digits, exponent = n.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    if not text:
        return "0"
    short = text.rstrip("0")
    return f"{'-' * sign}{short}e{exponent + len(text) - len(short)}"


def _reject(name: str) -> None:
    raise ValueError(name)


def flatten_json(text: str) -> list[tuple[str, str, str]] | None:
    """(field, kind, value) of every value of a JSON text, at every level; None if it doesn't parse."""
    try:
        top = json.loads(text, parse_float=Decimal, parse_int=Decimal, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None
    out, stack = [], [("$", top)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            out.append((path, "object", ""))
            stack.extend((f"{path}.{json.dumps(k)}", v) for k, v in value.items())
        elif isinstance(value, list):
            out.append((path, "array", str(len(value))))
            stack.extend((f"{path}[{i}]", v) for i, v in enumerate(value))
        elif isinstance(value, str):
            out.append((path, "string", value.encode("utf-8", "ignore").decode()))
        elif isinstance(value, Decimal):
            out.append((path, "number", _number(value)))
        else:
            out.append((path, "literal", json.dumps(value)))
    return out


def json_cells(records: DataFrame, id_col: str, payload_col: str) -> Cells:
    """Cells of every value of a JSON payload."""
    picked = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(payload_col).cast("string").alias("payload"))
    return Cells(picked, lambda text: None if text is None else flatten_json(text))


def column_cells(records: DataFrame, id_col: str, **columns) -> Cells:  # noqa: ANN003
    """Cells of named string columns; a record with a null in one of them has none."""
    names = list(columns)
    picked = records.select(F.col(id_col).cast("bigint").alias("id"), *[c.alias(n) for n, c in columns.items()])
    return Cells(picked, lambda *values: None if None in values else [(n, "string", v) for n, v in zip(names, values)])


def encoded(cells: Cells) -> DataFrame:
    """(id, high, low): each record's sorted tuple of identifiers, compacted; nulls for a record without cells. Narrow: no shuffle."""
    flatten = cells.flatten

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary()
        for batch in batches:
            keys = []
            for values in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                held = flatten(*values)
                keys.append((None, None) if held is None else compact(dictionary.tuple_of(held)))
            high, low = zip(*keys) if keys else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["id", "high", "low"])

    return spread(cells.records.where("id IS NOT NULL")).mapInArrow(run, "id bigint, high bigint, low bigint")


_KEY = ["high", "low"]


def _groups(keys: DataFrame, by: list[str]) -> DataFrame:
    return keys.where("high IS NOT NULL").groupBy(*by).agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))


def _pairs(keys: DataFrame, by: list[str]) -> DataFrame:
    """(by, keep_id, id): of every group of keys (by, id) the smallest id, with each other id."""
    groups = written(_groups(keys, by).where("n > 1"), "groups")
    large = small(groups.where(F.col("n") >= LARGE).drop("n"))
    rest = keys.join(large.select(*by), by, "left_anti").join(groups.where(F.col("n") < LARGE).drop("n"), by)
    return keys.join(large, by).unionByName(rest).where("id <> keep_id")


def copies(cells: Cells) -> DataFrame:
    """(keep_id, copy_id): of every group of equal records the smallest id, with each other id."""
    return _pairs(written(encoded(cells), "tuples"), _KEY).select("keep_id", F.col("id").alias("copy_id")).distinct()


def group_sizes(cells: Cells) -> DataFrame:
    """(keep_id, copies): one row per distinct record and how many records it stands for. A record without cells is
    a group of its own."""
    return _sizes(written(encoded(cells), "tuples"), _KEY).select("keep_id", "copies")


def _sizes(keys: DataFrame, by: list[str]) -> DataFrame:
    once = keys.distinct()
    alone = once.where("high IS NULL").select(*by, F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"))
    return _groups(once, by).withColumnRenamed("n", "copies").unionByName(alone)


def wildguard_cells(wildguard: DataFrame) -> Cells:
    harmful = F.coalesce(F.lower(strip_all(F.col("prompt_harm_label"))) == "harmful", F.lit(False))
    return column_cells(wildguard, "record_id", prompt=F.col("prompt"), harmful=harmful.cast("string"))


def _both(wildguard: DataFrame, raw_records: DataFrame) -> DataFrame:
    """(source_table, id, high, low) of the records of both tables."""
    w = encoded(wildguard_cells(wildguard)).withColumn("source_table", F.lit("wildguard_mix"))
    r = encoded(json_cells(raw_records, "raw_id", "payload")).withColumn("source_table", F.lit("raw_records"))
    return written(w.unionByName(r), "tuples")


def found(wildguard: DataFrame, raw_records: DataFrame) -> DataFrame:
    """(source_table, keep_id, copy_id) of both tables."""
    pairs = _pairs(_both(wildguard, raw_records), ["source_table", *_KEY])
    return pairs.select("source_table", "keep_id", F.col("id").alias("copy_id")).distinct()


def sizes(wildguard: DataFrame, raw_records: DataFrame) -> DataFrame:
    """(source_table, keep_id, copies) of both tables."""
    return _sizes(_both(wildguard, raw_records), ["source_table", *_KEY]).select("source_table", "keep_id", "copies")
