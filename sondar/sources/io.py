"""Readers and writers of records: delimited files, JSON, JSON lines, YAML, text, HTTP JSON and plain records."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondar.operators.dataset import coerce_label
from sondar.sources import files
from sondar.sources.builders import MESSAGES, from_messages

#: Largest file that is parsed by one Python task (YAML, HTTP); larger ones are an error.
MAX_BYTES = 256_000_000


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path (or pattern) there is; FileNotFoundError names them all."""
    for p in paths:
        if files.matches(spark, p):
            return p
    raise FileNotFoundError(f"none of {list(paths)} exists")


def latest(spark: SparkSession, pattern: str) -> str:
    """The last of the files that match, in order of their names."""
    found = files.matches(spark, pattern)
    if not found:
        raise FileNotFoundError(pattern)
    return found[-1]


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.options(header=True, multiLine=True, escape='"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated; words such as NA and empty fields stay text."""
    reader = spark.read.options(header=True, sep="\t", quote='"', escape='"', multiLine=True, nullValue="\x00", emptyValue="")
    out = (reader.schema(schema) if schema else reader).csv(path)
    return out.na.fill("")


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(text): whole files, without line ends around them."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^[\r\n]+|[\r\n]+$", "").alias("text"))


def read_yaml(spark: SparkSession, path: str, rows: Callable[[object], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that a function makes of a parsed YAML file. Needs a YAML module."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs the module yaml") from e
    return spark.createDataFrame(list(rows(yaml.safe_load(files.read_text(spark, path, MAX_BYTES)))), schema)


def read_yaml_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a YAML list, with the schema Spark infers of them as JSON. Needs a YAML module."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs the module yaml") from e
    records = yaml.safe_load(files.read_text(spark, path, MAX_BYTES))
    lines = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    return spark.read.json(lines.rdd.map(lambda r: r.value))


def read_http_json(spark: SparkSession, url: str, schema: str, *, allow_network: bool = False, timeout: float = 30) -> DataFrame:
    """A JSON array behind a URL; off unless allow_network is set."""
    if not allow_network:
        raise PermissionError("network sources are off: pass allow_network=True")
    from urllib.error import URLError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=timeout) as r:  # noqa: S310
            body = r.read(MAX_BYTES + 1)
    except (URLError, TimeoutError) as e:
        raise ConnectionError(f"{url}: {e}") from e
    if len(body) > MAX_BYTES:
        raise ValueError(f"{url} has more than {MAX_BYTES} bytes")
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in json.loads(body)], schema)


def read_union(spark: SparkSession, read: Callable[[str], DataFrame], paths: Mapping[str, str], column: str, *, skip_missing: bool = False) -> DataFrame:
    """All files, each with its key in a constant column, merged by name. A missing file is an error; with skip_missing it
    is left out, with a warning, as long as there is one."""
    missing = [p for p in paths.values() if not files.matches(spark, p)]
    if missing and (not skip_missing or len(missing) == len(paths)):
        raise FileNotFoundError(f"{missing} don't exist")
    if missing:
        warnings.warn(f"left out: {missing}", stacklevel=2)
    parts = [read(p).withColumn(column, F.lit(k)) for k, p in paths.items() if p not in missing]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def decoded(column: Column, schema: str) -> Column:
    """A JSON text as a value of the schema; null if it doesn't parse."""
    return F.from_json(column, schema)


def pretty(column: Column) -> Column:
    """A value as indented JSON."""
    return F.to_json(column, {"pretty": "true"})


def from_records(spark: SparkSession, records: Iterable[Mapping], *, name: str = "records", messages_key: str = "messages", label_key: str = "label", metadata_key: str = "metadata", include_extra: bool = True) -> DataFrame:
    """(sample_id, dataset, messages, label, metadata) of plain records.

    A record without messages or label raises KeyError, metadata that is no mapping TypeError. Other fields go into
    the metadata, where they override nested keys. Labels may be integers, booleans or words.
    """
    rows = []
    for i, r in enumerate(records):
        for key in (messages_key, label_key):
            if key not in r:
                raise KeyError(key)
        nested = r.get(metadata_key) or {}
        if not isinstance(nested, Mapping):
            raise TypeError(f"metadata of record {i} is no mapping")
        held = dict(nested)
        if include_extra:
            held |= {k: v for k, v in r.items() if k not in (messages_key, label_key, metadata_key)}
        texts = [{"role": str(m.get("role") or m.get("from") or "user"), "content": m.get("content") or m.get("value") or ""} for m in r[messages_key]]
        rows.append((i, name, texts, str(r[label_key]), {str(k): v if isinstance(v, str) or v is None else json.dumps(v) for k, v in held.items()}))
    df = spark.createDataFrame(rows, f"sample_id bigint, dataset string, messages {MESSAGES}, label string, metadata map<string,string>")
    return df.withColumn("label", coerce_label(F.col("label")))


def from_json_lines(spark: SparkSession, path: str, *, name: str | None = None, messages_key: str = "messages", label_key: str = "label", metadata_key: str = "metadata", include_extra: bool = True) -> DataFrame:
    """The same of a file of JSON lines, read in parallel; blank lines are skipped, the name is the file's stem."""
    text = spark.read.text(path).where("trim(value) <> ''").select("value", F.monotonically_increasing_id().alias("sample_id"))
    fields = F.from_json("value", "map<string,string>")
    parsed = text.select("sample_id", fields.alias("f"))
    messages = from_messages(F.from_json(F.col("f")[messages_key], "array<map<string,string>>"))
    nested = F.coalesce(F.from_json(F.try_element_at("f", F.lit(metadata_key)), "map<string,string>"), F.create_map().cast("map<string,string>"))
    extra = F.map_filter("f", lambda k, _: ~k.isin(messages_key, label_key, metadata_key))
    kept = F.map_filter(nested, lambda k, _: ~F.map_contains_key(extra, k)) if include_extra else nested
    metadata = F.map_concat(kept, extra) if include_extra else nested
    stem = name or os.path.splitext(os.path.basename(path))[0]
    return parsed.select("sample_id", F.lit(stem).alias("dataset"), messages.alias("messages"), coerce_label(F.col("f")[label_key]).alias("label"), metadata.alias("metadata"))


def metadata_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metadata keys as columns of their own; null where a record lacks one."""
    return df.select("*", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in keys])


def to_records(df: DataFrame, *, nested: bool = True, include_name: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """(messages, label, metadata) or, flat, the metadata keys as columns; with the dataset's name if wanted."""
    names = [F.col("dataset").alias("name")] if include_name else []
    if nested:
        return df.select("messages", "label", "metadata", *names)
    return metadata_columns(df, keys).select("messages", "label", *keys, *names)


def to_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with sorted keys, in as many files as partitions; parent folders are made."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)
