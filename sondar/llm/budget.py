"""Token budget of a corpus by source, language and domain (problem 2).

What is known is a table of counts (content hash, tokenizer hash, tokens), a table of
records (which content each record had) and a cube of totals. A new snapshot changes
them by signed deltas: a record that is gone or has another content or slice counts -1
with its old values, a new one +1 with its new ones. Only contents without a count
under this tokenizer are encoded; the cube takes the summed deltas, nothing else.

    snapshot -> hashes (native) -> contents without a count -> encoded (Arrow, narrow)
    old and new records -> signed deltas -> partial sums per cell -> new cube

The first snapshot goes the same way, from an empty state. Hashes travel through the
shuffles; texts do so only where neither the contents that have a count nor those that
have none fit in a broadcast. A task encodes a content once, however often it meets it.

Defined results
    null or empty text   -> 0 tokens; the record counts
    null source, language, domain -> a cell of its own (null source, 'und', null domain)
    null record id       -> no record
    repeated record ids  -> the row that came last counts (column came, nulls first; ties by
                            the greatest content hash, then cell), one only
    repeated texts       -> one count, every record adds to its cell
    empty tables         -> empty cube
    extra columns        -> ignored; texts are encoded whole
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondar.functions.text import language_code, source_name
from sondar.llm import bpe
from sondar.session import small, spread, table, written

CELL = ["source_table", "source", "language", "domain"]
RECORD = ["source_table", "record_id"]
_COLUMNS = [*RECORD, "content", *CELL[1:]]
_MEMO = 500_000


def tokenizer_hash(path: str) -> str:
    """Hash of the vocabulary file and of the pre-token pattern."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + bpe.PRETOKEN.encode()).hexdigest()[:32]


@dataclass
class State:
    """What is known after a snapshot; counts may hold several tokenizers."""

    counts: DataFrame  # content, tokenizer, tokens
    records: DataFrame  # source_table, record_id, content, source, language, domain, tokens
    cube: DataFrame  # source_table, source, language, domain, records, tokens

    def kept(self) -> State:
        """Written to the shared folder, to be the old state of the next snapshot."""
        return State(written(self.counts, "counts"), written(self.records, "records"), written(self.cube, "cube"))


def _hash(text):  # noqa: ANN001, ANN202
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def empty(spark: SparkSession) -> State:
    """The state before the first snapshot."""

    def none(columns: str) -> DataFrame:  # an empty relation that the optimizer knows to be empty
        return spark.sql(f"SELECT {', '.join(f'CAST(NULL AS {t}) AS {c}' for c, t in map(str.split, columns.split(', ')))} WHERE false")

    cells = "source_table string, source string, language string, domain string"
    return State(
        none("content binary, tokenizer string, tokens bigint"),
        none("source_table string, record_id string, content binary, source string, language string, domain string, tokens bigint"),
        none(f"{cells}, records bigint, tokens bigint"),
    )


def counted(texts: DataFrame, path: str) -> DataFrame:
    """(content, tokens) of texts (content, text), each content once a task. Narrow: no shuffle."""
    shared = texts.sparkSession.sparkContext.broadcast(bpe.perfect_hash(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bpe.encoder_of(shared).count
        seen: set[bytes] = set()
        for batch in batches:
            if len(seen) > _MEMO:
                seen.clear()
            at = []
            for k, content in enumerate(batch.column(0).to_pylist()):
                if content not in seen:
                    seen.add(content)
                    at.append(k)
            pick = pa.array(at, pa.int64())
            numbers = [count(t) for t in batch.column(1).take(pick).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), pa.array(numbers, pa.int64())], ["content", "tokens"])

    return texts.select("content", "text").mapInArrow(run, "content binary, tokens bigint")


def _once(rows: DataFrame) -> DataFrame:
    """rows (RECORD, content, cell, came) with one row a record, the last that came. Only rows of repeated ids are sorted."""
    again = rows.groupBy(*RECORD).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = small(written(again, "again"))
    last = rows.join(again, RECORD, "left_semi").groupBy(*RECORD).agg(F.max(F.struct("came", *_COLUMNS[2:])).alias("row"))
    return rows.join(again, RECORD, "left_anti").select(*_COLUMNS).unionByName(last.select(*RECORD, *[f"row.{c}" for c in _COLUMNS[2:]]))


def _without_count(texts: DataFrame, contents: DataFrame, known: DataFrame) -> DataFrame:
    """texts (content, text) of the contents without a count. What is joined is the smaller of the contents with and without one."""
    held = contents.join(known.select("content", F.lit(True).alias("known")), "content", "left")
    held = written(held.select("content", F.coalesce("known", F.lit(False)).alias("known")), "contents")
    counts = {r.known: r["count"] for r in held.groupBy("known").count().collect()}
    if not counts.get(True):
        return texts
    fewer = counts[True] <= counts.get(False, 0)
    side = small(held.where(F.col("known") == fewer).select("content"))
    return texts.join(side, "content", "left_anti" if fewer else "left_semi")


def update(snapshot: DataFrame, old: State | None = None, path: str | None = None) -> State:
    """The state after a snapshot (source_table, record_id, source, language, domain, text; came, the time it came, if known)."""
    path = path or bpe.vocabulary_path()
    mark = tokenizer_hash(path)
    seen_before = old is not None  # else no content has a count yet
    old = old or empty(snapshot.sparkSession)
    came = F.col("came") if "came" in snapshot.columns else F.lit(None).cast("timestamp")
    new = snapshot.where("record_id IS NOT NULL").withColumn("content", _hash(F.col("text")))
    known = old.counts.where(F.col("tokenizer") == mark).select("content", "tokens")
    bare = written(_once(new.select(*_COLUMNS, came.alias("came"))), "bare")
    texts = new.select("content", "text")
    unseen = _without_count(texts, bare.select("content").distinct(), known) if seen_before else texts
    fresh = written(counted(unseen, path).groupBy("content").agg(F.max("tokens").alias("tokens")), "fresh")
    counts = old.counts.unionByName(fresh.select("content", F.lit(mark).alias("tokenizer"), "tokens"))
    records = bare.join(known.unionByName(fresh), "content").select(*_COLUMNS, "tokens")
    sign = lambda df, n: df.select(*_COLUMNS, "tokens", F.lit(n).cast("bigint").alias("sign"))
    both = sign(records, 1).unionByName(sign(old.records, -1))
    # A record that stays as it was has both signs and adds nothing.
    deltas = both.groupBy(*_COLUMNS, "tokens").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    changes = deltas.groupBy(*CELL).agg(F.sum("sign").alias("records"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
    cube = old.cube.unionByName(changes).groupBy(*CELL).agg(F.sum("records").alias("records"), F.sum("tokens").alias("tokens"))
    return State(counts, records, cube.where("records <> 0 OR tokens <> 0"))


def totals(cube: DataFrame) -> DataFrame:
    """(by, source_table, source, language, domain, records, tokens): each cell, and totals by table, source, language and domain."""
    none = F.lit(None).cast("string")
    levels = (("cell", CELL), ("table", CELL[:1]), ("source", CELL[:2]), ("language", ["language"]), ("domain", ["domain"]))
    rows = [F.struct(F.lit(by).alias("by"), *[(F.col(c) if c in kept else none).alias(c) for c in CELL]) for by, kept in levels]
    # One pass over the cells: each adds to its total at every level.
    each = cube.select(F.explode(F.array(*rows)).alias("at"), "records", "tokens").select("at.*", "records", "tokens")
    return each.groupBy("by", *CELL).agg(F.sum("records").alias("records"), F.sum("tokens").alias("tokens"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of documents, dialogues and lmsys_chat, with the time each row came."""
    topics = table(spark, sf_dir, "source_registry").select(source_name(F.col("dataset")).alias("source"), _domain("topic").alias("domain"))
    topics = F.broadcast(topics.groupBy("source").agg(F.min("domain").alias("domain")))  # fixed: one row per registered source
    documents = spread(table(spark, sf_dir, "documents")).select(
        F.lit("documents").alias("source_table"),
        F.col("doc_id").cast("string").alias("record_id"),
        source_name(F.col("source")).alias("source"),
        _language(F.col("lang")),
        _domain("text_domain").alias("domain"),
        F.col("text"),
        F.col("crawled_at").alias("came"),
    )
    dialogues = spread(table(spark, sf_dir, "dialogues")).select(
        F.lit("dialogues").alias("source_table"),
        F.col("sample_id").cast("string").alias("record_id"),
        source_name(F.col("dataset")).alias("source"),
        _language(F.try_element_at("metadata", F.lit("language"))),
        _contents("messages"),
        F.col("ingested_at").alias("came"),
    )
    lmsys = spread(table(spark, sf_dir, "lmsys_chat")).select(
        F.lit("lmsys_chat").alias("source_table"),
        F.col("conversation_id").alias("record_id"),
        F.lit("lmsys_chat").alias("source"),
        _language(F.col("language")),
        _contents("conversation"),
        F.col("ingested_at").alias("came"),
    )
    chatted = dialogues.unionByName(lmsys).join(topics, "source", "left")
    return documents.unionByName(chatted)


def _contents(messages: str):  # noqa: ANN202
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n").alias("text")


def _language(label):  # noqa: ANN001, ANN202
    return F.coalesce(language_code(label), F.lit("und")).alias("language")


def _domain(name: str):  # noqa: ANN202
    return F.lower(F.trim(F.col(name)))


def earlier_runs(batches: DataFrame) -> DataFrame:
    """(source_table, record_id, earlier) of batches of another tokenizer: each record's tokens, where both its offsets are there."""
    newest = W.partitionBy("batch_id").orderBy(F.col("ingested_at").desc())
    once = batches.where("record_ids IS NOT NULL AND offsets IS NOT NULL").withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    each = once.select(source_name(F.col("dataset")).alias("dataset"), "offsets", F.posexplode("record_ids").alias("i", "record_id"))
    n = F.get("offsets", F.col("i") + 1) - F.get("offsets", F.col("i"))
    where = F.when(F.col("dataset") == "lmsys_chat", "lmsys_chat").otherwise("dialogues")
    return each.select(where.alias("source_table"), "record_id", n.alias("earlier")).where("earlier IS NOT NULL").groupBy("source_table", "record_id").agg(F.max("earlier").alias("earlier"))


def compared(records: DataFrame, batches: DataFrame) -> DataFrame:
    """(source_table, source, records, tokens, earlier, ratio) over the records of an earlier run."""
    both = records.join(earlier_runs(batches), RECORD)
    sums = both.groupBy("source_table", "source").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"), F.sum("earlier").alias("earlier"))
    return sums.withColumn("ratio", F.round(F.try_divide("tokens", "earlier"), 4))
