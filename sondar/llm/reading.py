"""Reading level of documents (problem 9).

The words of the graded samples of a band, ranked by frequency, are the vocabulary of
that band. A document's coverage rank in a band is the size of the smallest top of that
vocabulary which covers a fixed share of the document's tokens: plain texts need few
words of the basic vocabulary and never get there with the others. Coverage ranks and
sentence length are then calibrated in SQL: each band's mean and spread over the graded
samples, and the nearest band in those units.

Only running text counts: code, links, tables, headings, list marks and speaker names
are cut off, and lines that hardly hold a known word (foreign ones) are left out.

Defined results
    null, empty, blank text, fewer than MIN_WORDS words of English -> no band
    text that is mostly not English -> no band, whatever its lang says
    ties between bands       -> the easier one
    repeated rows            -> one result each (p9_found: distinct)
    no graded samples        -> no document has a band
    extra columns            -> ignored
    texts of any length      -> read whole
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondar.llm.words import fold
from sondar.session import drawn, spread, written

BANDS = ("basic", "intermediate", "advanced")
SHARE = 0.6
MIN_WORDS = 40
#: A line with a smaller share of known words is foreign; foreign lines may hold at most half of the letters.
KNOWN_LINE = 0.35
#: Letters that a Chinese character counts besides itself when foreign text is weighed.
HAN_LETTERS = 2
#: Bounds on what is fitted and broadcast: graded samples, drawn by a hash of their text where there are more, and words of a
#: band's vocabulary.
MAX_GRADED = 20_000
MAX_VOCABULARY = 50_000
#: Weight of sentence length beside the coverage ranks, and least spread of a feature.
SENTENCE_WEIGHT = 0.2
LEAST_SPREAD = 0.25

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_LINK = re.compile(r"(?:https?://|www\.)\S+|`[^`\n]*`|\S+@\S+\.\w+")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_MARK = re.compile(r"^(?:[-*+•]|\d{1,3}[.)]|>|(?:user|assistant|system|human|bot|q|a)\s*:)\s*", re.I)
_CODE = re.compile(r"[{}=<>\\]|\w\(\w*\)|^\s*(?:def|return|for|import|select|class)\b.*[(:;]")
_HAN = re.compile(r"[\u3400-\u9fff]")
_WORD = re.compile(r"[^\W\d_]+").findall
_STOP = re.compile(r"[.!?。！？]+(?=\s|$|[\"'”’)])")


def prose(text: str | None) -> list[str]:
    """Lines of running text."""
    if not text:
        return []
    out = []
    for line in _LINE.split(_LINK.sub(" ", _FENCE.sub("\n", fold(text)))):
        line = line.strip()
        if not line or line[0] in "|#" or _CODE.search(line):
            continue
        out.append(_MARK.sub("", line))
    return out


def vocabularies(graded: list[tuple[str, str]]) -> dict[str, dict[str, int]]:
    """Each band's words and their ranks by frequency (ties in order of the words)."""
    counts = {band: Counter() for band in BANDS}
    for text, band in graded:
        if band in counts:
            for line in prose(text):
                counts[band].update(_WORD(line))
    return {
        band: {w: k for k, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:MAX_VOCABULARY], 1)}
        for band, c in counts.items()
    }


class Reader:
    """Coverage ranks of texts."""

    def __init__(self, ranks: dict[str, dict[str, int]]):
        self.ranks = [ranks[band] for band in BANDS]
        self.known = set().union(*self.ranks)

    def features(self, text: str | None) -> tuple | None:
        """(words, sentence words, coverage rank of each band) of the English running text; None
        without enough of it, or if no band covers the share. A band that doesn't has a rank past all words."""
        counts: Counter[str] = Counter()
        stops = own = foreign = 0
        known = self.known
        for line in prose(text):
            found = _WORD(line)
            if not found:
                continue
            if sum(map(known.__contains__, found)) < KNOWN_LINE * len(found):
                foreign += sum(map(len, found)) + HAN_LETTERS * len(_HAN.findall(line))
                continue
            counts.update(found)
            own += sum(map(len, found))
            stops += len(_STOP.findall(line)) or 1
        words = counts.total()
        if words < MIN_WORDS or foreign > own:
            return None
        need = SHARE * words
        ranks = []
        for rank in self.ranks:
            covered, at = 0, 2 * len(known) + 1
            for r, n in sorted((rank[w], n) for w, n in counts.items() if w in rank):
                covered += n
                if covered >= need:
                    at = r
                    break
            ranks.append(at)
        if min(ranks) > 2 * len(known):
            return None
        return (words, words / max(1, stops), *ranks)


FEATURES = "words int, sentence_words double, rank_basic int, rank_intermediate int, rank_advanced int"
_NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def measured(texts: DataFrame, id_col: str, ranks: dict[str, dict[str, int]], keep: str | None = None) -> DataFrame:
    """Features of the texts that have enough English running text. Narrow: no shuffle."""
    shared = texts.sparkSession.sparkContext.broadcast(ranks)
    held = [id_col] + ([keep] if keep else [])
    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in held) + ", " + FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(len(held)).to_pylist()):
                if (row := reader.features(text)) is not None:
                    at.append(k)
                    rows.append(row)
            pick = pa.array(at, pa.int64())
            columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
            types = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(pick) for i in range(len(held))] + [pa.array(c, t) for c, t in zip(columns, types)], held + _NAMES
            )

    return spread(texts.select(*held, F.col("text").cast("string").alias("text"))).mapInArrow(run, schema)


def calibration(graded_features: DataFrame) -> Column:
    """SQL expression that names the nearest band, from each band's mean and spread of the features."""
    logs = [F.ln(F.col(f"rank_{b}").cast("double")).alias(f"r{i}") for i, b in enumerate(BANDS)]
    logs.append(F.ln("sentence_words").alias("r3"))
    stats = graded_features.select("band", *logs).groupBy("band")
    rows = {r.band: r for r in stats.agg(*[f(f"r{i}").alias(f"{n}{i}") for i in range(4) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).collect()}
    terms = ["ln(cast(rank_basic as double))", "ln(cast(rank_intermediate as double))", "ln(cast(rank_advanced as double))", "ln(sentence_words)"]
    distances = []
    for band in BANDS:
        if band not in rows:
            distances.append("double('Infinity')")
            continue
        r, parts = rows[band], []
        for i, term in enumerate(terms):
            spread = max(LEAST_SPREAD, r[f"s{i}"])
            weight = 1.0 if i < 3 else SENTENCE_WEIGHT
            parts.append(f"{weight!r}D * least(abs({term} - {r[f'm{i}']!r}D) / {spread!r}D, 8D)")
        distances.append(" + ".join(parts))
    nearest = f"least({', '.join(distances)})"
    cases = " ".join(f"WHEN {d} = {nearest} THEN '{b}'" for b, d in zip(BANDS, distances) if b in rows)
    return F.expr(f"CASE {cases} END") if cases else F.lit(None).cast("string")


def levels(documents: DataFrame, graded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, band, words, sentence_words, coverage ranks) of every document with enough English text."""
    picked = graded.select("text", F.lower(F.trim("band")).alias("band")).where("text IS NOT NULL AND band IS NOT NULL")
    picked = written(drawn(picked, "text", MAX_GRADED), "graded")
    ranks = vocabularies([(r.text, r.band) for r in picked.collect()])
    band = calibration(measured(picked, "band", ranks))
    texts = documents.select(F.col(doc_id).alias("doc_id"), "text")
    return measured(texts, "doc_id", ranks).withColumn("band", band)


def profile(documents: DataFrame, graded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """levels() for every document id: one without enough English text, or that no band covers, has nulls."""
    every = documents.select(F.col(doc_id).alias("doc_id")).distinct()
    return every.join(levels(documents, graded, doc_id).dropDuplicates(["doc_id"]), "doc_id", "left")


def found(documents: DataFrame, graded: DataFrame) -> DataFrame:
    """(doc_id, band): the basic and the advanced documents."""
    return levels(documents, graded).where("band IN ('basic', 'advanced')").select("doc_id", "band").distinct()
