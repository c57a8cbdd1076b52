"""Language of dialogues, messages and segments (problem 1), by compression.

Each language has a zstandard raw-content dictionary. A sentence is encoded with the
dictionary of every language of its script; the smallest encoding names the language,
unless the next one is hardly larger or the dictionary saves hardly anything. Russian and
Chinese, alone of the seven in their scripts, are held against languages outside the seven
(Ukrainian, Bulgarian, Serbian; Japanese), and what is nearer to one of those is rejected.

The dictionaries start from seed text and are refined on labelled rows: at most
SAMPLE_ROWS rows in hash order, whose sentences count only where the seed dictionaries
agree with the label. A dictionary holds at most DICTIONARY_BYTES, so what is broadcast
is bounded. Every row of the corpus is classified, whole.

Defined results
    null, empty or blank content -> no sentence, no language
    null or unknown label        -> names no language
    code, numbers, links, tables of numbers, acknowledgements -> in no language
    fewer than MIN_WORDS words (MIN_HAN characters) -> no sentence of its own
    ties between languages       -> rejected (the margin is 0)
    repeated rows                -> one result (rows are distinct)
    empty tables                 -> empty result; extra columns are ignored
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondar.functions.text import language_code
from sondar.llm.seeds import RIVALS, SEEDS
from sondar.session import drawn, spread

#: Bounds of the sample the dictionaries are refined on: labelled rows, and of one of them messages, characters of
#: a message, sentences, and characters of a sentence.
SAMPLE_ROWS = 3_000
SAMPLE_MESSAGES = 4
SAMPLE_MESSAGE_CHARS = 800
SAMPLE_SENTENCES = 12
SAMPLE_CHARS = 400
DICTIONARY_BYTES = 24_000
MIN_WORDS = 4
MIN_HAN = 8
#: Least margin to the next language, in bytes and as a share of its size.
MARGIN_BYTES = 2
MARGIN_SHARE = 0.05
#: Most a sentence may keep of the size it has without any dictionary.
KEPT_SHARE = 0.97
#: Longer stretches without an end of sentence are classified in pieces of this many characters.
PIECE = 4_000
#: Compression level. At negative levels literals stay as they are and only matches with the dictionary shorten a text,
#: which is all that tells languages apart; levels from 1 on also spend time on coding the literals.
LEVEL = -1
#: Least bytes of a match, and bits of the table that finds matches, which has room for all places of a dictionary.
MIN_MATCH = 5
HASH_LOG = 15

LATIN = ("en", "es", "pt", "fr", "de")

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`|(?:https?://|www\.)\S+|\S+@\S+\.\w+|\[[A-Za-z_ ]{1,20}\]|<[^<>\n]{1,80}>")
_ITEM = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:[-*+•–—]|\d{1,3}[.)]|#{1,6}|>|\|)[ \t]*|(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*|[|\t]{1,}(?=\s*\|)")
_END = re.compile(r"[.!?…]+[\"”»’')\]]*(?:\s+|$)|[。！？]+|[:;]\s*\n")
_CODE = re.compile(r"[{}=;<>\\]|\w\(|\)\s*:|\bSELECT\b|\breturn\b.*[+\[]")
_MAYBE_CODE = re.compile(r"[{}=;<>\\(]|SELECT|return").search
_SPECIAL = re.compile(r"[`\[<@~]|://|www\.").search
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_KANA = re.compile(r"[぀-ヿ가-힯]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
#: Letters of other languages in Cyrillic.
_NOT_RUSSIAN = re.compile(r"[іїєґўјљњћђџѓќѕ]", re.I)
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")


#: Eight plain words in a row.
_LONG = re.compile(r"(?:[A-Za-z]+,? ){7}[A-Za-z]+").search

_LONG_LATIN = re.compile(r"(?:[A-Za-zÀ-ɏ]+,? ){7}[A-Za-zÀ-ɏ]+").search
_LONG_CYRILLIC = re.compile(r"(?:[Ѐ-ӿ]+,? ){4}[Ѐ-ӿ]+").search


class _Plain(dict):
    def __missing__(self, code: int):
        kind = unicodedata.category(chr(code))
        out = self[code] = None if kind in ("Mn", "Cf", "Cs") else " " if kind[0] in "CZ" else code
        return out


_PLAIN = _Plain()


def plain(sentence: str) -> str:
    """Lower case, without accents or invisible characters, single blanks."""
    if not sentence.isascii():
        sentence = unicodedata.normalize("NFKD", sentence).translate(_PLAIN)
    return " ".join(sentence.casefold().split()).strip(" -*#>|\"'“”«»()[]")


def sentences(content: str | None) -> list[str]:
    """The natural-language sentences of a message, in order, without code and links."""
    if not content:
        return []
    text = _INLINE.sub(" ", _FENCE.sub("\n\n", content)) if _SPECIAL(content) else content
    blocks = _ITEM.split("\n" + text) if "\n" in text or "\r" in text or "|" in text or text[:1] in "-*+#>•" else [text]
    out = []
    for block in blocks:
        if not block or block.isspace():
            continue
        for s in _END.split(block):
            if not s or (_MAYBE_CODE(s) and _CODE.search(s) and len(_TOKEN.findall(s)) < 8 and not _HAN.search(s)):
                continue
            if len(s) <= PIECE:
                out.append(s)
            else:
                out.extend(s[i : i + PIECE] for i in range(0, len(s), PIECE))
    return out


def running(content: str) -> str:
    """A whole message without code and links, for its main language."""
    return _INLINE.sub(" ", _FENCE.sub(" ", content)) if _SPECIAL(content) else content


def script(sentence: str) -> tuple[str, int] | None:
    """(script, words) of a sentence long enough to be one; None otherwise."""
    if sentence.isascii():
        if _LONG(sentence):
            return "latin", 8
        n = len(_TOKEN.findall(sentence))
        return ("latin", n) if n >= MIN_WORDS else None
    if _LONG_LATIN(sentence) and not _HAN.search(sentence) and not _CYRILLIC.search(sentence):
        return "latin", 8
    if _LONG_CYRILLIC(sentence) and not _HAN.search(sentence) and not _NOT_RUSSIAN.search(sentence) and not _LATIN.search(sentence):
        return "cyrillic", 5
    han = len(_HAN.findall(sentence))
    if han >= MIN_HAN and han * 2 > len(_LATIN.findall(sentence)):
        return None if _KANA.search(sentence) else ("han", han)
    n = len(_TOKEN.findall(sentence))
    if n < MIN_WORDS:
        return None
    cyrillic, latin = len(_CYRILLIC.findall(sentence)), len(_LATIN.findall(sentence))
    if cyrillic > latin:
        return None if _NOT_RUSSIAN.search(sentence) else ("cyrillic", n)
    return ("latin", n) if latin * 2 > sum(map(str.isalpha, sentence)) else None


CANDIDATES = {"latin": LATIN, "cyrillic": ("ru", "uk", "bg", "sr"), "han": ("zh", "ja")}
#: A Chinese character takes four bytes, two of them zeros as in its neighbours, so that a single one can make a match.
ENCODINGS = {"han": "utf-32-be"}


class Classifier:
    """Compressors of the languages' dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes]):
        settings = {"source_size": 256, "min_match": MIN_MATCH, "hash_log": HASH_LOG, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        self.sized = {}
        for code, data in (rival_dictionaries() | dictionaries).items():
            if code in CANDIDATES["han"]:
                data = data.decode().encode(ENCODINGS["han"])
            parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(data), **settings)
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.sized[code] = zstandard.ZstdCompressor(dict_data=held, compression_params=parameters).compress
        self.by_script = {s: [(c, self.sized[c]) for c in codes if c in self.sized] for s, codes in CANDIDATES.items()}
        self.bare = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, **settings)).compress

    def kept(self, code: str, data: str) -> float:
        """The share that a language's dictionary leaves of a plain text."""
        raw = data.encode(ENCODINGS["han"] if code in CANDIDATES["han"] else "utf-8", "replace")
        return len(self.sized[code](raw)) / len(raw)

    def nearest(self, candidates: str, text: str) -> tuple[str, float] | None:
        """(language, confidence) of the smallest encoding of a plain text; None if no dictionary saves anything, the margin
        is narrow, or the language is none of the seven. Every dictionary of the script is tried."""
        data = text.encode(ENCODINGS.get(candidates, "utf-8"), "replace")
        sizes = sorted([(len(encode(data)), code) for code, encode in self.by_script[candidates]])
        (best, code), (rival, _) = sizes[:2]
        if best * 2 > len(data) and best > KEPT_SHARE * len(self.bare(data)):
            return None
        if rival - best < max(MARGIN_BYTES, MARGIN_SHARE * rival) or code not in SEEDS:
            return None
        return code, round(min(1.0, 2.5 * (rival - best) / rival), 4)

    def classify(self, sentence: str) -> tuple[str, float] | None:
        """(language, confidence) of one sentence; None if it is none or the margin is narrow."""
        kind = script(sentence)
        return None if kind is None else self.nearest(kind[0], plain(sentence))

    def main(self, content: str, folded: str | None = None) -> str | None:
        """The language of a whole message without code and links; None if it is none or the margin is narrow. folded, the
        content as words.fold and single blanks leave it, saves the same work where there is no code or link."""
        text = running(content)
        kind = script(text)
        got = None if kind is None else self.nearest(kind[0], plain(text) if folded is None or text is not content else folded)
        return got and got[0]

    def message(self, content: str | None) -> list[tuple[str, float, int]]:
        """(language, confidence, sentences) of each segment of a message: neighbouring sentences
        of one language, the rejected ones between them left to the segment before."""
        out: list[list] = []
        for s in sentences(content):
            got = self.classify(s)
            if got is None:
                continue
            code, sure = got
            if out and out[-1][0] == code:
                out[-1][1] += sure
                out[-1][2] += 1
            else:
                out.append([code, sure, 1])
        return [(code, round(total / n, 4), n) for code, total, n in out]


def seed_dictionaries() -> dict[str, bytes]:
    return {code: plain(text).encode() for code, text in SEEDS.items()}


def rival_dictionaries() -> dict[str, bytes]:
    return {code: plain(text).encode() for code, text in RIVALS.items()}


#: A labelled row teaches its language if more than half of its sentences are found to be in it.
#: Of them, those found with at least the first confidence count; in the last round also those
#: that are rejected, or found in another language with less than the second, if their opening
#: words are relatively most frequent in rows of this label.
ROUNDS = ((0.25, 0.0), (0.15, 0.0), (0.0, 0.4))


def _opening(sentence: str) -> str:
    return " ".join(plain(sentence).split(" ")[:2])


def refine(labelled: list[tuple[str, list[str]]]) -> dict[str, bytes]:
    """Dictionaries from (code, sentences) of labelled rows; their sentences go in by hash order,
    in the last round those that the dictionary before saves least on take half of the room."""
    rows = Counter(code for code, _ in labelled)
    openings: dict[str, Counter] = defaultdict(Counter)
    for code, own in labelled:
        for key in {_opening(s) for s in own}:
            openings[key][code] += 1
    typical = {key: max(c, key=lambda code: (c[code] / rows[code], code)) for key, c in openings.items() if c.total() > 1}
    dictionaries = seed_dictionaries()
    for sure, doubt in ROUNDS:
        classifier = Classifier(dictionaries)
        agreed: dict[str, dict[str, float]] = defaultdict(dict)
        for code, own in labelled:
            got = [(s, classifier.classify(s)) for s in own if script(s)]
            if sum(g is not None and g[0] == code for _, g in got) * 2 > len(got):
                for s, g in got:
                    own_language = g is not None and g[0] == code and g[1] >= sure
                    doubtful = doubt > 0 and (g is None or g[1] < doubt) and typical.get(_opening(s)) == code
                    if own_language or doubtful:
                        data = plain(s)
                        agreed[code].setdefault(data, classifier.kept(code, data))
        grown = {}
        for code, seed in seed_dictionaries().items():
            parts: dict[str, None] = {}
            size = len(seed)
            drawn = sorted(agreed[code], key=lambda s: hashlib.md5(s.encode()).digest())
            novel = sorted(agreed[code], key=lambda s: (-agreed[code][s], s))
            for order, room in ((novel if doubt else [], DICTIONARY_BYTES // 2), (drawn, DICTIONARY_BYTES)):
                for s in order:
                    length = len(s.encode()) + 2
                    if size + length > room:
                        break
                    if s not in parts:
                        parts[s] = None
                        size += length
            grown[code] = (". ".join(parts) + ". ").encode() + seed if parts else seed
        dictionaries = grown
    return dictionaries


def rows_of(table: DataFrame, source: str, id_col: str, messages: str) -> DataFrame:
    """(source_table, record_id, label, named, messages) of a table of dialogues."""
    return table.select(
        F.lit(source).alias("source_table"),
        F.col(id_col).cast("string").alias("record_id"),
        F.col("language").alias("label"),
        language_code(F.col("language")).alias("named"),
        F.col(messages).alias("messages"),
    )


def dictionaries_of(rows: DataFrame) -> dict[str, bytes]:
    """Refined on a bounded sample of the rows whose label names a language."""
    text = F.transform(F.slice("messages", 1, SAMPLE_MESSAGES), lambda m: F.substring(m["content"], 1, SAMPLE_MESSAGE_CHARS))
    usable = rows.where("named IS NOT NULL AND record_id IS NOT NULL AND messages IS NOT NULL")
    picked = drawn(usable.select("record_id", "named", text.alias("texts")), "record_id", SAMPLE_ROWS).select("named", "texts")
    labelled = []
    for row in picked.collect():
        own = [s[:SAMPLE_CHARS] for t in row.texts for s in sentences(t)]
        labelled.append((row.named, own[:SAMPLE_SENTENCES]))
    return refine(labelled)


def _exploded(rows: DataFrame) -> DataFrame:
    kept = spread(rows.where("record_id IS NOT NULL").select("source_table", "record_id", "named", "messages"))
    return kept.select(
        "source_table", "record_id", "named", F.posexplode("messages").alias("msg_idx", "m")
    ).select("source_table", "record_id", "named", "msg_idx", F.col("m.content").alias("content"))


SEGMENT = "source_table string, record_id string, named string, msg_idx bigint, segment int, language string, confidence double, sentences int"


def segments(rows: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """One row per segment of each message. Narrow: no shuffle."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries or dictionaries_of(rows))
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            at, found = [], []
            for k, content in enumerate(batch.column(4).to_pylist()):
                for n, segment in enumerate(classifier.message(content)):
                    at.append(k)
                    found.append((n, *segment))
            pick = pa.array(at, pa.int64())
            held = [batch.column(i).take(pick) for i in range(3)] + [batch.column(3).take(pick).cast(pa.int64())]
            n, code, sure, size = zip(*found) if found else ((), (), (), ())
            new = [pa.array(n, pa.int32()), pa.array(code, pa.string()), pa.array(sure, pa.float64()), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays(held + new, names)

    return _exploded(rows).mapInArrow(run, SEGMENT)


def found(rows: DataFrame) -> DataFrame:
    """(source_table, record_id, msg_idx, language): languages of a message that its dialogue's label doesn't name."""
    other = F.col("named").isNull() | (F.col("named") != F.col("language"))
    return segments(rows).where(other).select("source_table", "record_id", "msg_idx", "language").distinct()


def dialogues(rows: DataFrame) -> DataFrame:
    """(source_table, record_id, language, confidence, languages): the language of most sentences of
    a dialogue, the share of the confident sentences that are in it, and all its languages."""
    each = segments(rows).groupBy("source_table", "record_id", "language").agg(
        F.sum("sentences").alias("n"), F.sum(F.col("confidence") * F.col("sentences")).alias("sure")
    )
    main = F.max(F.struct(F.col("n"), F.col("sure"), F.col("language")))
    return each.groupBy("source_table", "record_id").agg(main.alias("main"), F.sum("n").alias("all"), F.sort_array(F.collect_set("language")).alias("languages")).select(
        "source_table",
        "record_id",
        F.col("main.language").alias("language"),
        F.round(F.col("main.n") / F.col("all") * F.col("main.sure") / F.col("main.n"), 4).alias("confidence"),
        "languages",
    )


def profiled(rows: DataFrame) -> DataFrame:
    """dialogues() for every record: one without a confident sentence has language null, confidence 0 and no languages."""
    every = rows.where("record_id IS NOT NULL").select("source_table", "record_id").distinct()
    return every.join(dialogues(rows), ["source_table", "record_id"], "left").select(
        "source_table", "record_id", "language", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("languages", F.array().cast("array<string>")).alias("languages")
    )
