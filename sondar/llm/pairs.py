"""Defective question and answer pairs (problem 4).

A pair is an assistant message directly after a user message. One pass over the pairs gives
the defects that a pair shows by itself (empty, refusal, copy of the question, another
language) and how the answer ends. Then all answers are sorted by text and compared with
their neighbour, and their lengths are counted: an answer is truncated if

    its end is broken                        (code left open, comma, sentence without its end)
    its end isn't closed and its neighbour goes on on the same line
    its end isn't closed and its length is a spike among different answers of its dataset
    its neighbour goes on and its length is a spike, whatever its end

    pairs (native) -> defects, end, length, mark, sort key (Arrow, narrow; written once)
    keys, one a wording and task -> range-partitioned, sorted, neighbours compared (Arrow)
                                 -> last key of a partition against the first of the next
    lengths of different wordings (partial aggregation) -> spikes

A wording that very many answers have goes into the sort once a task; ranges are cut by the
keys' first RANGE_CHARS characters, so that answers with a common opening fall apart and what
the cutting sends to the driver is bounded. A range is read as a stream, whatever its size.

Defined results
    null content of the answer -> empty; nothing else
    null or blank question     -> neither a copy nor in another language
    null dataset               -> a dataset of its own
    roles                      -> compared after role normalisation
    an answer with several defects has one row for each
    copies of an answer        -> one wording in the sort and in the lengths; each is reported
    repeated rows              -> distinct results; empty tables -> empty result
    extra columns              -> ignored; texts of any length are read whole
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondar.functions.text import normalize_role, source_name
from sondar.llm import language
from sondar.llm.words import fold
from sondar.session import small, spread, written

#: Words (characters of Chinese) that an answer must have for a longer neighbour to tell that it was shortened.
OPENING = 8
#: Characters of a sort key by which ranges are cut.
RANGE_CHARS = 1_000
#: A bare value in Chinese characters has at most so many.
MIN_HAN = 8
#: Words in a row that count as taken from the question, and the share of an answer that makes it a copy.
COPY_RUN = 5
COPY_SHARE = 0.9
#: The same for Chinese, where each character counts as a word.
COPY_RUN_HAN = 8
#: Sentences beside the refusal that an answer may have and still give no answer.
REFUSAL_REST = 2
REFUSAL_WORDS = 14
#: A length is a spike with this many answers and this many times as many as lengths around it.
SPIKE_LEAST = 12
SPIKE_TIMES = 8
SPIKE_AROUND = 10

# Placeholders for no answer, after folding and without brackets.
PLACEHOLDERS = {
    "", "none", "null", "nil", "nan", "na", "n a", "empty", "blank", "undefined", "tbd", "todo", "no response", "no answer",
    "no reply", "no output", "no content", "not available", "not applicable", "placeholder", "answer", "response", "sin respuesta",
    "sem resposta", "pas de reponse", "aucune reponse", "keine antwort", "нет ответа", "无", "无回答", "没有回答", "空",
}

_TAG = re.compile(r"<[^<>]{0,200}>|&nbsp;|&#160;")
_WORDS = re.compile(r"[\u3400-\u9fff]|[^\W_\u3400-\u9fff]+").findall
_BYTES = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def _words(folded: str) -> list[str]:
    """Runs of letters and digits, and single Chinese characters."""
    return folded.encode().translate(_BYTES).decode().split() if folded.isascii() else _WORDS(folded)


_EMPTY = {" ".join(_WORDS(p)) for p in PLACEHOLDERS}
_PLACEHOLDER_WORDS = max(p.count(" ") for p in _EMPTY) + 1
_WORD_RUNS = re.compile(r"[^\W_]+").findall
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]|「[^」]*」")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"”»’')\]]*\s*")
_REFUSE = re.compile(
    r"\b(?:can ?not|can['’]?t|unable to|not able to|won['’]?t(?: be able to)?|will not(?: be able to)?|must|have to|am going to have to)\s+(?:\w+ly\s+)?"
    r"(?:help|assist|comply|take part|participate|provide|answer|discuss|decline|refuse|pass on|fulfil|respond|share|support|engage|do that|do this|talk about)\b"
    r"|\bmy (?:rules|guidelines|polic(?:y|ies)|instructions) (?:stop|do not|don['’]?t|prevent|forbid|keep)"
    r"|\bturn to another (?:subject|topic)|\b(?:topic|subject) i (?:stay away from|avoid)|\bsomething i (?:must|have to) decline|\bi(?:['’]?d| would) rather not"
    r"|\bno (?:puedo|podemos) (?:ayudar|responder|contestar|hablar|dar|cumplir|atender|ofrecer)|\bdebo (?:rechazar|negarme|declinar)|\bno me es posible (?:responder|ayudar|contestar)"
    r"|\b(?:preciso|devo|tenho de|tenho que) (?:recusar|negar)|\bnao (?:posso|consigo|podemos) (?:ajudar|responder|falar|dar|atender|fornecer)"
    r"|\bne (?:peux|puis|pouvons) pas (?:vous |t['’ ])?(?:aider|repondre|traiter|fournir|accepter)|\bdois (?:refuser|decliner)|\bne suis pas en mesure de (?:repondre|vous)"
    r"|\bkann (?:ich )?(?:dir |ihnen )?(?:dabei |damit |das )?(?:leider )?nicht (?:helfen|beantworten|weiterhelfen)|\b(?:dabei|damit) kann ich (?:leider )?nicht"
    r"|\bkeine (?:auskunft|antwort) geben|\bmuss ich (?:leider )?ablehnen|\blehne (?:ich )?(?:diese|die) anfrage"
    r"|\bне (?:могу|можем) (?:вам )?(?:с этим )?(?:помо|отвеч|ответ|обсужд|выполн)|придется отклонить|вынужден\w* отказ"
    r"|(?:无法|不能)(?:为您)?(?:帮助|回答|提供|满足|协助|讨论)|必须拒绝|拒绝(?:这个|该|回答)",
)
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_ITEM = re.compile(r"^\s*(?:[-*+•–]|\d{1,3}[.)]|[a-zA-Z][.)])\s+")
_SMILE = r"(?:[\U0001F000-\U0001FAFF☀-➿⭐️\u200d]|[:;][-']?[)(DPp])"
_ENDED = re.compile(rf"[.!?。！？…؟][\"”»’')\]*_】」]*\s*(?:{_SMILE}\s*)*$")
_SMILED = re.compile(rf"{_SMILE}\s*$")
_DANGLING = re.compile(r"[-–—:(,;\[{、，：（=+/&]\s*$")
_SIGNED = re.compile(r"^\s*(?:--+|—|–|~)\s*\w|^\s*(?:best|regards|cheers|thanks|sincerely|saludos|atenciosamente|cordialement|gruß|grüße|с уважением)\b[\w ,]{0,40}$", re.I)
_LABEL = re.compile(r"^\s*[^\W\d_][\w ]{0,24}:\s*\S+(?:\s+\S+){0,2}\s*$")

# Names of the languages, folded, in the seven languages.
_NAMES = {
    "en": ("english", "ingles", "anglais", "englisch", "английск", "англииск", "英文", "英语"),
    "es": ("spanish", "espanol", "espagnol", "spanisch", "испанск", "西班牙", "espanhol", "castellano"),
    "pt": ("portuguese", "portugues", "portugais", "portugiesisch", "португальск", "葡萄牙"),
    "fr": ("french", "frances", "francais", "franzosisch", "французск", "法语", "法文"),
    "de": ("german", "aleman", "alemao", "allemand", "deutsch", "немецк", "德语", "德文"),
    "ru": ("russian", "ruso", "russo", "russe", "russisch", "русск", "俄语", "俄文"),
    "zh": ("chinese", "chino", "chines", "chinois", "chinesisch", "китаиск", "китайск", "中文", "汉语"),
}
_NAMED = {code: re.compile("|".join(n if ord(n[0]) > 0x2E80 else rf"\b{n}" for n in names)) for code, names in _NAMES.items()}


def is_empty(answer: str | None) -> bool:
    """Nothing but blanks, marks, empty markup or a placeholder."""
    return not answer or _is_empty(fold(answer))


def _is_empty(folded: str, words: list[str] | None = None) -> bool:
    if words is None or "<" in folded or "&" in folded:
        words = _words(_TAG.sub(" ", folded))
    return len(words) <= _PLACEHOLDER_WORDS and " ".join(words) in _EMPTY


def is_refusal(answer: str, folded: str | None = None) -> bool:
    """A sentence declines, and the others give no answer beside it: they are few and short."""
    sentences = [s for s in _SENTENCE.split(answer) if s]
    if len(sentences) > REFUSAL_REST + 2:
        return False
    # One long sentence may be the refusal itself; a second one is an answer.
    if sum(s.count(" ") >= REFUSAL_WORDS for s in sentences) > 1:
        return False
    folded = fold(answer) if folded is None else folded
    if not _REFUSE.search(folded):
        return False
    rest, refused = [], False
    for s in _SENTENCE.split(_QUOTED.sub(" ", folded)):
        if _REFUSE.search(s):
            refused = True
        elif s.strip():
            rest.append(s)
    return refused and len(rest) <= REFUSAL_REST and all(len(s.split()) <= REFUSAL_WORDS for s in rest)


def is_copy(question: str, answer: str) -> bool:
    """The answer's words are runs of the question's, once or more often."""
    return _is_copy(_words(fold(question)), _words(fold(answer)))


def _is_copy(asked: list[str], words: list[str]) -> bool:
    n = len(words)
    known = set(asked)
    if sum(map(known.__contains__, words)) < COPY_SHARE * n:  # runs can't cover more than the known words
        return False
    run = COPY_RUN_HAN if sum(map("\u3400".__le__, words)) * 2 > n else COPY_RUN
    if n < run:
        return run == COPY_RUN and n > 2 and f" {' '.join(words)} " in f" {' '.join(asked)} "
    held = set(zip(*[asked[i:] for i in range(run)]))
    covered, last = 0, 0
    for i, stretch in enumerate(zip(*[words[i:] for i in range(run)])):
        if stretch in held:
            covered += i + run - max(last, i)
            last = i + run
    return covered >= COPY_SHARE * n


def ending(answer: str) -> str:
    """'done', 'broken', or 'doubtful' where the end alone doesn't tell."""
    end = end_of(answer)
    return "done" if end in ("closed", "open") else end


def end_of(answer: str) -> str:
    """How an answer with some word ends: 'closed' by a mark or a code fence; 'open', by dots or without a mark in a form
    that needs none; 'broken'; 'doubtful' where the end alone doesn't tell."""
    text = answer.strip().strip("\u200b\ufeff\u2060\u00ad").rstrip()
    if text.count("```") % 2 or text.count("~~~") % 2:
        return "broken"
    if text.endswith(("```", "~~~")):
        return "closed"
    if text.endswith(("|", "...", "\u2026")):
        return "open"
    if _ENDED.search(text[-40:]):
        return "closed"
    lines = [line for line in _LINE.split(text) if line.strip()]
    if not lines:
        return "closed"
    last = lines[-1]
    if last.lstrip().startswith("|"):
        return "open"
    if _ENDED.search(last) or _SMILED.search(last) and not _DANGLING.search(_SMILED.sub("", last)):
        return "closed"
    if len(lines) > 1 and (_SIGNED.search(last) or (_LABEL.search(last) and not _ITEM.search(last))):
        return "open"
    words = _WORD_RUNS(text)
    if len(words) <= 3 and len(text) <= 60 and not _DANGLING.search(text) and len(language._HAN.findall(text)) <= MIN_HAN:
        return "open"
    if _DANGLING.search(last):
        return "broken"
    if _ITEM.search(last):
        items = [line for line in lines[:-1] if _ITEM.search(line)]
        return "broken" if any(_ENDED.search(line) for line in items) else "doubtful"
    if re.search(r"[.!?。！？]", text):
        return "broken"
    return "doubtful" if len(words) > 2 * OPENING else "broken"


#: Stands for a line end in a sort key, after every other character in the order of bytes.
_NEWLINE = "\uffff"


def sort_key(folded: str) -> str:
    """A folded answer with single blanks and line ends, without the dots it ends in."""
    lines = [" ".join(line.split()) for line in folded.splitlines()]
    return _NEWLINE.join(line for line in lines if line).rstrip(" .\u2026")


def goes_on(key: str, following: str | None) -> bool:
    """Whether the next sort key goes on with this one on the same line."""
    if following is None or len(following) <= len(key) or not following.startswith(key) or len(_WORDS(key)) < OPENING:
        return False
    return bool(_WORDS(following[len(key) :].split(_NEWLINE, 1)[0]))


class Judge:
    """Defects that one pair shows by itself, how its answer ends, and its sort key."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.classifier = language.Classifier(dictionaries)

    def judge(self, question: str | None, answer: str | None) -> tuple[list[str], str | None, str | None]:
        folded = fold(answer) if answer else ""
        words = _words(folded)
        if _is_empty(folded, words):
            return ["empty"], None, None
        out, end = [], end_of(answer)
        if end == "broken":
            out.append("truncated")
        if is_refusal(answer, folded):
            out.append("refusal")
        if question:
            asked = fold(question)
            if _is_copy(_words(asked), words):
                out.append("copies_question")
            else:
                theirs = self.classifier.main(answer, " ".join(folded.split()))
                if theirs and (ours := self.classifier.main(question, " ".join(asked.split()))) and ours != theirs and not _NAMED[theirs].search(asked):
                    out.append("other_language")
        return out, end, sort_key(folded)


def pairs_of(dialogues: DataFrame) -> DataFrame:
    """(sample_id, msg_idx, dataset, question, answer) of the assistant messages directly after a user message."""
    role = lambda m: normalize_role(m["role"])
    before = F.concat(F.array(F.lit(None).cast("struct<role:string,content:string>")), F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0))))
    zipped = F.zip_with(
        before, F.col("messages"), lambda q, a: F.struct((role(q) == "user").alias("u"), (role(a) == "assistant").alias("a"), q["content"].alias("question"), a["content"].alias("answer"))
    )
    each = dialogues.where("size(messages) > 1").select("sample_id", source_name(F.col("dataset")).alias("dataset"), F.posexplode(zipped).alias("msg_idx", "p"))
    return each.where("p.u AND p.a").select("sample_id", F.col("msg_idx").cast("bigint").alias("msg_idx"), "dataset", "p.question", "p.answer")


def labelled(dialogues: DataFrame) -> DataFrame:
    """Dialogues as rows of the language operator; their label is in the metadata."""
    rows = dialogues.withColumn("language", F.try_element_at(F.col("metadata"), F.lit("language")))
    return language.rows_of(rows, "dialogues", "sample_id", "messages")


_MEMO = 500_000


def judged(dialogues: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """(sample_id, msg_idx, dataset, defects, end, length, mark, key) of every pair; key, the sort key of the answer, where a
    task meets it for the first time, mark its hash. Empty answers have neither. Narrow: no shuffle."""
    spark = dialogues.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries or language.dictionaries_of(labelled(dialogues)))
    id_type = dialogues.schema["sample_id"].dataType.simpleString()
    names = ["sample_id", "msg_idx", "dataset", "defects", "end", "length", "mark", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value).judge
        seen: set[bytes] = set()
        for batch in batches:
            defects, ends, lengths, marks, keys = [], [], [], [], []
            for q, a in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                found, end, key = judge(q, a)
                mark = None
                if key is not None:
                    mark = xxhash.xxh3_128_digest(key)
                    if mark in seen:
                        key = None
                    elif len(seen) < _MEMO:
                        seen.add(mark)
                    else:
                        seen = {mark}
                defects.append(found)
                ends.append(end)
                lengths.append(len(a or ""))
                marks.append(mark)
                keys.append(key)
            new = [pa.array(defects, pa.list_(pa.string())), pa.array(ends, pa.string()), pa.array(lengths, pa.int32()), pa.array(marks, pa.binary()), pa.array(keys, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], names)

    schema = f"sample_id {id_type}, msg_idx bigint, dataset string, defects array<string>, end string, length int, mark binary, key string"
    held = spread(dialogues.select("sample_id", "dataset", "messages"))
    return pairs_of(held).select("sample_id", "msg_idx", F.coalesce("dataset", F.lit("")), "question", "answer").mapInArrow(run, schema)


_EDGES = "mark binary, place int, first string, last string"


def shortened(answers: DataFrame) -> DataFrame:
    """(mark) of the keys (mark, key) that the next key in sorted order goes on with."""

    names = [x.split()[0] for x in _EDGES.split(", ")]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys of a sorted range that go on, and a row with the first and the last key of the range."""
        place = TaskContext.get().partitionId()
        first = last = mark = None
        for batch in batches:
            marks = []
            for m, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if m == mark:
                    continue
                if mark is None:
                    first = k
                elif goes_on(last, k):
                    marks.append(mark)
                mark, last = m, k
            none = [pa.nulls(len(marks), t) for t in (pa.int32(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), *none], names)
        if mark is not None:
            edge = [pa.array([mark], pa.binary()), pa.array([place], pa.int32()), pa.array([first], pa.string()), pa.array([last], pa.string())]
            yield pa.RecordBatch.from_arrays(edge, names)

    ranges = answers.repartitionByRange(F.substring("key", 1, RANGE_CHARS)).sortWithinPartitions("key")
    compared = written(ranges.mapInArrow(neighbours, _EDGES), "neighbours")

    @F.pandas_udf("boolean")
    def on(keys, nexts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([goes_on(k, n) for k, n in zip(keys, nexts)], dtype=bool)

    # As many rows as there were ranges, however many answers.
    edges = compared.where("place IS NOT NULL").select("mark", "last", F.lead("first").over(W.orderBy("place")).alias("next"))
    edges = edges.where("next IS NOT NULL").where(on("last", "next")).select("mark")
    return compared.where("place IS NULL").select("mark").unionByName(edges)


def _tall(lengths: DataFrame) -> DataFrame:
    """(dataset, length) of lengths (dataset, length, n) that are far more frequent in a dataset than those around them."""
    around = W.partitionBy("dataset").orderBy("length").rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)
    others = (F.sum("n").over(around) - F.col("n")) / (2 * SPIKE_AROUND)
    tall = (F.col("n") >= SPIKE_LEAST) & (F.col("n") >= SPIKE_TIMES * others) & (F.col("length") > 100)
    return lengths.withColumn("tall", tall).where("tall").select("dataset", "length")


def spikes(dialogues: DataFrame) -> DataFrame:
    """(dataset, length): answer lengths that are far more frequent in a dataset than those around them, copies counted."""
    return _tall(pairs_of(dialogues).where("answer IS NOT NULL").groupBy("dataset", F.length("answer").alias("length")).agg(F.count("*").alias("n")))


def limits(answers: DataFrame) -> DataFrame:
    """(dataset, length): lengths that far more different answers (dataset, length, mark) of a dataset have than those around
    them. An answer that is often repeated makes none."""
    return _tall(answers.select("dataset", "length", "mark").distinct().groupBy("dataset", "length").agg(F.count("*").alias("n")))


def evidence(dialogues: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """(sample_id, msg_idx, dataset, defects, end, shortened, limited): each pair with its own defects, how its answer ends,
    whether its neighbour goes on with it, and whether its length is a spike."""
    pairs = written(judged(dialogues, dictionaries), "pairs")
    answers = pairs.where("mark IS NOT NULL")
    tall = limits(answers).withColumn("limited", F.lit(True))
    cut = shortened(answers.where("key IS NOT NULL").select("mark", "key")).withColumn("shortened", F.lit(True))
    both = pairs.drop("key").join(small(cut), "mark", "left").join(small(tall), ["dataset", "length"], "left").drop("mark")
    return both.na.fill(False, ["shortened", "limited"])


def found(dialogues: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """(sample_id, msg_idx, defect) of every defective answer."""
    cut = F.expr("if(end = 'closed', shortened AND limited, shortened OR limited)")
    defects = F.when(cut, F.array_union("defects", F.array(F.lit("truncated")))).otherwise(F.col("defects"))
    return evidence(dialogues, dictionaries).select("sample_id", "msg_idx", F.explode(defects).alias("defect")).distinct()
