"""Records of evaluation splits that also stand in the train split (problem 5).

Pieces with a guarantee: a pair of n and m words differs in at most k = max(n, m) // 10
words. Cut into at least k + 1 pieces, a record has a piece i that no edit touches, with
exactly i edits before it (the first place where fewer edits than pieces have gone by), so
the other record holds that piece whole, at most i words away from its place. The train side
gives its pieces, the held-out side every stretch of a piece's length; each pair within the
tolerance meets, at any length. Pairs that meet are then held against their words exactly.

    records -> words (Arrow, narrow), written once -> one representative per wording and side
            -> digests (Arrow, narrow) -> join on digest, with length and position
            -> overlap fraction -> word edit distance -> members of each wording

Copies are folded into representatives before any join, so a wording that a third of
the rows have is one row there. A digest that very many different wordings share on both
sides (an opening of a third of all records, say) would pair all of them. Such digests are
estimated on a sample and split: of 128 parities of classes of words a pair within the
tolerance differs in 2k at most, so of 2k + 2 segments of the parities one is equal, and
the records meet by digest and segment instead. No pair is lost by it, and the sample
decides only where to split.

Defined results
    null or unknown split           -> in no split, never reported
    null or blank messages, no word -> overlaps with nothing
    system messages, role spelling, case, punctuation, white space -> don't count
    equal ids in both splits        -> no pair (a pair has two different ids)
    repeated rows                   -> distinct pairs
    empty tables                    -> empty result
    extra columns                   -> ignored
    texts of any length             -> cut into pieces and compared whole
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondar.functions.text import normalize_role, split_name
from sondar.session import shuffling, small, spread, table_bytes, written

#: One word in this many may differ.
TOLERANCE = 10
#: Ratio of neighbouring classes of length; a record meets one or two of them.
CLASS_RATIO = 1.5
#: Pairs that a digest may form before it is split, estimated on one record in SAMPLE of either side.
MANY_PAIRS = 4_000_000
SAMPLE = 32
#: Bytes of digests in the shuffle for each byte of the written words, about.
DIGEST_GROWTH = 8
#: Most segments of 64 parities; longer records, with more edits, are not split.
MOST_SEGMENTS = 16

_MEMO = 500_000
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_B_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


_ASCII_WORDS = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))


class _OnlyWords(dict):
    """Translation of everything but letters, marks and digits to blanks; filled as characters turn up."""

    def __missing__(self, code: int) -> int:
        kind = unicodedata.category(chr(code))
        out = self[code] = code if kind[0] in "LM" or kind == "Nd" else 32
        return out


_ONLY_WORDS = _OnlyWords()


def words_of(text: str) -> str:
    """The words of a text (runs of letters, marks and digits), with case aside, joined by blanks."""
    if text.isascii():
        return b" ".join(text.encode().lower().translate(_ASCII_WORDS).split()).decode()
    return " ".join(text.upper().casefold().translate(_ONLY_WORDS).split())


def with_words(texts: DataFrame) -> DataFrame:
    """texts (id, held_out, text) with the words in place of the text. Narrow: no shuffle."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([None if t is None else words_of(t) for t in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], words], ["id", "held_out", "words"])

    return texts.select("id", "held_out", "text").mapInArrow(run, f"id {id_type}, held_out boolean, words string")


def dialogue_text(messages: Column) -> Column:
    """The user and assistant messages of a dialogue, in order."""
    kept = F.filter(messages, lambda m: normalize_role(m["role"]).isin("user", "assistant"))
    return F.array_join(F.transform(kept, lambda m: m["content"]), " ")


def pieces(n: np.ndarray, tolerance: int) -> np.ndarray:
    """How many pieces a record of n words is cut into: one more than the words in which it may differ from its
    longest partner, which has n * tolerance // (tolerance - 1) words."""
    return n // (tolerance - 1) + 1


def _class_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(CLASS_RATIO)).astype(np.int64)


class Cutter:
    """Digests of stretches of words, for many records at once."""

    def __init__(self, tolerance: int = TOLERANCE) -> None:
        if not 3 <= tolerance <= 100:
            raise ValueError("tolerance must be from 3 to 100")
        self.tolerance = tolerance
        self.memo: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def _cut(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(record, position, length, length class) of every piece, once for each class that a partner can have."""
        count = pieces(sizes, self.tolerance)
        record = np.repeat(np.arange(len(sizes)), count)
        number = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
        length = (sizes // count)[record]
        first, last = _class_of(sizes - sizes // self.tolerance)[record], _class_of(sizes * self.tolerance // (self.tolerance - 1))[record]
        for k in range(int((last - first).max(initial=-1)) + 1):
            has = first + k <= last
            yield record[has], (number * length)[has], length[has], first[has] + k

    def _slide(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(record, position, length, length class) of every stretch that can be the untouched piece of a partner."""
        shortest, longest = sizes - sizes // self.tolerance, sizes * self.tolerance // (self.tolerance - 1)
        n = np.arange(int(longest.max(initial=0)) + 1)
        of = n // pieces(n, self.tolerance)
        for length in np.unique(of[1:]):
            held = np.concatenate([[0], np.cumsum(of == length)])
            those = np.flatnonzero((held[longest + 1] > held[shortest]) & (sizes >= length))
            count = sizes[those] - length + 1
            record = np.repeat(those, count)
            at = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
            number = -(-at // (length + 1))
            near = number * (length - 1) <= at  # at most `number` words from the place of piece `number`
            record, at = record[near], at[near]
            yield record, at, np.full(len(at), length), _class_of(sizes)[record]

    def digests(self, texts: list[str], cut: bool) -> tuple[np.ndarray, ...]:
        """(record, digest, position, length of the stretch, words of the record, low, high): the pieces of each record
        if `cut`, else every stretch that can equal a piece of a partner. The digest takes in the length and the class of the
        held-out record's length, which is also in bits of its own; the lowest bits are zeros, which a shuffle compresses.
        low and high are the parities of how many words of the record fall into each of 128 classes of words."""
        words = [t.split(" ") for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        h = self.hashes([w for ws in words for w in ws])
        with np.errstate(over="ignore"):
            within = np.arange(len(h)) - np.repeat(starts, sizes)
            powers = np.cumprod(np.full(int(sizes.max(initial=1)), _B, np.uint64))
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * powers[within], out=sums[1:])
            unpowers = np.cumprod(np.full(int(sizes.max(initial=1)), _B_INVERSE, np.uint64))
            bit = np.uint64(1) << (h >> np.uint64(32) & np.uint64(63))
            upper = (h >> np.uint64(40) & np.uint64(1)).astype(bool)
            none = np.uint64(0)
            low, high = (np.bitwise_xor.reduceat(np.where(x, none, bit), starts).view(np.int64) if len(h) else np.zeros(0, np.int64) for x in (upper, ~upper))
            out = []
            for r, at, length, of in (self._cut if cut else self._slide)(sizes):
                begin = starts[r] + at
                digest = (sums[begin + length] - sums[begin]) * unpowers[at]
                digest = (digest ^ (digest >> np.uint64(29))) * _A + (length | of << 16).astype(np.uint64)
                digest = (digest ^ (digest >> np.uint64(32))) * _B
                digest = digest >> np.uint64(_CLASS_AT + _CLASS_BITS) << np.uint64(_CLASS_AT + _CLASS_BITS) | of.astype(np.uint64) << np.uint64(_CLASS_AT)
                out.append((r, digest.view(np.int64), at, length, sizes[r], low[r], high[r]))
        if not out:
            empty = np.zeros(0, np.int64)
            return (empty,) * 7
        return tuple(np.concatenate(x) for x in zip(*out))


#: Parities of classes of words that a pair is held against before its words are fetched.
SKETCH_BITS = 512


def sketches_of(records: DataFrame) -> DataFrame:
    """(rep, sketch) of records (rep, words): the parities of SKETCH_BITS classes of words, as integers of 64 bits. Narrow."""
    id_type = records.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            words = [t.split(" ") for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            h = cutter.hashes([w for ws in words for w in ws])
            place = np.repeat(np.arange(len(sizes)), sizes) * SKETCH_BITS + (h >> np.uint64(12)).astype(np.int64) % SKETCH_BITS
            odd = (np.bincount(place, minlength=len(sizes) * SKETCH_BITS) & 1).astype(np.uint8)
            lanes = np.packbits(odd).view(np.int64)
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * (SKETCH_BITS // 64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(lanes))], ["rep", "sketch"])

    return records.select("rep", "words").mapInArrow(run, f"rep {id_type}, sketch array<bigint>")


#: Bits of a position or a length in words, of a stretch's length with the mark of a split digest, and of a class of length.
_BITS, _LEN_BITS, _CLASS_BITS, _CLASS_AT = 28, 8, 6, 16
_SPLIT = 1 << (_LEN_BITS - 1)


def digests_of(records: DataFrame, cut: bool, tolerance: int = TOLERANCE) -> DataFrame:
    """(digest, rep, place, low, high) of records (rep, words), of their pieces if `cut`, else of all stretches that can equal
    one; place packs position, record length and stretch length, low and high are parities of the words."""
    id_type = records.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(tolerance)
        for batch in batches:
            if not batch.num_rows:
                continue
            record, digest, at, length, n, low, high = cutter.digests(batch.column(1).to_pylist(), cut)
            place = (n << (_BITS + _LEN_BITS)) | (at << _LEN_BITS) | length
            reps = batch.column(0).take(pa.array(record))
            columns = [pa.array(digest), reps, pa.array(place), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "rep", "place", "low", "high"])

    return records.select("rep", "words").mapInArrow(run, f"digest bigint, rep {id_type}, place bigint, low bigint, high bigint")


def _words(place: Column) -> Column:
    return F.shiftright(place, _BITS + _LEN_BITS)


def _at(place: Column) -> Column:
    return F.shiftright(place, _LEN_BITS).bitwiseAND(F.lit((1 << _BITS) - 1))


def _length(place: Column) -> Column:
    return place.bitwiseAND(F.lit(_SPLIT - 1))


def segments(tolerance: int) -> list[int]:
    """For each class of length the segments of 64 parities, one more than the edits a pair of the class may have; 0 where
    they would be too many."""
    most = [int(CLASS_RATIO ** (c + 1)) // (tolerance - 1) + 1 if c < 40 else MOST_SEGMENTS + 1 for c in range(1 << _CLASS_BITS)]
    return [n if n <= MOST_SEGMENTS else 0 for n in most]


def _segments_of(length_class: Column, tolerance: int) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in segments(tolerance)]), (length_class + 1).cast("int"))


#: Value of segment j of n in each half of the parities.
_SEGMENT = "shiftrightunsigned(if(j < n, {0}, {1}), CAST((j % n) * (64 div n) AS INT)) & if(j % n = n - 1, -1L, shiftleft(1L, CAST(64 div n AS INT)) - 1L)"


def _common(left: DataFrame, right: DataFrame) -> DataFrame:
    """(digest, many) of the digests that form very many pairs, by a sample of the records of both sides."""
    counts = left.groupBy("digest").agg(F.count("*").alias("a")).join(right.groupBy("digest").agg(F.count("*").alias("b")), "digest")
    return counts.where(F.col("a") * F.col("b") >= MANY_PAIRS / SAMPLE**2).select("digest", F.lit(True).alias("many"))


def _split(digests: DataFrame, common: DataFrame, tolerance: int) -> DataFrame:
    """digests with a key in place of the digest: the digest itself, or for common ones one for each segment of the parities."""
    n = _segments_of(F.shiftright("digest", _CLASS_AT).bitwiseAND(F.lit((1 << _CLASS_BITS) - 1)), tolerance)
    marked = digests.join(common, "digest", "left").withColumn("n", F.when(F.col("many"), n).otherwise(0))
    keys = F.expr(f"if(n > 0, transform(sequence(0, 2 * n - 1), j -> xxhash64(digest, j, {_SEGMENT.format('low', 'high')})), array(digest))")
    place = F.when(F.col("n") > 0, F.col("place").bitwiseOR(F.lit(_SPLIT))).otherwise(F.col("place"))
    return marked.select(F.explode(keys).alias("key"), "rep", place.alias("place"), "low", "high")


def within_edits(a: list[str], b: list[str], most: int) -> bool:
    """Whether at most `most` words are added, dropped or replaced between a and b.

    Equal ends are cut off, then the words in common bound the distance from below, then
    one bit-parallel column a word gives it exactly."""
    if abs(len(a) - len(b)) > most:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < hi - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if not a or not b:
        return max(len(a), len(b)) <= most
    if max(len(a), len(b)) - (Counter(a) & Counter(b)).total() > most:
        return False
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    n = len(a)
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = mask, 0, n
    for k, w in enumerate(b):
        same = places.get(w, 0)
        across = (((same & up) + up) ^ up) | same | down
        rise = down | (mask & ~(across | up))
        fall = up & across
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
        rise = (rise << 1 | 1) & mask
        fall = (fall << 1) & mask
        diagonal = same | down
        up = fall | (mask & ~(diagonal | rise))
        down = rise & diagonal
        if distance - (len(b) - 1 - k) > most:
            return False
    return distance <= most


def _representatives(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, held_out, words) with one row per wording and side, and the (held_out, rep, id) of
    wordings with copies. Only ids and marks are shuffled, after partial aggregation."""
    marks = records.select("id", "held_out", "mark")
    folded = marks.groupBy("mark", "held_out").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = marks.join(folded.where("copies > 1").drop("copies"), ["mark", "held_out"]).select("held_out", "rep", "id")
    members = written(members, "members")
    others = members.where("id <> rep").select("id", "held_out")
    reps = records.join(small(others), ["id", "held_out"], "left_anti")
    return reps.select(F.col("id").alias("rep"), "held_out", "words"), members


def _close(records: DataFrame, tolerance: int) -> tuple[DataFrame, DataFrame]:
    """(e, t, overlap) of the representatives of held-out and train wordings within the tolerance, and the members
    (held_out, rep, id) of wordings with copies."""
    records = records.where("held_out IS NOT NULL AND words <> '' AND id IS NOT NULL")
    records = written(records.select("id", "held_out", "words", F.unhex(F.md5("words")).alias("mark")), "records")
    reps, members = _representatives(records)
    # Records of a pair are about as long as each other. With the class of length in the digest, one that very
    # many records share falls apart by length, and pairs of too different lengths are hardly formed.
    drawn = reps.where(F.pmod(F.xxhash64("rep", F.lit("sample")), F.lit(SAMPLE)) == 0)
    common = small(written(_common(*(digests_of(drawn.where(F.col("held_out") == side), not side, tolerance) for side in (True, False))), "common"))
    left, right = (_split(digests_of(reps.where(F.col("held_out") == side), not side, tolerance), common, tolerance) for side in (True, False))
    left = left.select("key", F.col("rep").alias("e"), F.col("place").alias("e_place"), F.col("low").alias("e_low"), F.col("high").alias("e_high"))
    right = right.select("key", F.col("rep").alias("t"), F.col("place").alias("t_place"), F.col("low").alias("t_low"), F.col("high").alias("t_high"))
    e_n, t_n = _words(F.col("e_place")), _words(F.col("t_place"))
    most = F.floor(F.greatest(e_n, t_n) / tolerance)
    moved = _at(F.col("e_place")) - _at(F.col("t_place"))
    before = F.floor(_at(F.col("t_place")) / _length(F.col("t_place")))  # number of the piece, and of edits before it
    near = (before <= most) & (F.abs(moved) <= before) & (F.abs(e_n - t_n - moved) <= most - before)
    # A replaced word turns at most two parities, an added or dropped one turns one.
    turned = F.bit_count(F.col("e_low").bitwiseXOR(F.col("t_low"))) + F.bit_count(F.col("e_high").bitwiseXOR(F.col("t_high")))
    near = near & (turned <= 2 * most - F.abs(e_n - t_n))
    n = _segments_of(F.floor(F.log(e_n) / F.log(F.lit(CLASS_RATIO))), tolerance)
    # Records that meet in several segments of a split digest share that stretch once.
    meetings = F.expr(f"aggregate(sequence(0, 2 * n - 1), 0, (a, j) -> a + if(({_SEGMENT.format('xl', 'xh')}) = 0, 1, 0))")
    shared = _length(F.col("e_place")) / F.when(F.col("e_place").bitwiseAND(F.lit(_SPLIT)) > 0, meetings).otherwise(1)
    pairs = left.join(right, "key").where(near)
    pairs = pairs.withColumns({"n": n, "xl": F.col("e_low").bitwiseXOR(F.col("t_low")), "xh": F.col("e_high").bitwiseXOR(F.col("t_high"))})
    pairs = pairs.select("e", "t", shared.alias("len"), F.greatest(e_n, t_n).alias("size"), (2 * most - F.abs(e_n - t_n)).alias("turns"))
    pairs = pairs.groupBy("e", "t").agg((F.sum("len") / F.max("size")).alias("overlap"), F.max("turns").alias("turns"))
    with shuffling(records.sparkSession, DIGEST_GROWTH * table_bytes(records)):
        pairs = written(pairs, "pairs")

    def side_of(found: DataFrame, side: str) -> DataFrame:
        """The representatives of one side in some pair."""
        own = reps.where("held_out" if side == "e" else "NOT held_out").withColumnRenamed("rep", side)
        return own.join(small(found.select(side).distinct()), side, "left_semi").withColumnRenamed(side, "rep")

    # Many more parities first, then the words themselves of what is left.
    for side in ("t", "e"):
        pairs = pairs.join(sketches_of(side_of(pairs, side)).select(F.col("rep").alias(side), F.col("sketch").alias(f"{side}_sketch")), side)
    differ = F.aggregate(F.zip_with("e_sketch", "t_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    pairs = written(pairs.where(differ <= F.col("turns")).select("e", "t", "overlap"), "near")
    compared = pairs
    for side in ("t", "e"):
        compared = compared.join(side_of(pairs, side).select(F.col("rep").alias(side), F.col("words").alias(f"{side}_words")), side)

    @F.pandas_udf("boolean")
    def same(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for x, y in zip(a, b):
            x, y = x.split(" "), y.split(" ")
            out.append(within_edits(x, y, max(len(x), len(y)) // tolerance))
        return pd.Series(out, dtype=bool)

    return compared.where(same("e_words", "t_words")).select("e", "t", "overlap"), members


def overlaps(records: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(train_id, held_out_id, overlap) of records (id, held_out, words): the pairs across the
    two sides whose words are the same or differ in at most one word in `tolerance`."""
    close, members = _close(records, tolerance)
    e_members = members.where("held_out").select(F.col("rep").alias("e"), F.col("id").alias("e_id"))
    t_members = members.where("NOT held_out").select(F.col("rep").alias("t"), F.col("id").alias("t_id"))
    return (
        close.join(e_members, "e", "left")
        .join(t_members, "t", "left")
        .select(
            F.coalesce("t_id", "t").alias("train_id"),
            F.coalesce("e_id", "e").alias("held_out_id"),
            F.least(F.col("overlap"), F.lit(1.0)).alias("overlap"),
        )
        .where("train_id <> held_out_id")
    )


def partners(records: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(held_out_id, partners): how many train records each held-out record overlaps with, from the sizes of the wordings;
    pairs of copies aren't formed. A record isn't its own partner."""
    close, members = _close(records, tolerance)
    close, members = written(close, "close"), members.distinct()
    sizes = members.where("NOT held_out").groupBy(F.col("rep").alias("t")).agg(F.count("*").alias("size"))
    summed = close.join(sizes, "t", "left").groupBy("e").agg(F.sum(F.coalesce("size", F.lit(1))).alias("partners"))
    ids = lambda rep, condition: members.where(condition).select(F.col("rep").alias(rep), F.col("id").alias(f"{rep}_id"))
    each = summed.join(ids("e", "held_out"), "e", "left").select(F.coalesce("e_id", "e").alias("held_out_id"), "e", "partners")
    # Ids that stand on both sides.
    both = records.where("held_out IS NOT NULL AND id IS NOT NULL").groupBy(F.col("id").alias("held_out_id")).agg(F.min("held_out").alias("a"), F.max("held_out").alias("b")).where("a <> b").select("held_out_id")
    twice = each.join(small(both), "held_out_id", "left_semi").join(close.select("e", "t"), "e").join(ids("t", "NOT held_out"), "t", "left")
    own = twice.where(F.coalesce("t_id", "t") == F.col("held_out_id")).groupBy("held_out_id").agg(F.count("*").alias("own"))
    left = F.col("partners") - F.coalesce("own", F.lit(0))
    return each.join(small(own), "held_out_id", "left").select("held_out_id", left.alias("partners")).where("partners > 0")


def dialogue_records(dialogues: DataFrame) -> DataFrame:
    """(id, held_out, words) of dialogues (sample_id, split, messages)."""
    split = split_name(F.col("split"))
    held = spread(dialogues.select("sample_id", "split", "messages")).where(split.isNotNull())
    return with_words(held.select(F.col("sample_id").alias("id"), (split != "train").alias("held_out"), dialogue_text(F.col("messages")).alias("text")))


def found(dialogues: DataFrame) -> DataFrame:
    """(sample_id_a, sample_id_b): all cross-split pairs, the smaller id first."""
    pairs = overlaps(dialogue_records(dialogues))
    return pairs.select(
        F.least("train_id", "held_out_id").alias("sample_id_a"), F.greatest("train_id", "held_out_id").alias("sample_id_b")
    ).distinct()


def report(dialogues: DataFrame, name: Column) -> DataFrame:
    """(split, dataset, pairs, records): overlaps of each held-out split and dataset with the train split."""
    about = dialogues.select(F.col("sample_id").alias("held_out_id"), split_name(F.col("split")).alias("split"), name.alias("dataset")).where("split <> 'train'")
    return (
        partners(dialogue_records(dialogues)).join(about, "held_out_id")
        .groupBy("split", "dataset")
        .agg(F.sum("partners").alias("pairs"), F.countDistinct("held_out_id").alias("records"))
    )
