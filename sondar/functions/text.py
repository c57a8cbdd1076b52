"""Native text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Role aliases.
ROLE_ALIASES = {
    "human": "user",
    "gpt": "assistant",
    "ai": "assistant",
    "bot": "assistant",
    "doctor": "assistant",
    "patient": "user",
    "tool": "user",
}


def normalize_role(role: Column) -> Column:
    """Lower-case role with aliases mapped; unknown roles pass through lower-cased, null stays null."""
    low = F.lower(role)
    aliases = F.create_map(*[F.lit(x) for pair in ROLE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, low), low)


def fold_case(text: Column) -> Column:
    """Case aside: upper, then lower, so that the sharp s equals its capital spelling. The replacement
    between them also keeps the optimizer from dropping the inner call."""
    return F.lower(F.replace(F.upper(text), F.lit("\u1e9e"), F.lit("SS")))


def letters_digits(text: Column) -> Column:
    """Letters and digits of a string, in order, with case aside (null stays null)."""
    return fold_case(F.regexp_replace(text, r"[^\p{L}\p{Nd}]+", ""))


def squeeze_words(text: Column) -> Column:
    """Words (runs of letters and digits) in lower case, joined by one blank."""
    return F.trim(F.regexp_replace(fold_case(text), r"[^\p{L}\p{M}\p{Nd}]+", " "))


def strip_all(text: Column) -> Column:
    """Without any leading or trailing white space (trim() alone strips blanks only)."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def source_name(name: Column) -> Column:
    """Canonical spelling of a dataset or source name: lower case, trimmed, '_' between words."""
    return F.regexp_replace(F.lower(strip_all(name)), r"[\s\-_]+", "_")


#: Spellings of the split names.
SPLITS = {
    "train": ("train", "training"),
    "validation": ("validation", "valid", "val", "dev"),
    "test": ("test", "eval", "heldout"),
}


def split_name(split: Column) -> Column:
    """train, validation or test; null for null and for any other word."""
    low = F.regexp_replace(F.lower(strip_all(split)), r"[\s\-_]+", "")
    out = F.lit(None).cast("string")
    for name, spellings in SPLITS.items():
        out = F.when(low.isin(*spellings), F.lit(name)).otherwise(out)
    return out


#: Names and codes of the seven languages; compared in lower case, region suffixes cut off.
LANGUAGE_NAMES = {
    "en": ("en", "eng", "english", "inglés", "anglais", "englisch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "ru": ("ru", "rus", "russian", "русский"),
    "zh": ("zh", "zho", "chi", "chinese", "中文", "汉语", "漢語", "mandarin", "cmn"),
}


def language_code(label: Column) -> Column:
    """Two-letter code a language label names in any usual spelling; null if it names none."""
    low = F.regexp_replace(F.lower(strip_all(label)), r"[\s_\-(].*$", "")
    pairs = [F.lit(x) for code, names in LANGUAGE_NAMES.items() for name in names for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), low)
