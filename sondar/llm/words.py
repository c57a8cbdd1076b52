"""Word stream of a text for leak search: letters and digits only."""

from __future__ import annotations

import re
import unicodedata

#: White space, which separates words; every other control or format character is invisible inside a word.
_BREAKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"
_HYPHENS = "-\u2010\u2011\u00ad"
_LINE_END_HYPHEN = re.compile(rf"(?<=\w)[{_HYPHENS}][ \t]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])\s*(?=\w)")
_ASCII_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")
_ASCII_WORD = re.compile(r"[a-z0-9]+").findall
_WORD = re.compile(r"[^\W_]+").findall


class _Invisible(dict):
    """Translation that drops marks, format and control characters; filled as characters turn up."""

    def __missing__(self, code: int):
        c = chr(code)
        kind = unicodedata.category(c)
        drop = kind in ("Mn", "Me", "Cf", "Cs") or (kind == "Cc" and c not in _BREAKS)
        out = self[code] = None if drop and c != "\u00ad" else code
        return out


_DROP = _Invisible()


def _plain(text: str) -> str:
    return unicodedata.normalize("NFKD", text).translate(_DROP)


def _split(text: str, ascii_only: bool) -> list[str]:
    if ascii_only:
        return _ASCII_WORD(text.lower())
    text = text.replace("\u00ad", "").casefold()
    return _WORD(text)


def fold(text: str) -> str:
    """Lower case, without accents and invisible characters, words whole that a line end splits."""
    if text.isascii():
        if text.isprintable():  # without line ends and control characters
            return text.lower()
        return _LINE_END_HYPHEN.sub("", _ASCII_CONTROL.sub("", text)).lower()
    text = _plain(text)
    if "\n" in text or "\r" in text or not text.isprintable():
        text = _LINE_END_HYPHEN.sub("", text)
    return text.replace("\u00ad", "").casefold()


def word_streams(text: str | None) -> list[list[str]]:
    """The words of a text; where a line ends in a hyphen, one stream with the word
    whole and one with its two parts. [] for null."""
    if not text:
        return []
    ascii_only = text.isascii()
    text = _ASCII_CONTROL.sub("", text) if ascii_only else _plain(text)
    whole = _LINE_END_HYPHEN.sub("", text)
    streams = [_split(whole, ascii_only)]
    if whole is not text and whole != text:
        streams.append(_split(text, ascii_only))
    return streams
