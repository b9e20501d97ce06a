"""The words of a text, whatever its mark-up, line breaks, case and character forms."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Container

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*)?/?>", re.S)
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|sup|sub|mark|a|code|small)\b", re.I)
_BROKEN = re.compile(r"([^\W_]+)[-‐‑][ \t\r\f\v]*\n\s*(?=([^\W_]+))")
_SOFT = re.compile("\u00ad[ \\t]*\n\\s*")
_NOTHING = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ]")
#: Cyrillic and Greek letters that look like Latin ones. Fixed values.
_LOOK_ALIKE = str.maketrans("аеорсхуіјѕкмтвнԁοανιρκ", "aeopcxyijskmtbhdoavipk")


def _plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", _NOTHING.sub("", text))).casefold().translate(_LOOK_ALIKE)


def _clean(text: str) -> str:
    """Without entities, mark-up and soft hyphens at the end of a line."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m[0][1:2] != "!" and _INLINE.match(m[0]) else " ", text)
    return _SOFT.sub("", text) if "\u00ad" in text else text


def words(text: str) -> list[str]:
    """Lower-case words without accents: entities and compatibility forms resolved, tags and invisible characters
    dropped, words that a hyphen breaks over two lines joined."""
    return _WORD.findall(_plain(_BROKEN.sub(r"\1", _clean(text))))


def readings(text: str, known: Container[str]) -> list[list[str]]:
    """The words of a text, in two ways where a hyphen at the end of a line leaves two.

    A hyphen breaks a word (exam-, ple) or ends the first part of a compound (well-, known). What is known decides:
    the first reading joins wherever the joined word is known, the second parts wherever both parts are.
    """
    text = _clean(text)
    if "\n" not in text or not _BROKEN.search(text):
        return [_WORD.findall(_plain(text))]
    joins = lambda m: _plain(m[1] + m[2]) in known
    parts = lambda m: _plain(m[1]) in known and _plain(m[2]) in known
    one = _WORD.findall(_plain(_BROKEN.sub(lambda m: m[1] if joins(m) or not parts(m) else m[1] + " ", text)))
    two = _WORD.findall(_plain(_BROKEN.sub(lambda m: m[1] + " " if parts(m) or not joins(m) else m[1], text)))
    return [one] if one == two else [one, two]
