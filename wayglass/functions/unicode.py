"""Canonical decomposition of Unicode text, and white space as web pages' scripts see it, as column expressions.

Tables are made from Python's character database when the module loads; what runs are built-in functions only.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What scripts call white space, as the inside of a character class, and a word's characters.
WHITE = r"\t\n\x0b\f\r    -     　﻿"
WORD = "A-Za-z0-9_"

# Hangul syllables are 19 leading, 21 middle and 28 trailing parts (the first is none) from U+AC00 on.
_LEADING, _MIDDLE, _TRAILING = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))
_SYLLABLE, _PER_LEADING, _PER_MIDDLE = 0xAC00, 588, 28
_MARKS = range(0x300, 0x370)
#: What letters with marks have one of; translate() takes each character by itself, which is some ten times slower than to look for one.
_BEYOND_ASCII = r"[^\x00-\x7f]"


def _parts() -> dict[str, str]:
    """Characters, but for Hangul, that are others in canonical decomposition, and these."""
    every = (chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and not _SYLLABLE <= i < _SYLLABLE + 11172)
    return {c: d for c in every if (d := unicodedata.normalize("NFD", c)) != c}


_PARTS = _parts()
_ORDERED = sorted(_PARTS, key=lambda c: (-len(_PARTS[c]), c))
_ALL = "".join(_ORDERED)
#: For each place in a decomposition the characters there; those of _ALL beyond have none.
_PLACES = ["".join(_PARTS[c][i] for c in _ORDERED if len(_PARTS[c]) > i) for i in range(max(map(len, _PARTS.values())))]
_BARE = {c: "".join(x for x in d if ord(x) not in _MARKS) for c, d in _PARTS.items()}
#: Characters of which one is left when marks go; of the others, those that are more or none.
_LETTERS = "".join(c for c in _ORDERED if len(_BARE[c]) == 1)
_BASES = "".join(_BARE[c] for c in _LETTERS)
_ORDERS = {c: unicodedata.combining(c) for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c)}


def _ranges(points: list[int], gap: int) -> str:
    """A character class that holds the points, and maybe others that lie fewer than gap apart from these."""
    spans: list[list[int]] = []
    for p in sorted(points):
        if spans and p - spans[-1][1] < gap:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


_RARE = _ranges([ord(c) for c in _PARTS if len(_BARE[c]) != 1] + [*range(_SYLLABLE, _SYLLABLE + 11172)], 300)


_DECOMPOSED = _ranges([ord(c) for c in _PARTS] + [*range(_SYLLABLE, _SYLLABLE + 11172)], 300)
_MARK = _ranges(list(map(ord, _ORDERS)), 1)
#: A class that holds all marks and is tested by a character's kind at once, where _MARK goes through its ranges: marks, and what Java does not know yet.
_MAYBE_MARK = r"[\p{M}\p{Cn}]"


def _expanded(c: Column) -> Column:
    """The canonical decomposition of one character."""
    s = F.ascii(c) - _SYLLABLE
    part = lambda text, n: F.substring(F.lit(text), n + 1, F.lit(1))
    trailing = s % _PER_MIDDLE
    syllable = F.concat(part(_LEADING, F.floor(s / _PER_LEADING).cast("int")), part(_MIDDLE, F.floor(s % _PER_LEADING / _PER_MIDDLE).cast("int")), F.when(trailing > 0, part(_TRAILING, trailing - 1)).otherwise(""))
    other = F.when(F.translate(c, _ALL, _PLACES[0]) != c, F.concat(*[F.translate(c, _ALL, p) for p in _PLACES])).otherwise(c)
    return F.when(s.between(0, 11171), syllable).otherwise(other)


def _changed(text: Column, some: str) -> Column:
    """text with every character of a class decomposed; what lies between goes by unread."""
    pieces = F.regexp_extract_all(text, F.lit(f"{some}+|[^{some[1:]}+"), 0)
    each = lambda piece: F.array_join(F.transform(F.split(piece, ""), _expanded), "")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{some}"), each(p)).otherwise(p)), "")


def _ordered(text: Column) -> Column:
    """Runs of marks in canonical order, which is by class and else as they stand."""
    marks, classes = "".join(_ORDERS), "".join(chr(0x100 + n) for n in _ORDERS.values())
    # a character's class is a letter from U+0101 on, which sorts as the class does; others keep their place
    of = lambda c: F.translate(c, marks, classes)
    run = lambda r: F.array_join(F.transform(F.array_sort(F.transform(F.split(r, ""), lambda c, i: F.struct(of(c).alias("k"), i.alias("i"), c.alias("c")))), lambda x: x["c"]), "")
    pieces = F.regexp_extract_all(text, F.lit(f"{_MARK}+|[^\\x{{300}}-\\x{{10ffff}}]+|(?s:.)"), 0)
    in_order = F.array_join(F.transform(pieces, lambda p: F.when((F.length(p) > 1) & p.rlike(f"^{_MARK}+$"), run(p)).otherwise(p)), "")
    return F.when(text.rlike(f"{_MAYBE_MARK}{{2}}") & text.rlike(f"{_MARK}{{2}}"), in_order).otherwise(text)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often use has it."""
    return F.get(F.transform(F.array(value), use), 0)


def nfd(text: Column) -> Column:
    """The canonical decomposition (NFD) of a text, all scripts included."""
    return F.when(text.rlike(r"[^\x00-\xbf]"), once(_changed(text, _DECOMPOSED), _ordered)).otherwise(text)


def bare(text: Column) -> Column:
    """The canonical decomposition without the marks U+0300 to U+036F: letters with accents become plain ones.

    Letters that come down to one are changed at once; only others, such as Hangul, go character by character.
    """
    rest = lambda whole: F.regexp_replace(_ordered(whole), "[\\u0300-\\u036f]", "")
    full = lambda plain: F.when(plain.rlike(r"[^\x00-\x{2ff}]"), once(F.when(plain.rlike(_RARE), _changed(plain, _RARE)).otherwise(plain), rest)).otherwise(plain)
    return F.when(text.rlike(_BEYOND_ASCII), once(F.translate(text, _LETTERS, _BASES), full)).otherwise(text)


def bare_letters(text: Column) -> Column:
    """bare() for what is cut down to a-z and 0-9 anyway: other scripts are left as they are."""
    return F.when(text.rlike(_BEYOND_ASCII), F.translate(text, _LETTERS, _BASES)).otherwise(text)


def trimmed(text: Column) -> Column:
    """text without WHITE at both ends."""
    return F.regexp_replace(text, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def units(text: Column) -> Column:
    """A text's length in UTF-16 units, which scripts count: characters over U+FFFF are two."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10ffff}]", ""))


def longer(text: Column, n: int) -> Column:
    """Whether a text has more than n UTF-16 units; these are counted only where its characters leave that open."""
    return (F.length(text) > n // 2) & (units(text) > n)
